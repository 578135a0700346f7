"""All registered queries of this subpackage."""

import curlew.llm.chat
import curlew.llm.codes
import curlew.llm.decontaminate
import curlew.llm.html_text
import curlew.llm.lattice
import curlew.llm.mixing
import curlew.llm.neighbours
import curlew.llm.ngram_join
import curlew.llm.personal
import curlew.llm.quality
import curlew.llm.recompress
import curlew.llm.secrets
import curlew.llm.whitening  # noqa: F401
from curlew.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
