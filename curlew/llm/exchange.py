"""Find out which keys of many documents are shared, moving each key once and only a few bytes of it.

Map tasks cut the documents into chunks and send, for each chunk and each of ``parts`` ranges of the key space, the chunk's distinct
keys. A key that a third of all documents hold is thus sent once per chunk, not once per document. The task of a range answers each
chunk with the places of its keys that another chunk holds too, and the answers meet the chunk's own notes again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curlew.llm.words import pack, pack_short, unpack, unpack_short

SENT = "chunk bigint, part int, kind int, keys binary, places binary"
SENT_ARROW = pa.schema(
    [("chunk", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("places", pa.binary())]
)
ANSWER = "chunk bigint, kind int, data binary"
LONE, KNOWN, NOTES = 0, 1, 2  # keys of one document of the chunk; of several; the chunk's notes


def parts_for(spark: SparkSession, chars: int, chars_per_part: int) -> int:
    """Ranges of the key space: they grow with the input, so that one fits a task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // chars_per_part))


def send(chunk: int, keys: np.ndarray, places: np.ndarray, known: np.ndarray, notes: bytes, parts: int, width: int) -> Iterator[dict]:
    """Rows for one chunk. ``keys``: distinct and ascending; ``known``: which of them several documents of the chunk hold."""
    part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(np.diff(bounds)):
        at = slice(bounds[p], bounds[p + 1])
        k, w, lone = keys[at], places[at], ~known[at]
        if lone.any():
            yield {"chunk": chunk, "part": int(p), "kind": LONE, "keys": pack(k[lone], width), "places": pack_short(w[lone])}
        if not lone.all():
            yield {"chunk": chunk, "part": int(p), "kind": KNOWN, "keys": pack(k[~lone], width), "places": None}
    yield {"chunk": chunk, "part": chunk % parts, "kind": NOTES, "keys": notes, "places": None}


def to_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def shared_places(sent: DataFrame, width: int) -> DataFrame:
    """Per chunk, the places (32-bit numbers) of its keys that another chunk holds too, and the chunk's notes.

    Keys are compared by their low ``width`` bytes besides their range, and ranges grow in number with the input: now and then two keys
    pass for one, equally seldom at every size, which only adds places."""

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        notes = frame[frame.kind == NOTES]
        out = [pd.DataFrame({"chunk": notes.chunk, "kind": NOTES, "data": notes["keys"]})]
        rows = frame[frame.kind != NOTES]
        if len(rows):
            arrays = [unpack(x, width) for x in rows["keys"]]
            row = np.repeat(np.arange(len(rows)), [len(x) for x in arrays])
            keys = np.concatenate(arrays)
            order = np.argsort(keys, kind="stable")
            again = keys[order][1:] == keys[order][:-1]
            shared = np.zeros(len(keys), bool)
            shared[order[1:][again]] = True
            shared[order[:-1][again]] = True
            bounds = np.searchsorted(row, np.arange(len(rows) + 1))
            for i, (chunk, kind, places) in enumerate(zip(rows.chunk, rows.kind, rows.places, strict=True)):
                hit = shared[bounds[i] : bounds[i + 1]]
                if kind == LONE and hit.any():
                    data = unpack_short(places)[hit].astype("<u4").tobytes()
                    out.append(pd.DataFrame({"chunk": [chunk], "kind": [LONE], "data": [data]}))
        return pd.concat(out, ignore_index=True)

    return sent.groupBy("part").applyInPandas(answer, ANSWER).repartition(F.col("chunk"))


def total_chars(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.length("text"))).first()[0] or 0
