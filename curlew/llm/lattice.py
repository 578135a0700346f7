"""Likelihood of texts under a subword lattice.

The pieces and the order of their scores come from an existing vocabulary file; a piece's prior weight follows its rank. The training
documents' words re-weight the pieces (expected counts over all segmentations, ``PASSES`` times), single characters cover what no piece spells, and
the probability of a word is the sum over all its segmentations, by a forward recursion in log space. A text's probability is the
product over its words and one end.

Words repeat, so everything is computed per distinct word. Map tasks turn chunks of documents into a word list and, per document, the
places and counts of its words. Only the word lists are shuffled, once per chunk however many documents hold a word; the totals
of all training documents and the lattice scores come back to the chunks, where each document is summed up.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.llm.registry import query, table
from curlew.llm.words import MIX, chunk_ids, lower_blank_words, texts
from curlew.session import store

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_WORDS = 3_000_000
FOLDS, HELD_OUT = 7, 2
LONGEST_PIECE = 16
CHARACTER_SHARE = 1e-4  # of the probability, left to single characters whether the vocabulary has them or not
CHARACTERS = 0x110000
PASSES = 2  # of re-weighting
PRIOR_PIECES = 1000.0  # pieces' worth of weight that the vocabulary's own scores keep against the expected counts
MARK = "▁"


def vocabulary_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces of a vocabulary file with the natural logarithm of their prior weights.

    The scores of the file order the pieces; weights fall with the rank (Zipf) and add up to one. Pieces that span words, control
    pieces and byte pieces are left out, and A-Z is lower-cased."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[str, float] = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).translate(lower)
        if piece and MARK not in piece[1:] and len(piece) <= LONGEST_PIECE:
            scores[piece] = max(scores.get(piece, -math.inf), model.get_score(i))
    ranked = sorted(scores, key=lambda p: (-scores[p], p))
    weights = {p: 1.0 / (rank + 10.0) for rank, p in enumerate(ranked)}
    total = sum(weights.values())
    return {p: math.log(w / total) for p, w in weights.items()}


class Lattice:
    """All segmentations of words into pieces; single characters are always pieces.

    Words of one length are worked on together. Longer words than ``TOGETHER`` go alone."""

    TOGETHER = 64

    def __init__(self, scores: dict[str, float]):
        self.pieces = list(scores)
        self.scores = scores
        self.place = {p: i for i, p in enumerate(self.pieces)}
        numbers = np.array([self._number(p) for p in self.pieces], np.uint64)
        order = np.argsort(numbers)
        self.numbers, self.order = numbers[order], order
        self.values = np.append(np.array([scores[p] for p in self.pieces]) + math.log1p(-CHARACTER_SHARE), -np.inf)
        self.may = np.zeros(1 << 20, bool)
        self.may[numbers >> np.uint64(44)] = True
        self.character = math.log(CHARACTER_SHARE / CHARACTERS)

    @staticmethod
    def _step(number, code):
        number = (number ^ code) * MIX
        return number ^ (number >> np.uint64(29))

    def _number(self, piece: str) -> np.uint64:
        codes = np.array([[ord(c)] for c in piece], np.uint64)
        number = np.zeros(1, np.uint64)
        for code in codes:
            number = self._step(number, code)
        return number[0]

    def _edges(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece at each (start, end) of each word, or -1, where any word has one. ``codes``: a row per position."""
        edges = {}
        for start in range(len(codes)):
            number = np.zeros(codes.shape[1], np.uint64)
            for end in range(start + 1, min(len(codes), start + LONGEST_PIECE) + 1):
                number = self._step(number, codes[end - 1])
                at = np.flatnonzero(self.may[number >> np.uint64(44)])
                if len(at):
                    place = np.searchsorted(self.numbers, number[at])
                    place[place == len(self.numbers)] = 0
                    true = self.numbers[place] == number[at]
                    if true.any():
                        found = np.full(codes.shape[1], -1, np.int32)
                        found[at[true]] = self.order[place[true]]
                        edges[start, end] = found
        return edges

    def _sum(self, terms: list[np.ndarray]) -> np.ndarray:
        if len(terms) == 1:
            return terms[0]
        stack = np.stack(terms)
        top = stack.max(axis=0)
        return top + np.log(np.exp(stack - top).sum(axis=0))

    def _forward(self, length: int, edges: dict) -> np.ndarray:
        alpha = [None] * (length + 1)
        alpha[0] = 0.0
        for end in range(1, length + 1):
            terms = [alpha[end - 1] + self.character]
            for start in range(max(0, end - LONGEST_PIECE), end):
                found = edges.get((start, end))
                if found is not None:
                    terms.append(alpha[start] + self.values[found])
            alpha[end] = self._sum([np.broadcast_to(t, np.broadcast_shapes(*[np.shape(x) for x in terms])) for t in terms])
        return alpha

    def _groups(self, words: list[str], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``words``, code points with a row per position) of words of one length."""
        lengths = np.array([len(w) + 1 for w in words])
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if lengths[order[low]] <= self.TOGETHER:
                for at in range(low, high, most):
                    places = order[at : min(high, at + most)]
                    data = "".join(MARK + words[i] for i in places).encode("utf-32-le", "surrogatepass")
                    yield places, np.ascontiguousarray(np.frombuffer(data, "<u4").reshape(len(places), -1).T).astype(np.uint64)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability, summed over its segmentations."""
        out = np.zeros(len(words))
        for places, codes in self._groups(words):
            out[places] = self._forward(len(codes), self._edges(codes))[-1]
        for i, word in enumerate(words):
            if len(word) >= self.TOGETHER:
                out[i] = self.long_word(word)
        return out

    def _long_forward(self, text: str) -> array:
        rest = math.log1p(-CHARACTER_SHARE)
        alpha = array("d", [0.0])
        for end in range(1, len(text) + 1):
            terms = [alpha[end - 1] + self.character]
            for start in range(max(0, end - LONGEST_PIECE), end):
                score = self.scores.get(text[start:end])
                if score is not None:
                    terms.append(alpha[start] + score + rest)
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return alpha

    def long_word(self, word: str) -> float:
        """The same for one word of any length."""
        return self._long_forward(MARK + word)[-1]

    def _add_long(self, word: str, times: float, counts: np.ndarray) -> None:
        """Add the expected pieces of one word of any length to ``counts``; only the nearest values behind a place are kept."""
        text, rest = MARK + word, math.log1p(-CHARACTER_SHARE)
        alpha = self._long_forward(text)
        beta = deque([0.0], LONGEST_PIECE)  # of the places behind ``start``, the nearest first
        for start in range(len(text) - 1, -1, -1):
            terms = [beta[0] + self.character]
            for size, behind in enumerate(beta, 1):
                piece = text[start : start + size]
                score = self.scores.get(piece)
                if score is not None:
                    terms.append(score + rest + behind)
                    counts[self.place[piece]] += times * math.exp(alpha[start] + terms[-1] - alpha[-1])
            top = max(terms)
            beta.appendleft(top + math.log(sum(math.exp(t - top) for t in terms)))

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected number of each piece in all words, each taken ``times``."""
        counts = np.zeros(len(self.pieces))
        for places, codes in self._groups(words):
            length, edges = len(codes), self._edges(codes)
            alpha = self._forward(length, edges)
            beta = [None] * length + [np.zeros(codes.shape[1])]
            for start in range(length - 1, -1, -1):
                terms = [beta[start + 1] + self.character]
                for end in range(start + 1, min(length, start + LONGEST_PIECE) + 1):
                    found = edges.get((start, end))
                    if found is not None:
                        terms.append(beta[end] + self.values[found])
                beta[start] = self._sum(terms)
            for (start, end), found in edges.items():
                share = np.exp(alpha[start] + self.values[found] + beta[end] - alpha[-1]) * times[places]
                true = found >= 0
                counts += np.bincount(found[true], share[true], len(counts))
        for word, n in zip(words, times, strict=True):
            if len(word) >= self.TOGETHER:
                self._add_long(word, float(n), counts)
        return counts


class _Chunk:
    """Some documents: their words with training counts, and per document the places and counts of its words."""

    def __init__(self, number: int):
        self.number, self.words, self.size = number, {}, 0
        self.keys, self.held, self.lengths, self.cells = [], [], [], []

    def add(self, key: int | None, held: bool, words: list[bytes]) -> None:
        places = self.words
        at = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words))
        self.cells.append(np.unique(at, return_counts=True))
        self.keys.append(key)
        self.held.append(held)
        self.lengths.append(len(words))
        self.size += len(words)

    def batch(self) -> pa.RecordBatch:
        counts = np.zeros(len(self.words), np.int64)
        for (own, times), out in zip(self.cells, self.held, strict=True):
            if not out:
                counts[own] += times
        row = {
            "chunk": self.number,
            "doc": self.keys,
            "held_out": self.held,
            "n_words": self.lengths,
            "n_own": [len(own) for own, _ in self.cells],
            "word": list(self.words),
            "train": counts,
            "own": np.concatenate([own for own, _ in self.cells]).astype("<u4").tobytes(),
            "times": np.concatenate([times for _, times in self.cells]).astype("<u4").tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], _CHUNKS_ARROW)


CHUNKS = (
    "chunk bigint, doc array<bigint>, held_out array<boolean>, n_words array<bigint>, n_own array<bigint>, word array<binary>, "
    "train array<bigint>, own binary, times binary"
)
_CHUNKS_ARROW = pa.schema(
    [
        ("chunk", pa.int64()),
        ("doc", pa.list_(pa.int64())),
        ("held_out", pa.list_(pa.bool_())),
        ("n_words", pa.list_(pa.int64())),
        ("n_own", pa.list_(pa.int64())),
        ("word", pa.list_(pa.binary())),
        ("train", pa.list_(pa.int64())),
        ("own", pa.binary()),
        ("times", pa.binary()),
    ]
)


def is_held_out(doc_id: str | None, folds: int = FOLDS, held_out: int = HELD_OUT) -> bool:
    """Whether a document is kept from training, by the CRC-32 of its id as text; a null id counts as empty text."""
    return zlib.crc32((doc_id or "").encode()) % folds == held_out


def _chunked(docs: DataFrame, chunk_words: int, folds: int, held_out: int) -> DataFrame:
    def run(batches):
        ids = chunk_ids()
        chunk = _Chunk(next(ids))
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                words = lower_blank_words(text)
                if chunk.keys and chunk.size + len(words) > chunk_words:
                    yield chunk.batch()
                    chunk = _Chunk(next(ids))
                chunk.add(doc, is_held_out(None if doc is None else str(doc), folds, held_out), words)
        if chunk.keys:
            yield chunk.batch()

    return docs.mapInArrow(run, CHUNKS)


def _word_lists(batches: Iterator[pa.RecordBatch], size: int = 200_000) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words with their training counts, many at a time."""
    words: list[str] = []
    counts: list[int] = []
    for batch in batches:
        words += [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
        counts += batch.column("train").to_pylist()
        if len(words) >= size:
            yield words, np.array(counts, np.int64)
            words, counts = [], []
    if words:
        yield words, np.array(counts, np.int64)


def _sum_pieces(words: DataFrame, scores: dict[str, float]) -> dict[str, float]:
    """Expected piece counts over all training words: at most one row per piece of the vocabulary reaches the driver."""
    prior = words.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        lattice = Lattice(prior.value)
        counts = np.zeros(len(lattice.pieces))
        for words, times in _word_lists(batches):
            counts += lattice.expected(words, times.astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(lattice.pieces, pa.string()), pa.array(counts, pa.float64())], names=["piece", "n"])

    rows = words.filter("train > 0").select("word", "train").mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r.piece: r.n for r in rows.collect()}


def lattice_scores(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each document (doc_id a whole number, text).

    Words stand between ASCII white space, A-Z is lower-cased, and an end follows the last word; a null or empty text is its end alone.
    ``base_score`` is the add-one word unigram of the training documents; ``score`` the log10 marginal probability of the text in the
    lattice. Documents whose id has the held-out remainder do not train. Repeated rows are scored, and counted, each for itself; a null
    id takes part in training. An empty table gives no rows."""
    stored = store(_chunked(docs.select("doc_id", "text"), chunk_words, folds, held_out), "lattice-chunks")
    listed = stored.select("chunk", F.posexplode(F.arrays_zip("word", "train")).alias("place", "w")).select("chunk", "place", "w.word", "w.train")
    words = store(listed.groupBy("word").agg(F.sum("train").alias("train")), "lattice-words")
    ends = stored.select(F.sum(F.expr("size(filter(held_out, h -> NOT h))")).alias("ends")).first().ends or 0
    totals = words.select(F.sum("train").alias("n"), F.count(F.when(F.col("train") > 0, 1)).alias("v")).first()
    train_tokens, distinct = (totals.n or 0) + ends, (totals.v or 0) + (ends > 0)
    end_score = math.log10((ends + 1) / (train_tokens + distinct + 1))

    prior = learned = vocabulary_scores(vocabulary)
    for _ in range(PASSES):
        expected = _sum_pieces(words, learned)
        whole = sum(expected.values()) + PRIOR_PIECES
        learned = {p: math.log((expected.get(p, 0.0) + PRIOR_PIECES * math.exp(s)) / whole) for p, s in prior.items()}
    pieces = docs.sparkSession.sparkContext.broadcast(learned)
    log_all = math.log10(train_tokens + distinct + 1)
    # a text ends after a word with the training documents' rate of ends
    stop = (ends + 1) / (train_tokens + 2)
    log_stop, log_go = math.log10(stop), math.log10(1 - stop)

    def judge(batches):
        lattice = Lattice(pieces.value)
        held: list[pa.RecordBatch] = []

        def judged_rows():
            rows = pa.Table.from_batches(held)
            words = [w.decode("utf-8", "replace") for w in rows.column("word").to_pylist()]
            marginal = lattice.log_probabilities(words) / math.log(10) + log_go
            return rows.append_column("marginal", pa.array(marginal)).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= 200_000:
                yield from judged_rows()
                held = []
        if held:
            yield from judged_rows()

    judged = words.repartition(F.col("word")).mapInArrow(judge, "word binary, train bigint, marginal double")
    answers = listed.select("chunk", "place", "word").join(judged, "word").select(F.col("chunk").alias("to"), "place", F.col("train").alias("count"), "marginal")

    def add_up(key, chunk: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        row = chunk.iloc[0]
        counts, marginal = np.zeros(len(answer)), np.zeros(len(answer))
        counts[answer.place], marginal[answer.place] = answer["count"], answer.marginal
        own, times = np.frombuffer(row.own, "<u4"), np.frombuffer(row.times, "<u4").astype(np.float64)
        owner = np.repeat(np.arange(len(row.n_own)), row.n_own)
        total = lambda values: np.bincount(owner, times * values, len(row.n_own)) if len(own) else np.zeros(len(row.n_own))
        held = np.array(row.held_out, bool)
        n_words = np.array(row.n_words, np.int64)
        return pd.DataFrame(
            {
                "doc_id": pd.array(row.doc, dtype="Int64"),
                "held_out": held,
                "n_tokens": n_words + 1,
                "n_known": np.rint(total(counts[own] > 0)).astype(np.int64) + (ends > 0),
                "train_tokens": train_tokens,
                "base_score": total(np.log10(counts[own] + 1) - log_all) + end_score,
                "score": total(marginal[own]) + log_stop,
            }
        )

    result = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    sums = stored.select("chunk", "doc", "held_out", "n_words", "n_own", "own", "times")
    return sums.groupBy("chunk").cogroup(answers.groupBy("to")).applyInPandas(add_up, result)


@query("op4_lattice")
def op4_lattice(spark, sf):
    return lattice_scores(table(spark, sf, "documents"))
