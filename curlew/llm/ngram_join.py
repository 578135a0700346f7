"""Similarity join of documents on their word shingles (Jaccard), by prefixes of tokens and token combinations.

1. *Sieve.* A document that is similar to another shares most of its shingles with it. Half of the hash space is looked at: of the
   shingles there, all but the number that a partner may lack must occur in another document. Most documents end here. Keys travel
   truncated and once per chunk of documents (``exchange``); false meetings only let documents through.
2. *Classes.* Documents with equal shingle sets are one class from here on, however many they are.
3. *Prefixes.* Shingles are ordered by the number of classes that hold them. A class is indexed by the shingles that come first, as many
   as a partner may lack and one more. Shingles of up to ``RARE`` classes count singly; commoner ones only as pairs inside groups of
   the token space, with the prefix extended by one shingle for each group it touches. Groups get more with the length of the text,
   and a class is indexed at the two levels of length where its partners can be.
4. *Verification.* Classes that share keys are laid next to each other in blocks of bounded size and compared exactly, block by block.
   Where a group of candidates is larger than a block, the blocks are laid out anew by what is linked already, and only pairs of blocks
   that share a key and are not wholly one component are compared. Nothing is emitted per pair: a block gives a forest of links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.llm.components import Forest, components
from curlew.llm.exchange import LONE, NOTES, SENT, SENT_ARROW, parts_for, send, shared_places, to_batches, total_chars
from curlew.llm.registry import query, table
from curlew.llm.words import MIX, Chunk, chunk_ids, chunks, lower_blank_words
from curlew.operators.rowindex import with_running_totals
from curlew.session import store

SHINGLE, PERCENT = 5, 75
KEY_BYTES = 4
CHARS_PER_PART = 16 << 20
RARE = 16
BLOCK_TOKENS = 100_000
SLICE = 4096  # columns of a comparison held at a time, at most,
CELLS = 4_000_000  # and cells of a matrix


def shingle_sets(chunk: Chunk, size: int = SHINGLE) -> list[np.ndarray]:
    """Each document's distinct shingles, ascending; a shorter document's whole sequence is its only one."""
    numbers, _ = chunk.grams(size)
    out = []
    for start, length in zip(chunk.starts, chunk.lengths, strict=False):
        if length >= size:
            own = np.sort(numbers[start : start + length - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif length:
            digest = hashlib.sha256(chunk.numbers[start : start + length].tobytes()).digest()
            own = np.frombuffer(digest, "<u8", 1)
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
    return out


def _lack(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many of its shingles a partner may lack at most."""
    return size - -(-size * percent // 100)


def _sent(docs: DataFrame, parts: int, size: int) -> DataFrame:
    """Shingles of the looked-at half. Notes: per text its key, shingles, shingles looked at, and those that the chunk itself repeats."""

    def run(batches):
        ids = chunk_ids()

        def rows():
            for chunk in chunks(batches, lower_blank_words, ("text_key",)):
                sets = shingle_sets(chunk, size)
                half = [s[: np.searchsorted(s, np.uint64(1 << 63))] << np.uint64(1) for s in sets]
                owner = np.repeat(np.arange(len(half)), [len(s) for s in half])
                keys, first, rank, times = np.unique(np.concatenate(half), return_index=True, return_inverse=True, return_counts=True)
                known = times > 1
                repeated = np.bincount(owner, known[rank], len(half)) if len(owner) else np.zeros(len(half))
                notes = np.stack(
                    [
                        np.array([r["text_key"] for r in chunk.rows], np.int64),
                        np.array([len(s) for s in sets], np.int64),
                        np.array([len(s) for s in half], np.int64),
                        repeated.astype(np.int64),
                    ]
                ).tobytes()
                yield from send(next(ids), keys, owner[first], known, notes, parts, KEY_BYTES)

        yield from to_batches(rows(), SENT_ARROW)

    return docs.mapInArrow(run, SENT)


def _sieved(answers: DataFrame, percent: int) -> DataFrame:
    """(text_key, size, may): each text's shingles and whether it can be similar to another document."""

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        keys, sizes, half, shared = np.frombuffer(frame.data[frame.kind == NOTES].iloc[0], "<i8").reshape(4, -1)
        for places in frame.data[frame.kind == LONE]:
            shared = shared + np.bincount(np.frombuffer(places, "<u4"), minlength=len(keys))
        may = (sizes > 0) & (half - shared <= _lack(sizes, percent))
        return pd.DataFrame({"text_key": keys, "size": sizes, "may": may})

    return answers.groupBy("chunk").applyInPandas(gather, "text_key bigint, size bigint, may boolean")


def _class_rows(docs: DataFrame, size: int) -> DataFrame:
    """(text_key, class, size, tokens): each text's set by name; a task gives the tokens of a set once."""
    schema = pa.schema([("text_key", pa.int64()), ("class", pa.int64()), ("size", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        for chunk in chunks(batches, lower_blank_words, ("text_key",)):
            seen, rows = set(), []
            for row, own in zip(chunk.rows, shingle_sets(chunk, size), strict=True):
                data = own.tobytes()
                name = int.from_bytes(hashlib.sha256(data).digest()[:8], "little", signed=True)
                rows.append({"text_key": row["text_key"], "class": name, "size": len(own), "tokens": None if name in seen else data})
                seen.add(name)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.mapInArrow(run, "text_key bigint, class bigint, size bigint, tokens binary")


def _token_rows(classes: DataFrame) -> DataFrame:
    """(class, token) for each shingle of each class."""

    def run(batches):
        for batch in batches:
            for name, tokens in zip(batch.column("class").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                values = np.frombuffer(tokens, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), name, np.int64)), pa.array(values)], names=["class", "token"])

    return classes.select("class", "tokens").mapInArrow(run, "class bigint, token bigint")


def _levels(size: int, percent: int) -> set[int]:
    """Levels of length: texts whose sizes allow similarity have one in common."""
    place = math.log(size) / math.log(100 / percent)
    return {math.floor(place + e) + i for e in (-1e-9, 1e-9) for i in (0, 1)}


def _groups(level: int, percent: int) -> int:
    """Token groups of a level: about four frequent shingles of a prefix fall into each."""
    return max(1, int((100 / percent) ** (level - 1) * (1 - percent / 100) / 3))


def prefix_keys(size: int, counts: np.ndarray, tokens: np.ndarray, percent: int, rare: int = RARE) -> np.ndarray:
    """Keys of a class of ``size`` shingles of which ``tokens`` occur in ``counts`` classes, two or more.

    Two similar classes have a key in common: suppose not, and let the prefix of one end no later than the other's. Of the prefix they
    share no shingle that counts singly and at most one of each group, so more shingles of it are missing from the partner than may."""
    need = int(_lack(size, percent)) + 1 - (size - len(tokens))
    if need <= 0:
        return np.zeros(0, np.int64)
    order = np.lexsort((tokens, counts))
    counts, tokens = counts[order], tokens[order]
    singles = tokens[counts <= rare]
    if len(singles) >= need:
        return singles[:need].view(np.int64)
    if size == 1:  # only an equal set is similar
        return singles.view(np.int64)
    keys, common = [singles], tokens[len(singles) :]
    need -= len(singles)
    for level in _levels(size, percent):
        groups = _groups(level, percent)
        group = ((common * MIX) >> np.uint64(33)) % np.uint64(groups)
        by_group = np.argsort(group, kind="stable")
        nth = np.empty(len(common), np.int64)  # place of a token among those of its group
        bounds = np.flatnonzero(np.diff(group[by_group].astype(np.int64), prepend=-1))
        nth[by_group] = np.arange(len(common)) - np.repeat(bounds, np.diff(np.append(bounds, len(common))))
        reached = np.flatnonzero(np.cumsum(nth > 0) >= need)
        last = reached[0] + 1 if len(reached) else len(common)
        for g in np.unique(group[:last]):
            own = common[:last][group[:last] == g]
            a, b = np.triu_indices(len(own), 1)
            keys.append(((own[a] ^ own[b]) * MIX + own[a] * own[b] + np.uint64(level)) * MIX)
    return np.unique(np.concatenate(keys)).view(np.int64)


def _key_rows(listed: DataFrame, percent: int) -> DataFrame:
    """(key, class) from rows (class, size, shared: array of (n, token))."""

    def run(batches):
        for batch in batches:
            column = batch.column("shared")
            ends = column.offsets.to_numpy()
            counts, tokens = (column.values.field(i).to_numpy() for i in (0, 1))
            for i, (name, size) in enumerate(zip(batch.column("class").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                at = slice(ends[i], ends[i + 1])
                keys = prefix_keys(size, counts[at], tokens[at].view(np.uint64), percent)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), name, np.int64))], names=["key", "class"])

    return listed.mapInArrow(run, "key bigint, class bigint")


def _patterns(frame: pd.DataFrame, known: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """(columns of ``known``, size, members) of each pattern: classes of one size that hold the same of the known tokens are alike to all
    others, so they are compared as one."""
    groups: dict[tuple[int, bytes], list[int]] = {}
    for i, (tokens, size) in enumerate(zip(frame.tokens, frame["size"].tolist(), strict=True)):
        values = np.frombuffer(tokens, "<u8")
        at = np.searchsorted(known, values)
        at[at == len(known)] = 0
        held = at[known[at] == values] if len(known) else at[:0]
        groups.setdefault((size, np.sort(held).astype(np.int64).tobytes()), []).append(i)
    columns = [np.frombuffer(key, np.int64) for _, key in groups]
    return columns, np.array([size for size, _ in groups], np.int64), [np.array(m) for m in groups.values()]


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int) -> np.ndarray:
    """Sizes of the intersections of all sets of column numbers below ``width``, by products of incidence matrices, some columns at a
    time."""
    out = np.zeros((len(left), len(right)), np.float32)
    cells = []
    for sets in (left, right):
        cells.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)))
    step = max(64, min(SLICE, CELLS // max(len(left), len(right), 1)))
    for start in range(0, width, step):
        parts = []
        for (row, column), sets in zip(cells, (left, right), strict=True):
            at = (column >= start) & (column < start + step)
            part = np.zeros((len(sets), min(step, width - start)), np.float32)
            part[row[at], column[at] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _forest(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between the classes of two blocks (or of one with itself), as many as connect what is similar.

    Only tokens that can be common to two classes count, and rows of the comparison are made some at a time, so memory follows the
    tokens and not the square of the classes."""
    values = [np.frombuffer(b"".join(f.tokens), "<u8") for f in (left, right)]
    if left is right:
        known, times = np.unique(values[0], return_counts=True)
        known = known[times > 1]
    else:
        known = np.intersect1d(*values)
    names = [f["class"].to_numpy() for f in (left, right)]
    (a, a_size, a_members), (b, b_size, b_members) = (_patterns(f, known) for f in (left, right))
    forest, links = Forest(), []

    def join(x: int, y: int) -> None:
        if x != y and forest.join(x, y):
            links.append((min(x, y), max(x, y)))

    step = max(1, CELLS // max(len(b), 1))
    for start in range(0, len(a), step):
        common = overlaps(a[start : start + step], b, len(known)).astype(np.int64)
        union = a_size[start : start + step, None] + b_size[None, :] - common
        for i, j in np.argwhere((100 * common >= percent * union) & (common > 0)):
            xs, ys = names[0][a_members[start + i]], names[1][b_members[j]]
            for x in xs:
                join(int(x), int(ys[0]))
            for y in ys:
                join(int(xs[0]), int(y))
    return links


def _links(found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"a": [x[0] for x in found], "b": [x[1] for x in found]}, dtype="int64")


def _within(rows: DataFrame, percent: int) -> DataFrame:
    """Links inside each (block, candidates) group of rows (block, candidates, class, size, tokens)."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in frame.groupby("candidates"):
            if len(own) > 1:
                found += _forest(own, own, percent)
        return _links(found)

    return rows.groupBy("block").applyInPandas(compare, "a bigint, b bigint")


def _between(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links between the blocks of each pair (i, j)."""
    whole = rows.groupBy("block").agg(F.collect_list(F.struct("class", "size", "tokens")).alias("members"))
    left, right = whole.select(F.col("block").alias("i"), F.col("members").alias("left")), whole.select(F.col("block").alias("j"), F.col("members").alias("right"))

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                found = _forest(*(pd.DataFrame(batch.column(side)[k].as_py()) for side in ("left", "right")), percent)
                yield pa.RecordBatch.from_pandas(_links(found), preserve_index=False)

    joined = pairs.join(left, "i").join(right, "j").select("left", "right")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _block_pairs(keys: DataFrame, laid: DataFrame) -> DataFrame:
    """Pairs (i, j), i <= j, of blocks that share a key, but for blocks that lie wholly in one component."""
    place = laid.select("class", "block")
    whole = laid.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    whole = whole.select("block", F.when(F.col("low") == F.col("high"), F.col("low")).alias("only"))
    held = keys.join(place, "class").select("key", "block").distinct().join(whole, "block")
    lists = held.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "only"))).alias("at"))
    lists = lists.select("at").distinct()
    pairs = lists.select("at", F.posexplode("at").alias("n", "x")).select("x", F.explode(F.expr("slice(at, n + 1, size(at))")).alias("y"))
    differ = F.col("x.only").isNull() | F.col("y.only").isNull() | (F.col("x.only") != F.col("y.only"))
    return pairs.filter(differ).select(F.col("x.block").alias("i"), F.col("y.block").alias("j")).distinct()


def _laid_out(rows: DataFrame, order: list[str], block_tokens: int) -> DataFrame:
    """Rows with the number of their block: ordered, then cut by the running total of tokens."""
    placed = with_running_totals(rows, [F.col(c) for c in order], {"before": "size"}, totals=False)
    return placed.withColumn("block", F.floor(F.col("before") / block_tokens)).drop("before")


def _class_links(classes: DataFrame, percent: int, block_tokens: int) -> DataFrame:
    """Links (a, b) that connect all similar classes; ``classes`` has class, size and tokens."""
    shared = _token_rows(classes)
    common = shared.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    listed = shared.join(common, "token").groupBy("class").agg(F.collect_list(F.struct("n", "token")).alias("shared"))
    keys = store(_key_rows(classes.select("class", "size").join(listed, "class"), percent), "join-keys")
    stars = keys.groupBy("key").agg(F.min("class").alias("root"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keys.join(stars.select("key", "root"), "key")
    met = store(met, "join-met")
    candidates = components(met.select(F.col("root").alias("a"), F.col("class").alias("b")).distinct())
    near = met.groupBy("class").agg(F.min(F.xxhash64("key")).alias("m1"), F.min(F.xxhash64("key", F.lit(2))).alias("m2"))
    rows = classes.join(candidates.select(F.col("node").alias("class"), F.col("component").alias("candidates")), "class").join(near, "class")
    rows = store(_laid_out(rows, ["candidates", "m1", "m2", "class"], block_tokens), "join-blocks")
    links = store(_within(rows.select("block", "candidates", "class", "size", "tokens"), percent), "join-links")

    wide = rows.groupBy("candidates").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high")
    wide = store(wide.select("candidates"), "join-wide")
    if wide.isEmpty():
        return links
    linked = components(links).select(F.col("node").alias("class"), "component")
    rest = rows.drop("block").join(wide, "candidates", "left_semi").join(linked, "class", "left")
    rest = rest.withColumn("component", F.coalesce("component", "class"))
    laid = store(_laid_out(rest, ["candidates", "component", "m1", "m2", "class"], block_tokens), "join-blocks")
    pairs = store(_block_pairs(met.select("key", "class"), laid.select("class", "block", "component")), "join-pairs")
    more = _between(pairs, laid.select("block", "class", "size", "tokens"), percent)
    return store(links.union(more), "join-links")


def similar_documents(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """For each document: ``row`` (the input row), n_shingles, component_id and part (a number of its group, null for one without links).

    ``docs`` has doc_id and text. A-Z is lower-cased; words stand between ASCII white space; a document's set holds its distinct runs of
    ``size`` words, or its whole sequence when it is shorter. Two documents are linked when the intersection of their sets is at least
    ``percent`` of the union; component_id is the smallest doc_id that links reach. Documents without words or text have no shingles
    and no links. Repeated rows are documents of their own with one id; a null id is never the smallest unless it is alone. An empty
    table gives no rows."""
    if percent <= 50:
        raise ValueError("prefixes are made for more than half in common")
    spark = docs.sparkSession
    parts = parts_for(spark, total_chars(docs), CHARS_PER_PART)
    keyed = docs.select(F.struct("*").alias("row")).withColumn("text_key", F.xxhash64("row.text"))
    plain = keyed.select("text_key", F.col("row.text").alias("text"))
    sieved = _sieved(shared_places(_sent(plain, parts, size), KEY_BYTES), percent)
    sieved = store(sieved.groupBy("text_key").agg(F.max("size").alias("size"), F.max("may").alias("may")), "join-sieved")
    through = store(sieved.filter("may").select("text_key"), "join-through")
    # a share of all texts comes through, so the join is a shuffle at any size
    named = store(_class_rows(plain.join(through.hint("merge"), "text_key", "left_semi"), size), "join-classes")
    classes = named.groupBy("class").agg(F.max("size").alias("size"), F.max("tokens").alias("tokens"))
    classes = store(classes, "join-sets")
    joined = components(_class_links(classes, percent, block_tokens))

    texts = named.select("text_key", "class").distinct().join(joined.withColumnRenamed("node", "class"), "class", "left")
    texts = texts.select("text_key", F.coalesce("component", "class").alias("part"))
    least = keyed.groupBy("text_key").agg(F.min("row.doc_id").alias("least")).join(texts, "text_key")
    first = least.groupBy("part").agg(F.min("least").alias("first_id"))
    labels = sieved.select("text_key", "size").join(texts.join(first, "part").select("text_key", "part", "first_id"), "text_key", "left")
    return keyed.join(store(labels, "join-labels"), "text_key", "left").select(
        "row", F.col("size").alias("n_shingles"), F.coalesce("first_id", "row.doc_id").alias("component_id"), "part"
    )


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT shingle FROM s GROUP BY 1 HAVING count(*) > 1),
t AS (SELECT s.* FROM s JOIN shared USING (shingle)),
links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM t x JOIN t y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""


@query("op2_ngram_join", SQL)
def op2_ngram_join(spark, sf):
    found = similar_documents(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_shingles", "component_id")
