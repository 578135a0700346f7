"""Short codes for vectors: integer product quantisation, nearest entries found through a GNAT.

A vector becomes integers, cut into parts; each part is coded by the nearest of its codebook's entries. Spark assigns all parts in each
round and sums them by entry (combined in each task first); only the codebooks, whose size is a parameter, pass through the driver.

Entries are searched by a geometric near-neighbour access tree: a node has split points far from each other, gives each other entry to
the nearest one, and stores for each pair (split point, child) the range of distances from the point to the child's entries. A query
is compared with the split points; by the triangle inequality a child cannot hold an entry nearer than the gap between the query's
distance and the range. A child is left out only if that gap is strictly larger than the best distance so far, with the gap rounded down
and the best distance rounded up, so that ties survive; what is compared in the end are whole numbers, ties to the lower index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.llm.registry import query, table
from curlew.llm.vectors import extent, matrix, usable
from curlew.session import store

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
DEGREE, LEAF = 16, 12  # split points of a node; entries that are compared one by one
SLACK = 2.0**-48  # more than the rounding of a square root and a difference
LARGEST = 2.0**17  # components beyond it have squared distances that 64 bits cannot hold
HOT_SHARE = 1024  # a label with more than this part of the rows is hot; there are fewer than this many


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two whole-number matrices, exact."""
    largest = int(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if 4 * largest * largest * a.shape[1] < 2**53:  # all sums are whole numbers that a double holds
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2.0 * (x @ y.T)).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return out


class Tree:
    """Nearest of some whole-number points (rows of a matrix), ties to the lower row."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.compared = 0
        self.root = self._node(np.arange(len(points)))

    def _node(self, ids: np.ndarray) -> tuple:
        if len(ids) <= LEAF:
            return (ids,)
        # split points: each the farthest from those before
        splits, gap = [0], squared(self.points[ids], self.points[ids[:1]])[:, 0]
        while len(splits) < DEGREE and gap.max() > 0:
            splits.append(int(gap.argmax()))
            gap = np.minimum(gap, squared(self.points[ids], self.points[ids[splits[-1:]]])[:, 0])
        if len(splits) == 1:
            return (ids[:1],)  # all are equal, so the lowest one stands for them
        splits = np.sort(splits)
        others = np.delete(ids, splits)
        far = squared(self.points[others], self.points[ids[splits]])
        home, far = far.argmin(1), np.sqrt(far.astype(np.float64))
        low, high = np.zeros((len(splits), len(splits))), np.zeros((len(splits), len(splits)))
        children = []
        for j in range(len(splits)):
            mine = home == j
            children.append(self._node(others[mine]) if mine.any() else None)
            if mine.any():
                low[:, j], high[:, j] = far[mine].min(0) * (1 - SLACK), far[mine].max(0) * (1 + SLACK)
        return ids[splits], low, high, children

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, squared distance) for each query."""
        self.queries = queries
        self.best, self.row = np.full(len(queries), np.iinfo(np.int64).max), np.zeros(len(queries), np.int64)
        if len(queries):
            self._visit(self.root, np.arange(len(queries)))
        return self.row, self.best

    def _compare(self, asked: np.ndarray, ids: np.ndarray) -> np.ndarray:
        far = squared(self.queries[asked], self.points[ids])
        self.compared += far.size
        at = far.argmin(1)  # ids ascend, so this is the lowest of equals
        least, row = far[np.arange(len(asked)), at], ids[at]
        better = (least < self.best[asked]) | ((least == self.best[asked]) & (row < self.row[asked]))
        self.best[asked[better]], self.row[asked[better]] = least[better], row[better]
        return far

    def _visit(self, node: tuple, asked: np.ndarray) -> None:
        far = self._compare(asked, node[0])
        if len(node) == 1:
            return
        _, low, high, children = node
        home, far = far.argmin(1), np.sqrt(far.astype(np.float64))
        gap = np.full((len(asked), len(children)), -np.inf)
        for i in range(len(children)):
            gap = np.maximum(gap, np.maximum((far[:, i] * (1 - SLACK))[:, None] - high[i], low[i] - (far[:, i] * (1 + SLACK))[:, None]))
        gap -= np.abs(gap) * SLACK
        for first in (True, False):  # the nearest split point's child makes the radius small
            for j, child in enumerate(children):
                if child is not None:
                    reach = np.sqrt(self.best[asked].astype(np.float64)) * (1 + SLACK)
                    some = ((home == j) == first) & (gap[:, j] <= reach)
                    if some.any():
                        self._visit(child, asked[some])


def _cuts(length: int, parts: int) -> list[slice]:
    return [slice(length * p // parts, length * (p + 1) // parts) for p in range(parts)]


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(values * scale).astype(np.int64)


def _moved(vectors: DataFrame, books: list[np.ndarray], length: int, scale: int) -> list[np.ndarray]:
    """The codebooks after one round: each entry is the floor of the mean of its parts, or stays if it has none."""
    cuts = _cuts(length, len(books))
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def sums(batches):
        trees = [Tree(book) for book in books]
        counts = [np.zeros(len(book), np.int64) for book in books]
        totals = [np.zeros(book.shape, np.int64) for book in books]
        for batch in batches:
            whole = _whole(matrix(batch, length)[1], scale)
            for p, cut in enumerate(cuts):
                row, _ = trees[p].nearest(whole[:, cut])
                counts[p] += np.bincount(row, minlength=len(books[p]))
                for i in range(totals[p].shape[1]):  # exact: a batch's sums stay far below 2^53
                    totals[p][:, i] += np.bincount(row, whole[:, cut.start + i], len(books[p])).astype(np.int64)
        for p in range(len(books)):
            used = np.flatnonzero(counts[p])
            columns = [np.full(len(used), p), used, counts[p][used], totals[p][used].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = vectors.select("embedding").mapInArrow(sums, "part int, entry int, n bigint, sums array<bigint>")
    cells = rows.select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
    moved = [book.copy() for book in books]
    # as many rows as the codebooks have components
    for r in cells.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect():
        moved[r.part][r.entry, r.place] = r.value // r.n
    return moved


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[list[np.ndarray], int]:
    """(whole-number codebook per part, length of the vectors coded). No vectors give codebooks without entries.

    Entries start as the parts of the rows with the smallest ids (null ids last; of equal ids the smaller vectors first)."""
    length, largest = extent(vectors)
    if largest > LARGEST:
        raise ValueError(f"components beyond {LARGEST:.0f} are not supported: their squared distances do not fit 64 bits")
    kept = vectors.filter(usable("embedding") & (F.size("embedding") == length))
    first = kept.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    whole = _whole(np.array([r.embedding for r in first], np.float64).reshape(len(first), length), scale)
    books = [np.ascontiguousarray(whole[:, cut]) for cut in _cuts(length, parts)]
    for _ in range(rounds if first else 0):
        books = _moved(vectors, books, length, scale)
    return books, length


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Append the error summed over rows of the same label. Hot labels are few, whatever the data, and meet their rows by broadcast;
    the others by a shuffle in which no key has more than a thousandth of the rows."""
    sums = store(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    rows = sums.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE > rows
    few = F.broadcast(sums.filter(is_hot).select(F.col("label").alias("of"), "label_error"))
    met = coded.join(few, coded.label.eqNullSafe(few.of), "left").drop("of")
    other = sums.filter(~is_hot).select(F.col("label").alias("of"), "label_error")
    rest = met.filter("label_error IS NULL").drop("label_error")
    rest = rest.join(other, rest.label.eqNullSafe(other.of)).drop("of")
    return met.filter("label_error IS NOT NULL").unionByName(rest)


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (an index of two hex digits per part), error, label_error, codebooks_sha256 for each coded row.

    ``vectors`` has vec_id, embedding (an array of numbers) and label; other columns are left out. Rows whose vector is null or empty,
    holds null or non-finite components, or has another length than most are dropped. Null ids and labels are kept, null labels summed
    together; repeated rows all count and all return. Vectors whose length is no multiple of ``parts`` are cut as evenly as can be.
    Components beyond 131072 are an error, as their squared distances do not fit a long. No vectors give no rows."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part, so 1 to 256 entries")
    kind = vectors.schema["label"].dataType
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    books, length = codebooks(vectors, parts, entries, rounds, scale)
    cuts = _cuts(length, parts)

    def code(batches):
        trees = [Tree(book) for book in books]
        digits = np.array([f"{i:02x}" for i in range(256)], object)
        for batch in batches:
            places, values = matrix(batch, length)
            if not length or not len(places):
                continue
            found = [tree.nearest(_whole(values, scale)[:, cut]) for tree, cut in zip(trees, cuts, strict=True)]
            codes = sum((digits[row] for row, _ in found[1:]), digits[found[0][0]])
            errors = sum(far for _, far in found)
            kept = [batch.column(name).take(pa.array(places)) for name in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = store(vectors.mapInArrow(code, f"vec_id bigint, label {kind.simpleString()}, code string, error bigint"), "codes")
    return _with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(books)))


def _sql() -> str:
    """The codebooks and codes by comparing each part with all entries."""
    near = """assigned{r} AS MATERIALIZED (
        SELECT v.vec_id, v.label, v.part, v.xs,
            arg_min(e.entry, struct_pack(d := list_sum(list_transform(list_zip(v.xs, e.xs), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, i := e.entry)) AS entry,
            min(list_sum(list_transform(list_zip(v.xs, e.xs), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) AS d
        FROM parts v JOIN book{r} e USING (part) GROUP BY ALL)"""
    move = """book{n} AS MATERIALIZED (
        SELECT b.part, b.entry, coalesce(m.xs, b.xs) AS xs
        FROM book{r} b LEFT JOIN (
            SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY place) AS xs
            FROM (SELECT part, entry, place, sum(xs[place])::BIGINT AS s, count(*) AS c
                  FROM assigned{r}, unnest(range(1, len(xs) + 1)) AS u(place) GROUP BY part, entry, place)
            GROUP BY part, entry) m USING (part, entry))"""
    steps = [near.format(r=0)]
    for r in range(ROUNDS):
        steps += [move.format(r=r, n=r + 1), near.format(r=r + 1)]
    return f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS xs
        FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (
        SELECT vec_id, label, part, xs[1 + part * len(xs) // {PARTS} : (part + 1) * len(xs) // {PARTS}] AS xs FROM kept, range({PARTS}) AS p(part)),
    book0 AS MATERIALIZED (
        SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, xs FROM parts
        QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES}),
    {", ".join(steps)},
    coded AS (
        SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
        FROM assigned{ROUNDS} GROUP BY vec_id, label)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
        (SELECT sha256(string_agg(array_to_string(xs, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
    FROM coded"""


@query("op11_codes", _sql())
def op11_codes(spark, sf):
    return encode(table(spark, sf, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
