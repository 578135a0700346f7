"""Nearest neighbours by inner product: a navigable small-world graph per shard.

Equal vectors are one entry with its smallest ids; entries are dealt to shards of bounded size by their digest. A task builds its shard's
graph: nested layers, each about a sixteenth of the one below, with neighbour lists as flat arrays. Layers are built from the top;
nodes are inserted in batches that find their neighbours by a beam search from the layer above and among themselves, keep those that are
not better reached through another, and link back under the same rule. Vectors get one more component that makes all equally long, so
that the largest inner product is the nearest neighbour; scores are computed on the original vectors in double precision.

Graphs are stored, and every block of queries meets every shard in an equi-join; a search walks all queries of a block at once. A
query's best of all shards are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curlew.llm.registry import query, table
from curlew.session import store

TOP, SHARD, QUERY_BLOCK = 20, 8192, 1024
LINKS, LAYER_RATIO, BEAM_BUILD, BEAM_SEARCH = 32, 16, 64, 192
BATCH, AT_ONCE = 512, 4


def widened(vectors: np.ndarray) -> np.ndarray:
    """Vectors of equal length with the same inner products against queries that end in 0."""
    squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
    rest = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))
    scale = np.sqrt(squares.max(initial=0.0)) or 1.0
    return (np.column_stack([vectors, rest]) / scale).astype(np.float32)


def beam_search(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, nearness) of each query's best nodes, nearest first, -1 where there are fewer. ``entries``: -1 is no entry."""
    count = len(queries)
    ids = np.full((count, beam), -1, np.int64)
    near = np.full((count, beam), -np.inf, np.float32)
    done = np.ones((count, beam), bool)
    seen = np.zeros((count, len(points) + 1), bool)
    row = np.arange(count)[:, None]
    fresh = entries
    while True:
        # of equal new ids in a row only one counts
        order = np.sort(fresh, axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        fresh = np.where(seen[row, order], -1, order)
        seen[row, fresh] = True
        seen[:, -1] = False
        close = np.einsum("qd,qkd->qk", queries, points[fresh])
        close[fresh < 0] = -np.inf
        ids, near, done = np.hstack([ids, fresh]), np.hstack([near, close]), np.hstack([done, fresh < 0])
        best = np.argpartition(-near, beam - 1, axis=1)[:, :beam]
        ids, near, done = ids[row, best], near[row, best], done[row, best]
        open_near = np.where(done, -np.inf, near)
        width = min(AT_ONCE, beam)
        pick = np.argpartition(-open_near, width - 1, axis=1)[:, :width]
        picked = np.where(np.isfinite(open_near[row, pick]), ids[row, pick], -1)
        if (picked < 0).all():
            break
        done[row, pick] = True
        fresh = np.where(picked[:, :, None] < 0, -1, links[picked]).reshape(count, -1)
    order = np.argsort(-near, axis=1, kind="stable")
    return ids[row, order], near[row, order]


def spread_out(points: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first), up to ``most`` that are nearer to the row's node than to one kept before; places that
    stay free go to the nearest others."""
    count, width = ids.shape
    between = np.matmul(points[ids], points[ids].transpose(0, 2, 1))
    kept = np.zeros((count, width), bool)
    worst = np.full((count, width), -np.inf, np.float32)  # nearness of a candidate to its nearest kept one
    for c in range(width):
        take = (ids[:, c] >= 0) & (near[:, c] > worst[:, c]) & (kept.sum(axis=1) < most)
        kept[:, c] = take
        worst[take] = np.maximum(worst[take], between[take, c])
    rank = np.where(ids < 0, 3 * width, np.where(kept, 0, width) + np.arange(width))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, axis=1)
    if width < most:
        out = np.hstack([out, np.full((count, most - width), -1, np.int64)])
    return out


def _link_back(points: np.ndarray, links: np.ndarray, sources: np.ndarray) -> None:
    """Make the links of ``sources`` mutual; a node with too many keeps the best spread."""
    a = np.repeat(sources, links.shape[1])
    b = links[sources].ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.lexsort((-np.einsum("ij,ij->i", points[a], points[b]), b))
    a, b = a[order], b[order]
    nodes, first, times = np.unique(b, return_index=True, return_counts=True)
    nth = np.arange(len(b)) - np.repeat(first, times)
    few = nth < links.shape[1]
    fresh = np.full((len(nodes), links.shape[1]), -1, np.int64)
    fresh[np.searchsorted(nodes, b[few]), nth[few]] = a[few]
    for at in range(0, len(nodes), BATCH):
        some = nodes[at : at + BATCH]
        both = np.sort(np.hstack([links[some], fresh[at : at + BATCH]]), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        near = np.einsum("qd,qkd->qk", points[some], points[both])
        near[both < 0] = -np.inf
        order = np.argsort(-near, axis=1, kind="stable")
        links[some] = spread_out(points, np.take_along_axis(both, order, 1), np.take_along_axis(near, order, 1), links.shape[1])


def descend(points: np.ndarray, sizes: list[int], layers: list[np.ndarray], queries: np.ndarray, beam: int) -> np.ndarray:
    """Entries into the next layer: all nodes of the top layer are compared, then each layer is walked."""
    near = queries @ points[: sizes[0]].T
    width = min(beam, sizes[0])
    entries = np.argpartition(-near, width - 1, axis=1)[:, :width]
    for size, links in zip(sizes[1:], layers[1:], strict=True):
        entries = beam_search(points[:size], links, queries, entries, beam)[0]
    return entries


def build(points: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Layer sizes from the top and the neighbour arrays of the layers. The nodes of a layer are the first ones of the points."""
    sizes = [len(points)]
    while sizes[0] > 2 * LAYER_RATIO:
        sizes.insert(0, -(-sizes[0] // LAYER_RATIO))
    layers: list[np.ndarray] = []
    for depth, size in enumerate(sizes):
        links = np.full((size, LINKS), -1, np.int64)
        above = sizes[depth - 1] if depth else size
        start = 0
        while start < size:
            # the first batch is the layer above; later ones never outgrow what is there
            end = min(size, start + min(start, BATCH)) if start else above
            _insert(points[:size], links, sizes[:depth], layers, start, end)
            start = end
        layers.append(links)
    return sizes, layers


def _insert(points: np.ndarray, links: np.ndarray, sizes: list[int], layers: list[np.ndarray], start: int, end: int) -> None:
    for at in range(start, end, BATCH):
        new = np.arange(at, min(at + BATCH, end))
        queries = points[new]
        mates = np.arange(start, end)  # nodes of the same batch are compared directly
        near = queries @ points[mates].T
        near[new[:, None] == mates[None, :]] = -np.inf
        width = min(BEAM_BUILD, len(mates))
        best = np.argpartition(-near, width - 1, axis=1)[:, :width]
        ids, close = mates[best], np.take_along_axis(near, best, 1)
        if start:
            entries = descend(points, sizes, layers, queries, 4)
            old, old_near = beam_search(points, links, queries, entries, BEAM_BUILD)
            ids, close = np.hstack([ids, old]), np.hstack([close, old_near])
        ids = np.where(np.isfinite(close), ids, -1)
        order = np.argsort(-close, axis=1, kind="stable")[:, :BEAM_BUILD]
        kept = spread_out(points, np.take_along_axis(ids, order, 1), np.take_along_axis(close, order, 1), LINKS // 2)
        links[new, : LINKS // 2] = kept
    _link_back(points, links, np.arange(start, end))


def search(points: np.ndarray, sizes: list[int], layers: list[np.ndarray], queries: np.ndarray, beam: int = BEAM_SEARCH) -> np.ndarray:
    """Ids of each query's best nodes, nearest first, -1 where there are fewer."""
    wide = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
    entries = descend(points, sizes[:-1], layers[:-1], wide, 8) if len(sizes) > 1 else np.arange(sizes[0])[None, :].repeat(len(wide), 0)
    return beam_search(points, layers[-1], wide, entries, max(beam, 1))[0]


GRAPH = "shard int, dim int, vectors binary, ids array<array<bigint>>, sizes array<int>, links array<binary>"


def _graphs(entries: DataFrame) -> DataFrame:
    """A row per shard: its vectors, the smallest ids of each, and the flat neighbour arrays of the layers."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack([np.asarray(v, np.float64) for v in frame.vector])
        sizes, layers = build(widened(vectors))
        row = {
            "shard": int(frame.shard.iloc[0]),
            "dim": vectors.shape[1],
            "vectors": vectors.tobytes(),
            "ids": [[int(i) for i in x] for x in frame.ids],
            "sizes": sizes,
            "links": [x.astype("<i4").tobytes() for x in layers],
        }
        return pd.DataFrame([row])

    # nodes in the order of their digests: which are on the upper layers depends on nothing else
    return entries.groupBy("shard").applyInPandas(lambda f: make(f.sort_values("entry", kind="stable")), GRAPH)


def _walks(met: DataFrame, top: int, beam: int) -> DataFrame:
    """The best of each (block of queries, graph) row: query_id, vec_id, score."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def walk(row: dict) -> Iterator[pa.RecordBatch]:
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        points, ids = widened(vectors), row["ids"]
        layers = [np.frombuffer(x, "<i4").reshape(-1, LINKS).astype(np.int64) for x in row["links"]]
        queries = np.array([q["vector"] for q in row["queries"]], np.float64)
        found = search(points, row["sizes"], layers, queries, max(beam, 2 * top))
        out = []
        for q, vector, near in zip(row["queries"], queries, found, strict=True):
            near = near[near >= 0]
            scores = (vectors[near] * vector).sum(axis=1)
            best = [(-s, i) for s, n in zip(scores.tolist(), near.tolist(), strict=True) for i in ids[n] if i != q["id"]]
            best.sort()
            out += [(q["id"], i, -s) for s, i in best[:top]]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                yield from walk({name: batch.column(name)[i].as_py() for name in batch.schema.names})

    return met.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, queries: Column | str = "vec_id % 20 = 0", top: int = TOP, shard: int = SHARD, beam: int = BEAM_SEARCH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` nearest found of each query row, by inner product.

    ``vectors`` has vec_id (a whole number) and embedding (an array of numbers); ``queries`` chooses the query rows. A query's own id is
    no candidate of its own. Rows whose id or vector is null, whose vector is empty or zero, or holds null or non-finite components,
    and vectors of another length than most, take no part. Ties go to the smaller id. Repeated rows count once. An empty table, or
    one without queries, gives no rows."""
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = usable.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    lengths = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    usable = usable.filter(F.size("vector") == (lengths[0].n if lengths else 0)).distinct()

    # zeros of either sign are equal
    entry = F.xxhash64(F.transform("vector", lambda x: x + 0.0))
    ranked = usable.withColumn("entry", entry)
    order = Window.partitionBy("entry").orderBy("id")
    ranked = ranked.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top + 1)
    entries = store(
        ranked.groupBy("entry").agg(F.min_by("vector", "id").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids")), "vectors"
    )
    shards = max(1, -(-entries.count() // shard))
    graphs = store(_graphs(entries.withColumn("shard", F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int"))), "graphs")
    asked = usable.withColumnRenamed("id", "vec_id").filter(queries).select(F.struct(F.col("vec_id").alias("id"), "vector").alias("q"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.groupBy(F.pmod(F.xxhash64("q.id"), F.lit(blocks)).alias("block")).agg(F.collect_list("q").alias("queries"))
    every = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = every.join(graphs, "shard").select("queries", "dim", "vectors", "ids", "sizes", "links")
    found = _walks(met.repartition(max(1, min(blocks * shards, 10_000))), top, beam)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


@query("op10_neighbours")
def op10_neighbours(spark, sf):
    return nearest(table(spark, sf, "embeddings"))
