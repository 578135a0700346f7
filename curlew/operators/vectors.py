"""Nearest-neighbour search over item vectors, embedding lookups and dimension reduction.

Queries are dealt into chunks and items into stripes, both of bounded size, and a task searches one stripe for one chunk: it
multiplies block by block and keeps the best ``k`` of each query so far, so only these leave the task. Which of them meet is
an equi-join, so the (query, item) pairs themselves never become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curlew.functions.arrays import norm, zeros
from curlew.session import cut_lineage, store

# Rows of the blocks that are multiplied.
ITEM_BLOCK = 2048
QUERY_BLOCK = 512
# What a task holds: numbers of its query vectors (or results kept for them), and of its item vectors.
QUERY_FLOATS = 2_097_152
ITEM_FLOATS = 8_388_608
# Item vectors with up to this many numbers in all (8 MB) are searched without an index; they are counted first.
BROADCAST_FLOATS = 2_097_152
SCORE_DIGITS = 6
SLACK = 10.0**-SCORE_DIGITS  # scores are compared rounded

# Pairs that are multiplied in double precision at once, and lengths up to which single precision rules pairs out.
PRODUCTS = 65_536
SINGLE_LIMIT = 1e30

_SCORED = "request_id bigint, item_id bigint, score double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, some at a time."""
    pieces = [np.einsum("ij,ij->i", left[i : i + PRODUCTS], right[i : i + PRODUCTS], dtype=np.float64) for i in range(0, len(left), PRODUCTS)]
    return np.concatenate([np.zeros(0), *pieces])


def _stripe_search(k: int):
    """Best ``k`` of a stripe of items for each query of a chunk; equal rounded scores by item id. A query names the cells
    of the stripe that it searches in a bit mask, and may bring a ``floor`` that scores must reach. Pairs whose score is no
    number are no results. Blocks are multiplied in single precision; pairs that reach the limit but for its error are
    multiplied again in double precision, and these scores count."""

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return pa.table({"request_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        held = held.take(pc.sort_indices(held, sort_keys=[("item_id", "ascending")], null_placement="at_start"))
        queries, items, place = _matrix(asked["qvec"]), _matrix(held["embedding"]), held["place"].to_numpy()
        wanted = np.unpackbits(np.frombuffer(b"".join(asked["cells"].to_pylist()), dtype=np.uint8).reshape(len(asked), -1), axis=1).astype(bool)
        least = asked["floor"].fill_null(-math.inf).to_numpy().copy()
        none = len(held)  # the place of no item
        scores, places = np.full((len(asked), k), -math.inf), np.full((len(asked), k), none)
        lengths, reach = np.sqrt(_products(queries, queries)), np.sqrt(_products(items, items))
        single = lengths.max() * reach.max() < SINGLE_LIMIT  # not so with any vector that has no length
        precision = np.float32 if single else np.float64
        error = 2.0 * (queries.shape[1] + 4) * 2.0**-24 * lengths if single else np.zeros(len(asked))

        def keep(rows: np.ndarray, block: np.ndarray, raw: np.ndarray, asking: np.ndarray, of_cell: np.ndarray) -> None:
            limit, whole = least[rows], asking.all()
            off = error[rows] * reach[block].max() if single else error[rows]
            fresh = np.isneginf(limit)
            if raw.shape[1] > k and fresh.any():
                part = raw[fresh] if whole else np.where(asking[fresh][:, of_cell], raw[fresh], -math.inf)
                limit[fresh] = np.fmax(limit[fresh], np.partition(part, -k, axis=1)[:, -k] - SLACK - off[fresh])
            least_raw = np.nextafter((limit - off).astype(precision), precision(-math.inf))
            row, column = np.divmod(np.flatnonzero(raw >= least_raw[:, None]), raw.shape[1])
            if not whole:
                allowed = asking[row, of_cell[column]]
                row, column = row[allowed], column[allowed]
            exact = np.concatenate([np.zeros(0), *[
                _products(queries[rows[row[i : i + PRODUCTS]]], items[block[column[i : i + PRODUCTS]]]) for i in range(0, len(row), PRODUCTS)
            ]])
            reached = exact >= limit[row]
            row, column, exact = row[reached], column[reached], exact[reached]
            if not len(row):
                return
            changed, row = np.unique(row, return_inverse=True)
            own = rows[changed]
            of = np.concatenate([np.repeat(np.arange(len(own)), k), row])
            score = np.concatenate([scores[own].ravel(), np.round(exact, SCORE_DIGITS) + 0.0])
            at = np.concatenate([places[own].ravel(), block[column]])
            order = np.lexsort((at, -score, of))
            first = np.cumsum(np.bincount(of)) - np.bincount(of)
            best = order[first[:, None] + np.arange(k)]
            scores[own], places[own] = score[best], at[best]
            full = places[own, -1] < none
            least[own] = np.where(full, np.maximum(least[own], scores[own, -1] - SLACK), least[own])

        by_cell = np.argsort(place, kind="stable")  # small cells share a block
        for i in range(0, len(held), ITEM_BLOCK):
            block = by_cell[i : i + ITEM_BLOCK]
            cells, of_cell = np.unique(place[block], return_inverse=True)
            across, asking = items[block].T.astype(precision), wanted[:, cells]
            rows = np.flatnonzero(asking.any(axis=1))
            for q in range(0, len(rows), QUERY_BLOCK):
                some = rows[q : q + QUERY_BLOCK]
                keep(some, block, queries[some].astype(precision) @ across, asking[some], of_cell)
        row, column = np.nonzero(places < none)
        return pa.table(
            {
                "request_id": asked["request_id"].take(pa.array(row)),
                "item_id": held["item_id"].take(pa.array(places[row, column])),
                "score": scores[row, column],
            }
        )

    return search


def _search_stripes(asked: DataFrame, held: DataFrame, k: int, n_queries: int, n_stripes: int, dim: int) -> DataFrame:
    """Best ``k`` per query and stripe of ``(stripe, request_id, qvec, cells, floor)`` against ``(stripe, item_id,
    embedding, place)``."""
    cores = asked.sparkSession.sparkContext.defaultParallelism
    largest = max(1, QUERY_FLOATS // max(dim, k))
    busy = min(math.ceil(n_queries / QUERY_BLOCK), math.ceil(2 * cores / n_stripes))
    n_chunks = max(1, math.ceil(n_queries / largest), busy)
    # more partitions than groups, so that few of them get two
    partitions = min(4 * n_chunks * n_stripes, max(2000, n_chunks * n_stripes))
    chunk = F.pmod(F.xxhash64("request_id"), F.lit(n_chunks)).cast("int")
    asked = asked.withColumn("chunk", chunk).repartition(partitions, "chunk", "stripe")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))
    held = held.withColumn("chunk", every).repartition(partitions, "chunk", "stripe")
    return asked.groupBy("chunk", "stripe").cogroup(held.groupBy("chunk", "stripe")).applyInArrow(_stripe_search(k), _SCORED)


def _keep_best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("request_id").orderBy(F.col("score").desc(), F.col("item_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _sizes(queries: DataFrame, items: DataFrame) -> tuple[int, int, int]:
    """Number of item vectors, of numbers in them and of queries, in one job."""
    vectors = items.select(F.lit(0).alias("is_query"), F.size("embedding").alias("width"))
    both = vectors.union(queries.select(F.lit(1), F.lit(0)))
    counted = {r.is_query: r for r in both.groupBy("is_query").agg(F.count("width").alias("n"), F.sum("width").alias("w")).collect()}
    item_row, query_row = counted.get(0), counted.get(1)
    return (item_row.n, item_row.w or 0, query_row.n if query_row else 0) if item_row else (0, 0, query_row.n if query_row else 0)


def knn(queries: DataFrame, items: DataFrame, k: int = 300, float_limit: int = BROADCAST_FLOATS) -> DataFrame:
    """Exact top ``k`` items per query by inner product: ``(request_id, item_id, score, rank)``.

    ``queries`` has ``(request_id, qvec)`` and ``items`` has ``(item_id, embedding)``. A catalog of a checked small
    size is searched as it is; a larger one goes through the inverted file with bounds.
    """
    n_items, n_floats, n_queries = _sizes(queries, items)
    if n_floats > float_limit:
        return knn_bounded(queries, build_ivf(items, max(32, math.isqrt(n_items))), k)
    dim = max(1, math.ceil(n_floats / max(1, n_items)))
    n_stripes = max(1, math.ceil(n_floats / ITEM_FLOATS))
    stripe = F.pmod(F.xxhash64("item_id"), F.lit(n_stripes)).cast("int")
    held = _vectors(items, "item_id", "embedding").withColumns({"stripe": stripe, "place": F.lit(0)})
    asked = _vectors(queries, "request_id", "qvec").withColumns(
        {"cells": F.unhex(F.lit("80")), "floor": F.lit(None).cast("double"), "stripe": F.explode(F.sequence(F.lit(0), F.lit(n_stripes - 1)))}
    )
    return _keep_best(_search_stripes(asked, held, k, n_queries, n_stripes, dim), k)


@dataclass
class IvfIndex:
    """Coarse cells with their radius, and the items with their cell.

    ``centroids`` is a small matrix (the number of cells is a parameter); the items stay a table.
    """

    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    items: DataFrame


def build_ivf(items: DataFrame, n_cells: int = 32, seed: int = 42) -> IvfIndex:
    """Assign every item that has a vector to the nearest of ``n_cells`` k-means centroids."""
    known = items.where(F.col("embedding").isNotNull())
    vectors = known.select("item_id", "embedding", array_to_vector("embedding").alias("features"))
    # The row solver copes with fewer distinct vectors than cells; the block solver fails on them.
    model = KMeans(k=n_cells, seed=seed, maxIter=10, solver="row", predictionCol="cell").fit(vectors)
    centroids = np.array(model.clusterCenters())
    placed = cut_lineage(model.transform(vectors).select("item_id", "embedding", "cell"))
    # as many rows as there are cells
    table = placed.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    offset = F.zip_with(F.col("embedding").cast("array<double>"), "centroid", lambda x, c: x - c)
    stats = placed.join(F.broadcast(table), "cell").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(norm(offset)).alias("radius")).collect()
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=np.int64)
    for row in stats:  # one row per cell
        radii[row.cell], sizes[row.cell] = row.radius, row.n
    return IvfIndex(centroids, radii, sizes, placed)


@dataclass
class _Stripes:
    """Where the cells of an index lie: small cells share a stripe, a cell larger than one is dealt to several.

    ``cells``: the cells of each stripe, by their place in it; ``first``, ``parts`` and ``place`` by cell.
    """

    cells: list[list[int]]
    first: list[int]
    parts: list[int]
    place: list[int]


def _stripes(index: IvfIndex) -> _Stripes:
    largest = max(1, ITEM_FLOATS // max(1, index.centroids.shape[1]))
    laid, room = _Stripes([], [], [], []), 0
    for cell, size in enumerate(int(n) for n in index.sizes):
        parts = max(1, math.ceil(size / largest))
        if size > room or not laid.cells:
            laid.cells += [[] for _ in range(parts)]
            room = max(largest, size)
        room = room - size if parts == 1 else 0
        laid.first.append(len(laid.cells) - parts)
        laid.parts.append(parts)
        laid.place.append(len(laid.cells[-1]))
        for stripe in laid.cells[-parts:]:
            stripe.append(cell)
    return laid


def _search_cells(queries: DataFrame, index: IvfIndex, k: int, choose) -> DataFrame:
    """Search the cells that ``choose(vectors, batch) -> (queries x cells) booleans`` finds for each of the ``(request_id, qvec,
    floor)``. A query goes once to every stripe that has some of its cells."""
    laid = _stripes(index)
    known = index.items.sparkSession.createDataFrame(  # as many rows as there are cells
        [(c, *t) for c, t in enumerate(zip(laid.first, laid.parts, laid.place, strict=True))], "cell int, first int, parts int, place int"
    )
    stripe = F.col("first") + F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")
    held = _vectors(index.items.join(F.broadcast(known), "cell").withColumn("stripe", stripe), "item_id", "embedding", "stripe", "place")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), ROUTED):
                some = batch.iloc[start : start + ROUTED]
                chosen = choose(np.stack(some.qvec.to_numpy()).astype(np.float64), some)
                for stripe, cells in enumerate(laid.cells):
                    mine = chosen[:, cells]
                    rows = np.flatnonzero(mine.any(axis=1))
                    if len(rows):
                        masks = np.packbits(mine[rows], axis=1)
                        yield some.iloc[rows].assign(stripe=np.int32(stripe), cells=[m.tobytes() for m in masks])[_ROUTED_COLUMNS]

    asked = queries.mapInPandas(route, "stripe int, request_id bigint, qvec array<float>, cells binary, floor double")
    return _search_stripes(asked, held, k, queries.count(), max(1, len(laid.cells)), index.centroids.shape[1])


ROUTED = 1024  # queries that meet all centroids at once
_ROUTED_COLUMNS = ["stripe", "request_id", "qvec", "cells", "floor"]


def _nearest_cells(index: IvfIndex, n_probe: int):
    centroids = index.centroids
    lengths = (centroids**2).sum(axis=1)

    def choose(vectors: np.ndarray, _batch) -> np.ndarray:
        distance = lengths[None, :] - 2.0 * vectors @ centroids.T
        nearest = np.argsort(distance, axis=1, kind="stable")[:, :n_probe]
        chosen = np.zeros(distance.shape, dtype=bool)
        np.put_along_axis(chosen, nearest, True, axis=1)
        return chosen

    return choose


def _vectors(df: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    return df.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias(id_col), F.col(vec_col).cast("array<float>").alias(vec_col), *more
    )


def _requests(queries: DataFrame) -> DataFrame:
    return _vectors(queries, "request_id", "qvec").withColumn("floor", F.lit(None).cast("double"))


def knn_ivf(queries: DataFrame, index: IvfIndex, k: int = 300, n_probe: int = 1) -> DataFrame:
    """Approximate top ``k``: search only the ``n_probe`` cells nearest to the query."""
    return _keep_best(_search_cells(_requests(queries), index, k, _nearest_cells(index, n_probe)), k)


def knn_bounded(queries: DataFrame, index: IvfIndex, k: int = 300) -> DataFrame:
    """Exact top ``k`` through the inverted file.

    The nearest cell gives a first k-th score; then only cells whose best possible score (query x centroid plus query
    length x radius) reaches it are searched as well, for scores that reach it.
    """
    vectors = _requests(queries)
    nearest = _nearest_cells(index, 1)
    first = cut_lineage(_search_cells(vectors, index, k, nearest))
    kth = _keep_best(first, k).groupBy("request_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("found"))
    floor = F.when(F.col("found") >= k, F.col("kth") - SLACK)  # fewer than k results: nothing can be skipped
    waiting = vectors.drop("floor").join(kth.select("request_id", floor.alias("floor")), "request_id", "left")
    centroids, radii, nonempty = index.centroids, index.radii, index.sizes > 0

    def choose(queries_matrix: np.ndarray, batch: pd.DataFrame) -> np.ndarray:
        bound = queries_matrix @ centroids.T + np.linalg.norm(queries_matrix, axis=1)[:, None] * radii[None, :]
        floor_score = batch.floor.astype("float64").fillna(-np.inf).to_numpy()
        # a bound that is no number skips nothing
        return ~(bound < floor_score[:, None]) & nonempty[None, :] & ~nearest(queries_matrix, batch)

    rest = _search_cells(waiting, index, k, choose)
    return _keep_best(first.unionByName(rest), k)


def lookup_embeddings(rows: DataFrame, matrices: dict[str, DataFrame], id_col: str = "idx", dim: int = 64) -> DataFrame:
    """Attach one vector per named matrix ``(idx, embedding)``; a missing row gives the zero vector."""
    for name, matrix in matrices.items():
        vectors = matrix.select(F.col("idx").alias(id_col), F.col("embedding").alias(name))
        rows = rows.join(vectors, id_col, "left").withColumn(name, F.coalesce(F.col(name), zeros(dim)))
    return rows


def remap_embeddings(vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Replace the encoded index of embedding rows by the raw id; codes without an id are left out."""
    codes = vocabulary.select(F.col("code").alias("idx"), F.col("value").alias("item_id"))
    return vectors.join(codes, "idx").select("item_id", "embedding")


def pca(vectors: DataFrame, dim: int = 64, id_col: str = "item_id", vec_col: str = "embedding") -> DataFrame:
    """Reduce to ``dim`` principal components. Zero vectors (absent inputs) neither enter the fit nor get projected."""
    # Scaling, fitting and projecting each pass over the vectors, so they are stored first.
    rows = store(vectors.select(id_col, vec_col, (norm(F.col(vec_col)) > 0).alias("_present")), "pca")
    present = rows.where("_present").select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("raw"))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(present)
    centred = scaler.transform(present)
    model = PCA(k=dim, inputCol="centred", outputCol="reduced").fit(centred)
    reduced = model.transform(centred).select(id_col, vector_to_array("reduced").cast("array<float>").alias(vec_col))
    absent = rows.where(~F.col("_present")).select(id_col, zeros(dim).alias(vec_col))
    return reduced.unionByName(absent)
