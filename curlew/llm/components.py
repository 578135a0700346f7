"""Connected components of a link table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.session import store

EDGE = "a bigint, b bigint"


class Forest:
    """Groups of numbers under pairwise joining; a group is named by its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _thinned(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The same components with a star of links per task instead of every link."""

    def run(batches):
        forest, held = Forest(), 0

        def links():
            pairs = [(x, forest.find(x)) for x in forest.parent]
            pairs = [(root, x) for x, root in pairs if root != x]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                forest.join(a, b)
            held += len(batch)
            if held >= most:
                yield links()
                forest, held = Forest(), 0
        yield links()

    return edges.mapInArrow(run, EDGE)


def _are_stars(links: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and that one has none."""
    up = links.select(F.col("b").alias("node"), "a").union(links.select(F.col("a").alias("node"), "a"))
    least = up.groupBy("node").agg((F.min("a") < F.max("a")).alias("differ"))
    return not least.agg(F.max("differ")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) reaches. Nodes without links have no row.

    Rounds of "large star" and "small star" steps; each stores the links, which only ever number as many as there are nodes, and a
    task's own links are joined in memory first. Nothing depends on how many links a node has but the number of rows."""
    links = store(_thinned(edges.filter("a <> b")).distinct(), "links")
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours move to the least of the neighbourhood
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), F.col("b")).filter("a <> b").distinct()
        large = store(large, "links")
        # small star: a node and its smaller neighbours move to the least of them
        down = large.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        low = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(low, "x").select(F.col("m").alias("a"), F.explode(F.array("x", "y")).alias("b")).filter("a <> b").distinct()
        links = store(small, "links")
        if _are_stars(links):
            roots = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
