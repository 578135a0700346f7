"""The keyed table in many small batches."""

import random
from pathlib import Path

import pytest

from curlew.session import scratch_path
from curlew.sources.keyed import PIECES, KeyedTable

ROWS = "k bigint, t bigint, v string, _deleted boolean"


def _files(path):
    return [p for p in Path(path).rglob("*.parquet")]


def _rows(table):
    return sorted((r.k, r.t, r.v) for r in table.read().collect())


def test_many_batches_equal_a_dictionary_in_bounded_space(spark):
    rng = random.Random(5)
    path = scratch_path(spark, "keyed")
    table = KeyedTable(spark, path, ["k"], ["t"], buckets=4)
    assert table.read() is None
    expected, sizes = {}, []
    for batch in range(50):
        rows = []
        for key in rng.sample(range(60), 6):
            row = (key, rng.randrange(100), f"{batch}-{key}", rng.random() < 0.2)
            rows.append(row)
            known = expected.get(key)
            if known is None or row[1] >= known[1]:
                expected[key] = row
        table.upsert(spark.createDataFrame(rows, ROWS).coalesce(1), batch)
        sizes.append((len(_files(path)), sum(p.stat().st_size for p in _files(path))))
        if batch % 10 == 9:
            # a removed key's mark may be merged away, after which an older row would count again; newer ones here decide
            live = {k: r for k, r in expected.items() if not r[3]}
            got = {k: (k, t, v) for k, t, v in _rows(table)}
            assert {k: got.get(k) for k in live} == {k: r[:3] for k, r in live.items()}
    # two kept versions, each with at most so many pieces per bucket
    assert max(n for n, _ in sizes) <= 2 * 4 * (PIECES + 1)
    assert max(b for _, b in sizes[25:]) <= 2 * max(b for _, b in sizes[:25])
    assert len(list(Path(path, "manifest").glob("*.json"))) == 2


def test_only_touched_buckets_change(spark):
    path = scratch_path(spark, "keyed")
    table = KeyedTable(spark, path, ["k"], ["t"], buckets=8)
    table.upsert(spark.range(200).selectExpr("id AS k", "1L AS t", "'a' AS v"))
    before = table.manifest().buckets
    after = table.upsert(spark.createDataFrame([(7, 2, "b")], "k bigint, t bigint, v string")).buckets
    changed = [b for b in before if before[b] != after[b]]
    assert len(changed) == 1 and len(after[changed[0]]) == 2 and after[changed[0]][1][1] == 1
    assert (7, 2, "b") in _rows(table) and len(_rows(table)) == 200


def test_a_repeated_batch_changes_nothing(spark):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), ["k"], ["t"], buckets=2)
    rows = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k bigint, t bigint, v string")
    first = table.upsert(rows, 3)
    assert table.upsert(rows.selectExpr("k", "t + 1 AS t", "'again' AS v"), 3) == first
    assert table.upsert(rows.selectExpr("k", "t + 1 AS t", "'again' AS v"), 2) == first
    # another writer has its own batches
    table.upsert(rows.selectExpr("k", "t + 1 AS t", "'other' AS v"), 1, writer="other")
    assert _rows(table) == [(1, 6, "other"), (2, 6, "other")]


def test_readers_of_the_version_before_are_not_disturbed(spark):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), ["k"], ["t"], buckets=2)
    old = table.upsert(spark.createDataFrame([(1, 5, "a")], "k bigint, t bigint, v string"))
    reader = table.read()
    table.upsert(spark.createDataFrame([(1, 6, "b")], "k bigint, t bigint, v string"))
    assert [tuple(r) for r in reader.collect()] == [(1, 5, "a")]
    assert table.read(old.version).first().v == "a" and table.read().first().v == "b"


def test_a_write_that_fails_before_its_manifest_is_not_seen(spark, monkeypatch):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), ["k"], ["t"], buckets=2)
    table.upsert(spark.createDataFrame([(1, 5, "a")], "k bigint, t bigint, v string"), 0)
    newer = spark.createDataFrame([(1, 6, "b")], "k bigint, t bigint, v string")
    with monkeypatch.context() as patch:
        patch.setattr(KeyedTable, "_publish", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.upsert(newer, 1)
    assert _rows(table) == [(1, 5, "a")]
    table.upsert(newer, 1)
    assert _rows(table) == [(1, 6, "b")]


def test_removals_ties_empty_batches_and_columns(spark):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), ["k"], ["t"], buckets=2)
    table.upsert(spark.createDataFrame([], "k bigint, t bigint, v string"))
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (None, 1, "n")], "k bigint, t bigint, v string"))
    table.upsert(spark.createDataFrame([(1, 5, "tie")], "k bigint, t bigint, v string"))  # the later batch wins
    table.upsert(spark.createDataFrame([(2, 6, None, True)], ROWS))
    table.upsert(spark.createDataFrame([(3, 1)], "k bigint, t bigint"))
    assert sorted(((r.k, r.t, r.v) for r in table.read().collect()), key=str) == [(1, 5, "tie"), (3, 1, None), (None, 1, "n")]
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(3, 1, 1)], "k bigint, t bigint, w int"))
