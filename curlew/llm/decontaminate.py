"""Benchmark decontamination by winnowing.

Of the ``k``-word runs of a text, only the smallest of every ``window - k + 1`` neighbours is kept as a fingerprint. A passage of
``window`` words holds exactly that many runs, so wherever it stands, in an item or in a document, its smallest run is kept: every
shared passage of at least ``window`` words shares a fingerprint. Fingerprints of documents and items are joined and each meeting
is extended word by word to the longest common span; spans of ``window`` words or more are contamination. Items shorter than a
window count as one window and are found by the runs of their own length.

A bit map of fixed size (1 MB) tells map tasks which fingerprints cannot be an item's, whatever the size of the benchmark; the join
itself is left to Spark's choice by size. Work on a text is done once however many documents repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.llm.registry import query, table
from curlew.llm.words import MIX, Chunk, chunks, texts
from curlew.session import store

WINDOW, RUN = 13, 7
MAP_BITS = 23
#: Bytes that are no part of a word.
_BLANK = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_BLANK, b" " * len(_BLANK))


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and all characters beyond ASCII, with A-Z lower-cased."""
    return text.lower().translate(_TABLE).split() if text else []


def winnowed(numbers: np.ndarray, usable: np.ndarray, neighbours: int) -> np.ndarray:
    """Places that hold the smallest usable number of some ``neighbours`` places in a row."""
    values = np.where(usable, numbers, np.uint64(0xFFFFFFFFFFFFFFFF))
    count = len(values) - neighbours + 1
    if count <= 0:
        return np.flatnonzero(usable)
    least = values[:count].copy()
    for i in range(1, neighbours):
        np.minimum(least, values[i : i + count], out=least)
    kept = np.zeros(len(values), bool)
    for i in range(neighbours):
        kept[i : i + count] |= values[i : i + count] == least
    return np.flatnonzero(kept & usable)


def _fingerprints(chunk: Chunk, window: int, run: int, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, places) of the winnowed runs and of all runs of the given shorter lengths."""
    numbers, usable = chunk.grams(run)
    places = winnowed(numbers, usable, window - run + 1)
    yield numbers[places] * MIX, places
    for length in lengths:
        numbers, usable = chunk.grams(length)
        places = np.flatnonzero(usable)
        yield (numbers[places] ^ np.uint64(length)) * MIX, places


def _item_fingerprints(items: DataFrame, window: int, run: int) -> DataFrame:
    """item (its key), fp, at (word), size (of the item)."""
    schema = pa.schema([("item", pa.int64()), ("fp", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])

    def find(batches):
        for chunk in chunks(batches, plain_words, ("item",)):
            sizes = chunk.lengths
            short = sorted({int(n) for n in sizes if 0 < n < window})
            for i, (numbers, places) in enumerate(_fingerprints(chunk, window, run, short)):
                owner = chunk.owner[places]
                fits = sizes[owner] >= window if i == 0 else sizes[owner] == short[i - 1]
                numbers, places, owner = numbers[fits], places[fits], owner[fits]
                keys = np.array([r["item"] for r in chunk.rows], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[owner]),
                        pa.array(numbers.view(np.int64)),
                        pa.array((places - chunk.starts[owner]).astype(np.int32)),
                        pa.array(sizes[owner].astype(np.int32)),
                    ],
                    schema=schema,
                )

    return items.mapInArrow(find, "item bigint, fp bigint, at int, size int")


def _bit_map(prints: DataFrame) -> np.ndarray:
    """Which low bits occur among the fingerprints: at most 2^17 rows of 64 bits reach the driver."""
    low = F.col("fp").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    rows = (
        prints.select(F.shiftright(low, 6).alias("cell"), F.expr("shiftleft(1L, CAST(fp & 63 AS INT))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    cells = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for row in rows:
        cells[row.cell] = row.bits
    return np.unpackbits(cells.view(np.uint8), bitorder="little").astype(bool)


def _text_hits(docs: DataFrame, occurs: np.ndarray, window: int, run: int, lengths: list[int]) -> DataFrame:
    """(text_key, fp, pos): fingerprints of the documents that may be an item's."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(occurs))
    schema = pa.schema([("text_key", pa.int64()), ("fp", pa.int64()), ("pos", pa.int32())])

    def find(batches):
        bits = np.unpackbits(shared.value).astype(bool)
        for chunk in chunks(batches, plain_words, ("text_key",)):
            keys = np.array([r["text_key"] for r in chunk.rows], np.int64)
            for numbers, places in _fingerprints(chunk, window, run, lengths):
                may = bits[numbers & np.uint64((1 << MAP_BITS) - 1)]
                if may.any():
                    numbers, places = numbers[may], places[may]
                    owner = chunk.owner[places]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[owner]),
                            pa.array(numbers.view(np.int64)),
                            pa.array((places - chunk.starts[owner]).astype(np.int32)),
                        ],
                        schema=schema,
                    )

    return docs.mapInArrow(find, "text_key bigint, fp bigint, pos int")


def _window_spans(words: list[bytes], item: list[bytes], window: int) -> list[tuple[int, int]]:
    """The spans of all windows of the item, each compared as a whole: as much work as there are words."""
    size = min(window, len(item))
    windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
    return [(i, i + size) for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in windows] if size else []


def _spans(words: list[bytes], item: list[bytes], hits: list[dict], window: int) -> list[tuple[int, int]]:
    """Longest common spans through the hits that hold a window of the item. A hit without a place in the item is of a run that the item
    repeats."""
    if any(hit["at"] is None for hit in hits):
        return _window_spans(words, item, window)
    found: dict[int, list[tuple[int, int]]] = {}
    need = min(window, len(item))
    for hit in sorted(hits, key=lambda h: h["pos"]):
        pos, at = hit["pos"], hit["at"]
        line = found.setdefault(pos - at, [])
        if line and line[-1][0] <= pos < line[-1][1]:
            continue
        start, end, shift = pos, pos, pos - at
        while end < len(words) and end - shift < len(item) and words[end] == item[end - shift]:
            end += 1
        if end == pos:
            continue
        while start > 0 and start - shift > 0 and words[start - 1] == item[start - 1 - shift]:
            start -= 1
        line.append((start, end))
    return [span for line in found.values() for span in line if need and span[1] - span[0] >= need]


RESULT = (
    "n_words bigint, n_hit bigint, n_items bigint, item_ids array<string>, spans array<struct<start:bigint,end:bigint>>, contaminated boolean"
)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, run: int = RUN, share: int = 20) -> DataFrame:
    """For each document: ``row`` (the input row), its words, the words inside any window of an item, the items, the merged spans.

    ``items`` has item_id and text, ``docs`` a text. A document is ``contaminated`` when it has hit words and they are at least one
    in ``share``. A null text has no words; items without words are no items; repeated item ids count once, null ids among them, which
    ``n_items`` counts and ``item_ids`` leaves out; an empty benchmark or document table gives no hits or no rows. Other columns are kept in ``row`` and never looked at."""
    listed = items.select(
        F.xxhash64(F.col("item_id").cast("string"), "text").alias("item"), F.col("item_id").cast("string").alias("item_id"), "text"
    )
    listed = store(listed.dropDuplicates(["item"]), "items")
    prints = _item_fingerprints(listed.select("item", "text"), window, run)
    # a run that an item repeats goes once and without its place: places of a text times places of the item would be too many
    at = F.when(F.count_distinct("at") == 1, F.min("at")).alias("at")
    prints = store(prints.groupBy("item", "fp", "size").agg(at), "item-prints")
    lengths = [r.size for r in prints.filter(F.col("size") < window).select("size").distinct().collect()]
    keyed = docs.select(F.struct("*").alias("row")).withColumn("text_key", F.xxhash64("row.text"))
    hits = _text_hits(keyed.select("text_key", F.col("row.text").alias("text")), _bit_map(prints), window, run, sorted(lengths))
    matches = (
        hits.join(prints.select("fp", "item", "at"), "fp")
        .groupBy("text_key", "item")
        .agg(F.collect_set(F.struct("pos", "at")).alias("hits"))
        .join(listed.select("item", "item_id", F.col("text").alias("item_text")), "item")
        .groupBy("text_key")
        .agg(F.collect_list(F.struct("item_id", "item_text", "hits")).alias("matches"))
    )
    joined = keyed.join(store(matches, "item-matches"), "text_key", "left").select("row", "matches")
    row_type = joined.schema["row"].dataType.simpleString()

    def verify(batches):
        for batch in batches:
            rows = batch.column("row")
            counts, hit_counts, n_items, ids, spans, dirty = [], [], [], [], [], []
            for text, matched in zip(texts(batch), batch.column("matches").to_pylist(), strict=True):
                words, found, merged = plain_words(text), set(), []
                for match in matched or ():
                    own = _spans(words, plain_words(match["item_text"].encode()), match["hits"], window)
                    if own:
                        found.add(match["item_id"])
                        merged += own
                union: list[list[int]] = []
                for start, end in sorted(merged):
                    if union and start <= union[-1][1]:
                        union[-1][1] = max(union[-1][1], end)
                    else:
                        union.append([start, end])
                n_hit = sum(end - start for start, end in union)
                counts.append(len(words))
                hit_counts.append(n_hit)
                n_items.append(len(found))
                ids.append(sorted(found - {None}))
                spans.append([{"start": s, "end": e} for s, e in union])
                dirty.append(n_hit > 0 and share * n_hit >= len(words))
            yield pa.RecordBatch.from_arrays(
                [
                    rows,
                    pa.array(counts, pa.int64()),
                    pa.array(hit_counts, pa.int64()),
                    pa.array(n_items, pa.int64()),
                    pa.array(ids, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(dirty, pa.bool_()),
                ],
                names=["row", "n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated"],
            )

    return joined.mapInArrow(verify, f"row {row_type}, {RESULT}")


#: Occurring windows by plain string comparison.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.run = bw.run AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op5_decontaminate", SQL)
def op5_decontaminate(spark, sf):
    found = decontaminate(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )
