"""Removal of repeated passages by recompression.

A text is compressed in rounds. In each round every symbol falls into a left or a right class by its name, and a left symbol followed by
a right one becomes a pair with a name of its own. Names are digests of what they stand for, so equal symbols have equal names in all
documents without a dictionary, and a border between symbols depends only on the few words next to it: equal passages are cut at equal
places, but for their ends. Equal neighbours fall into one class and are never paired, so a run of one symbol is cut between all its
members, equally wherever it stands, and its equal names travel once.

After ``ROUNDS`` rounds symbols span up to 8 words. Borders of the last round, and borders of the round before inside symbols longer than
six words, are the anchors; each stands for the 8 words around it, 4 on either side. Every 13 consecutive words hold an anchor with
all of its 8 words (see ``anchors``), so

1. anchors that two documents share are found first, by truncated names (a false meeting only costs work);
2. only windows around shared anchors are compared, by 96-bit digests of their words, and each learns whether a document with a smaller
   id holds it too;
3. words covered by such windows are removed.

Both comparisons send distinct keys per chunk of documents, so a passage that a third of all documents hold is sent once per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.llm.exchange import LONE, NOTES, SENT, SENT_ARROW, parts_for, send, shared_places, to_batches, total_chars
from curlew.llm.registry import query, table
from curlew.llm.words import MIX, Chunk, blank_words, chunk_ids, chunks, grams, pack_short, texts, unpack_short

WINDOW = 13
SIDE = 4  # words on either side of an anchor
ROUNDS = 3
KEY_BYTES = 4  # of an anchor's name, besides its range of the key space
CHARS_PER_PART = 16 << 20
DIGEST = 12
_DIGEST = np.dtype([("a", "<u8"), ("b", "<u4")])
ID_BITS = np.uint64(1 << 63)  # turns signed ids into unsigned ones of the same order


def borders(numbers: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """After each round, the places at which a symbol begins."""
    starts, names, own, found = np.arange(len(numbers)), numbers, owner, []
    for round_no in range(ROUNDS):
        right = ((names ^ np.uint64(round_no + 1)) * MIX >> np.uint64(61)).astype(np.int64) % 2 == 1
        pair = np.zeros(len(names), bool)  # whether a symbol is paired with the next
        pair[:-1] = ~right[:-1] & right[1:] & (own[:-1] == own[1:])
        second = np.zeros(len(names), bool)
        second[1:] = pair[:-1]
        joined = names.copy()
        at = np.flatnonzero(pair)
        joined[at] = (names[at] * MIX ^ (names[at + 1] + np.uint64(round_no))) * MIX
        joined[at] ^= joined[at] >> np.uint64(31)
        starts, names, own = starts[~second], joined[~second], own[~second]
        found.append(starts)
    return found


def anchors(numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, names) of the anchors that have 4 words of their document on either side.

    A border of round r depends on 2^(r-1) words on either side, 4 in the last round. A window of 13 words has six places, 4 to 9, with
    4 words of the window on either side. If none of them is a border of the last round, all six lie inside one symbol of 7 or 8 words.
    It is a pair of symbols of at most 4 words, so the border between these, one of the round before, is among the six places."""
    found = borders(numbers, owner)
    last, before = found[-1], found[-2]
    marked = np.zeros(len(numbers) + 1, bool)
    marked[last] = True
    sizes = np.diff(np.append(last, len(numbers)))
    holder = np.searchsorted(last, before, side="right") - 1
    marked[before[sizes[holder] > 6]] = True
    places = np.flatnonzero(marked[: len(numbers)])
    places = places[(places >= SIDE) & (places + SIDE <= len(numbers))]
    places = places[owner[places - SIDE] == owner[places + SIDE - 1]] if len(places) else places
    names = grams(numbers, 2 * SIDE)[places - SIDE] if len(places) else np.zeros(0, np.uint64)
    return places, names * MIX


def _spread(flags: np.ndarray, first: int, last: int, size: int) -> np.ndarray:
    """Marks ``size`` places: those first..last away from each flag."""
    steps = np.zeros(size + 1, np.int64)
    low, high = np.clip(flags + first, 0, size), np.clip(flags + last + 1, 0, size)
    np.add.at(steps, low, 1)
    np.add.at(steps, high, -1)
    return np.cumsum(steps[:-1]) > 0


def _distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's keys: the distinct ones, an occurrence of each, whether several documents hold it, and each key's rank."""
    distinct, first, rank = np.unique(keys, return_index=True, return_inverse=True)
    known = np.zeros(len(distinct), bool)
    known[rank[owner != owner[first][rank]]] = True
    return distinct, first, known, rank


def _send_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """Anchor names of all texts. A chunk's notes: per document its key and the bounds of its anchors, and the known shared anchors."""

    def run(batches):
        ids = chunk_ids()

        def rows():
            for chunk in chunks(batches, blank_words, ("row_key",)):
                places, names = anchors(chunk.numbers, chunk.owner)
                owner = chunk.owner[places]
                bounds = np.searchsorted(owner, np.arange(len(chunk.rows) + 1))
                distinct, first, known, rank = _distinct(names, owner)
                held = np.flatnonzero(known[rank])
                notes = np.array([len(chunk.rows)], "<i8").tobytes()
                notes += np.array([r["row_key"] for r in chunk.rows], "<i8").tobytes()
                notes += bounds.astype("<i8").tobytes() + held.astype("<u4").tobytes()
                yield from send(next(ids), distinct, first, known, notes, parts, KEY_BYTES)

        yield from to_batches(rows(), SENT_ARROW)

    return docs.mapInArrow(run, SENT)


def _per_document(answers: DataFrame) -> DataFrame:
    """(row_key, anchors): the shared anchors of each document, by their number in it."""

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        notes = frame.data[frame.kind == NOTES].iloc[0]
        count = int(np.frombuffer(notes, "<i8", 1)[0])
        numbers = np.frombuffer(notes, "<i8", 2 * count + 2)
        keys, bounds = numbers[1 : count + 1], numbers[count + 1 :]
        places = [np.frombuffer(notes, "<u4", offset=8 * len(numbers))]
        places += [np.frombuffer(x, "<u4") for x in frame.data[frame.kind == LONE]]
        at = np.sort(np.concatenate(places).astype(np.int64))
        owner = np.searchsorted(bounds, at, side="right") - 1
        ends = np.searchsorted(owner, np.arange(count + 1))
        has = np.flatnonzero(np.diff(ends))
        return pd.DataFrame(
            {
                "row_key": keys[has],
                "anchors": [(at[ends[i] : ends[i + 1]] - bounds[i]).astype("<u4").tobytes() for i in has],
            }
        )

    return answers.groupBy("chunk").applyInPandas(gather, "row_key bigint, anchors binary")


def _least_places(sent: DataFrame) -> DataFrame:
    """Per chunk, the places of its keys that another chunk holds with a smaller id, and the chunk's notes.

    ``keys`` of a row are ``DIGEST``-byte digests; ``places`` are the first digest's number, the smallest id, and what each id is above
    it."""

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        notes = frame[frame.kind == NOTES]
        out = [pd.DataFrame({"chunk": notes.chunk, "kind": NOTES, "data": notes["keys"]})]
        rows = frame[frame.kind != NOTES]
        if len(rows):
            counts = np.array([len(x) // DIGEST for x in rows["keys"]])
            digests = np.frombuffer(b"".join(rows["keys"]), _DIGEST)
            heads = [np.frombuffer(x, "<u8", 2) for x in rows.places]
            ids = np.concatenate([head[1] + unpack_short(x[16:]) for head, x in zip(heads, rows.places, strict=True)])
            order = np.lexsort((ids, digests["b"], digests["a"]))
            same = digests[order][1:] == digests[order][:-1]
            group = np.concatenate([[0], np.cumsum(~same)])
            least = ids[order][np.flatnonzero(np.concatenate([[True], ~same]))][group]
            later = np.zeros(len(ids), bool)
            later[order] = least < ids[order]
            ends = np.concatenate([[0], np.cumsum(counts)])
            for i, (chunk, head) in enumerate(zip(rows.chunk, heads, strict=True)):
                hit = np.flatnonzero(later[ends[i] : ends[i + 1]])
                if len(hit):
                    data = (hit + int(head[0])).astype("<u4").tobytes()
                    out.append(pd.DataFrame({"chunk": [chunk], "kind": [LONE], "data": [data]}))
        return pd.concat(out, ignore_index=True)

    return sent.groupBy("part").applyInPandas(answer, "chunk bigint, kind int, data binary").repartition(F.col("chunk"))


def _send_windows(docs: DataFrame, parts: int, window: int) -> DataFrame:
    """Digests of the windows around shared anchors, with the smallest id of the chunk that holds each.

    A chunk's notes: per document its row key, the number of its windows, their starts, the rank of each window's digest, and
    whether the chunk itself knows a smaller id."""

    def run(batches):
        ids = chunk_ids()

        def rows():
            for chunk in chunks(batches, blank_words, ("row_key", "order_id", "anchors")):
                yield from _window_rows(next(ids), chunk, parts, window)

        yield from to_batches(rows(), SENT_ARROW, 64)

    return docs.mapInArrow(run, SENT)


def _window_rows(number: int, chunk: Chunk, parts: int, window: int) -> Iterator[dict]:
    places, names = anchors(chunk.numbers, chunk.owner)
    bounds = np.searchsorted(chunk.owner[places], np.arange(len(chunk.rows) + 1))
    hit = np.zeros(len(places), bool)
    for i, row in enumerate(chunk.rows):
        own = names[bounds[i] : bounds[i + 1]]
        hit[bounds[i] : bounds[i + 1]] = np.isin(own, own[np.frombuffer(row["anchors"], "<u4")])
    low, inside = chunk.grams(window)
    high = grams(chunk.numbers * MIX ^ (chunk.numbers >> np.uint64(32)), window)
    # a window from s holds all words of an anchor at s + 4 .. s + window - 4
    starts = np.flatnonzero(inside & _spread(places[hit], SIDE - window, -SIDE, len(low)))
    digests = np.empty(len(starts), _DIGEST)
    digests["a"], digests["b"] = low[starts], high[starts] >> np.uint64(32)
    distinct, rank = np.unique(digests, return_inverse=True)
    ids = np.array([r["order_id"] for r in chunk.rows], np.int64).view(np.uint64) ^ ID_BITS
    own = ids[chunk.owner[starts]]
    least = np.full(len(distinct), 0xFFFFFFFFFFFFFFFF, np.uint64)
    np.minimum.at(least, rank, own)
    part = (distinct["a"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    ends = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(np.diff(ends)):
        at = slice(ends[p], ends[p + 1])
        smallest = least[at].min()
        places = np.array([ends[p], smallest], "<u8").tobytes() + pack_short(least[at] - smallest)
        yield {"chunk": number, "part": int(p), "kind": LONE, "keys": distinct[at].tobytes(), "places": places}
    counts = np.bincount(chunk.owner[starts], minlength=len(chunk.rows))
    notes = np.array([len(chunk.rows), len(starts)], "<i8").tobytes()
    notes += np.array([r["row_key"] for r in chunk.rows], "<i8").tobytes() + counts.astype("<i8").tobytes()
    notes += (starts - chunk.starts[chunk.owner[starts]]).astype("<u4").tobytes() + rank.astype("<u4").tobytes()
    notes += (own > least[rank]).astype(np.uint8).tobytes()
    yield {"chunk": number, "part": number % parts, "kind": NOTES, "keys": notes, "places": None}


def _removed(answers: DataFrame) -> DataFrame:
    """(row_key, starts): per document, the windows that a smaller id holds."""

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        notes = frame.data[frame.kind == NOTES].iloc[0]
        n, m = (int(x) for x in np.frombuffer(notes, "<i8", 2))
        keys, counts = np.frombuffer(notes, "<i8", 2 * n, 16).reshape(2, n)
        at = 16 + 16 * n
        starts, rank = np.frombuffer(notes, "<u4", 2 * m, at).reshape(2, m)
        later = np.frombuffer(notes, np.uint8, m, at + 8 * m).astype(bool)
        hit = [np.frombuffer(x, "<u4") for x in frame.data[frame.kind == LONE]]
        if hit:
            flags = np.zeros(int(rank.max()) + 1, bool)
            flags[np.concatenate(hit)] = True
            later = later | flags[rank]
        owner = np.repeat(np.arange(n), counts)[later]
        ends = np.searchsorted(owner, np.arange(n + 1))
        has, starts = np.flatnonzero(np.diff(ends)), starts[later]
        return pd.DataFrame({"row_key": keys[has], "starts": [starts[ends[i] : ends[i + 1]].tobytes() for i in has]})

    return answers.groupBy("chunk").applyInPandas(gather, "row_key bigint, starts binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each document: ``row`` (the input row), n_words, n_removed, kept (the words left, joined by single spaces) and the removed
    spans (start and end in words).

    ``docs`` has doc_id (a whole number) and text; words stand between ASCII white space and are compared as they are. A word goes when
    it is covered by ``window`` consecutive words that also start in a document with a smaller doc_id; windows are judged on the input.
    A null text has no words and a null id comes after all others; rows with one id count as one document, so they don't remove each
    other's words. Empty tables give no rows."""
    if window < WINDOW:
        raise ValueError(f"anchors are found in windows of {WINDOW} words and more")
    spark = docs.sparkSession
    parts = parts_for(spark, total_chars(docs), CHARS_PER_PART)
    order = F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    # the texts are dealt out once, by a key that keeps copies apart; all three passes read that one exchange
    keyed = (
        docs.select(F.struct("*").alias("row"))
        .withColumn("row_key", F.xxhash64("row.text", order))
        .withColumn("order_id", order)
        .repartition(parts, "row_key")
        .sortWithinPartitions("row_key")
    )
    shared = _per_document(shared_places(_send_anchors(keyed, parts), KEY_BYTES))
    shared = shared.groupBy("row_key").agg(F.max("anchors").alias("anchors"))
    near = keyed.join(shared, "row_key")
    repeats = _removed(_least_places(_send_windows(near, parts, window)))
    repeats = repeats.groupBy("row_key").agg(F.first("starts").alias("starts"))
    joined = keyed.join(repeats, "row_key", "left")
    row_type = joined.schema["row"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            rows = batch.column("row")
            counts, gone, kept, spans = [], [], [], []
            for text, starts in zip(texts(batch), batch.column("starts").to_pylist(), strict=True):
                words = blank_words(text)
                covered = _spread(np.frombuffer(starts or b"", "<u4").astype(np.int64), 0, window - 1, len(words))
                counts.append(len(words))
                gone.append(int(covered.sum()))
                kept.append(b" ".join([w for w, c in zip(words, covered, strict=True) if not c]) if gone[-1] else b" ".join(words))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                spans.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span)],
                names=["row", "n_words", "n_removed", "kept", "spans"],
            )

    return joined.mapInArrow(cut, f"row {row_type}, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint>>")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT run, min(doc_id) AS first_id FROM runs GROUP BY 1),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(range(i, i + 13)) AS p FROM runs JOIN firsts USING (run) WHERE first_id < doc_id)),
kept AS (
  SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) a
  LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p WHERE g.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op8_recompress", SQL)
def op8_recompress(spark, sf):
    kept = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
