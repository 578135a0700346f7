"""Quality classifier by co-training of two views.

One classifier sees only the text (its characters, its words and how they repeat), the other only the metadata of the page (language, source,
stated length). Both start from the labelled documents. In each round each of them labels the unlabelled documents it is surest of, as
many of either class as the labels would let expect, and these train the other. At the end both views are calibrated on labelled documents
that trained neither, and a last regression on the two calibrated views gives the score of every document.

Fitting uses at most ``LABELLED`` labelled and ``UNLABELLED`` other documents, drawn by a digest of their id; all documents are scored.
Features are computed where the documents are; the model is a few hundred numbers.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.llm.decontaminate import plain_words
from curlew.llm.registry import query, table
from curlew.llm.words import texts
from curlew.session import store

LABELLED, UNLABELLED = 12_000, 6_000
ROUNDS, PER_ROUND = 3, 0.03  # share of the unlabelled documents that a view labels in a round
SURE = 0.95
WORD_BITS, CHOSEN_WORDS = 16, 400
META_BITS = 8
KEEP = 0.5
CACHED_WORDS = 200_000
#: Classes of bytes (blank, digit, upper case, lower case, mark, beyond ASCII).
_CLASS = np.array([0 if b in b" \t\n\r\x0b\x0c" else 1 if 48 <= b < 58 else 2 if 65 <= b < 91 else 3 if 97 <= b < 123 else 5 if b > 127 else 4 for b in range(256)])


class WordPlaces(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = zlib.crc32(word) & ((1 << WORD_BITS) - 1)
        return value


def text_style(text: bytes | None) -> list[float]:
    """Numbers that describe how a text is written."""
    data = np.frombuffer(text or b"", np.uint8)
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASS, counts, 6)
    words, size = (text or b"").split(), max(len(data), 1)
    letters = max(kinds[2] + kinds[3] + kinds[5], 1)
    lines = (text or b"").split(b"\n")
    return [
        math.log1p(len(words)),
        len(data) / max(len(words), 1) / 10,
        kinds[2] / letters,
        kinds[1] / size,
        kinds[4] / size,
        counts[ord("!")] / max(len(words), 1),
        counts[ord("|")] / max(len(words), 1),
        len(set(words)) / math.sqrt(max(len(words), 1)) / 10,
        1 - len(set(words)) / max(len(words), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(max(map(len, words), default=0)),
        float(not words),
    ]


STYLE = 12


def text_words(text: bytes | None, places: WordPlaces) -> np.ndarray:
    """Numbers of the different words of a text."""
    if len(places) > CACHED_WORDS:
        places.clear()
    return np.array(sorted({places[w] for w in plain_words(text)}), np.int32)


def page_places(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Numbers of the metadata: language, source, and the stated length in steps of a factor of 1.5."""
    step = "none" if n_chars is None else str(round(math.log(max(n_chars, 0) + 1) / math.log(1.5)))
    parts = (f"lang:{lang}", f"source:{source}", f"length:{step}", f"lang-length:{lang}:{step}")
    return [zlib.crc32(p.encode()) & ((1 << META_BITS) - 1) for p in parts]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last one is the offset) by Newton's method; the classes weigh equally."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = logistic(x @ w)
        change = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w += change
        if np.abs(change).max() < 1e-6:
            break
    return w


@dataclass
class View:
    """A classifier of one view: standardised inputs, weights, and the calibration of its output."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    slope: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.weights = fit_logistic((x - self.mean) / self.spread, y, 5.0)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.spread) @ self.weights[:-1] + self.weights[-1], -20, 20)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> View:
        self.slope = fit_logistic(self.raw(x)[:, None], y, 0.1)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) * self.slope[0] + self.slope[1]


@dataclass
class Model:
    chosen: np.ndarray
    text: View
    page: View
    both: np.ndarray

    def text_inputs(self, style: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([style, incidence(words, self.chosen)])

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(text), self.page.logit(page)
        return logistic(a), logistic(b), logistic(self.both[0] * a + self.both[1] * b + self.both[2])


def incidence(words: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), len(chosen)), np.float32)
    for i, own in enumerate(words):
        at = np.searchsorted(chosen, own)
        at[at == len(chosen)] = 0
        if len(chosen):
            out[i, at[chosen[at] == own]] = 1
    return out


def page_inputs(places: list) -> np.ndarray:
    out = np.zeros((len(places), 1 << META_BITS), np.float32)
    for i, own in enumerate(places):
        out[i, own] = 1
    return out


def telling_words(words: list[np.ndarray], y: np.ndarray, most: int = CHOSEN_WORDS) -> np.ndarray:
    """Words whose presence depends most on the class (chi square), in at least three documents."""
    size = 1 << WORD_BITS
    held = [np.bincount(np.concatenate([w for w, c in zip(words, y, strict=True) if c == k] or [np.zeros(0, int)]), minlength=size) for k in (0, 1)]
    n = [max((y == k).sum(), 1) for k in (0, 1)]
    total = held[0] + held[1]
    expected = total * n[1] / (n[0] + n[1])
    rest = total - expected
    chi = np.where(total >= 3, (held[1] - expected) ** 2 / np.maximum(expected, 1e-9) + (held[0] - rest) ** 2 / np.maximum(rest, 1e-9), 0)
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(best[chi[best] > 10.8]).astype(np.int32)


def co_train(frame: pd.DataFrame, rounds: int = ROUNDS) -> Model | None:
    """Fit from rows (key, good: 1, 0 or null, style, words, page). None where there are not both classes."""
    frame = frame.sort_values("key", kind="stable").reset_index(drop=True)
    known = frame.good.notna().to_numpy()
    y = frame.good.fillna(0).to_numpy(float)
    fold = np.arange(len(frame)) % 5 == 0  # of the labelled ones: for calibration only
    train, held = known & ~fold, known & fold
    if min(len(set(y[train])), len(set(y[held]))) < 2:
        return None
    words = [np.asarray(w, np.int32) for w in frame.words]
    chosen = telling_words([w for w, t in zip(words, train, strict=True) if t], y[train])
    model = Model(chosen, View(), View(), np.array([1.0, 1.0, 0.0]))
    inputs = (model.text_inputs(np.stack(frame.style.to_numpy()).astype(np.float32), words), page_inputs(list(frame.page)))
    views = (model.text, model.page)
    labels = [np.where(train, y, np.nan), np.where(train, y, np.nan)]  # what trains the text view, the page view
    for _ in range(rounds + 1):
        for view, x, own in zip(views, inputs, labels, strict=True):
            at = ~np.isnan(own)
            view.fit(x[at], own[at]).calibrate(x[held], y[held])
        for teacher, (view, x) in enumerate(zip(views, inputs, strict=True)):
            pupil, p = labels[1 - teacher], logistic(view.logit(x))
            free = ~known & np.isnan(pupil)
            for side, sureness, share in ((1.0, p, y[train].mean()), (0.0, 1 - p, 1 - y[train].mean())):
                most = int(PER_ROUND * share * (~known).sum())
                order = np.flatnonzero(free & (sureness >= SURE))
                pupil[order[np.argsort(-sureness[order], kind="stable")[:most]]] = side
    logits = np.column_stack([view.logit(x[held]) for view, x in zip(views, inputs, strict=True)])
    model.both = fit_logistic(logits, y[held], 0.1)
    return model


FEATURES = "key bigint, good double, style array<double>, words array<int>, page array<int>"


def _features(docs: DataFrame) -> DataFrame:
    schema = pa.schema(
        [
            ("key", pa.int64()),
            ("good", pa.float64()),
            ("style", pa.list_(pa.float64())),
            ("words", pa.list_(pa.int32())),
            ("page", pa.list_(pa.int32())),
        ]
    )

    def run(batches):
        places = WordPlaces()
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                own = texts(some)
                pages = zip(*(some.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)
                columns = [
                    some.column("key"),
                    some.column("good"),
                    pa.array([text_style(t) for t in own], pa.list_(pa.float64())),
                    pa.array([text_words(t, places) for t in own], pa.list_(pa.int32())),
                    pa.array([page_places(*p) for p in pages], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, FEATURES)


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, rounds: int = ROUNDS) -> Model | None:
    """Fit on about ``labelled`` labelled and ``unlabelled`` other documents, drawn by a digest of the id."""
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    good = good.agg((F.min("quality") * (1 - F.max(F.coalesce("toxic", F.lit(0))))).cast("double").alias("good"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    totals = docs.select("doc_id").distinct().join(good, "doc_id", "left").agg(F.count("good").alias("known"), F.count(F.lit(1)).alias("all")).first()
    others = max(totals["all"] - totals.known, 1)
    limit = F.when(F.col("good").isNotNull(), F.lit(labelled / max(totals.known, 1))).otherwise(F.lit(unlabelled / others))
    ids = docs.select("doc_id").distinct().join(good, "doc_id", "left").filter(draw < limit * (1 << 30))
    drawn = store(ids.filter("doc_id IS NOT NULL"), "quality-drawn")  # as many ids as the two sizes say, so they can be broadcast
    named = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))
    drawn = named.join(F.broadcast(drawn), "doc_id")
    features = store(_features(drawn.withColumn("key", F.xxhash64("doc_id", "text")).drop("doc_id")), "quality-sample")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        model = co_train(frame, rounds)
        if model is None:
            return pd.DataFrame({"name": [], "data": []}, dtype=object)
        parts = {"chosen": model.chosen, "both": model.both}
        for name, view in (("text", model.text), ("page", model.page)):
            parts |= {f"{name}.{k}": getattr(view, k) for k in ("mean", "spread", "weights", "slope")}
        return pd.DataFrame({"name": list(parts), "data": [np.asarray(v, np.float64).tolist() for v in parts.values()]})

    rows = features.withColumn("sample", F.lit(1)).groupBy("sample").applyInPandas(fit, "name string, data array<double>").collect()
    parts = {r.name: np.array(r.data) for r in rows}
    if not parts:
        return None
    views = [View(*(parts[f"{name}.{k}"] for k in ("mean", "spread", "weights", "slope"))) for name in ("text", "page")]
    return Model(parts["chosen"].astype(np.int32), *views, parts["both"])


def score_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **sizes) -> DataFrame:
    """For each document: ``row`` (the input row), text_score, page_score, score (chances of being good) and keep.

    ``docs`` has doc_id, text, lang, source and n_chars; ``labels`` doc_id, quality and toxic: a document is good when its quality is 1 and it
    is not toxic; of several labels the worst counts, null quality is none, null toxic is 0. Null or empty texts and null metadata are
    values of their own. Repeated rows get equal scores. Without labelled documents of both classes all scores are null and every
    document is kept; an empty table gives no rows."""
    model = fit_quality(docs, labels, **sizes)
    rows = docs.select(F.struct("*").alias("row"))
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("row", none.alias("text_score"), none.alias("page_score"), none.alias("score"), F.lit(True).alias("keep"))
    pages = rows.withColumn("lang", F.col("row.lang")).withColumn("source", F.col("row.source")).withColumn("n_chars", F.col("row.n_chars").cast("bigint"))

    def run(batches):
        places = WordPlaces()
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                own = texts(some)
                text = model.text_inputs(np.array([text_style(t) for t in own]), [text_words(t, places) for t in own])
                page = page_inputs([page_places(*p) for p in zip(*(some.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)])
                scores = model.scores(text, page)
                columns = [some.column("row"), *(pa.array(s, pa.float64()) for s in scores), pa.array(scores[2] >= keep)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "text_score", "page_score", "score", "keep"])

    row_type = pages.schema["row"].dataType.simpleString()
    return pages.mapInArrow(run, f"row {row_type}, text_score double, page_score double, score double, keep boolean")


@query("op3_quality")
def op3_quality(spark, sf):
    scored = score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("row.doc_id", "text_score", "page_score", "score", "keep")
