"""Secret scan: candidates by form, false positives removed by a random forest.

A candidate is a run of at least 12 letters, digits and the marks ``_ + / -`` with a letter and a digit, or what is assigned to a telling
name (``password=``, ``"token": "``), from 6 characters on and whatever they are. A forest judges it by its length, the
transitions between kinds of characters, the share of it that words of the corpus cover, the path it may be part of, and the words next to
it. The forest is trained on labelled findings. Where none are given, candidates that rules can tell label themselves: keys of a known
form and values assigned to a telling name are secrets; identifiers, dates and candidates made of words are not. Secrets, identifiers and
dates that a rule is certain of, and values with a given label, keep that verdict; the rest is left to the forest.

Only DataFrame and ML pipeline functions are used. Candidates are few against the text; the corpus is read again to count the texts in which
the words that occur in candidates stand outside of them. Copies of a text count once.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curlew.llm.personal import matches
from curlew.llm.registry import query, table
from curlew.session import store

_NAME = r"(?:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth|credential)"
#: The value stands close behind its name (cheaper conditions come first); one in a query string ends where the next parameter begins.
ASSIGNED = rf"(?<=[=:\s\"'])(?<=[=:]\s{{0,3}}[\"']?)(?<=(?i:{_NAME})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?)(?:[^\s\"'<>,;&=:.!?)]|(?<=[^\s\"'])[=:]|[.!?)](?=[^\s\"'<>,;])|&(?![A-Za-z0-9_]++=)){{6,}}+"
BY_FORM = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{12,}+={0,2}"
CANDIDATE = f"{ASSIGNED}|{BY_FORM}"
#: Forms of keys with a published prefix.
KNOWN_FORMS = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"
TELLING_NAME = rf"(?i){_NAME}[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?$"
IDENTIFIER = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}.*|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]+[a-z]{1,3}|[a-z]+[0-9]{1,4})$"
LABELLED = 20_000  # distinct findings that train the forest, drawn by a digest, up to half of them of each class
CONTEXTS = 8  # of one value that may train
TREES, DEPTH, SEED = 20, 6, 7
LEAST_COUNT = 5  # distinct texts that make a run of letters a word,
LEAST_SHARE = 1e-5  # or this share of all distinct texts, where that is more
CUT = 0.5
MASK = "[SECRET]"
_KINDS = {"l": "[a-z]", "u": "[A-Z]", "d": "[0-9]", "m": "[_+/-]"}
NUMBERS = ["length", "covered", "vowels", "distinct", "slashes", "in_path", "assigned", "quoted", "digits", *[f"{a}{b}" for a in _KINDS for b in _KINDS]]


def _candidates(docs: DataFrame) -> DataFrame:
    """(row_key, n, start, end, value, before, after) of each candidate, the ``n``-th of its text from 0; before and after are up to 60 code points of text."""
    text = F.col("text")
    between = F.split(text, CANDIDATE, -1)
    found = matches(text, CANDIDATE)
    # the text between two candidates: its end stands before the second, its beginning behind the first
    sides = F.transform(between, lambda g: F.struct(F.right(g, F.lit(60)).alias("before"), F.left(g, F.lit(60)).alias("after")))
    rows = docs.filter(text.rlike(CANDIDATE)).select("row_key", found.alias("found"), sides.alias("sides"))
    rows = rows.select("row_key", F.posexplode("found").alias("n", "c"), "sides")
    return rows.select(
        "row_key",
        "n",
        "c.start",
        "c.end",
        "c.value",
        F.get("sides", F.col("n"))["before"].alias("before"),
        F.get("sides", F.col("n") + 1)["after"].alias("after"),
    )


def _covered(values: DataFrame, docs: DataFrame, least: int, share: float) -> DataFrame:
    """(value, covered): the share of each value that stands in words of the corpus, by runs of three letters and more.

    A word stands outside candidates in at least ``least`` distinct texts and in ``share`` of them."""
    runs = values.select("value", F.explode(F.regexp_extract_all("value", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.lower("run"))
    wanted = store(runs.select("run").distinct(), "secret-runs")
    texts = docs.filter("text <> ''").select(F.xxhash64("text").alias("text_key"), F.regexp_replace("text", CANDIDATE, " ").alias("text"))
    n_texts = docs.filter("text <> ''").select(F.count_distinct(F.xxhash64("text")).alias("n")).first().n
    words = texts.select("text_key", F.explode(F.array_distinct(F.split(F.lower("text"), r"[\s!-/:-@\[-`{-~]+"))).alias("run")).filter(F.length("run") >= 3)
    # a pair per word and text, then sums in each task: no word's texts meet in one place
    pairs = words.join(wanted, "run").groupBy("run", "text_key").agg(F.lit(1).alias("one"))
    known = pairs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(least, share * n_texts))
    sums = runs.join(known.select("run"), "run").groupBy("value").agg(F.sum(F.length("run")).alias("letters"))
    return sums.select("value", F.least(F.lit(1.0), F.col("letters") / F.length("value")).alias("covered"))


def _described(candidates: DataFrame) -> DataFrame:
    """Add the forest's numbers and the neighbouring words to candidates with ``covered``."""
    value = F.col("value")

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / F.length(value)

    rows = candidates.select(
        "*",
        F.length(value).cast("double").alias("length"),
        share("[aeiouAEIOU]").alias("vowels"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.length(value)).alias("distinct"),
        share("/").alias("slashes"),
        (F.col("before").rlike(r"[/.:@]$") | F.col("after").rlike(r"^[/.@]")).cast("double").alias("in_path"),
        F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double").alias("assigned"),
        F.col("before").rlike("[\"']$").cast("double").alias("quoted"),
        share("[0-9]").alias("digits"),
        *[share(f"{a}(?={b})").alias(f"{x}{y}") for x, a in _KINDS.items() for y, b in _KINDS.items()],
    )
    return rows.withColumns(
        {
            "previous": F.lower(F.regexp_extract("before", r"([A-Za-z_]+)[^A-Za-z_]*$", 1)),
            "next": F.lower(F.regexp_extract("after", r"^[^A-Za-z_]*([A-Za-z_]+)", 1)),
        }
    )


def certain_label() -> Column:
    """1 or 0 where a rule decides by itself, else null."""
    value = F.col("value")
    named = F.col("before").rlike(TELLING_NAME)
    secret = value.rlike(KNOWN_FORMS) | (named & (F.col("covered") < 0.5))
    return F.when(secret, 1.0).when(value.rlike(IDENTIFIER) & ~named, 0.0)


def self_label() -> Column:
    """1 or 0 where a rule can tell, else null."""
    return F.coalesce(certain_label(), F.when((F.col("covered") >= 0.6) | (F.col("in_path") == 1), 0.0))


def _training(known: DataFrame, labelled: int) -> tuple[DataFrame, list[float]]:
    """(label, features, weight) of distinct findings, and the labels there are; classes weigh alike.

    Of a value, at most CONTEXTS contexts stay. A class gives all of its findings, or about half of ``labelled`` and at least one."""
    context = F.xxhash64("value", "previous", "next", "in_path", "assigned", "quoted")
    rows = known.select("label", "value", "features", context.alias("context"))
    # copies and the contexts of a common value combine in each task
    rows = rows.groupBy("label", "value", F.pmod("context", F.lit(CONTEXTS)).alias("slot")).agg(F.min_by("features", "context").alias("features"))
    rows = store(rows.withColumn("draw", F.pmod(F.xxhash64("value", "slot"), F.lit(1 << 30))), "secret-findings")
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).collect()
    share = {r.label: min(1.0, labelled / 2 / r.n) for r in found}
    total = sum(r.n * share[r.label] for r in found)
    drawn, weight = F.lit(False), F.lit(None).cast("double")
    for r in found:
        own = F.col("label") == r.label
        drawn |= own & (F.col("draw") < max(share[r.label] * (1 << 30), r.least + 1))
        weight = F.when(own, total / 2 / (r.n * share[r.label])).otherwise(weight)
    return rows.filter(drawn).select("label", "features", weight.alias("weight")), [r.label for r in found]


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, cut: float = CUT, labelled: int = LABELLED) -> DataFrame:
    """For each document: ``row`` (the input row), secrets (array of start, end, value, score, in code points) and redacted (the text
    with each secret replaced at its place).

    ``docs`` has doc_id and text. ``findings`` has value and is_secret (1 or 0) and trains the forest instead of the rules. Of each class
    at most about half of ``labelled`` distinct findings (value and context) train it, all if there are fewer; all candidates are judged,
    and given labels and certain rules stand. With labels of one class only, or none, that class, or the rules with doubt left as no
    secret, decide. A null text has no secrets and stays null. Repeated rows get equal results; an empty table
    gives no rows."""
    keyed = docs.select(F.struct("*").alias("row")).withColumn("row_key", F.xxhash64("row.doc_id", "row.text"))
    plain = keyed.select("row_key", F.coalesce("row.text", F.lit("")).alias("text"))
    candidates = store(_candidates(plain), "secret-candidates")
    covered = _covered(candidates.select("value").distinct(), plain, LEAST_COUNT, LEAST_SHARE)
    rows = candidates.join(covered, "value", "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    rows = _described(rows)
    if findings is not None:
        given = findings.filter("value IS NOT NULL AND is_secret IS NOT NULL").groupBy("value").agg(F.max("is_secret").cast("double").alias("label"))
        rows = rows.join(given, "value", "left").withColumn("verdict", F.col("label"))
    else:
        rows = rows.withColumns({"label": self_label(), "verdict": certain_label()})
    hashed = FeatureHasher(inputCols=["previous", "next"], outputCol="neighbours", numFeatures=128).transform(rows.fillna("", ["previous", "next"]))
    rows = store(VectorAssembler(inputCols=[*NUMBERS, "neighbours"], outputCol="features").transform(hashed).drop("neighbours"), "secret-rows")

    sample, labels = _training(rows.filter("label IS NOT NULL"), labelled)
    if len(labels) == 2:
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        judged = forest.fit(sample).transform(rows).withColumn("score", F.coalesce("verdict", vector_to_array("probability")[1]))
    elif labels and findings is not None:
        judged = rows.withColumn("score", F.lit(float(labels[0])))
    else:
        judged = rows.withColumn("score", F.coalesce("label", F.lit(0.0)))
    # all candidates of the rows that hold a secret, by their number in the text
    judged = judged.select("row_key", F.struct("n", "start", "end", "value", "score").alias("found"))
    found = judged.groupBy("row_key").agg(F.array_sort(F.collect_set("found")).alias("found")).filter(F.exists("found", lambda c: c["score"] >= cut))
    joined = keyed.join(store(found, "secrets"), "row_key", "left")
    kept = F.transform(F.filter("found", lambda c: c["score"] >= cut), lambda c: F.struct(c["start"], c["end"], c["value"], c["score"]))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,score:double>>")
    # the text between the candidates and each candidate or the mask, place by place: what stands elsewhere stays as it is
    between = F.split("row.text", CANDIDATE, -1)
    masked = F.transform("found", lambda c: F.when(c["score"] >= cut, F.lit(MASK)).otherwise(c["value"]))
    pieces = F.transform(between, lambda text, i: F.concat(text, F.coalesce(F.get(masked, i), F.lit(""))))
    return joined.select(
        "row",
        F.when(F.col("found").isNull(), none).otherwise(kept).alias("secrets"),
        F.when(F.col("found").isNull(), F.col("row.text")).otherwise(F.array_join(pieces, "")).alias("redacted"),
    )


@query("op6_secrets")
def op6_secrets(spark, sf):
    found = find_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id",
        F.size("secrets").cast("bigint").alias("n_secrets"),
        F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
        F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"),
    )
