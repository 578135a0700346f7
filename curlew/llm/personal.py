"""Personal data by patterns and by bootstrapped contexts.

Four kinds are found by their form: e-mail addresses, IPv4 addresses, card numbers and phone numbers. They are the seeds of a second search.
Every word with a digit or an at sign is a possible identifier; the words before it are its patterns. Patterns and values form a graph:
a pattern is as good for a kind as the share of its values known to be of that kind, a value as good as its patterns. In each round good
patterns, met with enough different known values, make new values known. Occurrences of such values that no seed covers are added.

Only DataFrame functions are used. Expressions on a text run in time linear in its length: every search begins where a run of its
characters begins, and repeated groups have a bounded or fixed shape. Counts over patterns and values are summed per task first, so a
pattern such as a very common word costs one row per task and value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curlew.llm.registry import query, table
from curlew.session import store

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 2
LEAST_VALUES = 5  # different known values a pattern must have been met with
GOOD_PATTERN, GOOD_VALUE = 0.8, 0.8
_LABEL = "[A-Za-z0-9-]"
#: The same matches as ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` and so on, stated without re-reading or recursion.
EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@{_LABEL}++\.{_LABEL}++(?:(?!\.(?!{_LABEL}))[A-Za-z0-9.-])*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A word with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_SPAN = "struct<start:bigint,end:bigint,value:string>"


def matches(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value), in code points: the texts between them give their places."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    cells = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).cast("bigint").alias("g")))

    def place(state: Column, cell: Column) -> Column:
        start = state["at"] + cell["g"]
        end = start + F.length(cell["m"])
        span = F.struct(start.alias("start"), end.alias("end"), cell["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
    return F.aggregate(cells, empty, place, lambda state: state["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a number pass the Luhn check."""
    digits = F.split(F.reverse(_digits(value)), "")

    def weighed(digit: Column, place: Column) -> Column:
        n = digit.cast("int")
        double = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when(place % 2 == 1, double).otherwise(n)

    total = F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), weighed), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _of_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """array of (kind, start, end, value) by kind, then start."""
    checks = {
        "email": (EMAIL, F.contains(text, F.lit("@")), lambda s: F.lit(True)),
        "ip": (IP, F.contains(text, F.lit(".")), lambda s: s["value"].rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")),
        "card": (CARD, F.lit(True), lambda s: luhn(s["value"])),
        "phone": (PHONE, F.contains(text, F.lit("+")), lambda s: F.length(_digits(s["value"])).between(8, 15)),
    }
    none = F.array().cast(f"array<{_SPAN}>")
    kinds = []
    for kind in KINDS:
        pattern, may, check = checks[kind]
        spans = F.filter(F.when(may, matches(text, pattern)).otherwise(none), check)
        kinds.append(_of_kind(spans, kind))
    return F.concat(*kinds)


def _tokens(text: Column) -> Column:
    """Words with a digit or an at sign as (start, end, value, before): ``before`` is the text's last two words in front."""
    found, between = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1)
    before = F.transform(F.slice(between, F.lit(1), F.size(found)), lambda g: F.regexp_extract(F.right(g, F.lit(80)), r"(\S+(?:\s+\S+)?)\s*$", 1))
    return F.zip_with(matches(text, TOKEN), before, lambda s, b: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lower(b).alias("before")))


def _occurrences(found: DataFrame) -> DataFrame:
    """(row_key, value, start, end, kind, patterns) of each token: trimmed of punctuation; kind where a seed covers it."""
    token = F.col("token")
    lead = F.length(F.regexp_extract(token["value"], "^[^A-Za-z0-9+@]*", 0))
    value = F.regexp_extract(token["value"], "^[^A-Za-z0-9+@]*(.*?)[^A-Za-z0-9]*$", 1)
    covering = F.filter("base", lambda b: (b["start"] < token["end"]) & (b["end"] > token["start"]))
    rows = found.withColumn("token", F.explode("tokens"))
    rows = rows.select(
        "row_key",
        value.alias("value"),
        (token["start"] + lead).alias("start"),
        (token["start"] + lead + F.length(value)).alias("end"),
        F.get(covering, F.lit(0))["kind"].alias("kind"),
        F.get(covering, F.lit(0))["value"].alias("seed"),
        F.array_distinct(F.array(token["before"], F.element_at(F.split(token["before"], r"\s+"), -1))).alias("patterns"),
    )
    return rows.filter(F.length(F.coalesce("seed", "value")) >= 5).withColumn("patterns", F.filter("patterns", lambda p: p != ""))


def _learn(occurrences: DataFrame, rounds: int) -> DataFrame:
    """(value, kind) of the values that good patterns make known and no seed has."""
    met = occurrences.select(F.explode("patterns").alias("pattern"), F.coalesce("seed", "value").alias("value"), "kind")
    met = store(met.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("seed_kind")), "context-graph")
    seeds = met.filter("seed_kind IS NOT NULL").select("value", F.col("seed_kind").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    seeds = store(seeds.dropDuplicates(["value"]), "context-seeds")
    totals = met.groupBy("pattern").agg(F.sum("n").alias("total"))
    known, learned = seeds, None
    for _ in range(rounds):
        by_kind = met.join(known, "value").groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("score")).alias("mass"), F.count(F.lit(1)).alias("values")
        )
        good = by_kind.filter(F.col("values") >= LEAST_VALUES).join(totals, "pattern")
        good = good.withColumn("trust", F.col("mass") / (F.col("total") + 1)).filter(F.col("trust") >= GOOD_PATTERN)
        reached = met.filter("seed_kind IS NULL").join(good.select("pattern", "kind", "trust"), "pattern")
        scored = reached.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("score"))
        best = scored.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("best")).select("value", "best.kind", "best.score")
        learned = store(best.filter(F.col("score") >= GOOD_VALUE).join(seeds.select("value"), "value", "left_anti"), "context-learned")
        known = seeds.unionByName(learned)
    return learned.select("value", "kind")


def _joined(spans: Column) -> Column:
    """kind:start:end of spans, by kind as listed, then start."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(
        spans, lambda s: F.struct(F.array_position(order, s["kind"]), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """For each document: ``row`` (the input row), base and added: arrays of (kind, start, end, value) in code points.

    ``docs`` has doc_id and text; a null or empty text has no spans. Base spans are those the four forms give and pass their checks;
    added ones come from contexts, are of the kind of the pattern, and never touch base spans. Repeated rows get equal results, and
    their contexts count as often as they occur. Without seeds nothing is added; an empty table gives no rows."""
    text = F.coalesce("row.text", F.lit(""))
    keyed = docs.select(F.struct("*").alias("row")).withColumn("row_key", F.xxhash64("row.doc_id", "row.text"))
    found = keyed.select("row_key", text.alias("text")).filter(F.col("text").rlike("[0-9@]"))
    found = found.select("row_key", base_spans(F.col("text")).alias("base"), _tokens(F.col("text")).alias("tokens"))
    found = store(found, "personal")
    occurrences = store(_occurrences(found), "personal-tokens")
    learned = _learn(occurrences, rounds)
    added = occurrences.filter("kind IS NULL").join(learned.withColumnRenamed("kind", "as"), "value")
    span = F.struct(F.col("as").alias("kind"), "start", "end", "value")
    added = added.groupBy("row_key").agg(F.collect_set(span).alias("added"))
    spans = found.dropDuplicates(["row_key"]).select("row_key", "base").join(added, "row_key", "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    return keyed.join(spans, "row_key", "left").select("row", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


@query("op9_personal")
def op9_personal(spark, sf):
    found = personal_data(table(spark, sf, "documents").select("doc_id", "text"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "row.doc_id",
        *counts,
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
    )
