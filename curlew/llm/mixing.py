"""Mixing sources to target weights.

Every source's words are packed end to end into blocks of ``block`` words. The mix is a row of slots, one block each, cut into output
shards of ``shard_slots``. Slots are dealt to places by one pseudorandom permutation of all slots: the source counts of a shard are a
multinomial draw at the target weights, conditioned on totals that meet every source's target to the word. The slots of a source walk
through its blocks along a pseudorandom permutation, one per pass over the source, and blocks and slots meet in an equi-join on
(source, block). Permutations are computed per index ("swap or not" shuffles), so nothing is sorted or collected.

Only DataFrame functions are used. Word positions come from two-level running sums over (source, hash bucket), so a source that holds a
third of all rows is spread over its buckets; slots are made in runs of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curlew.llm.registry import query, table
from curlew.session import store

BLOCK, SHARD_SLOTS, MOST_PASSES = 128, 1024, 3
BUCKETS = 4096  # per source; a bucket holds a 4096th of the source's documents
RUN = 4096  # slots made by one row
ROUNDS = 24  # of a swap-or-not shuffle
WEIGHTS = (5, 2, 1)
_BLANKS = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def shuffled(index: Column, size: Column, *key: Column) -> Column:
    """Image of ``index`` under a pseudorandom permutation of 0 .. size-1 that belongs to ``key`` (swap-or-not shuffle)."""

    def step(at: Column, turn: Column) -> Column:
        other = F.pmod(F.xxhash64(turn, F.lit("turn"), *key), size)
        partner = F.pmod(other - at, size)
        swap = F.xxhash64(F.greatest(at, partner), turn, *key).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), index.cast("bigint"), step)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_PASSES) -> DataFrame:
    """Add rank and target to (source, size): ``share`` of all words by weight, none above ``most`` times its size.

    Sources by code point, null last, take the weights in turn. With sources in the order of size per weight, the capped ones come
    first, and the others share what is left."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(by_name).cast("bigint") - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", F.col("size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = ranked.withColumn("level", left / heavy)
    level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("cap_order", "level"))).over(whole)
    levelled = levelled.withColumn("cap_order", F.row_number().over(by_cap))
    return levelled.withColumn("open", level).select(
        "source", "rank", "size", F.coalesce(F.least("cap", F.col("open.level") * F.col("weight")), "cap").alias("target")
    )


def _positions(docs: DataFrame, weights: tuple[int, ...], share: float) -> tuple[DataFrame, DataFrame]:
    """The source table, and the documents with their source's rank and the first word's position in the source."""
    sized = (
        docs.select(F.struct("*").alias("row"))
        .withColumn("size", word_count(F.col("row.text")))
        .withColumn("mix", F.xxhash64("row.doc_id", "row.text"))
        .withColumn("bucket", F.pmod("mix", F.lit(BUCKETS)))
    )
    buckets = store(
        sized.groupBy(F.col("row.source").alias("source"), "bucket").agg(F.sum("size").alias("words")), "mix-buckets"
    )
    sources = store(targets(buckets.groupBy("source").agg(F.sum("words").alias("size")), weights, share), "mix-sources")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    offsets = offsets.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).select(
        F.col("source").alias("name"), F.col("bucket").alias("in_bucket"), "offset", "rank", F.col("size").alias("source_size"), "target"
    )
    joined = sized.join(offsets, F.col("row.source").eqNullSafe(F.col("name")) & (F.col("bucket") == F.col("in_bucket")))
    order = Window.partitionBy("rank", "bucket").orderBy("mix", "row.doc_id", "size")
    placed = joined.withColumn("nth", F.row_number().over(order)).withColumn(
        "first", F.col("offset") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    return sources, placed.select("row", "size", "rank", "bucket", "nth", "source_size", "target", "first")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.0,
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 0,
) -> DataFrame:
    """The pieces of the mix: shard, slot and part (the order inside the output), doc_id and source of the document, size, source_size, target,
    start, n_words and words (the piece's words, joined by spaces).

    ``docs`` has doc_id, source and text. Words are what stands between ASCII white space; a null text has none and a null source is a
    source. A document of which nothing is taken has one row without shard and slot and with n_words 0, so each document can be
    counted. A source's pieces make up its target to the word (rounded down); none is passed over more than ceil(target / size) times.
    Rows that agree in everything share their place in the order; an empty table gives no rows."""
    sources, placed = _positions(docs, weights, share)
    blocks = F.ceil(F.col("size") / block).cast("bigint")
    wanted = F.floor(F.col("target") + 1e-6).cast("bigint")
    passes = F.floor(F.col("wanted") / F.col("size"))
    rest = F.col("wanted") - F.col("passes") * F.col("size")
    # the last pass takes blocks in its permuted order until the target is met: at most ceil(rest / block) + 1 of them
    plan = (
        sources.filter("size > 0")
        .withColumn("blocks", blocks)
        .withColumn("wanted", wanted)
        .withColumn("passes", passes)
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.least(F.ceil(rest / block) + 1, F.col("blocks")))
        .withColumn("short", F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("passes")), lambda turn: _place_of_last(turn, seed)))
    )
    runs = plan.withColumn("from", F.explode(F.expr(f"sequence(0L, CAST(slots AS BIGINT), {RUN}L)"))).filter("`from` < slots")
    # runs are few bytes and much work: a number of partitions keeps the adaptive planner from joining them into one task
    runs = runs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "from")
    slots = runs.withColumn("nth_slot", F.explode(F.expr(f"sequence(`from`, least(`from` + {RUN - 1}L, CAST(slots AS BIGINT) - 1))")))
    turn = F.floor(F.col("nth_slot") / F.col("blocks"))
    step = F.pmod("nth_slot", "blocks")
    slots = slots.withColumn("block", shuffled(step, F.col("blocks"), F.col("rank"), turn, F.lit(seed)))
    # only the last block of a source is short: words before a slot follow from where the pass meets it
    last_len = F.col("size") - (F.col("blocks") - 1) * block
    length = F.when(F.col("block") == F.col("blocks") - 1, last_len).otherwise(F.lit(block))
    short_at = F.get("short", turn.cast("int"))
    before = turn * F.col("size") + step * block - F.when(step > short_at, block - last_len).otherwise(0)
    slots = slots.withColumn("use", F.least(length, F.col("wanted") - before)).filter("use > 0")
    totals = plan.select("rank", F.coalesce(F.sum("slots").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("slots").over(Window.partitionBy()).alias("all"))
    placed_slots = (
        slots.select("rank", "block", "nth_slot", "use")
        .join(totals, "rank")
        .withColumn("place", shuffled(F.col("base") + F.col("nth_slot"), F.col("all").cast("bigint"), F.lit("place"), F.lit(seed)))
        .select("rank", "block", "use", F.floor(F.col("place") / shard_slots).alias("shard"), F.pmod("place", F.lit(shard_slots)).alias("slot"))
    )
    end = F.col("first") + F.col("size")
    # a document's words are cut into pieces before these are dealt out, so each word travels once per use
    listed = F.filter(F.split("row.text", _BLANKS, -1), lambda w: w != "")
    pieces = placed.select("*", "row.doc_id", "row.source", listed.alias("listed")).drop("row")
    pieces = pieces.withColumn(
        "block",
        F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first") / block), F.floor((end - 1) / block)))),
    )
    pieces = pieces.withColumn("from", F.greatest(F.col("first"), F.col("block") * block) - F.col("block") * block).withColumn(
        "to", F.least(end, (F.col("block") + 1) * block) - F.col("block") * block
    )
    taken = F.when(F.col("use").isNotNull(), F.greatest(F.lit(0), F.least("to", "use") - F.col("from")))
    start = F.col("block") * block + F.col("from") - F.col("first")
    pieces = pieces.withColumn("start", start)
    whole = F.slice("listed", (F.col("start") + 1).cast("int"), F.greatest(F.lit(0), F.col("to") - F.col("from")).cast("int"))
    pieces = pieces.withColumn("piece", F.array_join(whole, " ")).drop("listed")
    cut = F.array_join(F.slice(F.split("piece", " "), F.lit(1), F.col("n_words").cast("int")), " ")
    # many slots come from few bytes of runs, so no estimate knows their size, and a broadcast would gather them all in the driver
    return (
        pieces.join(placed_slots.hint("merge"), ["rank", "block"], "left")
        .withColumn("n_words", F.coalesce(taken, F.lit(0)).cast("bigint"))
        .select(
            F.when(F.col("n_words") > 0, F.col("shard")).alias("shard"),
            F.when(F.col("n_words") > 0, F.col("slot")).alias("slot"),
            F.col("from").alias("part"),
            "doc_id",
            "source",
            "rank",
            "bucket",
            "nth",
            "size",
            "source_size",
            "target",
            "start",
            "n_words",
            F.when(F.col("n_words") == F.col("to") - F.col("from"), F.col("piece")).when(F.col("n_words") > 0, cut).alias("words"),
        )
    )


def _place_of_last(turn: Column, seed: int) -> Column:
    """Step at which a pass meets the source's last block: the shuffle undone, its rounds from the last to the first."""
    size, key = F.col("blocks"), (F.col("rank"), turn, F.lit(seed))

    def step(at: Column, back: Column) -> Column:
        other = F.pmod(F.xxhash64(back, F.lit("turn"), *key), size)
        partner = F.pmod(other - at, size)
        swap = F.xxhash64(F.greatest(at, partner), back, *key).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.array(*[F.lit(i) for i in reversed(range(ROUNDS))]), size - 1, step)


def taken_per_document(mix: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken, a row for each document."""
    return (
        mix.groupBy("rank", "bucket", "nth", "doc_id", "size", "source_size", "target")
        .agg(F.sum("n_words").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


@query("op1_mix")
def op1_mix(spark, sf):
    return taken_per_document(mix_sources(table(spark, sf, "documents").select("doc_id", "source", "text")))
