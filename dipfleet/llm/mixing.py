"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipfleet.llm.common import checkpointed

#: A mix has one target row for each source; up to this many it is broadcast, beyond it is joined by shuffle.
BROADCAST_SOURCES = 10_000


#: Characters that are rare in prose: ASCII digits and punctuation.
MARKS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"


def words(text: str | Column) -> Column:
    """Runs of characters other than ASCII white space, as an array; empty for null."""
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_remove(F.split(body, "[\\x20\\x09-\\x0D]+"), "")


def quality_weight(text: str, said: Column) -> Column:
    """Weight in (0, 1] of a text and its words: less for many digits and marks a word, and for words said again and again.

    Prose of n words has well over 2 sqrt(n) different ones, so only repetition (or a text of a few words) lowers the
    second factor.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    marks = (F.length(body) - F.length(F.translate(body, MARKS, ""))).cast("double")
    n, different = F.size(said).cast("double"), F.size(F.array_distinct(said)).cast("double")
    return F.least(F.lit(1.0), (different * different + 1) / (4 * n + 1)) / (1 + marks / (n + 1))


def sampling_key(doc_id: str, text: str, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from a digest of id and text: the smallest keys are an exact weighted sample."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def with_keys(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    said = docs.withColumn("_said", words(text))
    keyed = said.withColumn("_size", F.size("_said").cast("long")).withColumn("_key", sampling_key(doc_id, text, quality_weight(text, F.col("_said")), seed))
    return keyed.withColumn("_id", F.col(doc_id).cast("long")).withColumn("_source", F.col(source).cast("string")).drop("_said")


def budgets(sized: DataFrame, weights: tuple[float, ...], epochs: int) -> DataFrame:
    """A row for each source: its words, its target, whole epochs and what is left of the target after them.

    Sources by code point, null last, weigh `weights` in turn and share all words; a target stops at `epochs` times
    its source and the excess is reshared by weight. In order of cap over weight the capped sources come first, so
    the level follows from prefix sums over the sources.
    """
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("_source_size"), F.count("*").alias("_rows"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = totals.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.col("_source_size") * F.lit(epochs))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("_source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("_level", level).withColumn("_capped", F.col("_cap") <= F.col("_w") * F.col("_level"))
    free = F.min(F.when(~F.col("_capped"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("level")))).over(everything)["level"]
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_w") * free)
    out = leveled.withColumn("_target", F.least(target, F.col("_cap").cast("double")))
    whole = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0))
    return out.withColumn("_epochs", F.least(whole, F.lit(epochs)).cast("long")).withColumn("_left", F.col("_target") - F.col("_epochs") * F.col("_source_size")).select("_source", "_source_size", "_rows", "_target", "_epochs", "_left")


def cuts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3, seed: int = 17, per_task: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The sized rows, and for each source the epochs, the last sampling key that the fractional epoch takes, how many
    rows have that key and how many of them it takes.

    Rows of one key (exact repeats) are one row with a count. Ranges of (source, key) of about `per_task` rows are cut
    where the keys lie, whatever their distribution; the sums of the ranges give prefix sums, and only ranges are sorted. So a
    source with any share of the rows is spread over many tasks.
    """
    sized = checkpointed(with_keys(docs.select(F.col(doc_id), F.col(text), F.col(source)), doc_id, text, source, seed).select("_id", "_source", "_size", "_key"))
    plan = checkpointed(budgets(sized, weights, epochs))
    tasks = max(1, -(-sized.count() // per_task))
    grouped = sized.groupBy("_source", "_key", "_size").agg(F.count("*").alias("_alike"))
    ranged = checkpointed(grouped.repartitionByRange(tasks, "_source", "_key", "_size").withColumn("_range", F.spark_partition_id()))
    words_in = F.col("_size") * F.col("_alike")
    sums = ranged.groupBy("_source", "_range").agg(F.sum(words_in).alias("_in"))
    run = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_in").over(run), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_inner", F.coalesce(F.sum(words_in).over(inside), F.lit(0)))
    placed = placed.join(sums, placed["_source"].eqNullSafe(sums["_s"]) & (placed["_range"] == sums["_r"])).drop("_s", "_r")
    rest = plan.select(F.col("_source").alias("_s"), "_left")
    placed = placed.join(_small(rest), placed["_source"].eqNullSafe(rest["_s"])).drop("_s").withColumn("_before", F.col("_base") + F.col("_inner"))
    # a row is taken while the middle of it lies within what is left
    n = F.floor((F.col("_left") - F.col("_before")) / F.col("_size") + 0.5).cast("long")
    over = 2 * (F.col("_before") + n * F.col("_size")) - F.col("_size") > 2 * F.col("_left")
    some = F.when(F.col("_size") > 0, F.least(F.col("_alike"), n - over.cast("long"))).when(F.col("_before") <= F.col("_left"), F.col("_alike")).otherwise(0)
    last = placed.withColumn("_some", some).where("_some > 0").groupBy("_source").agg(F.max(F.struct("_key", "_size", "_alike", "_some")).alias("_last"))
    cut = plan.join(last.withColumnRenamed("_source", "_s"), plan["_source"].eqNullSafe(F.col("_s")), "left").drop("_s")
    return sized, checkpointed(cut)


def _small(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def _apply(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Adds `_copies`. Of rows alike at a cut that takes only some of them, those numbered first are taken; they are numbered
    within the partitions that they lie in, which prefix sums of their counts put one after the other."""
    named = cut.withColumnRenamed("_source", "_s")
    joined = rows.join(_small(named), rows["_source"].eqNullSafe(named["_s"])).drop("_s")
    own, last = F.struct("_key", "_size"), F.struct("_last._key", "_last._size")
    fraction = (F.col("_left") > 0) & F.col("_last").isNotNull()
    split = F.coalesce(fraction & (own == last) & (F.col("_last._some") < F.col("_last._alike")), F.lit(False))
    whole = joined.withColumn("_chosen", F.coalesce(fraction & (own <= last), F.lit(False)))
    if not cut.where("_left > 0 and _last._some < _last._alike").isEmpty():
        alike = whole.where(split).withColumn("_part", F.spark_partition_id())
        counts = alike.groupBy("_source", "_part").agg(F.count("*").alias("_n"))
        run = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_base"))
        inside = F.row_number().over(Window.partitionBy("_source", "_part").orderBy(F.lit(0)))
        alike = alike.withColumn("_number", inside).join(counts, alike["_source"].eqNullSafe(counts["_s"]) & (alike["_part"] == counts["_p"]))
        alike = alike.withColumn("_chosen", F.col("_base") + F.col("_number") <= F.col("_last._some"))
        whole = whole.where(~split).unionByName(alike.select(whole.columns))
    return whole.withColumn("_copies", F.col("_epochs") + F.col("_chosen").cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Say for every document how many of its words the mix takes.

    Every source is given its target in words (see `budgets`); a target of several times its source first takes whole
    epochs of it, then a sample without replacement by `sampling_key`, cut where the prefix sum of sizes comes nearest
    to what is left: within half the longest text of the source, whatever the ids. A null source is a source of its
    own, last in order; a null text has 0 words; a null id counts as empty; rows of one id are sampled by their texts, and of
    exact repeats as many are taken as come nearest; other columns are ignored; an empty table gives an empty result.
    The same input gives the same mix.
    Returns `doc_id, source, size, source_size, target, copies, taken`.
    """
    sized, cut = cuts(docs, **options)
    return _apply(sized, cut).select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_size") * F.col("_copies")).alias("taken")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix themselves, all columns kept: each document as often as it is taken. No text is shuffled, but that
    of rows alike of which only some are taken."""
    options = {"doc_id": "doc_id", "text": "text", "source": "source", "seed": 17} | options
    _, cut = cuts(docs, **options)
    columns = [F.col(f"_row.{c}").alias(c) for c in docs.columns]
    keyed = with_keys(docs.select(F.struct(*docs.columns).alias("_row"), options["doc_id"], options["text"], options["source"]), options["doc_id"], options["text"], options["source"], options["seed"])
    copied = _apply(keyed.select("_row", "_id", "_source", "_size", "_key"), cut)
    return copied.where("_copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*columns)
