"""Dips and events of series too long for one task: time buckets, their summaries scanned, and no window over a whole series.

Rows are dealt by key and time bucket. What a bucket's rows need to know of earlier ones fits in a few values: the row before
the bucket and the one behind it, the last row below the line, and how many rows and runs there were. A summary of each bucket
(first and last row, first and last row below, runs that start inside) is scanned in order; then every bucket computes its rows
apart, and dips and events are aggregated by partial sums, whatever number of buckets they span.

Results equal those of `segment` on the same rows. Rows without a key belong to no series and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipfleet.functions.params import DipParams, EventParams, LiveParams
from dipfleet.functions.series import KEYS, earlier, is_below, ordered, so_far

#: An hour: some 72,000 samples at 20 a second.
BUCKET_MS = 3_600_000


def _local(samples: DataFrame, line: float | Column, keys: Sequence[str], bucket_ms: int) -> DataFrame:
    """What rows know within their bucket: place `_k` from 0, the row before (`_p`) and behind (`_n`), the last row below (`_b`)."""
    rows = samples.na.drop(subset=list(keys)).select(*keys, F.floor(F.col("time_ms") / bucket_ms).alias("_bucket"), "time_ms", "seq", F.col("distance").cast("double").alias("distance"), is_below("distance", line).alias("below"))
    w = ordered([*keys, "_bucket"])
    rows = rows.withColumn("_k", (F.row_number().over(w) - 1).cast("long"))
    here = F.struct(F.col("_k").alias("k"), F.col("time_ms").alias("t"), F.col("distance").alias("d"), F.col("below").alias("b"))
    return rows.withColumns({"_p": F.lag(here).over(w), "_n": F.lead(here).over(w), "_b": F.last(F.when(F.col("below"), here), ignorenulls=True).over(earlier(w))})


def _summaries(rows: DataFrame, keys: Sequence[str], starts: Column) -> DataFrame:
    """A row for each bucket. `starts`: rows that start a run, as far as rows of the bucket alone can tell; `opens`: the first row
    below, for which they cannot."""
    here = F.struct(F.col("_k").alias("k"), F.col("time_ms").alias("t"), F.col("distance").alias("d"), F.col("below").alias("b"))
    below = F.when(F.col("below"), F.col("_k"))
    return rows.groupBy(*keys, "_bucket").agg(
        F.count("*").alias("rows"), F.min_by(here, "_k").alias("first"), F.max_by(here, "_k").alias("last"), F.max_by(here, below).alias("last_below"),
        F.min_by(F.struct(F.col("_k").alias("k"), F.col("_p").alias("p")), below).alias("opens"), F.count_if(starts).alias("starts"), F.max(F.when(starts, F.col("_k"))).alias("last_start"),
    )


def _scanned(buckets: DataFrame, keys: Sequence[str], opens: Column) -> DataFrame:
    """What each bucket takes over: rows before it (`_at`), the row before (`_before`) and behind (`_behind`) it, the last row
    below (`_low`, with its position), runs that start before it (`_runs`) and where the last of these does (`_since`). `opens`: whether the bucket's first row below
    starts a run, by `_before`, `_low`, `_at` and `opens`."""
    w = Window.partitionBy(*keys).orderBy("_bucket")
    scan = buckets.withColumn("_at", F.coalesce(F.sum("rows").over(earlier(w)), F.lit(0)))
    low = F.when(F.col("last_below").isNotNull(), F.struct((F.col("_at") + F.col("last_below.k")).alias("i"), F.col("last_below.t").alias("t")))
    scan = scan.withColumns({"_before": F.lag("last").over(w), "_behind": F.lead("first").over(w), "_low": F.last(low, ignorenulls=True).over(earlier(w))})
    scan = scan.withColumn("_opens", F.coalesce(F.col("opens").isNotNull() & opens, F.lit(False)))
    runs = F.coalesce(F.sum(F.col("starts") + F.col("_opens").cast("long")).over(earlier(w)), F.lit(0))
    since = F.last(F.col("_at") + F.coalesce("last_start", F.when(F.col("_opens"), F.col("opens.k"))), ignorenulls=True).over(earlier(w))
    return scan.withColumns({"_runs": runs, "_since": since}).select(*keys, "_bucket", "_at", "_before", "_behind", "_low", "_runs", "_since")


def _known(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their position `i`, the row before (`pi, pt, pd, pb`) and behind (`ni, nt`), and the last one below (`lbi, lb`)."""
    both = rows.join(carried, [*keys, "_bucket"])
    before, behind = F.coalesce("_p", "_before"), F.coalesce("_n", "_behind")
    i = F.col("_at") + F.col("_k")
    return both.withColumns({
        "i": i, "pi": F.when(before.isNotNull(), i - 1), "pt": before["t"], "pd": before["d"], "pb": F.coalesce(before["b"], F.lit(False)), "ni": F.when(behind.isNotNull(), i + 1), "nt": behind["t"],
        "lbi": F.coalesce(F.col("_at") + F.col("_b.k"), F.col("_low.i")), "lb": F.coalesce("_b.t", "_low.t"),
    })


def _in_bucket(keys: Sequence[str], order: Sequence[str] = ("time_ms", "seq")):
    return so_far(Window.partitionBy(*keys, "_bucket").orderBy(*order))


def long_raw_dips(samples: DataFrame, baseline: float = DipParams.baseline, keys: Sequence[str] = KEYS, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """`segment.raw_dips`."""
    rows = _local(samples, baseline, keys, bucket_ms)
    inside = F.col("below") & F.coalesce(~F.col("_p.b"), F.lit(False))
    # of the first row below, only one at the very start of its bucket is not told by its own bucket
    edge = (F.col("opens.k") == 0) & ~F.coalesce(F.col("_before.b"), F.lit(False))
    known = _known(rows, _scanned(_summaries(rows, keys, inside), keys, edge), keys)
    known = known.withColumn("dip_id", F.col("_runs") + F.sum((F.col("below") & ~F.col("pb")).cast("long")).over(_in_bucket(keys)))
    return known.where("below").groupBy(*keys, "dip_id").agg(
        F.min(F.coalesce("pi", "i")).alias("start_idx"), F.max(F.coalesce("ni", "i")).alias("end_idx"), F.min(F.coalesce("pt", "time_ms")).alias("start_ms"), F.max(F.coalesce("nt", "time_ms")).alias("end_ms")
    )


def long_merge_dips(dips: DataFrame, merge_gap_ms: int = DipParams.merge_gap_ms, keys: Sequence[str] = KEYS, bucket_ms: int = 64 * BUCKET_MS) -> DataFrame:
    """`segment.merge_dips`; dips are few beside samples, so buckets are wider."""
    rows = dips.withColumn("_bucket", F.floor(F.col("start_ms") / bucket_ms))
    w = Window.partitionBy(*keys, "_bucket").orderBy("dip_id")
    rows = rows.withColumn("_end", F.lag("end_ms").over(w))
    apart = lambda start, end: ~F.coalesce(start - end < merge_gap_ms, F.lit(False))
    inside = F.col("_end").isNotNull() & apart(F.col("start_ms"), F.col("_end"))
    buckets = rows.groupBy(*keys, "_bucket").agg(F.count_if(inside).alias("starts"), F.min_by("start_ms", "dip_id").alias("start"), F.max_by("end_ms", "dip_id").alias("end"))
    scan = Window.partitionBy(*keys).orderBy("_bucket")
    buckets = buckets.withColumn("_before", F.lag("end").over(scan))
    runs = F.sum(F.col("starts") + apart(F.col("start"), F.col("_before")).cast("long")).over(earlier(scan))
    carried = buckets.select(*keys, "_bucket", "_before", F.coalesce(runs, F.lit(0)).alias("_runs"))
    new = apart(F.col("start_ms"), F.coalesce("_end", "_before"))
    numbered = rows.join(carried, [*keys, "_bucket"]).withColumn("_did", F.col("_runs") + F.sum(new.cast("long")).over(_in_bucket(keys, ("dip_id",))))
    return numbered.groupBy(*keys, F.col("_did").alias("dip_id")).agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def long_events(samples: DataFrame, params: EventParams = EventParams(), keys: Sequence[str] = KEYS, bucket_ms: int = BUCKET_MS) -> DataFrame:  # noqa: B008
    """`segment.event_stats` of the events of `segment.segment_events`, or of `segment_events_live` for `LiveParams`.

    A row starts an event if it is below and the row before is past the gap after the last row below; a row within an event
    is past its end if the row before was already. So each row is judged by the row before and the last one below.
    """
    live = isinstance(params, LiveParams)
    least = 2 if live else 1
    past = lambda i, t, lbi, lb: F.coalesce((i - lbi >= least) & (t - lb > params.gap_ms), F.lit(False))
    rows = _local(samples, params.line, keys, bucket_ms)
    inside = F.col("below") & F.col("_b").isNotNull() & past(F.col("_p.k"), F.col("_p.t"), F.col("_b.k"), F.col("_b.t"))
    before_i, before_t = F.col("_at") + F.col("opens.k") - 1, F.coalesce("opens.p.t", "_before.t")
    edge = F.col("_low").isNull() | past(before_i, before_t, F.col("_low.i"), F.col("_low.t"))
    known = _known(rows, _scanned(_summaries(rows, keys, inside), keys, edge), keys)
    start = F.col("below") & (F.col("lb").isNull() | past(F.col("pi"), F.col("pt"), F.col("lbi"), F.col("lb")))
    known = known.withColumn("_start", start).withColumn("event_id", F.col("_runs") + F.sum(F.col("_start").cast("long")).over(_in_bucket(keys))).where("event_id > 0")
    over = ~F.col("pb") & past(F.col("pi"), F.col("pt"), F.col("lbi"), F.col("lb"))
    known = known.where(F.col("_start") | ~over).withColumn("_close", ~F.col("below") & past(F.col("i"), F.col("time_ms"), F.col("lbi"), F.col("lb")))
    if live:  # as many rows as the live buffer holds
        since = F.coalesce(F.last(F.when(F.col("_start"), F.col("i")), ignorenulls=True).over(_in_bucket(keys)), "_since")
        known = known.withColumn("_from", F.greatest(since - 1, F.lit(0))).withColumn("_held", F.col("i") - F.col("_from") < params.buffer)
    else:
        known = known.withColumn("_held", F.lit(True))
    good = lambda c: F.when(~F.isnan(c), c)
    own = F.struct("i", "time_ms", good(F.col("distance")).alias("d"), F.when(~F.col("_start") | F.col("pi").isNotNull(), F.abs(good(F.col("distance")) - good(F.col("pd")))).alias("step"))
    lead = F.struct(F.col("pi").alias("i"), F.col("pt").alias("time_ms"), good(F.col("pd")).alias("d"), F.lit(None).cast("double").alias("step"))
    both = F.when(F.col("_start") & F.col("pi").isNotNull(), F.array(lead, own)).otherwise(F.array(own))
    known = known.withColumn("r", F.when(F.col("_held"), both).otherwise(F.array().cast("array<struct<i:long,time_ms:long,d:double,step:double>>")))
    stats = known.select(*keys, "event_id", "_close", F.explode_outer("r").alias("r")).groupBy(*keys, "event_id").agg(
        F.min("r.i").alias("start_idx"), F.max("r.i").alias("end_idx"), F.min("r.time_ms").alias("time_ms"), F.count("r").alias("samples"), ((F.max("r.time_ms") - F.min("r.time_ms")) / 1000.0).cast("double").alias("duration"),
        F.min("r.d").alias("min_depth"), F.coalesce(F.var_pop("r.d"), F.lit(0.0)).alias("variance"), F.coalesce(F.avg("r.step"), F.lit(0.0)).alias("avg_gradient"), F.max("_close").alias("_closed"),
    )
    return (stats.where("_closed") if live else stats).drop("_closed")
