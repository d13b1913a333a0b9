"""Sliding windows of series (id, t, v), their moments and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcorr.config import CorrConfig
from sparkcorr.functions.window_math import near_constant, spiked, total


def difference(series: DataFrame) -> DataFrame:
    """v - previous v of the series; 0 for the first."""
    before = F.lag("v").over(Window.partitionBy("id").orderBy("t"))
    return series.withColumn("v", F.coalesce(F.col("v") - before, F.lit(0).cast("double")))


def _offset(series: DataFrame, cfg: CorrConfig) -> tuple[DataFrame, Column]:
    """Ticks since the first one of all series, which aligns the windows."""
    if cfg.origin is not None:
        return series, F.col("t") - F.lit(cfg.origin)
    first = series.agg(F.min("t").alias("__first"))  # one row
    return series.join(F.broadcast(first), F.lit(True)), F.col("t") - F.col("__first")


def sliding_windows(series: DataFrame, cfg: CorrConfig) -> DataFrame:
    """(id, t0, xs): every full window on the step grid, values in order.

    Ticks are gathered in chunks of some dozen window starts, with the ticks after them that their
    windows need: one shuffle of little more than the series, and no group larger than a chunk,
    however long a series. Nulls and NaN count as missing; a window with a missing or repeated tick
    isn't made.
    """
    per = cfg.w // cfg.step
    starts = max(4 * per, 32)
    span = starts * cfg.step
    rows, since = _offset(series.where(F.col("v").isNotNull() & ~F.isnan("v")), cfg)
    chunk = F.floor(F.col("since") / span).cast("long")
    ahead = (F.pmod("since", F.lit(span)) < cfg.w - cfg.step) & (chunk > 0)
    dealt = rows.withColumn("since", since).where("since >= 0").select("id", "t", "v", (F.col("t") - F.col("since")).alias("first"), F.explode(F.when(ahead, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))).alias("chunk"))
    # by chunk too where the ids alone would do: one series may be most of the data
    chunks = dealt.repartition("id", "chunk").groupBy("id", "chunk").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("tv"), F.min("first").alias("first"))
    low, high = F.element_at("tv", 1)["t"], F.element_at("tv", -1)["t"]
    dense = (high - low + 1 == F.size("tv")) & (F.size(F.array_distinct(F.transform("tv", lambda x: x["t"]))) == F.size("tv"))
    chunks = chunks.select("id", "tv", (F.col("first") + F.col("chunk") * span).alias("base"), low.alias("low"), high.alias("high"), dense.alias("dense"))

    def window(j):
        t0 = F.col("base") + j * cfg.step
        inside = (t0 >= F.col("low")) & (t0 + (cfg.w - 1) <= F.col("high"))
        cut = F.slice("tv", (t0 - F.col("low") + 1).cast("int"), cfg.w)
        sought = F.filter("tv", lambda x: x["t"].between(t0, t0 + (cfg.w - 1)))
        return F.when(inside, F.struct(t0.alias("t0"), F.when(F.col("dense"), cut).otherwise(sought).alias("part")))

    made = chunks.select("id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(starts - 1).cast("long")), window)).alias("made"))
    ticks = F.array_distinct(F.transform("made.part", lambda x: x["t"]))
    whole = made.where(F.col("made").isNotNull() & (F.size("made.part") == cfg.w) & (F.size(ticks) == cfg.w))
    return whole.select("id", F.col("made.t0").alias("t0"), F.transform("made.part", lambda x: x["v"]).alias("xs"))


def with_moments(windows: DataFrame) -> DataFrame:
    """Sums of the first four powers."""
    zero, xs = F.lit(0).cast("double"), F.col("xs")
    sums = {
        "s1": F.aggregate(xs, zero, lambda s, x: s + x),
        "s2": F.aggregate(xs, zero, lambda s, x: s + x * x),
        "s3": F.aggregate(xs, zero, lambda s, x: s + x * x * x),
        "s4": F.aggregate(xs, zero, lambda s, x: s + x * x * x * x),
    }
    return windows.select("*", *(c.alias(k) for k, c in sums.items()))


def with_flags(windows: DataFrame, cfg: CorrConfig) -> DataFrame:
    sums = [F.col(f"s{k}") for k in (1, 2, 3, 4)]
    return windows.withColumn("is_const", near_constant(cfg.w, *sums[:2])).withColumn("is_spiked", spiked(cfg.w, *sums))


def flagged_windows(series: DataFrame, cfg: CorrConfig) -> DataFrame:
    return with_flags(with_moments(sliding_windows(series, cfg)), cfg)


def basic_windows(windows: DataFrame, cfg: CorrConfig) -> DataFrame:
    """(id, t0, block, total) of the tumbling basic windows in each window."""
    b = cfg.basic_window
    blocks = F.transform(F.sequence(F.lit(0), F.lit(cfg.w // b - 1)), lambda i: total(F.slice("xs", i * b + 1, b)))
    return windows.select("id", "t0", F.posexplode(blocks).alias("block", "total"))


def rolling_moments(series: DataFrame, w: int) -> DataFrame:
    """(id, t, s1..s4) of the w ticks from each tick on, where there are so many. One window operator."""
    ahead = Window.partitionBy("id").orderBy("t").rowsBetween(0, w - 1)
    v = F.col("v")
    sums = [F.sum(x).over(ahead).alias(f"s{k}") for k, x in enumerate((v, v * v, v * v * v, v * v * v * v), 1)]
    return series.select("id", "t", *sums, F.count("v").over(ahead).alias("n")).where(F.col("n") == w).drop("n")
