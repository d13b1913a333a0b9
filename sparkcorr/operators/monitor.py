"""Episodes of correlation, their events, and summaries by lag.

A key is (id1, id2, lag): id1's window is the later one. With ``merge_orientations`` the two
directions of a pair share one key, and where both hold at an anchor the row with the smaller ids
counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcorr.config import CorrConfig
from sparkcorr.functions.window_math import episode_sign

KEY = ["id1", "id2", "lag"]


def merge_orientations(correlated: DataFrame) -> DataFrame:
    a, b = F.least("id1", "id2"), F.greatest("id1", "id2")
    first = F.min_by(F.struct("t2", "corr"), F.struct("id1", "id2")).alias("row")
    return correlated.groupBy(a.alias("id1"), b.alias("id2"), "lag", "t1").agg(first).select("id1", "t1", "id2", "row.t2", "lag", "row.corr")


def runs(correlated: DataFrame, cfg: CorrConfig) -> DataFrame:
    """Each correlated window with its sign, its episode, and how the windows before and after relate.

    One window operator over (id1, id2, lag) serves all that follows.
    """
    if cfg.merge_orientations:
        correlated = merge_orientations(correlated)
    by = Window.partitionBy(*KEY).orderBy("t1")
    out = correlated.withColumn("corr_sign", episode_sign(F.col("corr")))
    out = out.withColumn("prev_t1", F.lag("t1").over(by)).withColumn("prev_sign", F.lag("corr_sign").over(by)).withColumn("next_t1", F.lead("t1").over(by))
    contiguous = F.coalesce(F.col("prev_t1") == F.col("t1") - cfg.step, F.lit(False))
    starts = ~(contiguous & (F.col("prev_sign") == F.col("corr_sign")))
    return out.withColumn("contiguous", contiguous).withColumn("starts", starts).withColumn("episode", F.sum(F.col("starts").cast("int")).over(by))


def status(correlated: DataFrame, cfg: CorrConfig) -> DataFrame:
    """id1, id2, lag, start_t1, start_t2, duration, corr_sign of every episode."""
    of = runs(correlated, cfg).groupBy(*KEY, "episode").agg(F.min("t1").alias("start_t1"), F.min("t2").alias("start_t2"), F.count("*").alias("n"), F.first("corr_sign").alias("corr_sign"))
    return of.select(*KEY, "start_t1", "start_t2", (F.lit(cfg.w) + (F.col("n") - 1) * cfg.step).cast("long").alias("duration"), F.col("corr_sign").cast("long").alias("corr_sign"))


def anomalies(correlated: DataFrame, cfg: CorrConfig, last_anchor: DataFrame) -> DataFrame:
    """id1, id2, lag, time_idx, anomaly: into, changed_sign, out_of.

    ``last_anchor`` has one row and column, the last window start of all; what holds there hasn't
    ended. After a gap, a restart with the other sign is ``changed_sign`` if ``carry_sign_over_gap``,
    else ``into``.
    """
    of = runs(correlated, cfg).join(F.broadcast(last_anchor.toDF("last_anchor")), F.lit(True))  # one row
    other = F.col("prev_sign").isNotNull() & (F.col("prev_sign") != F.col("corr_sign"))
    changed = other if cfg.carry_sign_over_gap else other & F.col("contiguous")
    open_end = F.col("next_t1").isNull() | (F.col("next_t1") != F.col("t1") + cfg.step)
    time = F.least("t1", "t2")
    event = lambda t, name: F.struct(t.alias("time_idx"), name.alias("anomaly"))
    begun = F.when(F.col("starts"), event(time, F.when(changed, "changed_sign").otherwise("into")))
    # an episode's length at its last window, less the part that windows share, is one step past its start
    ended = F.when(open_end & (F.col("t1") < F.col("last_anchor")), event(time + cfg.step, F.lit("out_of")))
    return of.select(*KEY, F.explode(F.filter(F.array(begun, ended), lambda e: e.isNotNull())).alias("e")).select(*KEY, "e.time_idx", "e.anomaly")


def max_lag(correlated: DataFrame) -> DataFrame:
    """id1, id2, t1, max_corr, lag: for ids in order and each time of the first, the strongest
    correlation; ties go to the smaller lag. Combined before the shuffle, unlike a ranking."""
    a, b = F.least("id1", "id2"), F.greatest("id1", "id2")
    t = F.when(F.col("id1") == a, F.col("t1")).otherwise(F.col("t2"))
    rank = F.struct(F.abs("corr"), -F.col("lag"), F.col("corr"), -F.col("t2"))
    best = F.max_by(F.struct("corr", "lag"), rank).alias("best")
    return correlated.groupBy(a.alias("id1"), b.alias("id2"), t.alias("t1")).agg(best).select("id1", "id2", "t1", F.col("best.corr").alias("max_corr"), F.col("best.lag").alias("lag"))


def intervals(events: DataFrame, total_time: int, tolerance: int, *, keys: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """keys, start, end of the spans in which a key is on.

    ``into`` opens one unless it comes within ``tolerance`` of the last close; ``out_of`` closes it;
    what is still open ends at ``total_time``. The fold is over one key's events in order.
    """
    marker = F.when(F.col("anomaly") == "into", 1).when(F.col("anomaly") == "out_of", -1)
    listed = events.withColumn("marker", marker).where("marker is not null").groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.col("time_idx").cast("long").alias("time"), "marker"))).alias("events"))
    none = F.lit(None).cast("long")
    state = F.struct(none.alias("since"), none.alias("closed"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def fold(s, e):
        opens = (e["marker"] == 1) & s["since"].isNull() & (s["closed"].isNull() | (e["time"] - s["closed"] > tolerance))
        closes = (e["marker"] == -1) & s["since"].isNotNull()
        span = F.struct(s["since"].alias("start"), e["time"].alias("end"))
        return F.struct(
            F.when(opens, e["time"]).when(closes, none).otherwise(s["since"]).alias("since"),
            F.when(closes, e["time"]).otherwise(s["closed"]).alias("closed"),
            F.when(closes, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"),
        )

    def finish(s):
        tail = F.struct(s["since"].alias("start"), F.lit(total_time).cast("long").alias("end"))
        return F.when(s["since"].isNotNull(), F.concat(s["spans"], F.array(tail))).otherwise(s["spans"])

    spans = F.aggregate("events", state, fold, finish)
    return listed.select(*keys, F.explode(spans).alias("span")).select(*keys, "span.start", "span.end")


def anomaly_spans(events: DataFrame, tolerance: int) -> DataFrame:
    """keys, start, end of gaps longer than ``tolerance`` between an ``out_of`` and the next ``into``."""
    by = Window.partitionBy(*KEY).orderBy("time_idx", "anomaly")
    ahead = events.where(F.col("anomaly").isin("into", "out_of")).withColumn("next_time", F.lead("time_idx").over(by)).withColumn("next", F.lead("anomaly").over(by))
    gap = (F.col("anomaly") == "out_of") & (F.col("next") == "into") & (F.col("next_time") - F.col("time_idx") > tolerance)
    return ahead.where(gap).select(*KEY, F.col("time_idx").alias("start"), F.col("next_time").alias("end"))


def top_durations(of: DataFrame, k: int = 5, *, drop_self: bool = True, one_per_pair: bool = True) -> DataFrame:
    """The k longest episodes; of each pair its longest if ``one_per_pair``."""
    order = ["id1", "id2", "lag", "start_t1", "start_t2", "corr_sign"]
    rows = of.where("id1 <> id2") if drop_self else of
    if one_per_pair:
        rank = F.struct(F.col("duration"), *(-F.col(c) for c in ("lag", "start_t1", "start_t2", "corr_sign")))
        pair = [F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")]
        rows = rows.withColumn("rank", rank).groupBy(*pair).agg(F.max_by(F.struct(*rows.columns), F.struct("rank", F.col("id1") < F.col("id2"))).alias("row")).select("row.*")
    return rows.orderBy(F.desc("duration"), *order).limit(k)
