"""Pairs of windows within a lag, and their validation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcorr.config import CorrConfig
from sparkcorr.functions.window_math import canonical_pair, dot, passes, pearson


def lag_buckets(left: DataFrame, right: DataFrame, cfg: CorrConfig) -> tuple[DataFrame, DataFrame, list[str]]:
    """Keys that turn "t2 within ``n_lags`` before t1" into an equi-join.

    Time falls into buckets of a lag and a step; a partner goes to its own bucket and the next.
    With ``id_blocks`` > 1 the series are dealt to as many blocks, and each bucket to the square of
    that: for when one bucket's windows are too many for a task.
    """
    width = cfg.n_lags + cfg.step
    bucket = F.floor(F.col("t0") / width).cast("long")
    left = left.withColumn("bucket", bucket)
    right = right.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    if cfg.id_blocks == 1:
        return left, right, ["bucket"]
    own = F.pmod(F.xxhash64("id"), F.lit(cfg.id_blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cfg.id_blocks - 1).cast("long")))
    left = left.withColumn("block1", own).withColumn("block2", every)
    right = right.withColumn("block2", own).withColumn("block1", every)
    return left, right, ["bucket", "block1", "block2"]


def band_join(left: DataFrame, right: DataFrame, cfg: CorrConfig, *, extra=None, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``left`` (id, t0, ...) with those of ``right`` that start 0 to ``n_lags`` earlier.

    At equal starts the ids must be in order, so that no pair comes twice nor a window with
    itself. Columns become ``x_*`` and ``y_*``. ``extra`` is a condition on those names.
    """
    left, right, keys = lag_buckets(left, right, cfg)
    keys += list(extra_keys)
    x = left.select(*(F.col(c).alias(f"x_{c}") for c in left.columns))
    y = right.select(*(F.col(c).alias(f"y_{c}") for c in right.columns))
    on = [F.col(f"x_{k}") == F.col(f"y_{k}") for k in keys]
    t1, t2 = F.col("x_t0"), F.col("y_t0")
    on += [t2.between(t1 - cfg.n_lags, t1), (t2 < t1) | (F.col("x_id") < F.col("y_id"))]
    return x.join(y, [*on, *([extra] if extra is not None else [])]).drop(*(f"{s}_{k}" for s in "xy" for k in ("bucket", "block1", "block2")))


def exact_pairs(windows: DataFrame, cfg: CorrConfig, *, prune_spikes: bool = False) -> DataFrame:
    """All pairs of windows that aren't constant, with arrays and moments."""
    kept = windows.where(~F.col("is_const") & ~F.col("is_spiked") if prune_spikes else ~F.col("is_const"))
    kept = kept.select("id", "t0", "xs", "s1", "s2", "is_spiked")
    return band_join(kept, kept, cfg)


def pair_keys(pairs: DataFrame) -> DataFrame:
    """id1, t1, id2, t2 in canonical order."""
    return pairs.select(*canonical_pair(F.col("x_id"), F.col("x_t0"), F.col("y_id"), F.col("y_t0")))


def measured(pairs: DataFrame, cfg: CorrConfig) -> DataFrame:
    """Canonical keys with Pearson's r, Euclidean distance and whether a side is spiked."""
    c = lambda n: F.col(n)
    xy = dot(c("x_xs"), c("y_xs"))
    r = pearson(cfg.w, c("x_s1"), c("x_s2"), c("y_s1"), c("y_s2"), c("xy"))
    dist = F.sqrt(F.greatest(c("x_s2") + c("y_s2") - 2 * c("xy"), F.lit(0).cast("double")))
    keys = canonical_pair(c("x_id"), c("x_t0"), c("y_id"), c("y_t0"))
    return pairs.withColumn("xy", xy).select(*keys, r.alias("corr"), dist.alias("dist"), (c("x_is_spiked") | c("y_is_spiked")).alias("spiked")).withColumn("lag", c("t1") - c("t2"))


def validate(pairs: DataFrame, cfg: CorrConfig) -> DataFrame:
    """(id1, t1, id2, t2, lag, corr) of the pairs that pass; all of them with 1 if ``corr_val`` is off."""
    columns = ["id1", "t1", "id2", "t2", "lag", "corr"]
    if not cfg.corr_val:
        return pair_keys(pairs).withColumn("lag", F.col("t1") - F.col("t2")).withColumn("corr", F.lit(1).cast("double")).select(*columns)
    return measured(pairs, cfg).where(~F.col("spiked") & passes(F.col("corr"), cfg.threshold, cfg.neg_corr)).select(*columns)


def exact_correlated(windows: DataFrame, cfg: CorrConfig) -> DataFrame:
    """The exact plan as a join. Spikes are pruned below it, which changes no result when validating."""
    return validate(exact_pairs(windows, cfg, prune_spikes=cfg.corr_val), cfg)


def min_distance_pair(pairs: DataFrame, cfg: CorrConfig) -> DataFrame:
    """The closest tested pair that isn't rejected; ties by key. One row."""
    tested = measured(pairs, cfg).where(~F.col("spiked"))
    key = F.struct("id1", "id2", "t1", "t2")
    best = tested.agg(F.min(F.struct("dist", key.alias("pair"))).alias("best"))
    return best.select("best.pair.*", "best.dist").where("id1 is not null")


def counters(pairs: DataFrame, cfg: CorrConfig) -> DataFrame:
    """Candidates, tested (not rejected) and validated pairs. One row."""
    ok = ~F.col("spiked")
    return measured(pairs, cfg).agg(
        F.count("*").alias("total_candidates"),
        F.count_if(ok).alias("tested"),
        F.count_if(ok & passes(F.col("corr"), cfg.threshold, cfg.neg_corr)).alias("validated"),
    )


def exact_counts(windows: DataFrame, cfg: CorrConfig) -> DataFrame:
    """``total_candidates`` and ``tested`` of the exact plan, one row, from counts of windows a start; no pair is made.

    Windows at starts t1 > t2 pair all with all, those at one start by ids in order.
    """
    kept = windows.where(~F.col("is_const"))
    starts = kept.groupBy("t0").agg(F.count("*").alias("n"), F.count_if(~F.col("is_spiked")).alias("k"))
    left, right, keys = lag_buckets(starts, starts, replace(cfg, id_blocks=1))
    x = left.select(*(F.col(c).alias(f"x_{c}") for c in left.columns))
    y = right.select(*(F.col(c).alias(f"y_{c}") for c in right.columns))
    near = [F.col(f"x_{k}") == F.col(f"y_{k}") for k in keys] + [F.col("y_t0").between(F.col("x_t0") - cfg.n_lags, F.col("x_t0"))]
    both = lambda n: F.when(F.col("y_t0") < F.col("x_t0"), F.col(f"x_{n}") * F.col(f"y_{n}")).otherwise(F.floor(F.col(f"x_{n}") * (F.col(f"x_{n}") - 1) / 2))
    total = lambda n: F.coalesce(F.sum(both(n).cast("long")), F.lit(0).cast("long"))
    return x.join(y, near).agg(total("n").alias("total_candidates"), total("k").alias("tested"))
