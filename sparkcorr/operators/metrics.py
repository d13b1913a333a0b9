"""Agreement of a plan's results with the truth, and diagnostics of a run. One row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcorr.functions.window_math import metric_sign, safe_div

PAIR = ["id1", "id2", "t1", "t2"]
_D = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(safe_div(_D(a), _D(b)), F.lit(0).cast("double"))


def _rates(tp: str, pred: str, gt: str, suffix: str = "") -> list[Column]:
    p, r = _ratio(F.col(tp), F.col(pred)), _ratio(F.col(tp), F.col(gt))
    return [p.alias(f"precision{suffix}"), r.alias(f"recall{suffix}"), _ratio(2 * p * r, p + r).alias(f"f1_score{suffix}")]


def window_metrics(pred: DataFrame, truth: DataFrame, total_pairs: DataFrame, *, closest: DataFrame | None = None) -> DataFrame:
    """Precision, recall, specificity and F1 over window pairs, in all and by sign.

    ``total_pairs`` has one row and column: the pairs that the exact plan tested. With ``closest``
    (one pair), ``recall_min`` tells whether it was found.
    """
    p = pred.select(*PAIR, metric_sign(F.col("corr")).alias("p"))
    t = truth.select(*PAIR, metric_sign(F.col("corr")).alias("g"))
    p_is, g_is = F.col("p").isNotNull(), F.col("g").isNotNull()
    counts = {"tp": p_is & g_is, "pred": p_is, "gt": g_is}
    for name, s in (("pos", 1), ("neg", -1)):
        counts |= {f"tp_{name}": (F.col("p") == s) & (F.col("g") == s), f"pred_{name}": F.col("p") == s, f"gt_{name}": F.col("g") == s}
    one = p.join(t, PAIR, "full").agg(*(F.count_if(c).alias(k) for k, c in counts.items()))
    one = one.join(F.broadcast(total_pairs.toDF("total_pairs")), F.lit(True))  # one row
    negatives = F.greatest(F.col("total_pairs") - F.col("gt"), F.lit(0))
    tn = F.greatest(negatives - (F.col("pred") - F.col("tp")), F.lit(0))
    out = one.select("tp", "pred", "gt", *_rates("tp", "pred", "gt"), _ratio(tn, negatives).alias("specificity"), *_rates("tp_pos", "pred_pos", "gt_pos", "_pos"), *_rates("tp_neg", "pred_neg", "gt_neg", "_neg"))
    if closest is not None:
        hit = closest.select(*PAIR).join(pred.select(*PAIR), PAIR, "left_semi").agg((F.count("*") > 0).cast("long").alias("recall_min"))
        out = out.join(F.broadcast(hit), F.lit(True))
    return out


def interval_metrics(pred: DataFrame, truth: DataFrame, total_time: int, *, keys: tuple[str, ...] = ("id1", "id2", "lag")) -> DataFrame:
    """The same over points of time: spans (keys, start, end), disjoint for each key."""
    length = lambda s, e: F.sum(e - s)
    p = pred.groupBy(*keys).agg(length(F.col("start"), F.col("end")).alias("pred"))
    t = truth.groupBy(*keys).agg(length(F.col("start"), F.col("end")).alias("gt"))
    a = pred.select(*keys, F.col("start").alias("s"), F.col("end").alias("e"))
    both = a.join(truth, list(keys)).groupBy(*keys).agg(F.sum(F.greatest(F.lit(0).cast("long"), F.least("e", "end") - F.greatest("s", "start"))).alias("tp"))
    joined = p.join(t, list(keys), "full").join(both, list(keys), "left")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = joined.agg(z("tp").alias("tp"), z("pred").alias("pred"), z("gt").alias("gt"), (F.count("*") * total_time).alias("points"))
    tp, fp, fn = F.col("tp"), F.col("pred") - F.col("tp"), F.col("gt") - F.col("tp")
    tn = F.greatest(F.col("points") - tp - fp - fn, F.lit(0))
    return one.select("tp", fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), *_rates("tp", "pred", "gt"), _ratio(tn, tn + fp).alias("specificity"))


def max_lag_metrics(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean and population deviation of truth - prediction over common (id1, id2, t1)."""
    key = ["id1", "id2", "t1"]
    diff = F.col("truth") - F.col("pred")
    snapped = F.when(F.abs(diff) <= 1e-12, F.lit(0).cast("double")).otherwise(F.round(diff, 12))
    joined = pred.select(*key, F.col("max_corr").alias("pred")).join(truth.select(*key, F.col("max_corr").alias("truth")), key)
    return joined.select(snapped.alias("d")).agg(F.count("*").alias("n"), F.avg("d").alias("diff_mean"), F.stddev_pop("d").alias("diff_std"))


def diagnostics(run: DataFrame) -> DataFrame:
    """Derived columns of rows with times and counts of a plan and of the exact plan (``*_bf``)."""
    c = _D
    corr_prop = safe_div(c("corr_w_bf"), c("cand_w_bf"))
    num = c("cand_time_bf") + c("val_time_bf") + c("monit_time_bf")
    ceil = safe_div(num, c("sk_time") + c("cand_time") + c("val_time_bf") * corr_prop + c("monit_time_bf"))
    speedup = F.when(c("runtime") > 0, safe_div(c("runtime_bf"), c("runtime"))).otherwise(F.lit(float("inf")))
    waste_bf, waste = safe_div(c("cand_w_bf"), c("corr_w_bf")), safe_div(c("cand_w"), c("corr_w"))
    out = {"speedup": speedup, "speedup_ceil": ceil, "rel_speedup_eff": safe_div(speedup, ceil), "corr_prop": corr_prop, "waste_val_bf": waste_bf, "waste_val": waste, "rel_waste_red": safe_div(waste_bf, waste)}
    return run.select("*", *(v.alias(k) for k, v in out.items()))


def distance_diagnostics(pairs: DataFrame, threshold: float) -> DataFrame:
    """Counts and means by class (pos, neg, non) of pairs with ``corr``, ``dist``, ``sketch_dist`` and ``estimate``."""
    kind = F.when(F.col("corr") >= threshold, "pos").when(F.col("corr") <= -threshold, "neg").otherwise("non")
    error = F.col("estimate") - F.col("corr")
    return pairs.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), F.avg("dist").alias("mean_dist"), F.avg("sketch_dist").alias("mean_sketch_dist"), F.avg("estimate").alias("mean_estimate"), F.avg(F.abs(error)).alias("mean_abs_error")
    )


def confusion_sample(pred: DataFrame, truth: DataFrame, tested: DataFrame, k: int) -> DataFrame:
    """The first k pairs of each of TP, FP, FN and TN, by key; a report, so limited by design."""
    marks = tested.select(*PAIR).join(pred.select(*PAIR, F.lit(1).alias("p")), PAIR, "left").join(truth.select(*PAIR, F.lit(1).alias("g")), PAIR, "left")
    p, g = F.col("p").isNotNull(), F.col("g").isNotNull()
    label = F.when(p & g, "TP").when(p, "FP").when(g, "FN").otherwise("TN")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label").orderBy(*PAIR))
    return marks.select(*PAIR, label.alias("label")).withColumn("rank", rank).where(F.col("rank") <= k)
