"""Runs with records: the exact plan, the sketch plan, parameter search, and comparison.

A run writes its tables under a folder and returns one record; times are wall-clock times of the
jobs. Intermediate pairs are written once and read by what follows, so that monitoring and counting
don't repeat the join.
"""

from __future__ import annotations

import time
from dataclasses import replace
from itertools import count

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sparkcorr.config import CorrConfig
from sparkcorr.operators import metrics, monitor, pairs, search
from sparkcorr.operators.candidates import proposed, with_payload
from sparkcorr.operators.sketch import sketches
from sparkcorr.plans.query import CorrQuery
from sparkcorr.sources import artifacts
from sparkcorr.sources.series import train_split


def _timed(job) -> tuple:
    began = time.perf_counter()
    out = job()
    return out, time.perf_counter() - began


def run(series: DataFrame, cfg: CorrConfig, method: str, folder: str, *, dataset_id: str = "", recall_by_window: bool | None = None) -> dict:
    """Correlated pairs, status, events and strongest lags under ``folder``; and the run's record.

    The exact plan correlates by blocks; its candidates are counted, and not written. The sketch plan's
    sketches and candidates are written, each with its own time.
    ``recall_by_window`` limits what is kept to the pairs (True) or the events (False); None keeps all.
    """
    spark = series.sparkSession
    size = series.agg(F.count_distinct("id").alias("m"), (F.max("t") - F.min("t") + 1).alias("n")).first()
    cfg = replace(cfg, id_blocks=max(cfg.id_blocks, cfg.blocks_for(size.m)))
    query = CorrQuery(series, cfg, method)
    by_blocks = method == "exact" and cfg.corr_val
    began = time.perf_counter()

    def sketch() -> None:
        if method == "sketch":
            sketches(query.sketched_windows.where(~F.col("is_const")), cfg).select("id", "t0", "sketch").write.mode("overwrite").parquet(f"{folder}/sketches")

    def propose() -> int:
        if by_blocks:
            return pairs.exact_counts(query.windows, cfg).first().total_candidates
        if method == "exact":
            keys = pairs.pair_keys(query.candidates)
        else:
            keys = proposed(spark.read.parquet(f"{folder}/sketches"), cfg).select(F.col("x_id").alias("id1"), F.col("x_t0").alias("t1"), F.col("y_id").alias("id2"), F.col("y_t0").alias("t2"))
        keys.write.mode("overwrite").parquet(f"{folder}/candidates")
        return spark.read.parquet(f"{folder}/candidates").count()

    _, sk_time = _timed(sketch)
    cand_w, cand_time = _timed(propose)

    def validate() -> Row:
        if by_blocks:
            query.correlated.write.mode("overwrite").parquet(f"{folder}/correlated")
            validated = spark.read.parquet(f"{folder}/correlated").count()
            return Row(**pairs.exact_counts(query.windows, cfg).first().asDict(), validated=validated)
        keys = spark.read.parquet(f"{folder}/candidates").select(F.col("id1").alias("x_id"), F.col("t1").alias("x_t0"), F.col("id2").alias("y_id"), F.col("t2").alias("y_t0"))
        held = with_payload(keys, query.windows)
        pairs.validate(held, cfg).write.mode("overwrite").parquet(f"{folder}/correlated")
        return pairs.counters(held, cfg).first()

    counts, val_time = _timed(validate)
    found = spark.read.parquet(f"{folder}/correlated")

    def follow() -> None:
        kept = None if recall_by_window is None else artifacts.to_write(recall_by_window)
        tables = {"status": monitor.status(found, cfg), "anomalies": monitor.anomalies(found, cfg, query.last_anchor), "max_lag_correlated": monitor.max_lag(found)}
        for kind, rows in tables.items():
            if kept is None or kind in kept:
                artifacts.write(rows, kind, f"{folder}/{kind}")

    _, monit_time = _timed(follow)
    values = {k: getattr(cfg, k) for k in ("w", "step", "n_lags", "threshold", "neg_corr", "n_vectors", "cell_stretch", "grid_dimension", "freq_threshold", "sketch_norm", "seed", "seed_toggle", "corr_val")}
    counted = cfg.counts(size.n or 0, size.m)
    return values | {
        "dataset_id": dataset_id, "alg": method, "n_series": size.m, "n_ticks": size.n, "n_w": counted["n_w"], "total_w": counted["total_w"], "mem_w": counted["mem_w"], "runtime": time.perf_counter() - began,
        "sk_time": sk_time, "cand_time": cand_time, "val_time": val_time, "monit_time": monit_time, "cand_w": cand_w, "corr_w": found.count(),
        "total_candidates": counts.total_candidates, "tested": counts.tested, "validated": counts.validated, "status": "success", "error": None,
    }


def _agreement(spark, folder: str, truth: str, tested: int) -> dict:
    total = spark.createDataFrame([(tested,)], "tested long")
    found, real = (spark.read.parquet(f"{f}/correlated") for f in (folder, truth))
    out = metrics.window_metrics(found, real, total).first().asDict()
    lags = metrics.max_lag_metrics(monitor.max_lag(found), monitor.max_lag(real)).first()
    return out | {"max_lag_diff_mean": lags.diff_mean, "max_lag_diff_std": lags.diff_std}


def _derived(spark, record: dict, truth: dict) -> dict:
    names = {k: record[k] for k in ("runtime", "cand_time", "sk_time", "cand_w", "corr_w")} | {f"{k}_bf": truth[k] for k in ("runtime", "cand_time", "val_time", "monit_time", "cand_w", "corr_w")}
    row = metrics.diagnostics(spark.createDataFrame([Row(**{k: float(v) for k, v in names.items()})])).first().asDict()
    return {k: row[k] for k in row if k not in names} | {f"{k}_bf": truth[k] for k in ("runtime", "cand_w", "corr_w")}


def training(series: DataFrame, train_ratio: float) -> DataFrame:
    """The first ``train_ratio`` of the ticks of ``series``, counted from its first one."""
    if train_ratio >= 1:
        return series
    span = series.agg(F.min("t").alias("first"), F.max("t").alias("last")).first()
    return series if span.first is None else train_split(series.withColumn("t", F.col("t") - span.first), span.last - span.first + 1, train_ratio).withColumn("t", F.col("t") + span.first)


def param_search(series: DataFrame, cfg: CorrConfig, grid: dict[str, list], folder: str, *, train_ratio: float = 1.0, **selection) -> tuple[DataFrame, DataFrame]:
    """All trials of a grid of ``CorrConfig`` fields against the exact plan, and the row to use.

    Trials run on the first ``train_ratio`` of the ticks; each has its folder, ``trial=0`` and so on.
    """
    spark, number = series.sparkSession, count()
    series = training(series, train_ratio)
    truth = run(series, cfg, "exact", f"{folder}/exact")

    def trial(params: dict) -> dict:
        own = f"{folder}/trial={next(number)}"
        record = run(series, replace(cfg, **params), "sketch", own)
        return record | _agreement(spark, own, f"{folder}/exact", truth["tested"]) | _derived(spark, record, truth)

    rows = search.run_trials(grid, trial)
    columns = list(dict.fromkeys(k for r in rows for k in r))
    sample = {k: next((r[k] for r in rows if r.get(k) is not None), "") for k in columns}
    kind = lambda v: "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
    schema = ", ".join(f"`{k}` {kind(v)}" for k, v in sample.items())
    table = spark.createDataFrame([tuple(r.get(k) if not isinstance(sample[k], float) or r.get(k) is None else float(r[k]) for k in columns) for r in rows], schema)
    return table, search.select_best(table, **selection)


def search_and_compare(series: DataFrame, cfg: CorrConfig, grid: dict[str, list], folder: str, *, train_ratio: float = 0.3, rival: DataFrame | None = None, dataset_id: str = "", **selection) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trials on the first ``train_ratio`` of the ticks, the row selected, and the comparison on all ticks with its parameters."""
    rows, best = param_search(series, cfg, grid, f"{folder}/search", train_ratio=train_ratio, **selection)
    chosen = best.first()
    tuned = replace(cfg, **{k: chosen[k] for k in grid}) if chosen else cfg
    return rows, best, compare(series, tuned, f"{folder}/compare", rival=rival, dataset_id=dataset_id)


def compare(series: DataFrame, cfg: CorrConfig, folder: str, *, rival: DataFrame | None = None, dataset_id: str = "") -> DataFrame:
    """One row a plan: its record, its agreement with the exact plan, and derived diagnostics.

    ``rival`` has another system's (id1, id2, t1, max_corr); only its strongest lags are compared.
    """
    spark = series.sparkSession
    truth = run(series, cfg, "exact", f"{folder}/exact", dataset_id=dataset_id)
    main = run(series, cfg, "sketch", f"{folder}/sketch", dataset_id=dataset_id)
    real = f"{folder}/exact"
    rows = []
    for record, own in ((truth, real), (main, f"{folder}/sketch")):
        rows.append(record | _agreement(spark, own, real, truth["tested"]) | _derived(spark, record, truth))
    if rival is not None:
        best = search.strongest(rival.select("id1", "id2", "t1", "max_corr"), ["id1", "id2", "t1"], "max_corr")
        lags = metrics.max_lag_metrics(best, monitor.max_lag(spark.read.parquet(f"{real}/correlated"))).first()
        rows.append({"dataset_id": dataset_id, "alg": "rival", "status": "success", "max_lag_diff_mean": lags.diff_mean, "max_lag_diff_std": lags.diff_std})
    fields = {c.split()[0]: c.split()[1] for c in artifacts.RUN_RECORD.split(", ")}
    rest = [k for k in rows[0] if k not in fields]
    schema = artifacts.RUN_RECORD + "".join(f", {k} {'long' if isinstance(rows[0][k], int) else 'double'}" for k in rest)
    return spark.createDataFrame([tuple(r.get(k) for k in [*fields, *rest]) for r in rows], schema)
