"""Artifact tables: canonical columns and order, and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorr.operators.search import append_unseen, strongest

ORDER = {
    "correlated": ["id1", "id2", "t1", "t2"],
    "max_lag_correlated": ["id1", "id2", "t1"],
    "status": ["id1", "id2", "lag", "start_t1", "start_t2"],
    "anomalies": ["id1", "id2", "lag", "time_idx", "anomaly"],
    "candidates": ["id1", "id2", "t1", "t2"],
    "neg_pairs": ["id1", "id2", "t1", "t2"],
}
_TIMES = {"correlated": ("t1", "t2"), "max_lag_correlated": ("t1",), "status": ("start_t1", "start_t2"), "anomalies": ("time_idx",)}


def with_times(rows: DataFrame, kind: str, time_dim: DataFrame | None) -> DataFrame:
    """Add ``<tick>_time`` for each tick column from (t, ts); ticks as they are without a dimension."""
    for c in _TIMES.get(kind, ()):
        if time_dim is None:
            rows = rows.withColumn(f"{c}_time", F.col(c))
        else:
            dim = time_dim.select(F.col("t").alias(c), F.col("ts").alias(f"{c}_time"))
            rows = rows.join(dim, c, "left")
    return rows


def deduplicated(rows: DataFrame, kind: str) -> DataFrame:
    """The stronger of two correlations with one key; an event once."""
    if kind in ("correlated", "max_lag_correlated"):
        return strongest(rows, ORDER[kind], "corr" if kind == "correlated" else "max_corr")
    return rows.dropDuplicates()


def write(rows: DataFrame, kind: str, path: str, *, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """In canonical order, by a range-partitioned external sort. ``fmt`` csv is ``;``-separated with a header."""
    out = rows.sort(*ORDER[kind]).write.mode(mode)
    out.csv(path, sep=";", header=True) if fmt == "csv" else out.format(fmt).save(path)


def append(rows: DataFrame, kind: str, path: str) -> None:
    """Add the rows whose key the table doesn't have yet."""
    spark = rows.sparkSession
    append_unseen(rows, spark.read.parquet(path), ORDER[kind]).write.mode("append").parquet(path)


def to_write(recall_by_window: bool) -> list[str]:
    """What a run keeps: the pairs if they are what recall is measured on, else the events."""
    return ["correlated"] if recall_by_window else ["anomalies"]


def negative_pairs(correlated: DataFrame, threshold: float) -> DataFrame:
    return correlated.where(F.col("corr") <= -threshold)


def delete(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


RUN_RECORD = (
    "dataset_id string, alg string, n_series long, n_ticks long, w long, step long, n_lags long, threshold double, neg_corr boolean, n_vectors long, cell_stretch double, grid_dimension long, "
    "freq_threshold double, sketch_norm string, seed long, seed_toggle long, corr_val boolean, n_w long, total_w long, mem_w long, runtime double, sk_time double, cand_time double, "
    "val_time double, monit_time double, cand_w long, corr_w long, total_candidates long, tested long, validated long, status string, error string"
)


def run_record(spark: SparkSession, **values) -> DataFrame:
    """One row of ``RUN_RECORD``; what isn't given is null."""
    names = [c.split()[0] for c in RUN_RECORD.split(", ")]
    unknown = values.keys() - set(names)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return spark.createDataFrame([tuple(values.get(n) for n in names)], RUN_RECORD)


def sentences(rows: DataFrame, kind: str) -> DataFrame:
    """One readable line a row."""
    forms = {
        "correlated": ("%s at %d and %s at %d: r = %.4f", ["id1", "t1", "id2", "t2", "corr"]),
        "status": ("%s and %s, lag %d: from %d for %d, sign %d", ["id1", "id2", "lag", "start_t1", "duration", "corr_sign"]),
        "anomalies": ("%s and %s, lag %d: %s at %d", ["id1", "id2", "lag", "anomaly", "time_idx"]),
    }
    text, columns = forms[kind]
    return rows.select(F.format_string(text, *columns).alias("line"))
