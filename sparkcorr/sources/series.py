"""Sources of long series (id STRING, t BIGINT, v DOUBLE)."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOURS_A_YEAR = 8760


def from_wide(wide: DataFrame, t: str, ids: list[str] | None = None) -> DataFrame:
    """One row a series and tick from a column a series; nulls stay."""
    ids = ids if ids is not None else [c for c in wide.columns if c != t]
    out = wide.select(F.col(t).cast("long").alias("t"), *(F.col(c).cast("double").alias(c) for c in ids))
    return out.unpivot("t", ids, "id", "v").select("id", "t", "v")


def to_ticks(rows: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """Replace ``ts`` by dense ticks; and the dimension (t, ts) to show times with.

    Ranks come from the sorted distinct times alone, as positions in range partitions, and not from
    a window over all rows.
    """
    times = rows.select(F.col(ts).alias("ts")).where("ts is not null").distinct().sort("ts")
    tagged = times.select("ts", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    tagged = tagged.withColumn("k", F.col("m") - F.shiftleft(F.col("p").cast("long"), 33))
    sizes = {r["p"]: r["n"] for r in tagged.groupBy("p").agg((F.max("k") + 1).alias("n")).collect()}  # one row a partition
    before, offsets = 0, {}
    for p in sorted(sizes):
        offsets[p] = before
        before += sizes[p]
    shift = F.coalesce(*([F.get(F.array(*(F.lit(offsets.get(p, 0)).cast("long") for p in range(max(offsets, default=0) + 1))), F.col("p"))]), F.lit(0).cast("long"))
    dim = tagged.select((F.col("k") + shift).alias("t"), "ts")
    return rows.join(dim, rows[ts] == dim["ts"]).drop("ts"), dim


def zero_filled(counts: DataFrame) -> DataFrame:
    """(id, t, v) with every tick from 0, or the first one if that is earlier, to the last one for every id; 0 where there is none."""
    span = F.broadcast(counts.agg(F.least(F.min("t"), F.lit(0)).cast("long").alias("first"), F.max("t").alias("last")))  # one row
    grid = counts.select("id").distinct().join(span, F.lit(True)).select("id", F.explode(F.sequence("first", "last")).alias("t"))
    return grid.join(counts, ["id", "t"], "left").select("id", "t", F.coalesce("v", F.lit(0).cast("double")).alias("v"))


def counts_by(rows: DataFrame, id_col: str, ts: str, origin: str, unit_seconds: int, value=None) -> DataFrame:
    """Counts, or sums of ``value``, by id and tick of ``unit_seconds`` since ``origin``; zero-filled."""
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lit(origin).cast("timestamp"))
    tick = F.floor(seconds / unit_seconds).cast("long")
    agg = F.count("*") if value is None else F.sum(value)
    counts = rows.groupBy(F.col(id_col).cast("string").alias("id"), tick.alias("t")).agg(agg.cast("double").alias("v"))
    return zero_filled(counts.where("t is not null"))


def station_csv(spark: SparkSession, country: str, variable: str, roots: list[str]) -> DataFrame:
    """(id, ts, v) of ``<country>-<variable>.csv``: date, hour, then a column a station.

    The first root that has the file is read, by Spark, so that roots may be in any store.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for root in roots:
        path = f"{root.rstrip('/')}/{country}-{variable}.csv"
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            break
    else:
        raise FileNotFoundError(f"{country}-{variable}.csv in none of {roots}")
    raw = spark.read.csv(path, header=True, sep=csv_separator(spark, path))
    date, hour, *stations = raw.columns
    ts = F.to_timestamp(F.concat_ws("T", F.col(date), F.lpad(F.col(hour), 2, "0")), "yyyy-MM-dd'T'HH")
    wide = raw.select(ts.alias("ts"), *(F.col(f"`{s}`").cast("double").alias(s) for s in stations))
    return wide.unpivot("ts", stations, "id", "v").select("id", "ts", "v")


def csv_separator(spark: SparkSession, path: str, default: str = ";") -> str:
    """By the header alone: the one of ``;`` and ``,`` that is there more often."""
    header = spark.read.text(path).limit(1).collect()
    line = header[0][0] if header else ""
    semicolons, commas = line.count(";"), line.count(",")
    return default if semicolons == commas else ";" if semicolons > commas else ","


def rival_results(spark: SparkSession, path: str, suffix: str = ".*") -> DataFrame:
    """(id1, id2, t1, max_corr) of headerless files ``<id1>_<id2>_<suffix>.csv``; ids end with four capitals or digits."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    pattern = rf"^(.*[A-Z0-9]{{4}})_(.*[A-Z0-9]{{4}})_{suffix}\.csv$"
    rows = spark.read.csv(path, sep=";", schema="t1 BIGINT, max_corr DOUBLE")
    return rows.select(F.regexp_extract(name, pattern, 1).alias("id1"), F.regexp_extract(name, pattern, 2).alias("id2"), "t1", "max_corr").where("id1 <> ''")


def first_rows(series: DataFrame, count: int) -> DataFrame:
    return series.where(F.col("t") < count)


def last_years(series: DataFrame, years: int) -> DataFrame:
    """The last ``years`` times 8760 ticks."""
    last = F.broadcast(series.agg(F.max("t").alias("__last")))  # one row
    return series.join(last, F.col("t") > F.col("__last") - years * HOURS_A_YEAR).drop("__last")


def first_series(series: DataFrame, ids: list[str], n_var: int) -> DataFrame:
    return series.where(F.col("id").isin(ids[:n_var]))


def train_split(series: DataFrame, n: int, ratio: float) -> DataFrame:
    """The first ``ratio`` of n ticks, half rounded to even; the test set is everything."""
    return series.where(F.col("t") < round(ratio * n))


def loader(name: str) -> Callable[..., DataFrame]:
    """``module:callable``: a loader (spark, country, variable) -> series."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def datasets(variables: list[str], countries: list[str], n_years: list[int], n_vars: list[int]) -> Iterator[dict]:
    """Every combination, with the slug that names its artifacts."""
    for variable in variables:
        for country in countries:
            for years in n_years:
                for n_var in n_vars:
                    slug = f"{country}_{variable}".lower().replace(" ", "_")
                    yield {"variable": variable, "country": country, "n_years": years, "n_var": n_var, "dataset_id": f"{slug}_{n_var}_{years}"}
