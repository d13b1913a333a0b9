"""Parameter search, selection, and small table operations around it."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trials(grid: dict[str, list]) -> list[dict]:
    """The Cartesian product of a parameter grid, in its order."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def run_trials(grid: dict[str, list], trial: Callable[[dict], dict]) -> list[dict]:
    """One record a trial; a trial that raises is recorded as failed and the rest go on."""
    out = []
    for params in trials(grid):
        began = time.perf_counter()
        try:
            out.append(params | trial(params) | {"status": "success", "error": None})
        except Exception as error:
            out.append(params | {"status": "failed", "error": f"{type(error).__name__}: {error}"[:500]})
        out[-1].setdefault("runtime", time.perf_counter() - began)
    return out


def select_best(rows: DataFrame, *, target_recall: float = 0.95, fallback_ratio: float = 0.98, speedup_ratio: float = 0.98) -> DataFrame:
    """The row of a search with the fewest candidates among those near the best speedup.

    Successful rows; of them those that are faster than the exact plan with a vote threshold below
    1, if any; those with the target recall, else near the best recall; those near the best
    speedup; then fewest ``cand_w``, highest ``speedup``. One pass of window-free aggregates a rule.
    """
    clamp = lambda x: min(max(float(x), 0.0), 1.0)
    ok = rows.where("status = 'success'") if "status" in rows.columns else rows

    def prefer(df: DataFrame, wanted, otherwise) -> DataFrame:
        """Rows with ``wanted``, or if there are none those with ``otherwise``."""
        marked = df.withColumn("__wanted", F.coalesce(wanted, F.lit(False)))
        some = F.broadcast(marked.agg(F.coalesce(F.bool_or("__wanted"), F.lit(False)).alias("__some"), F.max("recall").alias("__recall")))
        return marked.join(some, F.lit(True)).where(F.when(F.col("__some"), F.col("__wanted")).otherwise(otherwise)).drop("__wanted", "__some", "__recall")

    feasible = prefer(ok, (F.col("speedup") > 1) & (F.col("freq_threshold") < 1), F.lit(True))
    floor = F.greatest(F.col("__recall") * clamp(fallback_ratio), F.lit(0).cast("double"))
    recalled = prefer(feasible, F.col("recall") >= target_recall, F.col("recall") >= floor)
    best = F.broadcast(recalled.agg(F.max("speedup").alias("__best")))
    near = recalled.join(best, F.col("speedup") >= F.col("__best") * clamp(speedup_ratio)).drop("__best")
    return near.orderBy(F.asc_nulls_last("cand_w"), F.desc("speedup")).limit(1)


def save_best(best: DataFrame, path: str) -> None:
    """The selected row as JSON, through Spark, so that any store will do."""
    best.coalesce(1).write.mode("overwrite").json(path)


def load_best(spark: SparkSession, path: str) -> dict:
    row = spark.read.json(path).first()
    return json.loads(json.dumps(row.asDict(recursive=True), default=str)) if row else {}


def strongest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key: the largest absolute value, of equals the larger."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.abs(value), F.col(value)))
    return rows.groupBy(*keys).agg(best.alias("row")).select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest))


def append_unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in ``seen``, each key once."""
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def recent_years(rows: DataFrame, years: int, ts: str) -> DataFrame:
    """Rows from 1 January of the year of the last one, less ``years`` - 1."""
    last = F.broadcast(rows.agg(F.year(F.max(ts)).alias("__last")))
    return rows.join(last, F.year(ts) >= F.col("__last") - (years - 1)).drop("__last")


def by_membership(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Rows all of whose ``columns`` hold an id of ``ids``."""
    for c in columns:
        rows = rows.join(ids.select(F.col(ids.columns[0]).alias(c)).distinct(), c, "left_semi")
    return rows
