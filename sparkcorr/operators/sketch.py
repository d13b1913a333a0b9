"""Random-projection sketches of windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcorr.config import CorrConfig
from sparkcorr.functions.window_math import dot, total


def weights(cfg: CorrConfig) -> np.ndarray:
    """(K, w) signs over root K: one block of base signs, toggled for each basic window."""
    k, b = cfg.n_vectors, cfg.basic_window
    base = np.random.RandomState(cfg.seed).choice([1, -1], size=(k, b)) / np.sqrt(k)
    toggle = np.random.RandomState(cfg.seed_toggle).choice([1, -1], size=(cfg.w // b, k))
    return np.concatenate([base * toggle[j][:, None] for j in range(cfg.w // b)], axis=1)


def project(windows: DataFrame, cfg: CorrConfig, *, centred: bool) -> DataFrame:
    """``windows`` with the array ``sketch``: K dot products. ``centred`` projects x - mean.

    The weights are a literal of the plan, K * w numbers; only numbers of the size of a window
    travel with the plan, whatever the data.
    """
    w = weights(cfg)
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in w))
    mean = total(F.col("xs")) / F.lit(float(cfg.w))
    sums = F.array(*(F.lit(float(s)) for s in w.sum(axis=1)))
    raw = F.transform(rows, lambda row: dot(row, F.col("xs")))
    sketch = F.zip_with(raw, sums, lambda r, s: r - s * F.col("__mean")) if centred else raw
    return windows.withColumn("__mean", mean).withColumn("sketch", sketch).drop("__mean")


def unit(xs: Column) -> Column:
    """To length 1; zeros if the length is 0."""
    norm = F.sqrt(total(F.transform(xs, lambda x: x * x)))
    return F.when(norm > 0, F.transform(xs, lambda x: x / norm)).otherwise(F.transform(xs, lambda x: F.lit(0).cast("double")))


def standard(xs: Column, k: int) -> Column:
    """Mean 0 and deviation 1 over the coordinates; zeros if they are all equal."""
    mean = total(xs) / F.lit(float(k))
    dev = F.sqrt(F.greatest(total(F.transform(xs, lambda x: x * x)) / F.lit(float(k)) - mean * mean, F.lit(0).cast("double")))
    return F.when(dev > 0, F.transform(xs, lambda x: (x - mean) / dev)).otherwise(F.transform(xs, lambda x: F.lit(0).cast("double")))


def sketches(windows: DataFrame, cfg: CorrConfig) -> DataFrame:
    """Normalised sketches of windows: by mean and length (``mean_l2``), or ``z`` over coordinates."""
    raw = project(windows, cfg, centred=cfg.sketch_norm == "mean_l2")
    norm = unit(F.col("sketch")) if cfg.sketch_norm == "mean_l2" else standard(F.col("sketch"), cfg.n_vectors)
    return raw.withColumn("sketch", norm)


def chunks(sketched: DataFrame, cfg: CorrConfig) -> DataFrame:
    """One row a grid: ``grid``, and its chunk of the sketch in ``sketch``; all-zero chunks go."""
    d = cfg.grid_dimension
    parts = F.transform(F.sequence(F.lit(0), F.lit(cfg.n_grids - 1)), lambda g: F.slice("sketch", g * d + 1, d))
    rest = [c for c in sketched.columns if c != "sketch"]
    out = sketched.select(*rest, F.posexplode(parts).alias("grid", "sketch"))
    return out.where(F.exists("sketch", lambda x: x != 0))


def cosine(u: Column, v: Column) -> Column:
    """The sketches' estimate of r."""
    norm = F.sqrt(dot(u, u) * dot(v, v))
    return F.when(norm > 0, F.try_divide(dot(u, v), norm))
