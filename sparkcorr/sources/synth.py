"""Synthetic series with planted correlations.

Base processes are sequential recurrences, so each series is one pandas group, seeded by (seed,
position): the result doesn't depend on partitioning. Where pairs are planted is planned on the
driver; the plan's size is the number of pairs, not of ticks. Planted templates are then joined
onto the series.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorr.shipping import ship

#: The base processes and their parameters; ``sigma``, the noise's deviation, is 1 for all.
DEFAULTS = {
    "white_noise": {},
    "random_walk": {},
    "seasonal_arma": {"phi": 0.6, "theta": -0.3, "season_period": 200, "season_amplitude": 1.0},
    "seasonal_ar": {"phi_short": 0.3, "phi_long": 0.6, "season_lag": 24},
    "ou": {"theta": 0.3, "mu": 0.0, "dt": 1.0},
    "rw_seasonal_drift": {"drift": 0.05, "season_amplitude": 0.5, "season_period": 288},
    "trend_ar": {"phi": 0.5},
    "integrated_seasonal": {"phi": 0.4, "psi": 0.5, "season_lag": 24},
    "ar1": {"phi": 0.6},
}
PROCESSES = tuple(DEFAULTS)


@dataclass(frozen=True)
class SynthConfig:
    m: int = 8
    n: int = 2000
    w: int = 256
    z: float = 0.001
    threshold: float = 0.7
    corr_sign: str = "both"
    base_proc: str = "ar1"
    observation_noise: float = 0.0
    equalise: int = 0
    equalise_pad: str = "reflect"
    parameters: dict = field(default_factory=dict)  # of the process, beside DEFAULTS
    seed: int = 1

    def __post_init__(self):
        if self.base_proc not in PROCESSES or self.corr_sign not in ("pos", "neg", "both") or self.equalise_pad not in ("reflect", "edge", "constant"):
            raise ValueError("unknown process, sign or padding")
        if self.parameters.keys() - DEFAULTS[self.base_proc].keys() - {"sigma"}:
            raise ValueError(f"{self.base_proc} has the parameters sigma, {', '.join(DEFAULTS[self.base_proc])}")
        if self.w > self.n or self.m < 2:
            raise ValueError("a template must fit a series, and there must be two")

    @property
    def stem(self) -> str:
        own = "".join(f"_{k}{v:g}" for k, v in sorted(self.parameters.items()))
        return f"synth_{self.base_proc}{own}_z{self.z:g}_m{self.m}_n{self.n}_w{self.w}_sign{self.corr_sign}_thr{self.threshold:g}_seed{self.seed}".replace(".", "p")


def _recur(noise: np.ndarray, *coefficients: tuple[int, float]) -> np.ndarray:
    """x[t] = noise[t] + the sum of coefficient * x[t - lag], from the longest lag on; noise alone before."""
    x = noise.copy()
    for t in range(max(lag for lag, _ in coefficients), len(x)):
        x[t] += sum(a * x[t - lag] for lag, a in coefficients)
    return x


def base_process(kind: str, n: int, rng: np.random.Generator, **parameters) -> np.ndarray:
    """One series of a process, with ``parameters`` in place of ``DEFAULTS``."""
    p = {"sigma": 1.0} | DEFAULTS[kind] | parameters
    noise, t = p["sigma"] * rng.standard_normal(n), np.arange(n)
    if kind == "white_noise":
        return noise
    if kind == "random_walk":
        return noise.cumsum()
    if kind == "ar1":
        return _recur(noise, (1, p["phi"]))
    if kind == "ou":  # around mu, in steps of dt
        noise[1:] *= np.sqrt(p["dt"])
        return p["mu"] + _recur(noise, (1, 1 - p["theta"] * p["dt"]))
    if kind == "trend_ar":
        u, slope, curve = np.linspace(0.0, 1.0, n), rng.normal(0.5, 0.2), rng.normal(0.0, 0.1)
        noise[:1] = 0.0
        return slope * u + curve * u * u + _recur(noise, (1, p["phi"]))
    if kind == "seasonal_ar":
        return _recur(noise, (1, p["phi_short"]), (max(1, int(p["season_lag"])), p["phi_long"]))
    if kind == "integrated_seasonal":
        return _recur(noise, (1, p["phi"]), (max(1, int(p["season_lag"])), p["psi"])).cumsum()
    season = p["season_amplitude"] * np.sin(2 * np.pi * t / max(1, p["season_period"]) + rng.uniform(0, 2 * np.pi))
    if kind == "rw_seasonal_drift":  # the season moves the steps
        return (noise + np.where(t > 0, p["drift"] + season, 0.0)).cumsum()
    shocks = p["sigma"] * rng.standard_normal(n)
    return season + _recur(noise + p["theta"] * np.concatenate(([0.0], shocks[:-1])), (1, p["phi"]))


def equalise(x: np.ndarray, width: int, pad: str = "reflect", target: float = 1.0) -> np.ndarray:
    """Divide by the centred rolling deviation, to a common volatility."""
    half = width // 2
    padded = np.pad(x, (half, width - 1 - half), mode=pad)
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    return x / np.maximum(view.std(axis=1), 1e-9) * target


def correlated_template(x: np.ndarray, r: float, sign: int, mean: float, std: float, threshold: float, rng: np.random.Generator, tries: int = 64) -> np.ndarray | None:
    """A vector whose correlation with ``x`` is about sign * r, and at least the threshold in size."""
    unit = (x - x.mean()) / max(x.std(), 1e-12)
    for _ in range(tries):
        y = mean + std * (sign * r * unit + np.sqrt(max(0.0, 1 - r * r)) * rng.standard_normal(len(x)))
        if abs(np.corrcoef(x, y)[0, 1]) >= threshold:
            return y
    return None


def plan(cfg: SynthConfig) -> list[dict]:
    """Where pairs go: two series, a slot in each, a sign and a target; slots of w ticks, none used twice."""
    rng = np.random.default_rng([cfg.seed, 1 << 20])
    goal = int(cfg.z * cfg.m * cfg.n / (2 * cfg.w))
    free = [list(rng.permutation(cfg.n // cfg.w)) for _ in range(cfg.m)]
    out = []
    while len(out) < goal:
        room = np.array([len(f) for f in free], float)
        if (room > 0).sum() < 2:
            break
        a, b = rng.choice(cfg.m, 2, replace=False, p=room / room.sum())
        sign = {"pos": 1, "neg": -1}.get(cfg.corr_sign, 1 if len(out) % 2 == 0 else -1)
        out.append({"pair": len(out), "pos1": int(a), "pos2": int(b), "start1": int(free[a].pop()) * cfg.w, "start2": int(free[b].pop()) * cfg.w, "sign": sign, "r": float(rng.uniform(cfg.threshold, 1))})
    return out


def generate(spark: SparkSession, cfg: SynthConfig) -> tuple[DataFrame, DataFrame, dict]:
    """Series (id, t from 1, v), truth (id1, id2, time1, time2, corr) and metadata."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pos = int(pdf["pos"].iloc[0])
        rng = np.random.default_rng(np.random.SeedSequence([cfg.seed, pos]))
        x = base_process(cfg.base_proc, cfg.n, rng, **cfg.parameters)
        if cfg.observation_noise:
            x = x + cfg.observation_noise * rng.standard_normal(cfg.n)
        if cfg.equalise:
            x = equalise(x, cfg.equalise, cfg.equalise_pad)
        return pd.DataFrame({"pos": pos, "t": np.arange(1, cfg.n + 1), "v": x})

    ship(spark)
    base = spark.range(cfg.m).withColumnRenamed("id", "pos").groupBy("pos").applyInPandas(walk, "pos long, t long, v double")
    placed = plan(cfg)
    schema = "pair long, pos1 long, pos2 long, start1 long, start2 long, sign long, r double"
    spots = spark.createDataFrame([tuple(p[k.split()[0]] for k in schema.split(", ")) for p in placed], schema)
    slot = F.floor((F.col("t") - 1) / cfg.w).cast("long") * cfg.w
    source = base.withColumn("start1", slot).join(F.broadcast(spots.withColumnRenamed("pos1", "pos")), ["pos", "start1"])

    def mirror(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        x = pdf.sort_values("t")["v"].to_numpy()
        rng = np.random.default_rng([cfg.seed, 1 << 21, int(first["pair"])])
        y = correlated_template(x, first["r"], int(first["sign"]), x.mean(), max(x.std(), 1e-9), cfg.threshold, rng)
        if y is None:
            return pd.DataFrame({"pair": [], "pos": [], "t": [], "v": [], "corr": []}).astype({"pair": "int64", "pos": "int64", "t": "int64"})
        t = int(first["start2"]) + 1 + np.arange(len(y))
        return pd.DataFrame({"pair": int(first["pair"]), "pos": int(first["pos2"]), "t": t, "v": y, "corr": np.corrcoef(x, y)[0, 1]})

    planted = source.groupBy("pair").applyInPandas(mirror, "pair long, pos long, t long, v double, corr double")
    name = F.concat(F.lit("s"), (F.col("pos") + 1).cast("string"))
    out = base.join(planted.select("pos", "t", F.col("v").alias("new")), ["pos", "t"], "left").select(name.alias("id"), "t", F.coalesce("new", "v").cast("float").cast("double").alias("v"))
    label = lambda c: F.concat(F.lit("s"), (F.col(c) + 1).cast("string"))
    truth = planted.groupBy("pair").agg(F.first("corr").alias("corr")).join(F.broadcast(spots), "pair").select(label("pos1").alias("id1"), label("pos2").alias("id2"), (F.col("start1") + 1).alias("time1"), (F.col("start2") + 1).alias("time2"), "corr")
    meta = asdict(cfg) | {"pair_goal": int(cfg.z * cfg.m * cfg.n / (2 * cfg.w)), "pairs_used": len(placed), "achieved_z": 2 * len(placed) * cfg.w / (cfg.m * cfg.n)}
    return out, truth, meta


def cached(spark: SparkSession, cfg: SynthConfig, root: str, *, refresh: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """The same from Parquet under ``root``, made on first use."""
    path = f"{root.rstrip('/')}/{cfg.stem}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    if refresh or not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        series, truth, meta = generate(spark, cfg)
        series.write.mode("overwrite").parquet(f"{path}/series")
        truth.write.mode("overwrite").parquet(f"{path}/truth")
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return spark.read.parquet(f"{path}/series"), spark.read.parquet(f"{path}/truth"), json.loads(spark.read.text(f"{path}/meta").first()[0])
