"""Streaming: the lagged correlator and the episode monitor as stateful operators.

A time chunk is the step: rows (id, t, v) arrive in any partitioning. The correlator keeps, for
each group of series pairs, the windows of the last ``n_lags`` ticks; the monitor keeps one small
record a key. Both emit what the batch operators give for the same ticks. Rows that come after their
tick's step has been closed are dropped; ``lateness`` says for how many ticks a step stays open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from sparkcorr.config import CorrConfig
from sparkcorr.shipping import ship

PAIRS = "id1 string, t1 long, id2 string, t2 long, lag long, corr double"
EVENTS = "id1 string, id2 string, lag long, time_idx long, anomaly string"


def _normalised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are neither incomplete, constant nor spiked; and these, centred and of length 1."""
    w = x.shape[1]
    rows = np.flatnonzero(~np.isnan(x).any(1))
    d = x[rows] - x[rows].mean(1, keepdims=True)
    ssd = (d * d).sum(1)
    ok = ssd > 1e-6 * w
    if w >= 4:
        with np.errstate(divide="ignore", invalid="ignore"):
            ok &= (d**4).mean(1) / (ssd / w) ** 2 - 3 <= 5
    return rows[ok], d[ok] / np.sqrt(ssd[ok])[:, None]


def correlate_stream(series: DataFrame, cfg: CorrConfig, *, lateness: int = 0) -> DataFrame:
    """Validated pairs of a streaming (id, t, v), each once its later window is complete.

    State is keyed by a pair of series blocks, ``id_blocks`` of them; it is one matrix of the retained
    ticks. A step closes when a tick is seen that is ``lateness`` ticks past its last one; until then a
    step's ticks may come in any micro-batch. With 0, a micro-batch must hold all series' ticks of the
    steps that it closes, as a source of whole chunks does.
    """
    ship(series.sparkSession)
    blocks = cfg.id_blocks
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    dealt = series.withColumn("own", own).withColumn("other", every).select(
        F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), F.col("own").alias("own"), "id", F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v")
    )
    origin = cfg.origin or 0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        across = key[0] != key[1]
        ids, owns, first, done, kept = [], [], origin, -1, np.zeros((0, 0))
        if state.exists:
            ids, owns, first, done, raw = state.get
            ids, owns = list(ids), list(owns)
            kept = np.frombuffer(raw, np.float64).reshape(len(ids), -1) if ids else kept
        new = pd.concat([p[["own", "id", "t", "v"]] for p in batches])
        new = new[(new["t"] >= max(first, origin + (done + 1) * cfg.step)) & new["v"].notna()]
        newest = max(done, int((new["t"].max() - origin - lateness + 1) // cfg.step - 1)) if len(new) else done
        row_of = {i: k for k, i in enumerate(ids)}
        for i, block in new[["id", "own"]].drop_duplicates("id").itertuples(index=False):
            if i not in row_of:
                row_of[i] = len(ids)
                ids.append(i)
                owns.append(int(block))
        ticks = max(kept.shape[1], int(new["t"].max()) - first + 1 if len(new) else 0)
        values = np.full((len(ids), ticks), np.nan)
        values[: kept.shape[0], : kept.shape[1]] = kept
        values[new["id"].map(row_of).to_numpy(int), new["t"].to_numpy() - first] = new["v"].to_numpy()
        rank = np.empty(len(ids), np.int64)
        rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        of_block, windows, out = np.array(owns), {}, []
        for s in range(done + 1, newest + 1):
            t1 = origin + (s + 1) * cfg.step - cfg.w
            if t1 < origin:
                continue
            for t0 in range(max(origin, t1 - cfg.n_lags), t1 + 1, cfg.step):
                if t0 not in windows:
                    windows[t0] = _normalised(values[:, t0 - first : t0 - first + cfg.w])
            windows = {t0: x for t0, x in windows.items() if t0 >= t1 - cfg.n_lags}
            rows, x = windows[t1]
            for t0, (others, y) in windows.items():
                r = np.clip(x @ y.T, -1, 1)
                ok = (np.abs(r) if cfg.neg_corr else r) >= cfg.threshold
                if t0 == t1:
                    ok &= rank[rows][:, None] < rank[others]
                if across:  # a pair within a block belongs to that block's key
                    ok &= of_block[rows][:, None] != of_block[others]
                out += [(ids[rows[a]], t1, ids[others[b]], t0, t1 - t0, r[a, b]) for a, b in zip(*np.nonzero(ok))]
        keep = max(first, origin + (newest + 2) * cfg.step - cfg.w - cfg.n_lags)
        state.update((ids, owns, keep, newest, np.ascontiguousarray(values[:, keep - first :]).tobytes()))
        yield pd.DataFrame(out, columns=["id1", "t1", "id2", "t2", "lag", "corr"])

    kept = "ids array<string>, owns array<long>, first long, done long, vals binary"
    return dealt.groupBy("b1", "b2").applyInPandasWithState(step, PAIRS, kept, "append", GroupStateTimeout.NoTimeout)


def monitor_stream(correlated: DataFrame, cfg: CorrConfig) -> DataFrame:
    """Events of a streaming table of correlated windows (``PAIRS``), whose anchors come in order.

    State is one record a key: last anchor, its partner, sign. An end is reported with the first
    anchor that shows the gap, or, at the last, never: as in the batch operator what holds at the end
    of the stream hasn't ended.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("t1")
        out = []
        for t1, t2, r in rows[["t1", "t2", "corr"]].itertuples(index=False):
            sign = 1 if r >= 0 else -1
            if last is not None and t1 <= last[0]:
                continue  # late
            contiguous = last is not None and t1 == last[0] + cfg.step
            if last is not None and not contiguous:
                out.append((*key, min(last[0], last[1]) + cfg.step, "out_of"))
            if not (contiguous and last[2] == sign):
                other = last is not None and last[2] != sign and (contiguous or cfg.carry_sign_over_gap)
                out.append((*key, min(t1, t2), "changed_sign" if other else "into"))
            last = (int(t1), int(t2), sign)
        state.update(last)
        yield pd.DataFrame(out, columns=["id1", "id2", "lag", "time_idx", "anomaly"])

    ship(correlated.sparkSession)
    return correlated.groupBy("id1", "id2", "lag").applyInPandasWithState(step, EVENTS, "t1 long, t2 long, sign long", "append", GroupStateTimeout.NoTimeout)


def score_stream(correlated: DataFrame, truth: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch's true positives, by anchor, while the stream runs.

    A micro-batch's counts are the folder ``batch=<id>``, which a retry writes over.
    """
    keys = ["id1", "t1", "id2", "t2"]

    def score(batch: DataFrame, batch_id: int) -> None:
        hit = truth.select(*keys, F.lit(True).alias("hit"))
        counts = batch.join(hit, keys, "left").groupBy("t1").agg(F.count("*").alias("pred"), F.count_if("hit").alias("tp"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return correlated.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).start()


def read_series(spark, path: str, max_files: int = 1) -> DataFrame:
    """A folder of Parquet files (id, t, v) as a stream, some files a micro-batch."""
    schema = StructType.fromDDL("id string, t long, v double")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
