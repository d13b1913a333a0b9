"""Ready-made queries over the driver's tables, with the SQL that gives the same rows.

Series are integer-valued counts and sums, so that moments are exact in DOUBLE on any engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorr.config import CorrConfig
from sparkcorr.operators import candidates as cand
from sparkcorr.operators import metrics, monitor, pairs, search
from sparkcorr.operators import sketch as sk
from sparkcorr.operators import windows as win
from sparkcorr.plans import experiment
from sparkcorr.plans.query import CorrQuery
from sparkcorr.sources import artifacts
from sparkcorr.sources import series as src

Query = Callable[[SparkSession, str], DataFrame]

HOURS = 720  # up to which reports count what holds at the end
CFG = CorrConfig(w=48, step=12, n_lags=48, threshold=0.3, n_vectors=8)
ABS = replace(CFG, neg_corr=True)
DAILY = CorrConfig(w=28, step=7, n_lags=0, threshold=0.5)
WEEKLY = CorrConfig(w=24, step=12, n_lags=48, threshold=0.5, n_vectors=8)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.counts_by(_table(spark, sf_dir, "events"), "event_type", "ts", "2024-01-01 00:00:00", 3600)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.counts_by(_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "1995-01-01 00:00:00", 86400)


def weekly_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.counts_by(_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", "1995-01-02 00:00:00", 604800, F.col("l_quantity"))


def _r(c: str, digits: int = 4):
    return F.round(c, digits).alias(c)


def _corr(df: DataFrame) -> DataFrame:
    return df.select("id1", "t1", "id2", "t2", "lag", _r("corr"))


def query(spark: SparkSession, sf_dir: str, cfg: CorrConfig = CFG, method: str = "exact") -> CorrQuery:
    return CorrQuery(hourly_events(spark, sf_dir), cfg, method)


_HOUR = "CAST(floor((epoch(CAST(ts AS TIMESTAMP)) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS BIGINT)"


def _series_sql(source: str, id_: str, tick: str, value: str = "count(*)") -> str:
    return f"""counted AS (SELECT CAST({id_} AS VARCHAR) AS id, {tick} AS t, CAST({value} AS DOUBLE) AS v FROM {source} GROUP BY 1, 2),
series AS (SELECT i.id, g.t, coalesce(c.v, CAST(0 AS DOUBLE)) AS v
  FROM (SELECT DISTINCT id FROM counted) i CROSS JOIN (SELECT unnest(generate_series(least(min(t), 0), max(t))) AS t FROM counted) g
  LEFT JOIN counted c ON c.id = i.id AND c.t = g.t)"""


EVENTS = _series_sql("events", "event_type", _HOUR)
ORDERS = _series_sql("orders", "o_orderpriority", "CAST(floor((epoch(CAST(o_orderdate AS TIMESTAMP)) - epoch(TIMESTAMP '1995-01-01')) / 86400) AS BIGINT)")
LINES = _series_sql("lineitem", "l_suppkey", "CAST(floor((epoch(CAST(l_shipdate AS TIMESTAMP)) - epoch(TIMESTAMP '1995-01-02')) / 604800) AS BIGINT)", "sum(l_quantity)")


def _windows_sql(cfg: CorrConfig, source: str = "series") -> str:
    w = cfg.w
    spike = f"coalesce((s4/{w}e0 - 4e0*(s1/{w}e0)*(s3/{w}e0) + 6e0*(s1/{w}e0)*(s1/{w}e0)*(s2/{w}e0) - 3e0*(s1/{w}e0)*(s1/{w}e0)*(s1/{w}e0)*(s1/{w}e0)) / nullif((s2/{w}e0 - (s1/{w}e0)*(s1/{w}e0)) * (s2/{w}e0 - (s1/{w}e0)*(s1/{w}e0)), 0e0) - 3e0 > 5e0, false)"
    return f"""lists AS (SELECT id, list(v ORDER BY t) AS vs FROM {source} GROUP BY id),
cut AS (SELECT id, t0, vs[t0 + 1 : t0 + {w}] AS xs FROM (SELECT id, vs, unnest(range(0, len(vs) - {w} + 1, {cfg.step})) AS t0 FROM lists)),
summed AS (SELECT *, list_sum(xs) AS s1, list_sum([x * x for x in xs]) AS s2, list_sum([x * x * x for x in xs]) AS s3, list_sum([x * x * x * x for x in xs]) AS s4 FROM cut),
windows AS (SELECT *, s2 - s1 * s1 / {w}e0 <= {1e-6 * w!r}::DOUBLE AS is_const, {spike} AS is_spiked FROM summed)"""


def _pairs_sql(cfg: CorrConfig) -> str:
    w = cfg.w
    return f"""pairs AS (SELECT a.id AS id1, a.t0 AS t1, b.id AS id2, b.t0 AS t2, a.t0 - b.t0 AS lag, a.is_spiked OR b.is_spiked AS spiked, a.s1 AS sx, a.s2 AS sxx, b.s1 AS sy, b.s2 AS syy, list_dot_product(a.xs, b.xs) AS sxy, a.xs AS ax, b.xs AS bx
  FROM windows a JOIN windows b ON b.t0 BETWEEN a.t0 - {cfg.n_lags} AND a.t0 AND (b.t0 < a.t0 OR a.id < b.id) WHERE NOT a.is_const AND NOT b.is_const),
measured AS (SELECT *, greatest(-1e0, least(1e0, (sxy - sx * sy / {w}e0) / sqrt((sxx - sx * sx / {w}e0) * (syy - sy * sy / {w}e0)))) AS corr, sqrt(greatest(0e0, sxx + syy - 2 * sxy)) AS dist FROM pairs)"""


def _passes_sql(cfg: CorrConfig) -> str:
    r = "abs(corr)" if cfg.neg_corr else "corr"
    return f"NOT spiked AND {r} >= {cfg.threshold!r}::DOUBLE"


def _correlated_sql(cfg: CorrConfig, series: str = EVENTS) -> str:
    return f"{series}, {_windows_sql(cfg)}, {_pairs_sql(cfg)}, correlated AS (SELECT id1, t1, id2, t2, lag, round(corr, 4) AS corr FROM measured WHERE {_passes_sql(cfg)})"


def _monitor_sql(cfg: CorrConfig, carry: bool = True) -> str:
    changed = "prev_sign IS NOT NULL AND prev_sign <> corr_sign" + ("" if carry else " AND contiguous")
    return f"""signed AS (SELECT *, CASE WHEN corr >= 0 THEN 1 ELSE -1 END AS corr_sign FROM correlated),
looked AS (SELECT *, lag(t1) OVER k AS prev_t1, lag(corr_sign) OVER k AS prev_sign, lead(t1) OVER k AS next_t1 FROM signed WINDOW k AS (PARTITION BY id1, id2, lag ORDER BY t1)),
started AS (SELECT *, coalesce(prev_t1 = t1 - {cfg.step}, false) AS contiguous, NOT coalesce(prev_t1 = t1 - {cfg.step} AND prev_sign = corr_sign, false) AS starts FROM looked),
runs AS (SELECT *, sum(starts::INT) OVER (PARTITION BY id1, id2, lag ORDER BY t1) AS episode FROM started),
status AS (SELECT id1, id2, lag, min(t1) AS start_t1, min(t2) AS start_t2, CAST({cfg.w} + (count(*) - 1) * {cfg.step} AS BIGINT) AS duration, CAST(min(corr_sign) AS BIGINT) AS corr_sign FROM runs GROUP BY id1, id2, lag, episode),
anomalies AS (
  SELECT id1, id2, lag, least(t1, t2) AS time_idx, CASE WHEN {changed} THEN 'changed_sign' ELSE 'into' END AS anomaly FROM runs WHERE starts
  UNION ALL SELECT id1, id2, lag, least(t1, t2) + {cfg.step}, 'out_of' FROM runs
  WHERE (next_t1 IS NULL OR next_t1 <> t1 + {cfg.step}) AND t1 < (SELECT max(t0) FROM windows))"""


def _total_time(cfg: CorrConfig, ticks: int = HOURS) -> int:
    return cfg.counts(ticks, 1)["total_time"]


#: Spans at tolerance 0: an ``into`` up to the next ``out_of``.
def _intervals_sql(cfg: CorrConfig, name: str = "spans", events: str = "anomalies") -> str:
    return f"""{name}_e AS (SELECT DISTINCT id1, id2, lag, time_idx, CASE anomaly WHEN 'into' THEN 1 ELSE -1 END AS marker FROM {events} WHERE anomaly <> 'changed_sign'),
{name}_n AS (SELECT *, lead(time_idx) OVER (PARTITION BY id1, id2, lag ORDER BY time_idx, marker) AS next_time FROM {name}_e),
{name} AS (SELECT id1, id2, lag, time_idx AS "start", coalesce(next_time, {_total_time(cfg)}) AS "end" FROM {name}_n WHERE marker = 1)"""


def _weights_sql(cfg: CorrConfig) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in row) + "]" for row in sk.weights(cfg)) + "]"


def _sketch_sql(cfg: CorrConfig) -> str:
    k, w = cfg.n_vectors, cfg.w
    if cfg.sketch_norm == "mean_l2":
        norm = "CASE WHEN list_sum([x * x for x in raw]) > 0 THEN [x / sqrt(list_sum([y * y for y in raw])) for x in raw] ELSE [0e0 * x for x in raw] END"
        dots = f"list_dot_product(r, xs) - list_sum(r) * (s1 / {w}e0)"
    else:
        dev = f"sqrt(greatest(list_sum([y * y for y in raw]) / {k}e0 - (list_sum(raw) / {k}e0) * (list_sum(raw) / {k}e0), 0e0))"
        norm = f"CASE WHEN {dev} > 0 THEN [(x - list_sum(raw) / {k}e0) / {dev} for x in raw] ELSE [0e0 * x for x in raw] END"
        dots = "list_dot_product(r, xs)"
    return f"""projected AS (SELECT *, [{dots} for r in {_weights_sql(cfg)}] AS raw FROM windows WHERE NOT is_const),
sketched AS (SELECT id, t0, {norm} AS sketch FROM projected)"""


_PARTITIONED = replace(CFG, partitioned=True, grid_dimension=2, freq_threshold=0.5, cell_stretch=1.0)


def _near_sql(cfg: CorrConfig) -> str:
    band = f"b.t0 BETWEEN a.t0 - {cfg.n_lags} AND a.t0 AND (b.t0 < a.t0 OR a.id < b.id)"
    if not cfg.partitioned:
        return f"""near AS (SELECT a.id AS id1, a.t0 AS t1, b.id AS id2, b.t0 AS t2, CAST(1 AS BIGINT) AS votes FROM sketched a JOIN sketched b ON {band}
  WHERE list_sum([(a.sketch[i] - b.sketch[i]) * (a.sketch[i] - b.sketch[i]) for i in range(1, {cfg.n_vectors + 1})]) <= {cfg.tau**2!r}::DOUBLE)"""
    d = cfg.grid_dimension
    return f"""near AS (SELECT id1, t1, id2, t2, votes FROM (SELECT a.id AS id1, a.t0 AS t1, b.id AS id2, b.t0 AS t2,
   CAST(len([g for g in range(0, {cfg.n_grids}) if list_sum([(a.sketch[g * {d} + i] - b.sketch[g * {d} + i]) * (a.sketch[g * {d} + i] - b.sketch[g * {d} + i]) for i in range(1, {d + 1})]) <= {cfg.tau**2!r}::DOUBLE]) AS BIGINT) AS votes
  FROM sketched a JOIN sketched b ON {band}) WHERE votes >= {cfg.min_votes!r})"""


_RATE = "coalesce({a}::DOUBLE / nullif({b}, 0), 0e0)"


def _rates_sql(tp: str, pred: str, gt: str, suffix: str = "") -> str:
    p, r = _RATE.format(a=tp, b=pred), _RATE.format(a=tp, b=gt)
    return f"{p} AS precision{suffix}, {r} AS recall{suffix}, coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0e0) AS f1_score{suffix}"


_RUNS = [
    # runtime, runtime_bf, cand_time, cand_time_bf, val_time_bf, monit_time_bf, sk_time, cand_w, cand_w_bf, corr_w, corr_w_bf
    ("a", 2.0, 10.0, 0.5, 3.0, 6.0, 1.0, 0.25, 4000, 60000, 900, 1000),
    ("b", 5.0, 10.0, 1.5, 3.0, 6.0, 1.0, 0.75, 20000, 60000, 990, 1000),
    ("c", 1.0, 10.0, 0.0, 3.0, 6.0, 0.0, 0.0, 0, 60000, 0, 0),
]
_RUN_COLUMNS = "name string, runtime double, runtime_bf double, cand_time double, cand_time_bf double, val_time_bf double, monit_time_bf double, sk_time double, cand_w long, cand_w_bf long, corr_w long, corr_w_bf long"
_TRIALS = [
    # trial, status, recall, speedup, freq_threshold, cand_w
    (1, "success", 0.99, 3.00, 0.50, 900), (2, "success", 0.97, 4.00, 0.50, 800), (3, "success", 0.96, 3.95, 0.25, 700),
    (4, "success", 0.94, 9.00, 0.25, 100), (5, "success", 0.99, 0.80, 0.50, 50), (6, "failed", 1.00, 9.90, 0.50, 10), (7, "success", 0.98, 3.99, 1.00, 20),
]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql


def _with(body: str, select: str) -> str:
    return f"WITH {body} {select}"


_WINDOW_ROWS = f"{EVENTS}, {_windows_sql(CFG)}"
_CORR_COLUMNS = "SELECT id1, t1, id2, t2, lag, corr FROM correlated"

_add("series_hourly_counts", hourly_events, _with(EVENTS, "SELECT id, t, v FROM series"))
_add("series_difference", lambda s, d: win.difference(hourly_events(s, d)), _with(EVENTS, "SELECT id, t, coalesce(v - lag(v) OVER (PARTITION BY id ORDER BY t), 0e0) AS v FROM series"))
_add(
    "rolling_moments",
    lambda s, d: win.rolling_moments(hourly_events(s, d), CFG.w),
    _with(EVENTS, f"SELECT * FROM (SELECT id, t, sum(v) OVER k AS s1, sum(v * v) OVER k AS s2, sum(v * v * v) OVER k AS s3, sum(v * v * v * v) OVER k AS s4 FROM series WINDOW k AS (PARTITION BY id ORDER BY t ROWS BETWEEN CURRENT ROW AND {CFG.w - 1} FOLLOWING)) WHERE t <= {HOURS - CFG.w}"),
)
_add(
    "sliding_windows",
    lambda s, d: win.basic_windows(query(s, d).windows, CFG).select("id", "t0", F.col("block").cast("long").alias("block"), "total"),
    _with(_WINDOW_ROWS, f"SELECT id, t0, j AS block, list_sum(xs[j * {CFG.basic_window} + 1 : (j + 1) * {CFG.basic_window}]) AS total FROM (SELECT *, unnest(range({CFG.w // CFG.basic_window})) AS j FROM windows)"),
)
_add("window_flags", lambda s, d: query(s, d).windows.select("id", "t0", "s1", "s2", "s3", "s4", "is_const", "is_spiked"), _with(_WINDOW_ROWS, "SELECT id, t0, s1, s2, s3, s4, is_const, is_spiked FROM windows"))
_add("window_kurtosis", lambda s, d: query(s, d).windows.select("id", "t0", F.round(_kurtosis(), 4).alias("kurtosis")), _with(_WINDOW_ROWS, "SELECT id, t0, round(kurtosis_pop(x), 4) AS kurtosis FROM (SELECT id, t0, unnest(xs) AS x FROM windows) GROUP BY id, t0"))
_add("exact_pairs", lambda s, d: pairs.pair_keys(query(s, d).candidates), _with(f"{_WINDOW_ROWS}, {_pairs_sql(CFG)}", "SELECT id1, t1, id2, t2 FROM pairs"))
_add("exact_pairs_count", lambda s, d: query(s, d).candidates.agg(F.count("*").alias("n_pairs")), _with(f"{_WINDOW_ROWS}, {_pairs_sql(CFG)}", "SELECT count(*) AS n_pairs FROM pairs"))
_add("corr_exact_pos", lambda s, d: _corr(query(s, d).correlated), _with(_correlated_sql(CFG), _CORR_COLUMNS))
_add("corr_exact_abs", lambda s, d: _corr(query(s, d, ABS).correlated), _with(_correlated_sql(ABS), _CORR_COLUMNS))
_add("corr_blocked", lambda s, d: _corr(query(s, d, replace(CFG, id_blocks=3)).correlated), _with(_correlated_sql(CFG), _CORR_COLUMNS))
_add("corr_synchronous", lambda s, d: _corr(CorrQuery(daily_orders(s, d), DAILY).correlated), _with(_correlated_sql(DAILY, ORDERS), _CORR_COLUMNS))
_add(
    "corr_autocorrelation",
    lambda s, d: _corr(_same_series(weekly_quantity(s, d))),
    _with(f"{LINES}, {_windows_sql(WEEKLY)}, {_pairs_sql(WEEKLY).replace('b.t0 BETWEEN', 'b.id = a.id AND b.t0 BETWEEN')}, correlated AS (SELECT id1, t1, id2, t2, lag, round(corr, 4) AS corr FROM measured WHERE {_passes_sql(WEEKLY)})", _CORR_COLUMNS),
)
_add("corr_unvalidated", lambda s, d: query(s, d, replace(CFG, corr_val=False)).correlated, _with(f"{_WINDOW_ROWS}, {_pairs_sql(CFG)}", "SELECT id1, t1, id2, t2, lag, 1e0 AS corr FROM pairs"))
_add("negative_pairs", lambda s, d: artifacts.negative_pairs(_corr(query(s, d, ABS).correlated), ABS.threshold), _with(_correlated_sql(ABS), _CORR_COLUMNS + f" WHERE corr <= -{ABS.threshold}"))
_add("min_distance_pair", lambda s, d: pairs.min_distance_pair(query(s, d).candidates, CFG).withColumn("dist", F.round("dist", 4)), _with(f"{_WINDOW_ROWS}, {_pairs_sql(CFG)}", "SELECT id1, id2, t1, t2, round(dist, 4) AS dist FROM measured WHERE NOT spiked ORDER BY measured.dist, id1, id2, t1, t2 LIMIT 1"))
_add("validation_counters", lambda s, d: query(s, d).counters, _with(f"{_WINDOW_ROWS}, {_pairs_sql(CFG)}", f"SELECT count(*) AS total_candidates, count(*) FILTER (NOT spiked) AS tested, count(*) FILTER ({_passes_sql(CFG)}) AS validated FROM measured"))


def _kurtosis():
    from sparkcorr.functions.window_math import excess_kurtosis

    return excess_kurtosis(CFG.w, *(F.col(f"s{k}") for k in (1, 2, 3, 4)))


def _same_series(series: DataFrame) -> DataFrame:
    """Correlations of series with themselves: joined on the id, so that no other pair is made."""
    of = win.flagged_windows(series, WEEKLY).where("not is_const and not is_spiked").select("id", "t0", "xs", "s1", "s2", "is_spiked")
    return pairs.validate(pairs.band_join(of, of, WEEKLY, extra_keys=("id",)), WEEKLY)


def _monitored(s, d, cfg: CorrConfig = ABS) -> tuple[DataFrame, CorrQuery]:
    q = query(s, d, cfg)
    return _corr(q.correlated), q


_BUFFERED = replace(ABS, carry_sign_over_gap=False)
_MON = f"{_correlated_sql(ABS)}, {_monitor_sql(ABS)}"
_MON_BUFFERED = f"{_correlated_sql(ABS)}, {_monitor_sql(ABS, carry=False)}"
_EVENT_COLUMNS = "SELECT id1, id2, lag, time_idx, anomaly FROM anomalies"


def _events(s, d, cfg: CorrConfig = ABS) -> DataFrame:
    of, q = _monitored(s, d, cfg)
    return monitor.anomalies(of, cfg, q.last_anchor)


_add("status_episodes", lambda s, d: monitor.status(_monitored(s, d)[0], ABS), _with(_MON, "SELECT * FROM status"))
_add("anomaly_events", _events, _with(_MON, _EVENT_COLUMNS))
_add("anomaly_events_buffered", lambda s, d: _events(s, d, _BUFFERED), _with(_MON_BUFFERED, _EVENT_COLUMNS))
_add(
    "status_merged_orientations",
    lambda s, d: monitor.status(_monitored(s, d)[0], replace(ABS, merge_orientations=True)),
    _with(f"{_correlated_sql(ABS).replace('correlated AS (', 'directed AS (')}, correlated AS (SELECT least(id1, id2) AS id1, t1, greatest(id1, id2) AS id2, t2, lag, corr FROM (SELECT *, row_number() OVER (PARTITION BY least(id1, id2), greatest(id1, id2), lag, t1 ORDER BY id1, id2) AS k FROM directed) WHERE k = 1), {_monitor_sql(ABS)}", "SELECT * FROM status"),
)
_MAX_LAG = """SELECT id1, id2, t1, corr AS max_corr, lag FROM (SELECT *, row_number() OVER (PARTITION BY id1, id2, t1 ORDER BY abs(corr) DESC, lag, corr DESC, t2) AS k
 FROM (SELECT least(id1, id2) AS id1, greatest(id1, id2) AS id2, CASE WHEN id1 <= id2 THEN t1 ELSE t2 END AS t1, t2, corr, lag FROM {source})) WHERE k = 1"""
_add("max_lag", lambda s, d: monitor.max_lag(_monitored(s, d)[0]), _with(_correlated_sql(ABS), _MAX_LAG.format(source="correlated")))
_add("corr_intervals_tol0", lambda s, d: monitor.intervals(_events(s, d, _BUFFERED), _total_time(ABS), 0), _with(f"{_MON_BUFFERED}, {_intervals_sql(ABS)}", 'SELECT id1, id2, lag, "start", "end" FROM spans'))
_INTERVALS_TOL = f"""RECURSIVE {_MON_BUFFERED},
e AS (SELECT *, row_number() OVER (PARTITION BY id1, id2, lag ORDER BY time_idx, marker) AS k FROM (SELECT DISTINCT id1, id2, lag, time_idx, CASE anomaly WHEN 'into' THEN 1 ELSE -1 END AS marker FROM anomalies WHERE anomaly <> 'changed_sign')),
fold AS (
  SELECT id1, id2, lag, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS closed, CAST(NULL AS BIGINT) AS "start", CAST(NULL AS BIGINT) AS "end" FROM (SELECT DISTINCT id1, id2, lag FROM e)
  UNION ALL
  SELECT f.id1, f.id2, f.lag, e.k,
    CASE WHEN e.marker = 1 AND f.since IS NULL AND (f.closed IS NULL OR e.time_idx - f.closed > {ABS.w}) THEN e.time_idx WHEN e.marker = -1 THEN NULL ELSE f.since END,
    CASE WHEN e.marker = -1 AND f.since IS NOT NULL THEN e.time_idx ELSE f.closed END,
    CASE WHEN e.marker = -1 THEN f.since END, CASE WHEN e.marker = -1 AND f.since IS NOT NULL THEN e.time_idx END
  FROM fold f JOIN e ON e.id1 = f.id1 AND e.id2 = f.id2 AND e.lag = f.lag AND e.k = f.k + 1)"""
_add(
    "corr_intervals_tolw",
    lambda s, d: monitor.intervals(_events(s, d, _BUFFERED), _total_time(ABS), ABS.w),
    _with(_INTERVALS_TOL, f"""SELECT id1, id2, lag, "start", "end" FROM fold WHERE "end" IS NOT NULL
  UNION ALL SELECT id1, id2, lag, since, {_total_time(ABS)} FROM (SELECT *, row_number() OVER (PARTITION BY id1, id2, lag ORDER BY k DESC) AS z FROM fold) WHERE z = 1 AND since IS NOT NULL"""),
)
_add(
    "anomaly_gap_spans",
    lambda s, d: monitor.anomaly_spans(_events(s, d, _BUFFERED), ABS.w),
    _with(_MON_BUFFERED, f"""SELECT id1, id2, lag, time_idx AS "start", next_time AS "end" FROM (SELECT *, lead(time_idx) OVER k AS next_time, lead(anomaly) OVER k AS nxt FROM anomalies WHERE anomaly <> 'changed_sign' WINDOW k AS (PARTITION BY id1, id2, lag ORDER BY time_idx, anomaly))
  WHERE anomaly = 'out_of' AND nxt = 'into' AND next_time - time_idx > {ABS.w}"""),
)
_add(
    "top_durations",
    lambda s, d: monitor.top_durations(monitor.status(_monitored(s, d)[0], ABS)),
    _with(_MON, """SELECT id1, id2, lag, start_t1, start_t2, duration, corr_sign FROM (SELECT *, row_number() OVER (PARTITION BY least(id1, id2), greatest(id1, id2) ORDER BY duration DESC, lag, start_t1, start_t2, corr_sign, id1 DESC) AS k FROM status WHERE id1 <> id2) WHERE k = 1
  ORDER BY duration DESC, id1, id2, lag, start_t1, start_t2, corr_sign LIMIT 5"""),
)

_ANGLE = 0.3
_TAU = (2 * (1 - _ANGLE)) ** 0.5
_HARD = 0.5
_HARD_TAU = (2 * (1 - _HARD)) ** 0.5
_L2 = "list_sum([(a.embedding[i]::DOUBLE {op} b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE {op} b.embedding[i]::DOUBLE) for i in range(1, 65)])"


def _vectors(s, d) -> DataFrame:
    return _table(s, d, "embeddings")


_add(
    "eps_join_full",
    lambda s, d: cand.vector_neighbours(_vectors(s, d), _TAU, id_col="vec_id", vector_col="embedding").select("id1", "id2", _r("dist")),
    f"SELECT a.vec_id AS id1, b.vec_id AS id2, round(sqrt({_L2.format(op='-')}), 4) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_L2.format(op='-')} <= {_TAU**2!r}::DOUBLE",
)
_add(
    "eps_join_neg",
    lambda s, d: cand.vector_neighbours(_vectors(s, d), _HARD_TAU, id_col="vec_id", vector_col="embedding", negatives=True).select("id1", "id2", F.col("sign").cast("long").alias("sign"), _r("dist")),
    " UNION ALL ".join(f"SELECT a.vec_id AS id1, b.vec_id AS id2, CAST({sign} AS BIGINT) AS sign, round(sqrt({_L2.format(op=op)}), 4) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_L2.format(op=op)} <= {_HARD_TAU**2!r}::DOUBLE" for sign, op in ((1, "-"), (-1, "+"))),
)
_add(
    "eps_join_scalar_votes",
    lambda s, d: cand.coordinate_votes(_vectors(s, d), 0.05, 6, id_col="vec_id", vector_col="embedding", dims=8),
    "WITH u AS (SELECT vec_id, i AS grid, embedding[i]::DOUBLE AS u FROM (SELECT *, unnest(range(1, 9)) AS i FROM embeddings)) SELECT a.vec_id AS id1, b.vec_id AS id2, count(*) AS votes FROM u a JOIN u b ON a.grid = b.grid AND a.vec_id < b.vec_id AND abs(a.u - b.u) <= 0.05::DOUBLE GROUP BY 1, 2 HAVING count(*) >= 6",
)


def _long_sketch(df: DataFrame) -> DataFrame:
    out = df.select("id", "t0", F.posexplode("sketch").alias("k", "u"))
    return out.select("id", "t0", F.col("k").cast("long").alias("k"), (F.round("u", 8) + F.lit(0).cast("double")).alias("u"))


_SKETCH_ROWS = f"SELECT id, t0, j - 1 AS k, round(sketch[j], 8) + 0e0 AS u FROM (SELECT *, unnest(range(1, {CFG.n_vectors + 1})) AS j FROM sketched)"
_Z = replace(CFG, sketch_norm="z")
_add("sketch_project", lambda s, d: _long_sketch(sk.project(query(s, d).windows, CFG, centred=False)), _with(f"{_WINDOW_ROWS}, sketched AS (SELECT id, t0, [list_dot_product(r, xs) for r in {_weights_sql(CFG)}] AS sketch FROM windows)", _SKETCH_ROWS))
_add("sketch_mean_l2", lambda s, d: _long_sketch(sk.sketches(query(s, d).windows.where("not is_const"), CFG)), _with(f"{_WINDOW_ROWS}, {_sketch_sql(CFG)}", _SKETCH_ROWS))
_add("sketch_z", lambda s, d: _long_sketch(sk.sketches(query(s, d).windows.where("not is_const"), _Z)), _with(f"{_WINDOW_ROWS}, {_sketch_sql(_Z)}", _SKETCH_ROWS))


def _proposed(s, d, cfg: CorrConfig) -> DataFrame:
    return cand.candidates(query(s, d, cfg).windows, cfg).select(F.col("x_id").alias("id1"), F.col("x_t0").alias("t1"), F.col("y_id").alias("id2"), F.col("y_t0").alias("t2"), "votes")


#: As the search chooses them: the fewest candidates with a recall of 0.95 on the sf0.01 events.
_TUNED = replace(CFG, n_vectors=32, cell_stretch=1.25)
_add("sketch_candidates", lambda s, d: _proposed(s, d, _TUNED), _with(f"{_WINDOW_ROWS}, {_sketch_sql(_TUNED)}, {_near_sql(_TUNED)}", "SELECT id1, t1, id2, t2, votes FROM near"))
_add("sketch_votes", lambda s, d: _proposed(s, d, _PARTITIONED), _with(f"{_WINDOW_ROWS}, {_sketch_sql(_PARTITIONED)}, {_near_sql(_PARTITIONED)}", "SELECT id1, t1, id2, t2, votes FROM near"))
_SKETCH_CORR = f"{_WINDOW_ROWS}, {_pairs_sql(CFG)}, {_sketch_sql(_TUNED)}, {_near_sql(_TUNED)}, found AS (SELECT id1, t1, id2, t2, lag, round(corr, 4) AS corr FROM measured JOIN near USING (id1, t1, id2, t2) WHERE {_passes_sql(CFG)}), correlated AS (SELECT id1, t1, id2, t2, lag, round(corr, 4) AS corr FROM measured WHERE {_passes_sql(CFG)})"
_add("corr_sketch", lambda s, d: _corr(query(s, d, _TUNED, "sketch").correlated), _with(_SKETCH_CORR, "SELECT id1, t1, id2, t2, lag, corr FROM found"))
_add(
    "window_metrics",
    lambda s, d: _rounded(query(s, d, _TUNED, "sketch").metrics(query(s, d))),
    _with(
        _SKETCH_CORR + """, counted AS (SELECT count(*) FILTER (p IS NOT NULL AND g IS NOT NULL) AS tp, count(p) AS pred, count(g) AS gt,
 count(*) FILTER (p > 0 AND g > 0) AS tp_pos, count(*) FILTER (p > 0) AS pred_pos, count(*) FILTER (g > 0) AS gt_pos, count(*) FILTER (p <= 0 AND g <= 0) AS tp_neg, count(*) FILTER (p <= 0) AS pred_neg, count(*) FILTER (g <= 0) AS gt_neg,
 (SELECT count(*) FROM measured WHERE NOT spiked) AS total FROM (SELECT f.corr AS p, c.corr AS g FROM found f FULL JOIN correlated c USING (id1, t1, id2, t2))),
rated AS (SELECT tp, pred, gt, """.replace("counted AS", "tallied AS") + _rates_sql("tp", "pred", "gt") + ", coalesce(greatest(greatest(total - gt, 0) - (pred - tp), 0)::DOUBLE / nullif(greatest(total - gt, 0), 0), 0e0) AS specificity, " + _rates_sql("tp_pos", "pred_pos", "gt_pos", "_pos") + ", " + _rates_sql("tp_neg", "pred_neg", "gt_neg", "_neg") + " FROM tallied)",
        "SELECT tp, pred, gt, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("precision", "recall", "f1_score", "specificity", "precision_pos", "recall_pos", "f1_score_pos", "precision_neg", "recall_neg", "f1_score_neg")) + " FROM rated",
    ),
)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


_PRED = replace(ABS, threshold=0.35, carry_sign_over_gap=False)
_ABOVE = "found AS (SELECT * FROM correlated WHERE abs(corr) >= 0.35)"


def _stronger(s, d) -> DataFrame:
    return _monitored(s, d)[0].where(F.abs("corr") >= _PRED.threshold)


def _interval_metrics(s, d) -> DataFrame:
    of, q = _monitored(s, d)
    spans = [monitor.intervals(monitor.anomalies(rows, _BUFFERED, q.last_anchor), _total_time(ABS), 0) for rows in (of.where(F.abs("corr") >= _PRED.threshold), of)]
    return _rounded(metrics.interval_metrics(*spans, _total_time(ABS)))


def _renamed(sql: str, suffix: str, source: str) -> str:
    """The monitor's CTEs under other names, over another table of correlations."""
    sql = re.sub(r"\b(signed|looked|started|runs|status|anomalies)\b(?= AS \()|(?<=FROM )(signed|looked|started|runs|status|anomalies)\b", lambda m: m[0] + suffix, sql)
    return sql.replace("FROM correlated)", f"FROM {source})")


_INTERVAL_METRICS = f"{_MON_BUFFERED}, {_ABOVE}, {_renamed(_monitor_sql(ABS, carry=False), '_p', 'found')}, {_intervals_sql(ABS, 'g')}, {_intervals_sql(ABS, 'p', 'anomalies_p')}"
_add(
    "interval_metrics",
    _interval_metrics,
    _with(
        _INTERVAL_METRICS + f""", lens AS (SELECT coalesce((SELECT sum("end" - "start") FROM p), 0)::BIGINT AS pred, coalesce((SELECT sum("end" - "start") FROM g), 0)::BIGINT AS gt,
 coalesce((SELECT sum(greatest(0, least(p."end", g."end") - greatest(p."start", g."start"))) FROM p JOIN g USING (id1, id2, lag)), 0)::BIGINT AS tp,
 (SELECT count(*) FROM (SELECT id1, id2, lag FROM p UNION SELECT id1, id2, lag FROM g)) * {_total_time(ABS)} AS points),
rated AS (SELECT tp, pred - tp AS fp, gt - tp AS fn, greatest(points - pred - gt + tp, 0) AS tn, """ + _rates_sql("tp", "pred", "gt") + ", coalesce(greatest(points - pred - gt + tp, 0)::DOUBLE / nullif(greatest(points - pred - gt + tp, 0) + pred - tp, 0), 0e0) AS specificity FROM lens)",
        "SELECT tp, fp, fn, tn, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("precision", "recall", "f1_score", "specificity")) + " FROM rated",
    ),
)
_add(
    "maxlag_metrics",
    lambda s, d: _rounded(metrics.max_lag_metrics(monitor.max_lag(_corr(query(s, d, _TUNED, "sketch").correlated)), monitor.max_lag(_corr(query(s, d).correlated)))),
    _with(
        f"{_SKETCH_CORR}, a AS ({_MAX_LAG.format(source='found')}), b AS ({_MAX_LAG.format(source='correlated')})",
        "SELECT count(*) AS n, round(avg(x), 6) AS diff_mean, round(stddev_pop(x), 6) AS diff_std FROM (SELECT CASE WHEN abs(b.max_corr - a.max_corr) <= 1e-12 THEN 0e0 ELSE round(b.max_corr - a.max_corr, 12) END AS x FROM a JOIN b USING (id1, id2, t1))",
    ),
)
_DIV = "CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) END"
_CEIL = _DIV.format(a="cand_time_bf + val_time_bf + monit_time_bf", b=f"sk_time + cand_time + val_time_bf * {_DIV.format(a='corr_w_bf', b='cand_w_bf')} + monit_time_bf")
_add(
    "run_diagnostics",
    lambda s, d: _rounded(metrics.diagnostics(s.createDataFrame(_RUNS, _RUN_COLUMNS)).select("name", "speedup", "speedup_ceil", "rel_speedup_eff", "corr_prop", "waste_val_bf", "waste_val", "rel_waste_red")),
    f"WITH r({', '.join(c.split()[0] for c in _RUN_COLUMNS.split(', '))}) AS (VALUES {_values([tuple(float(v) if isinstance(v, float) else v for v in r) for r in _RUNS])}), "
    f"x AS (SELECT name, runtime_bf::DOUBLE / runtime AS speedup, {_CEIL} AS speedup_ceil, {_DIV.format(a='corr_w_bf', b='cand_w_bf')} AS corr_prop, {_DIV.format(a='cand_w_bf', b='corr_w_bf')} AS waste_val_bf, {_DIV.format(a='cand_w', b='corr_w')} AS waste_val FROM r) "
    f"SELECT name, round(speedup, 6) AS speedup, round(speedup_ceil, 6) AS speedup_ceil, round({_DIV.format(a='speedup', b='speedup_ceil')}, 6) AS rel_speedup_eff, round(corr_prop, 6) AS corr_prop, round(waste_val_bf, 6) AS waste_val_bf, round(waste_val, 6) AS waste_val, round({_DIV.format(a='waste_val_bf', b='waste_val')}, 6) AS rel_waste_red FROM x",
)
_add(
    "select_best_params",
    lambda s, d: search.select_best(s.createDataFrame(_TRIALS, "trial long, status string, recall double, speedup double, freq_threshold double, cand_w long")),
    f"""WITH t(trial, status, recall, speedup, freq_threshold, cand_w) AS (VALUES {_values(_TRIALS)}), ok AS (SELECT * FROM t WHERE status = 'success'),
fast AS (SELECT * FROM ok WHERE speedup > 1 AND freq_threshold < 1), feasible AS (SELECT * FROM fast UNION ALL SELECT * FROM ok WHERE NOT EXISTS (SELECT 1 FROM fast)),
good AS (SELECT * FROM feasible WHERE recall >= 0.95), recalled AS (SELECT * FROM good UNION ALL SELECT * FROM feasible WHERE NOT EXISTS (SELECT 1 FROM good) AND recall >= 0.98 * (SELECT max(recall) FROM feasible))
SELECT CAST(trial AS BIGINT) AS trial, status, recall::DOUBLE AS recall, speedup::DOUBLE AS speedup, freq_threshold::DOUBLE AS freq_threshold, CAST(cand_w AS BIGINT) AS cand_w FROM recalled WHERE speedup >= 0.98 * (SELECT max(speedup) FROM recalled) ORDER BY cand_w NULLS LAST, speedup DESC LIMIT 1""",
)
_add(
    "dedupe_strongest",
    lambda s, d: search.strongest(_table(s, d, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_quantity") - F.lit(25).cast("double")).alias("q")), ["l_suppkey", "l_returnflag"], "q"),
    "SELECT l_suppkey, l_returnflag, q FROM (SELECT l_suppkey, l_returnflag, l_quantity - 25e0 AS q, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY abs(l_quantity - 25e0) DESC, l_quantity DESC) AS k FROM lineitem) WHERE k = 1",
)
_add(
    "append_unseen",
    lambda s, d: search.append_unseen(_table(s, d, "orders").select("o_custkey"), _table(s, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"), ["o_custkey"]),
    "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
_add("recent_years", lambda s, d: search.recent_years(_table(s, d, "orders").select("o_orderkey", "o_orderdate"), 2, "o_orderdate").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= (SELECT year(max(o_orderdate)) - 1 FROM orders)")
_add("train_split", lambda s, d: experiment.training(daily_orders(s, d), 0.3), _with(ORDERS, "SELECT id, t, v FROM series WHERE t < (SELECT min(t) + round_even(0.3 * (max(t) - min(t) + 1), 0) FROM series)"))
_add("select_rows", lambda s, d: src.first_series(src.first_rows(daily_orders(s, d), 100), ["1-URGENT", "2-HIGH"], 2), _with(ORDERS, "SELECT id, t, v FROM series WHERE t < 100 AND id IN ('1-URGENT', '2-HIGH')"))
_add("select_years", lambda s, d: src.last_years(hourly_events(s, d).withColumn("t", F.col("t") * 60), 1), _with(EVENTS, "SELECT id, t * 60 AS t, v FROM series WHERE t * 60 > (SELECT max(t) * 60 FROM series) - 8760"))
_add("membership_filter", lambda s, d: search.by_membership(_corr(query(s, d).correlated), s.createDataFrame([("click",), ("view",), ("purchase",)], "id string"), "id1", "id2"), _with(_correlated_sql(CFG), _CORR_COLUMNS + " WHERE id1 IN ('click', 'view', 'purchase') AND id2 IN ('click', 'view', 'purchase')"))
_add(
    "time_ticks",
    lambda s, d: src.to_ticks(_table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")[0].select("o_orderkey", "t"),
    "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderdate) - 1 AS t FROM orders WHERE o_orderdate IS NOT NULL",
)
_add(
    "wide_to_long",
    lambda s, d: src.from_wide(_table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_quantity", "l_discount"), "line"),
    "SELECT u.id, l_orderkey * 10 + l_linenumber AS t, u.v FROM lineitem, unnest([{'id': 'l_quantity', 'v': l_quantity}, {'id': 'l_discount', 'v': l_discount}]) AS x(u)",
)


def _distances(s, d) -> DataFrame:
    q = query(s, d, CFG, "sketch")
    return _rounded4(metrics.distance_diagnostics(q.distances(query(s, d)), CFG.threshold))


def _rounded4(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 4).alias(c) if t == "double" else c for c, t in df.dtypes))


_add(
    "distance_diagnostics",
    _distances,
    _with(
        f"""{_WINDOW_ROWS}, {_pairs_sql(CFG)}, {_sketch_sql(CFG)}, both_ AS (SELECT m.corr, m.dist, sqrt(list_sum([(a.sketch[i] - b.sketch[i]) * (a.sketch[i] - b.sketch[i]) for i in range(1, {CFG.n_vectors + 1})])) AS sd,
 list_dot_product(a.sketch, b.sketch) / sqrt(list_dot_product(a.sketch, a.sketch) * list_dot_product(b.sketch, b.sketch)) AS est FROM measured m JOIN sketched a ON a.id = m.id1 AND a.t0 = m.t1 JOIN sketched b ON b.id = m.id2 AND b.t0 = m.t2)""",
        "SELECT CASE WHEN corr >= 0.3::DOUBLE THEN 'pos' WHEN corr <= -0.3::DOUBLE THEN 'neg' ELSE 'non' END AS kind, count(*) AS n, round(avg(dist), 4) AS mean_dist, round(avg(sd), 4) AS mean_sketch_dist, round(avg(est), 4) AS mean_estimate, round(avg(abs(est - corr)), 4) AS mean_abs_error FROM both_ GROUP BY 1",
    ),
)
_add(
    "confusion_sample",
    lambda s, d: metrics.confusion_sample(query(s, d, _TUNED, "sketch").correlated, query(s, d).correlated, pairs.pair_keys(query(s, d).candidates), 3).withColumn("rank", F.col("rank").cast("long")),
    _with(
        _SKETCH_CORR,
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id1, id2, t1, t2) AS rank FROM (SELECT m.id1, m.t1, m.id2, m.t2, CASE WHEN f.corr IS NOT NULL AND c.corr IS NOT NULL THEN 'TP' WHEN f.corr IS NOT NULL THEN 'FP' WHEN c.corr IS NOT NULL THEN 'FN' ELSE 'TN' END AS label FROM measured m LEFT JOIN found f USING (id1, t1, id2, t2) LEFT JOIN correlated c USING (id1, t1, id2, t2))) WHERE rank <= 3",
    ),
)
_add("artifact_dedupe", lambda s, d: artifacts.deduplicated(_corr(query(s, d, ABS).correlated).unionByName(_corr(query(s, d).correlated)), "correlated").select("id1", "t1", "id2", "t2", "lag", "corr"), _with(_correlated_sql(ABS), _CORR_COLUMNS))
_add("corr_weekly_suppliers", lambda s, d: _corr(CorrQuery(weekly_quantity(s, d), replace(WEEKLY, n_lags=0, threshold=0.6)).correlated), _with(_correlated_sql(replace(WEEKLY, n_lags=0, threshold=0.6), LINES), _CORR_COLUMNS))
