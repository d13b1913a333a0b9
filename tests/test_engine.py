"""Hand-checked fixtures and properties of the correlation engine."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcorr.config import CorrConfig, default_basic_window
from sparkcorr.functions import window_math as wm
from sparkcorr.operators import candidates, metrics, monitor, pairs, search
from sparkcorr.operators import sketch as sk
from sparkcorr.operators import windows as win
from sparkcorr.plans.query import CorrQuery
from sparkcorr.sources import artifacts, series as src, synth
from sparkcorr.streaming import monitor as stream


def long(spark, **named):
    rows = [(i, t, None if v is None else float(v)) for i, vs in named.items() for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, "id string, t long, v double")


def cfg(**kw):
    return CorrConfig(**({"w": 4, "step": 2, "n_lags": 4, "threshold": 0.9} | kw))


def pairs_of(df):
    return {(r.id1, r.t1, r.id2, r.t2): r.corr for r in df.collect()}


@pytest.mark.parametrize("w,step,want", [(168, 12, 12), (96, 12, 12), (48, 12, 12), (1024, 32, 32)])
def test_basic_window_rule(w, step, want):
    assert default_basic_window(w, step) == want


def test_configuration_rules():
    assert cfg(n_lags=13, step=4, w=8).n_lags == 12
    with pytest.raises(ValueError):
        CorrConfig(w=256, step=12)
    with pytest.raises(ValueError):
        CorrConfig(w=48, step=12, partitioned=True, n_vectors=8, grid_dimension=3)
    assert math.isclose(cfg(threshold=0.7).tau, 0.774597, abs_tol=1e-6)
    assert math.isclose(cfg(threshold=0.7, partitioned=True, n_vectors=16, grid_dimension=4).tau, 0.387298, abs_tol=1e-6)
    assert cfg(cell_stretch=-1).cell_stretch == 1 and cfg(grid_dimension=0).grid_dimension == 1
    assert CorrConfig(w=48, step=0).step == CorrConfig(w=48, step=0).basic_window
    assert cfg(partitioned=True, n_vectors=8, freq_threshold=0.5).min_votes == 4
    assert cfg().with_(w=8, step=4).w == 8
    assert cfg().blocks_for(10) == 1 and CorrConfig(w=168, step=12, n_lags=168).blocks_for(10_000) == 15
    assert cfg().counts(10, 3) == {"n_w": 4, "total_w": 12, "mem_w": 2, "total_time": 10}


def test_perfect_pairs(spark):
    s = long(spark, a=[1, 2, 3, 4], b=[2, 4, 6, 8], c=[4, 3, 2, 1])
    assert pairs_of(CorrQuery(s, cfg()).correlated) == {("a", 0, "b", 0): 1.0}
    both = pairs_of(CorrQuery(s, cfg(neg_corr=True)).correlated)
    assert both == {("a", 0, "b", 0): 1.0, ("a", 0, "c", 0): -1.0, ("b", 0, "c", 0): -1.0}
    row = pairs.measured(CorrQuery(s, cfg()).candidates, cfg()).where("id1 = 'a' and id2 = 'b'").first()
    assert math.isclose(row.dist, math.sqrt(30))


def test_lagged_copy_lag_bounds_and_autocorrelation(spark):
    rng = random.Random(1)
    a = [rng.randrange(100) for _ in range(16)]
    b = [0, 1] + a[:-2]
    found = pairs_of(CorrQuery(long(spark, a=a, b=b), cfg(threshold=0.999)).correlated)
    assert all(("b", t, "a", t - 2) in found for t in range(2, 13, 2))
    every = CorrQuery(long(spark, a=a, b=b), cfg()).candidates
    lags = {r.x_t0 - r.y_t0 for r in every.collect()}
    assert lags == {0, 2, 4}
    assert every.where("x_id = y_id and x_t0 = y_t0").count() == 0
    wave = [math.sin(2 * math.pi * t / 4) for t in range(16)]
    own = pairs_of(CorrQuery(long(spark, a=wave), cfg(threshold=0.99)).correlated)
    assert own and {k[1] - k[3] for k in own} == {4}


def test_constant_spiked_and_missing_windows(spark):
    s = long(spark, k=[5] * 4, edge=[0.0005, -0.0005] * 2, a=[1, 2, 3, 4])
    flags = {r.id: r.is_const for r in win.flagged_windows(s, cfg()).collect()}
    assert flags == {"k": True, "edge": True, "a": False}
    spike = long(spark, a=[0] * 15 + [100])
    row = win.flagged_windows(spike, CorrConfig(w=16, step=4)).select("*", wm.excess_kurtosis(16, *(F.col(f"s{k}") for k in (1, 2, 3, 4))).alias("x")).first()
    assert row.is_spiked and math.isclose(row.x, 11.0667, abs_tol=1e-3)
    assert not win.flagged_windows(long(spark, a=[0, 0, 9]), CorrConfig(w=3, step=3)).first().is_spiked
    holes = long(spark, a=[1, 2, None, 4, 5, 6, 7, 9])
    assert [r.t0 for r in win.sliding_windows(holes, cfg()).orderBy("t0").collect()] == [4]
    assert win.sliding_windows(long(spark), cfg()).count() == 0


def test_differences_start_at_zero(spark):
    assert [r.v for r in win.difference(long(spark, a=[3, 5, 4])).orderBy("t").collect()] == [0, 2, -1]


def test_origin_follows_first_tick(spark):
    late = long(spark, a=[1, 2, 3, 5, 8, 13]).withColumn("t", F.col("t") + 1)
    assert sorted(r.t0 for r in win.sliding_windows(late, cfg(origin=None)).collect()) == [1, 3]


def test_id_blocks_change_nothing(spark):
    rng = np.random.default_rng(2)
    s = long(spark, **{f"s{k}": rng.integers(0, 9, 24) for k in range(7)})
    one, many = (pairs_of(CorrQuery(s, cfg(threshold=0.8, id_blocks=b)).correlated) for b in (1, 3))
    assert one and one.keys() == many.keys()


def test_sketches_are_linear_and_blocks_agree(spark):
    c = CorrConfig(w=12, step=3, basic_window=3, n_vectors=6)
    w = sk.weights(c)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 12))
    assert np.allclose(w @ x + w @ y, w @ (x + y))
    assert np.allclose(sum(w[:, b : b + 3] @ x[b : b + 3] for b in range(0, 12, 3)), w @ x)
    assert np.allclose(np.abs(w), 1 / np.sqrt(6))
    windows = win.flagged_windows(long(spark, a=list(x)), c)
    got = sk.sketches(windows, c).first().sketch
    raw = w @ (x - x.mean())
    assert np.allclose(got, raw / np.linalg.norm(raw))
    z = sk.sketches(windows, CorrConfig(w=12, step=3, basic_window=3, n_vectors=6, sketch_norm="z")).first().sketch
    assert np.allclose(z, (w @ x - (w @ x).mean()) / (w @ x).std())


@pytest.mark.parametrize("partitioned", [False, True])
@pytest.mark.parametrize("neg", [False, True])
def test_sketch_plan_is_part_of_the_exact_one(spark, partitioned, neg):
    rng = np.random.default_rng(4)
    base = rng.normal(size=40).cumsum()
    s = long(spark, a=base, b=base + rng.normal(size=40) * 0.1, c=-base, d=rng.normal(size=40))
    c = CorrConfig(w=8, step=4, n_lags=8, threshold=0.8, n_vectors=8, neg_corr=neg, partitioned=partitioned, grid_dimension=2, freq_threshold=0.5, cell_stretch=1.5)
    exact, found = pairs_of(CorrQuery(s, c).correlated), pairs_of(CorrQuery(s, c, "sketch").correlated)
    assert found.keys() <= exact.keys() and len(found) >= 0.5 * len(exact)
    assert any(r < 0 for r in found.values()) == neg


def test_unvalidated_pairs_have_one(spark):
    q = CorrQuery(long(spark, a=[1, 2, 3, 4], b=[1, 5, 2, 4]), cfg(corr_val=False))
    assert pairs_of(q.correlated) == {("a", 0, "b", 0): 1.0}


def correlated(spark, anchors, lag=0):
    rows = [("a", t, "b", t - lag, lag, float(r)) for t, r in anchors]
    return spark.createDataFrame(rows, "id1 string, t1 long, id2 string, t2 long, lag long, corr double")


def events(spark, anchors, last, **kw):
    c = CorrConfig(w=8, step=2, n_lags=8, threshold=0.5, **kw)
    out = monitor.anomalies(correlated(spark, anchors), c, spark.createDataFrame([(last,)], "last_anchor long"))
    return sorted((r.time_idx, r.anomaly) for r in out.collect())


def test_episodes(spark):
    c = CorrConfig(w=8, step=2, n_lags=8)
    of = monitor.status(correlated(spark, [(0, 1), (2, 1), (4, 1)]), c).collect()
    assert [(r.start_t1, r.duration, r.corr_sign) for r in of] == [(0, 12, 1)]
    assert events(spark, [(0, 1), (2, 1), (4, 1)], 20) == [(0, "into"), (6, "out_of")]
    assert events(spark, [(0, 1), (2, -1)], 2) == [(0, "into"), (2, "changed_sign")]
    assert events(spark, [(0, 1), (6, -1)], 6) == [(0, "into"), (2, "out_of"), (6, "changed_sign")]
    assert events(spark, [(0, 1), (6, -1)], 6, carry_sign_over_gap=False) == [(0, "into"), (2, "out_of"), (6, "into")]


def state_machine(anchors, step, last, carry):
    out, prev = [], None
    for t, sign in anchors:
        contiguous = prev and t == prev[0] + step
        if prev and not contiguous:
            out.append((prev[0] + step, "out_of"))
        if not (contiguous and prev[1] == sign):
            out.append((t, "changed_sign" if prev and prev[1] != sign and (contiguous or carry) else "into"))
        prev = (t, sign)
    if prev and prev[0] < last:
        out.append((prev[0] + step, "out_of"))
    return sorted(out)


@pytest.mark.parametrize("carry", [True, False])
def test_islands_match_a_state_machine(spark, carry):
    rng = random.Random(5)
    for _ in range(4):
        anchors = [(t, rng.choice([1, -1])) for t in range(0, 60, 2) if rng.random() < 0.6]
        assert events(spark, anchors, 58, carry_sign_over_gap=carry) == state_machine(anchors, 2, 58, carry)


@pytest.mark.parametrize("tol,want", [(0, [(0, 10), (12, 20), (40, 50)]), (8, [(0, 10), (40, 50)])])
def test_intervals(spark, tol, want):
    rows = [("a", "b", 0, t, x) for t, x in ((0, "into"), (10, "out_of"), (12, "into"), (20, "out_of"), (40, "into"))]
    of = monitor.intervals(spark.createDataFrame(rows, "id1 string, id2 string, lag long, time_idx long, anomaly string"), 50, tol)
    assert sorted((r.start, r.end) for r in of.collect()) == want


def test_max_lag_tie_takes_the_smaller_lag(spark):
    both = correlated(spark, [(8, 0.9)], 4).unionByName(correlated(spark, [(8, -0.9)], 2))
    assert monitor.max_lag(both).first().lag == 2


def test_window_metrics(spark):
    schema = "id1 string, t1 long, id2 string, t2 long, corr double"
    rows = lambda **kw: spark.createDataFrame([(k, 0, "z", 0, v) for k, v in kw.items()], schema)
    truth, pred = rows(a=1.0, b=-1.0, c=1.0), rows(a=1.0, b=1.0, d=1.0)
    m = metrics.window_metrics(pred, truth, spark.createDataFrame([(10,)], "n long"), closest=truth.where("id1 = 'c'")).first()
    assert m.tp == 2 and all(math.isclose(x, 2 / 3) for x in (m.precision, m.recall, m.f1_score))
    assert math.isclose(m.specificity, 6 / 7) and math.isclose(m.precision_pos, 1 / 3) and m.recall_pos == 0.5
    assert m.precision_neg == m.recall_neg == 0 and m.recall_min == 0


def test_interval_and_max_lag_metrics(spark):
    span = lambda a, b: spark.createDataFrame([("a", "b", 0, a, b)], "id1 string, id2 string, lag long, start long, end long")
    m = metrics.interval_metrics(span(5, 15), span(0, 10), 20).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (5, 5, 5, 5)
    of = lambda *r: spark.createDataFrame([("a", "b", t, x) for t, x in enumerate(r)], "id1 string, id2 string, t1 long, max_corr double")
    d = metrics.max_lag_metrics(of(0.5, 0.5), of(0.5, 0.7)).first()
    assert math.isclose(d.diff_mean, 0.1) and math.isclose(d.diff_std, 0.1)


def test_search_records_failures_and_selects(spark):
    def trial(p):
        if p["k"] == 2:
            raise RuntimeError("no")
        return {"recall": 0.9 + p["k"] / 100, "speedup": 2.0, "freq_threshold": 0.5, "cand_w": 10 - p["k"]}

    rows = search.run_trials({"k": [1, 2, 3], "s": [0]}, trial)
    assert [r["status"] for r in rows] == ["success", "failed", "success"]
    table = spark.createDataFrame([(r["k"], r["status"], r.get("recall"), r.get("speedup"), r.get("freq_threshold"), r.get("cand_w")) for r in rows], "k long, status string, recall double, speedup double, freq_threshold double, cand_w long")
    assert search.select_best(table).first().k == 3


def test_strongest_prefers_the_positive_tie(spark):
    rows = spark.createDataFrame([("k", -0.9), ("k", 0.9)], "key string, r double")
    assert search.strongest(rows, ["key"], "r").first().r == 0.9


def test_sources(spark, tmp_path):
    (tmp_path / "FR-temp.csv").write_text("day,hour,AAAA,BBBB\n2024-01-01,0,1.5,\n2024-01-01,13,2.5,3\n")
    got = {(r.id, r.ts.hour): r.v for r in src.station_csv(spark, "FR", "temp", [str(tmp_path / "none"), str(tmp_path)]).collect()}
    assert got == {("AAAA", 0): 1.5, ("BBBB", 0): None, ("AAAA", 13): 2.5, ("BBBB", 13): 3.0}
    with pytest.raises(FileNotFoundError):
        src.station_csv(spark, "XX", "temp", [str(tmp_path)])
    (tmp_path / "rival").mkdir()
    (tmp_path / "rival" / "AAAA_BBBB_x.csv").write_text("0;0.5\n3;-0.9\n")
    rival = src.rival_results(spark, str(tmp_path / "rival")).orderBy("t1").collect()
    assert [(r.id1, r.id2, r.t1, r.max_corr) for r in rival] == [("AAAA", "BBBB", 0, 0.5), ("AAAA", "BBBB", 3, -0.9)]
    assert src.loader("sparkcorr.sources.series:from_wide") is src.from_wide
    assert [d["dataset_id"] for d in src.datasets(["temp"], ["FR"], [1, 2], [5])] == ["fr_temp_5_1", "fr_temp_5_2"]
    assert src.train_split(long(spark, a=range(5)), 5, 0.5).count() == 2
    wide = src.from_wide(spark.createDataFrame([(0, 1.0, None), (1, 2.0, 3.0)], "t long, a double, b double"), "t")
    assert sorted((r.id, r.t, r.v or -1) for r in wide.collect()) == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, -1), ("b", 1, 3.0)]


def test_artifacts(spark, tmp_path):
    rows = correlated(spark, [(2, 0.5), (0, 0.9)])
    path = str(tmp_path / "correlated")
    artifacts.write(rows, "correlated", path)
    artifacts.append(rows.unionByName(correlated(spark, [(4, 0.7)])), "correlated", path)
    assert sorted(r.t1 for r in spark.read.parquet(path).collect()) == [0, 2, 4]
    artifacts.write(rows, "correlated", str(tmp_path / "csv"), fmt="csv")
    assert spark.read.csv(str(tmp_path / "csv"), sep=";", header=True).count() == 2
    dim = spark.createDataFrame([(0, "x"), (2, "y")], "t long, ts string")
    assert {r.t1: r.t1_time for r in artifacts.with_times(rows, "correlated", dim).collect()} == {0: "x", 2: "y"}
    assert artifacts.deduplicated(rows.unionByName(rows.withColumn("corr", F.lit(-0.95))), "correlated").where("corr = -0.95").count() == 2
    assert artifacts.run_record(spark, dataset_id="d", w=4).first().w == 4
    assert "r = 0.9000" in artifacts.sentences(rows, "correlated").orderBy("line").first().line
    assert artifacts.delete(spark, path)
    search.save_best(rows.limit(1), str(tmp_path / "best"))
    assert search.load_best(spark, str(tmp_path / "best"))["id1"] == "a"


def test_metric_text(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1e-5,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in df.select(wm.metric_text(F.col("v"))).collect()] == ["0.0000", "0.5000", "1.000e-05", "nan", "nan"]


@pytest.mark.parametrize("kind", synth.PROCESSES)
def test_processes_are_finite_and_seeded(kind):
    a, b = (synth.base_process(kind, 200, np.random.default_rng(1)) for _ in range(2))
    assert np.isfinite(a).all() and (a == b).all() and a.std() > 0


def test_processes_follow_their_parameters():
    at = lambda kind, **p: synth.base_process(kind, 20_000, np.random.default_rng(4), **p)
    lagged = lambda x, k: np.corrcoef(x[:-k], x[k:])[0, 1]
    assert abs(lagged(at("ar1"), 1) - 0.6) < 0.03 and abs(lagged(at("ar1", phi=0.2), 1) - 0.2) < 0.03
    assert abs(at("white_noise", sigma=3).std() - 3) < 0.1
    ou = at("ou", mu=5, theta=0.5, dt=0.25)
    assert abs(ou.mean() - 5) < 0.2 and abs(lagged(ou, 1) - 0.875) < 0.02
    assert abs(np.diff(at("rw_seasonal_drift", season_amplitude=0, drift=0.5)).mean() - 0.5) < 0.05
    assert lagged(at("seasonal_ar"), 24) > 0.5 > lagged(at("seasonal_ar", phi_long=0.0), 24)
    steps = np.diff(at("integrated_seasonal"))
    assert lagged(steps, 24) > 0.4
    quiet = at("seasonal_arma", sigma=0.0, season_amplitude=2.0, season_period=50)
    assert np.allclose(quiet[50:], quiet[:-50]) and abs(np.abs(quiet).max() - 2) < 0.01
    with pytest.raises(ValueError):
        synth.SynthConfig(base_proc="ou", parameters={"phi": 1})


def test_planted_pairs_are_found(spark, tmp_path):
    c = synth.SynthConfig(m=4, n=480, w=24, z=0.2, threshold=0.9, base_proc="white_noise", seed=3)
    series, truth, meta = synth.cached(spark, c, str(tmp_path))
    again = synth.cached(spark, c, str(tmp_path))[0]
    assert series.count() == 4 * 480 and again.exceptAll(series).count() == 0 and meta["pairs_used"] > 0
    found = pairs_of(CorrQuery(series, CorrConfig(w=24, step=24, n_lags=480, threshold=0.88, neg_corr=True, origin=1)).correlated)
    planted = {frozenset([(r.id1, r.time1), (r.id2, r.time2)]) for r in truth.collect()}
    assert planted <= {frozenset([(k[0], k[1]), (k[2], k[3])]) for k in found}
    assert np.isfinite(synth.equalise(np.arange(50.0), 7)).all()


def test_streams_equal_batches(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 5, 48).astype(float).cumsum()
    s = long(spark, a=base, b=base + rng.integers(0, 3, 48), c=-base, d=rng.integers(0, 9, 48))
    for blocks in (1, 2):
        c = CorrConfig(w=8, step=4, n_lags=8, threshold=0.8, neg_corr=True, id_blocks=blocks)
        folder = str(tmp_path / f"in{blocks}")
        for k in range(0, 48, 8):
            s.where((F.col("t") >= k) & (F.col("t") < k + 8)).coalesce(1).write.mode("append").parquet(folder)
        out = stream.correlate_stream(stream.read_series(spark, folder), c)
        q = out.writeStream.format("memory").queryName(f"found{blocks}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{blocks}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = pairs_of(CorrQuery(s, c).correlated)
        got = pairs_of(spark.table(f"found{blocks}"))
        assert want and got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_late_ticks_are_kept(spark, tmp_path):
    """Ticks that come up to three micro-batches late, and series of which some lack a tick."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 5, 48).astype(float).cumsum()
    s = long(spark, a=base, b=base + rng.integers(0, 3, 48), c=-base, d=rng.integers(0, 9, 48)).where("not (id = 'd' and t = 20)")
    c = CorrConfig(w=8, step=4, n_lags=8, threshold=0.8, neg_corr=True, id_blocks=2)
    folder = str(tmp_path / "in")
    late = F.col("t") + F.pmod(F.hash("id", "t"), F.lit(7))
    for k in range(0, 60, 2):
        s.where((late >= k) & (late < k + 2)).coalesce(1).write.mode("append").parquet(folder)
    out = stream.correlate_stream(stream.read_series(spark, folder), c, lateness=8)
    q = out.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {k: v for k, v in pairs_of(CorrQuery(s, c).correlated).items() if k[1] + 8 <= 40 and k[3] + 8 <= 40}
    got = pairs_of(spark.table("late"))
    assert want and got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_streamed_events_equal_batch_but_for_open_ends(spark, tmp_path):
    c = CorrConfig(w=8, step=2, n_lags=8, threshold=0.5)
    rng = random.Random(7)
    rows = correlated(spark, [(t, rng.choice([1, -1])) for t in range(0, 40, 2) if rng.random() < 0.6])
    folder = str(tmp_path / "pairs")
    for k in range(0, 40, 10):
        rows.where((F.col("t1") >= k) & (F.col("t1") < k + 10)).select("id1", "t1", "id2", "t2", "lag", "corr").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = stream.monitor_stream(source, c).writeStream.format("memory").queryName("events").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = rows.agg(F.max("t1").alias("last_anchor"))
    want = sorted((r.time_idx, r.anomaly) for r in monitor.anomalies(rows, c, last).collect())
    assert sorted((r.time_idx, r.anomaly) for r in spark.table("events").collect()) == want


@pytest.mark.parametrize("block", [1, 40, 8192])
def test_votes_of_coordinates_by_blocks(spark, block):
    """Ids as strings and repeated, short, null and NaN vectors; against every pair. Only pairs that pass are rows of the plan."""
    rng = random.Random(3)
    rows = [(f"v{rng.randrange(90)}" if k % 9 else None, [rng.choice([rng.random() / 4, k % 3 * 0.1, math.nan, None]) for _ in range(rng.choice([8, 8, 10, 5, 0]))]) for k in range(120)] + [("v1", None)]
    df = spark.createDataFrame(rows, "id string, v array<float>").withColumn("v", F.transform("v", lambda x: F.round(x.cast("double"), 6)))
    rows = [tuple(r) for r in df.collect()]
    want = {}
    for a, x in rows:
        for b, y in rows:
            if a and b and a < b and x and y:
                n = sum(p is not None and q is not None and abs(p - q) <= 0.05 for p, q in zip(x[:8], y[:8]))
                want[a, b] = want.get((a, b), 0) + n
    votes = candidates.coordinate_votes(df, 0.05, 3, id_col="id", vector_col="v", dims=8, block=block)
    assert {(r.id1, r.id2): r.votes for r in votes.collect()} == {k: n for k, n in want.items() if n >= 3}
    assert "Join" not in votes._jdf.queryExecution().toString()
