"""Runs with records, search and comparison, the command line, and SQL functions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcorr.__main__ import main
from sparkcorr.config import CorrConfig
from sparkcorr.functions import sql
from sparkcorr.operators import pairs, search
from sparkcorr.operators import sketch as sk
from sparkcorr.operators.windows import flagged_windows
from sparkcorr.plans import experiment
from sparkcorr.plans.query import CorrQuery
from sparkcorr.streaming import monitor as stream

CFG = CorrConfig(w=8, step=4, n_lags=8, threshold=0.8, n_vectors=8, neg_corr=True, cell_stretch=1.5)


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    base = rng.normal(size=40).cumsum()
    named = {"a": base, "b": base + 0.1 * rng.normal(size=40), "c": -base, "d": rng.normal(size=40)}
    path = str(tmp_path_factory.mktemp("series"))
    spark.createDataFrame([(k, t, float(v)) for k, x in named.items() for t, v in enumerate(x)], "id string, t long, v double").write.mode("overwrite").parquet(path)
    return path


def test_search_and_comparison(spark, series, tmp_path):
    rows, best = experiment.param_search(spark.read.parquet(series), CFG, {"cell_stretch": [0.25, 2.0], "n_vectors": [8, -1]}, str(tmp_path / "s"), target_recall=0.9)
    got = rows.collect()
    assert [r.status for r in got] == ["success", "failed", "success", "failed"] and "ValueError" in got[1].error
    assert got[0].recall < 0.9 <= got[2].recall and best.first().cell_stretch == 2.0  # the one trial with that recall
    assert all(r.sk_time > 0 for r in got if r.status == "success")
    folders = [spark.read.parquet(f"{tmp_path}/s/trial={k}/correlated").count() for k in (0, 2)]
    assert folders == [got[0].corr_w, got[2].corr_w]
    table = experiment.compare(spark.read.parquet(series), CFG, str(tmp_path / "c"), rival=spark.createDataFrame([("a", "b", 0, 0.9), ("a", "b", 0, -0.9)], "id1 string, id2 string, t1 long, max_corr double"))
    by = {r.alg: r for r in table.collect()}
    assert by.keys() == {"exact", "sketch", "rival"}
    assert by["exact"].recall == by["exact"].precision == 1 and by["sketch"].precision == 1 and by["sketch"].corr_w <= by["exact"].corr_w
    assert math.isclose(by["exact"].speedup, 1) and by["exact"].max_lag_diff_mean == 0


@pytest.mark.parametrize("speedups,recalls,best", [([3, 2.99, 1], [0.95, 0.96, 1], 1), ([3, 2, 1.5], [0.5, 0.99, 0.99], 1), ([3, 2, 1.5], [0.9, 0.2, 0.3], 0), ([0.5, 0.9, 0.8], [1, 1, 1], 1)])
def test_selection_on_fixed_rows(spark, speedups, recalls, best):
    """Target recall, near-best speedup, and of those the fewest candidates."""
    rows = [("success", k, float(s), float(r), 0.5, [100, 50, 70][k]) for k, (s, r) in enumerate(zip(speedups, recalls))]
    df = spark.createDataFrame([*rows, ("failed", 9, 99.0, 1.0, 0.5, 1)], "status string, k int, speedup double, recall double, freq_threshold double, cand_w long")
    assert search.select_best(df).first().k == best


def test_exact_counts_are_those_of_the_pairs(spark, series):
    query = CorrQuery(spark.read.parquet(series), CFG)
    want = pairs.counters(query.candidates, CFG).first()
    assert pairs.exact_counts(query.windows, CFG).first().asDict() == {"total_candidates": want.total_candidates, "tested": want.tested}
    assert query.counters.first().asDict() == want.asDict()
    empty = pairs.exact_counts(query.windows.where("false"), CFG).first()
    assert empty.total_candidates == empty.tested == 0


def test_search_on_the_first_ticks_then_comparison_on_all(spark, series, tmp_path):
    shifted = spark.read.parquet(series).withColumn("t", F.col("t") + 7)
    assert experiment.training(shifted, 0.5).agg(F.min("t"), F.max("t")).first() == (7, 26)
    trials, best, rows = experiment.search_and_compare(shifted, CFG, {"n_vectors": [8], "cell_stretch": [2.0]}, str(tmp_path), train_ratio=0.6, target_recall=0.1)
    assert trials.first().n_ticks == 24 and best.first().cell_stretch == 2.0
    assert {(r.alg, r.n_ticks, r.cell_stretch) for r in rows.collect()} >= {("exact", 40, 2.0), ("sketch", 40, 2.0)}


def small_series(spark, country, variable):
    rng = np.random.default_rng(len(country + variable))
    base = rng.normal(size=40).cumsum()
    return spark.createDataFrame([(k, t, float(x + 0.01 * n)) for n, k in enumerate("abc") for t, x in enumerate(base * (1 if k != "c" else -1))], "id string, t long, v double")


def test_command_line_on_a_grid_of_datasets(spark, tmp_path, capsys):
    base = ["--w", "8", "--step", "4", "--n-lags", "8", "--threshold", "0.8"]
    grid = ["--loader", f"{__name__}:small_series", "--variables", "Rain", "Wind", "--countries", "fr", "--n-vars", "2"]
    assert main(["exact", "--out", str(tmp_path / "g"), *grid, *base]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()[-2:]]
    assert [(x["dataset_id"], x["n_series"]) for x in lines] == [("fr_rain_2_0", 2), ("fr_wind_2_0", 2)]
    assert main(["tune", "--out", str(tmp_path / "t"), "--grid", '{"n_vectors": [8]}', "--train-ratio", "0.6", "--target-recall", "0.1", *grid[:4], *base]) == 0
    assert sorted(json.loads(x)["alg"] for x in capsys.readouterr().out.strip().splitlines()[-2:]) == ["exact", "sketch"]
    rows = "\n".join(f"2020-01-{1 + t // 24:02d};{t % 24};{t % 5 + t / 9};{(t % 5) * 2 + t / 5}" for t in range(40))
    (tmp_path / "es-Rain.csv").write_text("Date;Hour;S1;S2\n" + rows)
    (tmp_path / "rival").mkdir()
    (tmp_path / "rival" / "ABCD_EFGH_x.csv").write_text("0;0.9\n")
    more = ["--rival-results", str(tmp_path / "rival"), "--rival-suffix", "x"]
    assert main(["compare", "--out", str(tmp_path / "r"), "--station-roots", str(tmp_path), "--variables", "Rain", "--countries", "es", *more, *base]) == 0
    assert sorted(json.loads(x)["alg"] for x in capsys.readouterr().out.strip().splitlines()[-3:]) == ["exact", "rival", "sketch"]


def test_command_line(series, tmp_path, capsys):
    base = ["--series", series, "--w", "8", "--step", "4", "--n-lags", "8", "--threshold", "0.8", "--neg-corr", "true"]
    assert main(["exact", "--out", str(tmp_path / "e"), *base]) == 0
    exact = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert exact["corr_w"] > 0 and exact["cand_w"] >= exact["corr_w"]
    assert main(["search", "--out", str(tmp_path / "s"), "--grid", '{"n_vectors": [8]}', "--target-recall", "0.1", *base]) == 0
    capsys.readouterr()
    assert main(["sketch", "--out", str(tmp_path / "k"), "--params", str(tmp_path / "s" / "best"), *base]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["n_vectors"] == 8
    assert main(["compare", "--out", str(tmp_path / "c"), *base]) == 0
    assert main(["synth", "--out", str(tmp_path / "y"), "--m", "3", "--n", "96", "--w", "24", "--z", "0.5"]) == 0
    with pytest.raises(SystemExit):
        main(["exact", "--out", str(tmp_path / "e")])


def test_sql_functions(spark, series):
    sql.register(spark)
    windows = flagged_windows(spark.read.parquet(series), CFG)
    x, y = np.array([1.0, 2, 4]), np.array([3.0, 1, 2])
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<double>, y array<double>")
    row = df.selectExpr("corr_arr(x, y) as r", "dist_arr(x, y) as d", "corr_arr(x, array(1D, 1D, 1D)) as none").first()
    assert math.isclose(row.r, np.corrcoef(x, y)[0, 1]) and math.isclose(row.d, np.linalg.norm(x - y)) and row.none is None
    w = F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in sk.weights(CFG)))
    both = sk.sketches(windows, CFG).withColumn("w", w).selectExpr("sketch", "sketch_arr(w, xs) as own").collect()
    assert all(np.allclose(r.sketch, r.own) for r in both)


def test_online_scores(spark, series, tmp_path):
    found = CorrQuery(spark.read.parquet(series), CFG).correlated.select("id1", "t1", "id2", "t2", "lag", "corr")
    folder = str(tmp_path / "pairs")
    found.coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(found.schema).parquet(folder)
    truth = spark.read.parquet(folder).where("t1 > 8")
    q = stream.score_stream(source, truth, str(tmp_path / "scores"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    scores = spark.read.parquet(str(tmp_path / "scores")).agg(F.sum("pred"), F.sum("tp")).first()
    assert tuple(scores) == (found.count(), truth.count())
