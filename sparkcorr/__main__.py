"""python -m sparkcorr {exact,sketch,search,compare,tune,synth} ...

Series are Parquet tables (id, t, v), station files, or what a loader gives; with ``--variables`` and so on a
command runs for each dataset of the grid, under a folder of its own. ``tune`` searches on the first
``--train-ratio`` of the ticks and compares on all. Options set fields of the configuration; values of a search's
``--grid`` are JSON, as in ``--grid '{"n_vectors": [8, 16], "cell_stretch": [0.5, 1]}'``.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from sparkcorr.config import CorrConfig
from sparkcorr.operators import search
from sparkcorr.plans import experiment
from sparkcorr.sources import artifacts, synth
from sparkcorr.sources import series as sources


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkcorr", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["exact", "sketch", "search", "compare", "tune", "synth"])
    parser.add_argument("--series", help="Parquet table (id, t, v)")
    parser.add_argument("--station-roots", nargs="+", help="folders of wide station files <country>-<variable>.csv, instead of --series")
    parser.add_argument("--loader", help="module:callable (spark, country, variable) -> series, instead of --series")
    parser.add_argument("--variables", nargs="+", help="of the datasets, with --station-roots or --loader")
    parser.add_argument("--countries", nargs="+", default=["all"])
    parser.add_argument("--n-years", nargs="+", type=int, default=[0], help="last years of each dataset; 0 keeps all")
    parser.add_argument("--n-vars", nargs="+", type=int, default=[0], help="first series of each dataset; 0 keeps all")
    parser.add_argument("--rival-results", help="folder of another system's results, for compare and tune")
    parser.add_argument("--rival-suffix", default=".*", help="end of those files' names")
    parser.add_argument("--train-ratio", type=float, default=None, help="share of the ticks to search on; 1 for search, 0.3 for tune")
    parser.add_argument("--out", required=True, help="folder for results")
    parser.add_argument("--dataset-id", default="")
    parser.add_argument("--grid", type=json.loads, default={"n_vectors": [8, 16, 32, 64], "cell_stretch": [0.25, 0.5, 0.75, 1.0, 1.25]})
    parser.add_argument("--params", help="selected row of a search, for sketch and compare")
    parser.add_argument("--target-recall", type=float, default=0.95)
    known = {f.name for c in (CorrConfig, synth.SynthConfig) for f in fields(c)}
    for name in sorted(known):
        parser.add_argument(f"--{name.replace('_', '-')}", type=_value, default=None)
    args = parser.parse_args(argv)
    own = lambda cls: {f.name: getattr(args, f.name) for f in fields(cls) if getattr(args, f.name) is not None}
    spark = SparkSession.builder.appName("sparkcorr").getOrCreate()
    if args.command == "synth":
        _, truth, meta = synth.cached(spark, synth.SynthConfig(**own(synth.SynthConfig)), args.out)
        print(json.dumps(meta | {"planted": truth.count()}))
        return 0
    if not (args.series or args.variables and (args.station_roots or args.loader)):
        parser.error("--series is needed, or --variables with --station-roots or --loader")
    options = own(CorrConfig)
    if args.params:
        best = search.load_best(spark, args.params)
        options = {k: best[k] for k in ("n_vectors", "cell_stretch", "grid_dimension", "freq_threshold", "sketch_norm", "seed", "seed_toggle") if k in best} | options
    cfg = CorrConfig(**options)
    if args.series:
        command(spark, args, spark.read.parquet(args.series), cfg, args.out, args.dataset_id)
        return 0
    for entry in sources.datasets(args.variables, args.countries, args.n_years, args.n_vars):
        command(spark, args, dataset(spark, args, entry), cfg, f"{args.out}/{entry['dataset_id']}", entry["dataset_id"])
    return 0


def dataset(spark: SparkSession, args: argparse.Namespace, entry: dict) -> DataFrame:
    """The series of one dataset of the grid."""
    if args.loader:
        series = sources.loader(args.loader)(spark, entry["country"], entry["variable"])
    else:
        series = sources.to_ticks(sources.station_csv(spark, entry["country"], entry["variable"], args.station_roots), "ts")[0]
    if entry["n_years"]:
        series = sources.last_years(series, entry["n_years"])
    if entry["n_var"]:
        ids = [r.id for r in series.select("id").distinct().orderBy("id").limit(entry["n_var"]).collect()]
        series = sources.first_series(series, ids, entry["n_var"])
    return series


def command(spark: SparkSession, args: argparse.Namespace, series: DataFrame, cfg: CorrConfig, out: str, dataset_id: str) -> None:
    """One command on one dataset; results go under ``out``, records to standard output."""
    rival = sources.rival_results(spark, args.rival_results, args.rival_suffix) if args.rival_results else None
    if args.command == "search":
        rows, best = experiment.param_search(series, cfg, args.grid, out, target_recall=args.target_recall, train_ratio=args.train_ratio or 1.0)
        rows.write.mode("overwrite").parquet(f"{out}/trials")
        search.save_best(best, f"{out}/best")
        print(json.dumps(search.load_best(spark, f"{out}/best")))
    elif args.command in ("compare", "tune"):
        if args.command == "tune":
            trials, best, rows = experiment.search_and_compare(series, cfg, args.grid, out, target_recall=args.target_recall, train_ratio=args.train_ratio or 0.3, rival=rival, dataset_id=dataset_id)
            trials.write.mode("overwrite").parquet(f"{out}/trials")
            search.save_best(best, f"{out}/best")
        else:
            rows = experiment.compare(series, cfg, out, rival=rival, dataset_id=dataset_id)
        rows.write.mode("overwrite").parquet(f"{out}/comparison")
        for line in rows.toJSON().collect():  # one row a plan
            print(line)
    else:
        record = experiment.run(series, cfg, args.command, out, dataset_id=dataset_id)
        artifacts.run_record(spark, **record).write.mode("overwrite").parquet(f"{out}/record")
        print(json.dumps(record))


if __name__ == "__main__":
    raise SystemExit(main())
