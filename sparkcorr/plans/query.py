"""One correlation query: configuration in, lazily composed DataFrames out."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcorr.config import CorrConfig
from sparkcorr.operators import candidates as cand
from sparkcorr.operators import blocks, metrics, monitor, pairs
from sparkcorr.operators import sketch as sk
from sparkcorr.operators.windows import difference, flagged_windows


class CorrQuery:
    """Tables that follow from a series under a configuration.

    ``method`` is ``exact`` (all pairs within the lag) or ``sketch`` (sketch neighbours, validated
    on the data). ``preprocess`` differences what is sketched; validation sees the data as it is.
    """

    def __init__(self, series: DataFrame, cfg: CorrConfig, method: str = "exact"):
        if method not in ("exact", "sketch"):
            raise ValueError("method is exact or sketch")
        self.series, self.cfg, self.method = series, cfg, method

    @cached_property
    def windows(self) -> DataFrame:
        return flagged_windows(self.series, self.cfg)

    @cached_property
    def sketched_windows(self) -> DataFrame:
        return flagged_windows(difference(self.series), self.cfg) if self.cfg.preprocess else self.windows

    @cached_property
    def candidates(self) -> DataFrame:
        """Proposed pairs, with arrays."""
        if self.method == "exact":
            return pairs.exact_pairs(self.windows, self.cfg)
        proposed = cand.candidates(self.sketched_windows, self.cfg)
        return cand.with_payload(proposed, self.windows.where("not is_const") if self.cfg.corr_val else self.windows)

    @cached_property
    def correlated(self) -> DataFrame:
        if self.method == "exact":
            return blocks.correlated(self.windows, self.blocked) if self.cfg.corr_val else pairs.exact_correlated(self.windows, self.cfg)
        return pairs.validate(self.candidates, self.cfg)

    @cached_property
    def blocked(self) -> CorrConfig:
        """The configuration with as many ``id_blocks`` as the number of series needs."""
        series = self.series.select("id").distinct().count()
        return replace(self.cfg, id_blocks=max(self.cfg.id_blocks, self.cfg.blocks_for(series)))

    @cached_property
    def last_anchor(self) -> DataFrame:
        return self.windows.agg(F.max("t0").alias("last_anchor"))

    @cached_property
    def status(self) -> DataFrame:
        return monitor.status(self.correlated, self.cfg)

    @cached_property
    def anomalies(self) -> DataFrame:
        return monitor.anomalies(self.correlated, self.cfg, self.last_anchor)

    @cached_property
    def max_lag(self) -> DataFrame:
        return monitor.max_lag(self.correlated)

    @cached_property
    def counters(self) -> DataFrame:
        if self.method == "exact" and self.cfg.corr_val:
            validated = self.correlated.agg(F.count("*").alias("validated"))
            return pairs.exact_counts(self.windows, self.cfg).join(F.broadcast(validated), F.lit(True))  # one row each
        return pairs.counters(self.candidates, self.cfg)

    def metrics(self, truth: CorrQuery) -> DataFrame:
        """Agreement with the exact plan's pairs."""
        return metrics.window_metrics(self.correlated, truth.correlated, truth.counters.select("tested"))

    def distances(self, truth: CorrQuery) -> DataFrame:
        """Every pair of the exact plan with the distance and the estimate of its sketches."""
        keyed = sk.sketches(self.sketched_windows, self.cfg).select("id", "t0", "sketch")
        out = pairs.measured(truth.candidates, self.cfg)
        for i in (1, 2):
            side = keyed.select(F.col("id").alias(f"id{i}"), F.col("t0").alias(f"t{i}"), F.col("sketch").alias(f"sketch{i}"))
            out = out.join(side, [f"id{i}", f"t{i}"])
        u, v = F.col("sketch1"), F.col("sketch2")
        return out.select("id1", "t1", "id2", "t2", "corr", "dist", F.sqrt(cand.squared_distance(u, v)).alias("sketch_dist"), sk.cosine(u, v).alias("estimate"))
