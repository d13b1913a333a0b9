"""SQL functions for arrays of doubles; temporary, of one session, and inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SUM = "aggregate({a}, cast(0 as double), (s, v) -> s + v)"
_N = "cast(size(x) as double)"


def _total(a: str) -> str:
    return _SUM.format(a=a)


FUNCTIONS = {
    "dot_arr": ("x array<double>, y array<double>", "double", _total("zip_with(x, y, (a, b) -> a * b)")),
    "dist_arr": ("x array<double>, y array<double>", "double", f"sqrt({_total('zip_with(x, y, (a, b) -> (a - b) * (a - b))')})"),
    "ssd_arr": ("x array<double>", "double", f"{_total('transform(x, v -> v * v)')} - {_total('x')} * {_total('x')} / {_N}"),
    "corr_arr": (
        "x array<double>, y array<double>",
        "double",
        f"case when size(x) = size(y) and ssd_arr(x) > 0 and ssd_arr(y) > 0 then greatest(cast(-1 as double), least(cast(1 as double), (dot_arr(x, y) - {_total('x')} * {_total('y')} / {_N}) / sqrt(ssd_arr(x) * ssd_arr(y)))) end",
    ),
    "unit_arr": ("x array<double>", "array<double>", "transform(x, v -> coalesce(try_divide(v, sqrt(dot_arr(x, x))), cast(0 as double)))"),
    "sketch_arr": ("weights array<array<double>>, x array<double>", "array<double>", f"unit_arr(transform(weights, w -> {_total('zip_with(w, x, (a, b) -> a * b)')} - {_total('w')} * {_total('x')} / {_N}))"),
}


def register(spark: SparkSession) -> list[str]:
    """``corr_arr`` (null if a side is constant), ``sketch_arr`` (``mean_l2``) and what they are made of."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
