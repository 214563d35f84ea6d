"""Aggregates in steps: partial states, states merged, results taken out of states.

For each function, ``partial`` is an aggregate from values to a state, ``merge``
one from states to a state, and ``extract`` a scalar function from a state to the
result, so that states can be stored and combined later, at any level.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Companion(NamedTuple):
    partial: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    extract: Callable[[Column], Column]


def _same(f: Callable[[Column], Column], merge: Callable[[Column], Column] | None = None) -> Companion:
    """An aggregate whose result is its state."""
    return Companion(f, merge or f, lambda s: s)


def _moments(x: Column) -> Column:
    return F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def _merged_moments(s: Column) -> Column:
    """States of other means shift by their distance from the common one."""
    n, total = F.sum(s["n"]), F.sum(s["n"] * s["mean"])
    return F.struct(n.alias("n"), (total / n).alias("mean"), (F.sum(s["m2"]) + F.sum(s["n"] * s["mean"] * s["mean"]) - total * total / n).alias("m2"))


def _variance(of: Callable[[Column], Column]) -> Companion:
    return Companion(_moments, _merged_moments, of)


COMPANIONS: dict[str, Companion] = {
    "sum": _same(F.sum), "min": _same(F.min), "max": _same(F.max), "count": _same(F.count, F.sum), "bool_and": _same(F.bool_and), "bool_or": _same(F.bool_or), "bitwise_and_agg": _same(F.bit_and), "bitwise_or_agg": _same(F.bit_or), "bitwise_xor_agg": _same(F.bit_xor),
    "avg": Companion(lambda x: F.struct(F.sum(x).alias("sum"), F.count(x).alias("n")), lambda s: F.struct(F.sum(s["sum"]).alias("sum"), F.sum(s["n"]).alias("n")), lambda s: F.try_divide(s["sum"], s["n"])),
    "var_pop": _variance(lambda s: F.try_divide(s["m2"], s["n"])), "var_samp": _variance(lambda s: F.try_divide(s["m2"], s["n"] - 1)), "stddev_pop": _variance(lambda s: F.sqrt(F.greatest(F.lit(0.0), F.try_divide(s["m2"], s["n"])))), "stddev_samp": _variance(lambda s: F.sqrt(F.greatest(F.lit(0.0), F.try_divide(s["m2"], s["n"] - 1)))),
    "approx_distinct": Companion(lambda x: F.hll_sketch_agg(x, 14), F.hll_union_agg, F.hll_sketch_estimate),
    "set_agg": Companion(F.collect_set, lambda s: F.array_distinct(F.flatten(F.collect_set(s))), lambda s: s),
}


def companion(name: str) -> Callable[..., Column]:
    """``avg_partial``, ``avg_merge``, ``avg_extract`` and the like by name."""
    function, _, step = name.rpartition("_")
    if function not in COMPANIONS or step not in Companion._fields:
        raise ValueError(f"no companion function {name}")
    return getattr(COMPANIONS[function], step)
