"""Aggregate functions by name, as Column builders for ``groupBy().agg()``.

Names that Spark's registry has are called there. Those that gather a group's
values into an array or map hold one entry for each distinct value; where a group
has many rows for each, ``operators.aggregates`` has the same in two steps.
Sketches of kinds that Spark lacks are stood in for: HLL for CPC, KLL for REQ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., Column]


def entropy(counts: Column) -> Column:
    """Entropy in bits of the distribution that counts describe."""
    total = F.sum(counts)
    bits = (F.ln(total) - F.sum(F.when(counts > 0, counts * F.ln(counts)).otherwise(0.0)) / total) / F.ln(F.lit(2.0))
    return F.when(total > 0, F.greatest(F.lit(0.0), bits)).otherwise(0.0)


def most_frequent(buckets: int, x: Column) -> Column:
    return F.map_from_entries(F.transform(F.call_function("approx_top_k", x, F.lit(buckets)), lambda e: F.struct(e["item"], e["count"])))


def checksum(*columns: Column) -> Column:
    """A sum of hashes that does not depend on the rows' order; it wraps."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")) % F.lit(2**63 - 1).cast("decimal(38,0)")


def _kll(kind: str) -> Builder:
    return lambda x, k=200: F.call_function(f"kll_sketch_agg_{kind}", x, F.lit(k))


def quantile(x: Column, q: float) -> Column:
    return F.call_function("kll_sketch_get_quantile_double", F.call_function("kll_sketch_agg_double", x.cast("double")), F.lit(float(q)))


AGGREGATES: dict[str, Builder] = {
    "approx_distinct": lambda x, error=0.023: F.approx_count_distinct(x, error), "approx_most_frequent": most_frequent, "approx_set": lambda x: F.hll_sketch_agg(x, 12), "hyperloglog": lambda x: F.hll_sketch_agg(x, 12),
    "hll": lambda x, k=12: F.hll_sketch_estimate(F.hll_sketch_agg(x, k)), "hll_sketch": lambda x, k=12: F.hll_sketch_agg(x, k), "hll_union_sketches": lambda s: F.hll_union_agg(s), "merge": lambda s: F.hll_union_agg(s), "hll_estimate": F.hll_sketch_estimate,
    "cpc": lambda x, k=12: F.hll_sketch_estimate(F.hll_sketch_agg(x, k)), "cpc_sketch": lambda x, k=12: F.hll_sketch_agg(x, k), "theta": lambda x: F.theta_sketch_estimate(F.theta_sketch_agg(x)),
    "kll": quantile, "req": quantile, "quantiles": lambda x, qs: F.percentile_approx(x, list(qs), 10_000), "fi": lambda x, k: F.call_function("approx_top_k", x, F.lit(k)),
    **{f"kll_sketch_{t}": _kll("bigint") for t in "bcsil"}, "kll_sketch_f": _kll("float"), "kll_sketch_d": _kll("double"),
    "arbitrary": F.any_value, "bitwise_and_agg": F.bit_and, "bitwise_or_agg": F.bit_or, "bitwise_xor_agg": F.bit_xor, "checksum": checksum, "entropy": entropy, "geometric_mean": lambda x: F.exp(F.avg(F.ln(x))),
    "set_agg": F.collect_set, "set_union": lambda a: F.array_distinct(F.flatten(F.collect_set(a))), "map_agg": lambda k, v: F.map_from_entries(F.collect_set(F.struct(k, v))),
    "max_data_size_for_stats": lambda x: F.max(F.octet_length(x)), "sum_data_size_for_stats": lambda x: F.sum(F.octet_length(x)), "non_null_count": F.count, "$internal$count_distinct": F.count_distinct,
    "first_ignore_null": lambda x: F.first(x, True), "last_ignore_null": lambda x: F.last(x, True), "regr_replacement": lambda x: F.var_pop(x) * F.count(x),
}
