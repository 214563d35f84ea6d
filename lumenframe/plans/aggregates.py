"""Aggregate functions: Spark's form and the oracle's side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions.dialects import function
from lumenframe.operators import aggregates as agg
from lumenframe.operators.companions import companion

from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


def grouped(name: str, table: str, keys: str, columns: dict[str, str | tuple[str, str]], oracle: bool = True) -> None:
    both = {k: (v, v) if isinstance(v, str) else v for k, v in columns.items()}
    form = lambda i: f"SELECT {keys}, " + ", ".join(f"{v[i]} AS {k}" for k, v in both.items()) + f" FROM {table} GROUP BY {keys}"
    R.sql(name, form(0), form(1), oracle)


r6 = lambda x: f"round({x}, 6)"
grouped("agg_basic", "{lineitem}", "l_returnflag", {
    "count": "count(*)", "non_null_count": "count(nullif(l_linenumber, 1))", "count_distinct": "count(DISTINCT l_suppkey)", "count_if": ("count_if(l_quantity > 10)", "count_if(l_quantity > 10)::BIGINT"), "sum_int": ("sum(l_linenumber)", "sum(l_linenumber)::BIGINT"), "sum": "round(sum(l_quantity), 2)", "avg": "round(avg(l_quantity), 6)", "min": "min(l_shipdate)", "max": "max(l_shipdate)",
    "bool_and": "bool_and(l_quantity > 0)", "bool_or": "bool_or(l_quantity > 49)", "every": ("every(l_quantity > 1)", "bool_and(l_quantity > 1)"), "bit_and": "bit_and(l_orderkey)", "bit_or": "bit_or(l_orderkey)", "bit_xor": "bit_xor(l_orderkey)", "max_by": "max_by(l_orderkey, l_orderkey * 10 + l_linenumber)", "min_by": "min_by(l_orderkey, l_orderkey * 10 + l_linenumber)", "geometric_mean": (r6("exp(avg(ln(l_quantity)))"), r6("geomean(l_quantity)")),
})
grouped("agg_moments", "{lineitem}", "l_returnflag", {
    "stddev_pop": r6("stddev_pop(l_quantity)"), "stddev_samp": r6("stddev_samp(l_quantity)"), "var_pop": r6("var_pop(l_quantity)"), "var_samp": r6("var_samp(l_quantity)"), "m2": ("round(var_pop(l_quantity) * count(l_quantity), 2)", "round(var_pop(l_quantity) * count(l_quantity), 2)"),
    "corr": r6("corr(l_quantity, l_discount)"), "covar_pop": r6("covar_pop(l_quantity, l_discount)"), "covar_samp": r6("covar_samp(l_quantity, l_discount)"), **{f: r6(f"{f}(l_quantity, l_discount)") for f in "regr_slope regr_intercept regr_r2 regr_avgx regr_avgy regr_sxx regr_sxy regr_syy".split()}, "regr_count": ("regr_count(l_quantity, l_discount)", "regr_count(l_quantity, l_discount)::BIGINT"),
    "skewness": ("round(skewness(l_quantity), 5)", "round(skewness_pop(l_quantity), 5)" if False else "round((avg(l_quantity ** 3) - 3 * avg(l_quantity) * avg(l_quantity ** 2) + 2 * avg(l_quantity) ** 3) / stddev_pop(l_quantity) ** 3, 5)"), "spark_kurtosis": ("round(kurtosis(l_quantity), 4)", "round(kurtosis_pop(l_quantity), 4)"),
    "presto_kurtosis": ("round((count(*) - 1) * ((count(*) + 1) * (kurtosis(l_quantity) + 3) - 3 * (count(*) - 1)) / ((count(*) - 2) * (count(*) - 3)), 4)", "round(kurtosis(l_quantity), 4)"),
})
grouped("agg_percentile", "{lineitem}", "l_returnflag", {"median": ("percentile(l_extendedprice, 0.5)", "quantile_cont(l_extendedprice, 0.5)"), "p90": (r6("percentile(l_quantity, 0.9)"), r6("quantile_cont(l_quantity, 0.9)")), "percentile_approx_exact": ("percentile_approx(l_linenumber, 0.5, 10000)", "quantile_disc(l_linenumber, 0.5)")})
grouped("agg_arrays", "{orders}", "o_orderstatus", {
    "collect_list": ("size(collect_list(o_custkey))", "len(list(o_custkey))::INTEGER"), "collect_set": ("size(collect_set(o_custkey))", "count(DISTINCT o_custkey)::INTEGER"), "array_agg_with_nulls": ("size(collect_list(struct(nullif(o_custkey, 3) AS x)))", "len(array_agg(nullif(o_custkey, 3)))::INTEGER"),
    "sum_data_size": ("sum(octet_length(o_orderpriority))", "sum(strlen(o_orderpriority))::BIGINT"), "max_data_size": ("max(octet_length(o_orderpriority))", "max(strlen(o_orderpriority))::INTEGER"),
})
# values of the row that the order puts first or last, with and without nulls: a sort within the group decides, not the order of arrival
R.sql("agg_first_last", "SELECT o_custkey, first_value(k) AS first, last_value(k) AS last, first_value(k) IGNORE NULLS AS first_known, last_value(k) IGNORE NULLS AS last_known, any_value(o_custkey) AS any FROM (SELECT o_custkey, nullif(o_orderkey, o_custkey) AS k FROM {orders} DISTRIBUTE BY o_custkey SORT BY o_custkey, o_orderkey) GROUP BY o_custkey", "SELECT o_custkey, first(nullif(o_orderkey, o_custkey) ORDER BY o_orderkey) AS first, last(nullif(o_orderkey, o_custkey) ORDER BY o_orderkey) AS last, any_value(nullif(o_orderkey, o_custkey) ORDER BY o_orderkey) AS first_known, last(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey <> o_custkey) AS last_known, any_value(o_custkey) AS any FROM {orders} GROUP BY 1")


def joined(column: str):
    return F.concat_ws(",", F.col(column).cast("array<string>")).alias(column)


def entries(column: str):
    """A map's entries as text, by key."""
    text = F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return F.concat_ws(";", F.array_sort(text)).alias(column)


@R.add("agg_max_min_n", "SELECT o_custkey, array_to_string(list(o_totalprice ORDER BY o_totalprice DESC)[1:3], ',') AS high, array_to_string(list(o_totalprice ORDER BY o_totalprice)[1:3], ',') AS low FROM orders GROUP BY 1")
def max_min_n(t):
    high, low = agg.extremes(t.orders, ["o_custkey"], "o_totalprice", 3, "high"), agg.extremes(t.orders, ["o_custkey"], "o_totalprice", 3, "low", greatest=False)
    return high.join(low, "o_custkey").select("o_custkey", joined("high"), joined("low"))


@R.add("agg_set", "SELECT o_orderstatus, string_agg(DISTINCT o_custkey % 7, ',' ORDER BY o_custkey % 7) AS s FROM orders GROUP BY 1")
def set_agg(t):
    return agg.distinct_values(t.orders.withColumn("x", F.col("o_custkey") % 7), ["o_orderstatus"], "x", "s").select("o_orderstatus", joined("s"))


@R.add("agg_set_union", "SELECT o_orderstatus, string_agg(DISTINCT x, ',' ORDER BY x) AS s FROM (SELECT o_orderstatus, unnest([o_custkey % 7, o_orderkey % 5]) AS x FROM orders) GROUP BY 1")
def set_union(t):
    return agg.set_union(t.orders.withColumn("x", F.expr("array(o_custkey % 7, o_orderkey % 5)")), ["o_orderstatus"], "x", "s").select("o_orderstatus", joined("s"))


@R.add("agg_reduce", "SELECT o_orderstatus, sum(o_custkey)::BIGINT AS s, count(*) AS n FROM orders GROUP BY 1")
def reduce_agg(t):
    """Folds in chunks; a pair of sum and count, merged."""
    rows = t.orders.select("o_orderstatus", F.struct(F.col("o_custkey").alias("s"), F.lit(1).cast("long").alias("n")).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("n"))
    merged = agg.reduce_agg(rows, ["o_orderstatus"], "x", start, lambda a, x: F.struct((a["s"] + x["s"]).alias("s"), (a["n"] + x["n"]).alias("n")), "r", chunk=500)
    return merged.select("o_orderstatus", "r.s", "r.n")


@R.add("agg_map", "SELECT o_orderstatus, string_agg(k || '=' || v, ';' ORDER BY k || '=' || v) AS m FROM (SELECT o_orderstatus, o_orderpriority AS k, min(o_custkey) AS v FROM orders GROUP BY 1, 2) GROUP BY 1")
def map_agg(t):
    return agg.map_agg(t.orders, ["o_orderstatus"], "o_orderpriority", "o_custkey", "m").select("o_orderstatus", entries("m"))


@R.add("agg_histogram", "SELECT o_orderstatus, string_agg(k || '=' || n, ';' ORDER BY k || '=' || n) AS h FROM (SELECT o_orderstatus, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def histogram(t):
    return agg.histogram(t.orders, ["o_orderstatus"], "o_orderpriority", "h").select("o_orderstatus", entries("h"))


@R.add("agg_multimap", "SELECT n_regionkey, string_agg(k || '=' || v, ';' ORDER BY k || '=' || v) AS m FROM (SELECT n_regionkey, n_nationkey % 2 AS k, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS v FROM nation GROUP BY 1, 2) GROUP BY 1")
def multimap(t):
    rows = agg.multimap(t.nation.withColumn("k", F.col("n_nationkey") % 2), ["n_regionkey"], "k", "n_nationkey", "m")
    return rows.withColumn("m", F.transform_values("m", lambda k, v: F.concat_ws(",", v.cast("array<string>")))).select("n_regionkey", entries("m"))


R.sql("agg_entropy", "SELECT o_orderstatus, round(greatest(0, (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(2)), 6) AS entropy FROM (SELECT o_orderstatus, count(*) AS c FROM {orders} GROUP BY o_orderstatus, o_orderpriority) GROUP BY o_orderstatus", "SELECT o_orderstatus, round(entropy(o_orderpriority), 6) AS entropy FROM orders GROUP BY 1")


def _maps(t):
    """Maps whose keys differ from row to row; some have no entry, some are null."""
    some = F.when(F.col("o_orderkey") % 11 == 0, None).when(F.col("o_orderkey") % 7 == 0, F.expr("map_filter(map('z', o_custkey), (k, v) -> false)"))
    return t.orders.withColumn("m", some.otherwise(F.expr("map(o_orderpriority, o_custkey, concat('k', o_orderkey % 3), o_orderkey)")))


_MAP_ROWS = "(SELECT o_orderstatus, unnest([o_orderpriority, 'k' || (o_orderkey % 3)]) AS k, unnest([o_custkey, o_orderkey]) AS v FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0)"
for _how in ("sum", "avg", "count", "min", "max"):
    _v = {"sum": "sum(v)::BIGINT", "avg": "round(avg(v), 4)::VARCHAR"}.get(_how, f"{_how}(v)")

    def _union(t, how=_how):
        rows = agg.map_aggregate(_maps(t), ["o_orderstatus"], "m", how, "m")
        return (rows.withColumn("m", F.transform_values("m", lambda k, v: F.round(v, 4))) if how == "avg" else rows).select("o_orderstatus", entries("m"))

    R.add(f"agg_map_union_{_how}", f"SELECT o_orderstatus, string_agg(k || '=' || v, ';' ORDER BY k || '=' || v) AS m FROM (SELECT o_orderstatus, k, {_v} AS v FROM {_MAP_ROWS} GROUP BY 1, 2) GROUP BY 1")(_union)


@R.add("agg_map_union", f"SELECT o_orderstatus, string_agg(DISTINCT k, ',' ORDER BY k) AS ks, true AS known FROM {_MAP_ROWS} GROUP BY 1")
def map_union(t):
    """Of a key that several maps have, any of their values: here one that is among them."""
    rows = agg.map_aggregate(_maps(t), ["o_orderstatus"], "m", "any", "m")
    return rows.select("o_orderstatus", F.concat_ws(",", F.array_sort(F.map_keys("m"))).alias("ks"), F.forall(F.map_values("m"), lambda v: v >= 0).alias("known"))


@R.add("agg_array_sum_count", "SELECT o_orderstatus, sum(o_custkey)::BIGINT || ',' || sum(o_orderkey)::BIGINT AS s, count(nullif(o_custkey % 3, 0)) || ',' || count(*) AS n FROM orders GROUP BY 1")
def array_sum_count(t):
    rows = t.orders.select("o_orderstatus", F.expr("array(o_custkey, o_orderkey)").alias("a"), F.expr("array(nullif(o_custkey % 3, 0), o_orderkey)").alias("b"))
    sums, counts = agg.array_aggregate(rows, ["o_orderstatus"], "a", "sum", "s"), agg.array_aggregate(rows, ["o_orderstatus"], "b", "count", "n")
    return sums.join(counts, "o_orderstatus").select("o_orderstatus", joined("s"), joined("n"))


def _named(name: str, sql: str, columns) -> None:
    """Aggregates called by name, by return flag."""
    R.add(name, sql)(lambda t: t.lineitem.groupBy("l_returnflag").agg(*(c.alias(k) for k, c in columns().items())))


f = function
_named("agg_by_name", """
SELECT l_returnflag, any_value(l_returnflag) AS arbitrary, bit_and(l_orderkey) AS band, bit_or(l_orderkey) AS bor, bit_xor(l_orderkey) AS bxor, round(geomean(l_quantity), 6) AS geo, count(DISTINCT l_suppkey)::INTEGER AS sets,
       max(strlen(l_linestatus))::INTEGER AS widest, sum(strlen(l_linestatus))::BIGINT AS bytes, count(nullif(l_linenumber, 1)) AS known, count(DISTINCT l_partkey) AS differing, round(var_pop(l_quantity) * count(*), 2) AS m2,
       round(stddev(l_quantity), 6) AS sd, round(stddev(l_quantity), 6) AS std, round(variance(l_quantity), 6) AS var, true AS near, true AS hll, true AS theta, true AS cpc, true AS kll, true AS req, true AS top, true AS frequent, true AS quarters, true AS sums
FROM lineitem GROUP BY 1""", lambda: {
    "arbitrary": f("arbitrary")(F.col("l_returnflag")), "band": f("bitwise_and_agg")(F.col("l_orderkey")), "bor": f("bitwise_or_agg")(F.col("l_orderkey")), "bxor": f("bitwise_xor_agg")(F.col("l_orderkey")), "geo": F.round(f("geometric_mean")(F.col("l_quantity")), 6), "sets": F.size(f("set_agg")(F.col("l_suppkey"))),
    "widest": f("max_data_size_for_stats")(F.col("l_linestatus")), "bytes": f("sum_data_size_for_stats")(F.col("l_linestatus")), "known": f("non_null_count")(F.expr("nullif(l_linenumber, 1)")), "differing": f("$internal$count_distinct")(F.col("l_partkey")), "m2": F.round(f("regr_replacement")(F.col("l_quantity")), 2),
    "sd": F.round(f("stddev")(F.col("l_quantity")), 6), "std": F.round(f("std")(F.col("l_quantity")), 6), "var": F.round(f("variance")(F.col("l_quantity")), 6),
    **{k: F.abs(f(n)(F.col("l_partkey")) / F.count_distinct("l_partkey") - 1) < 0.1 for k, n in {"near": "approx_distinct", "hll": "hll", "theta": "theta", "cpc": "cpc"}.items()},
    **{k: F.abs(f(k)(F.col("l_quantity"), 0.5) - F.percentile("l_quantity", 0.5)) <= 3 for k in ("kll", "req")}, "top": F.size(f("fi")(F.col("l_linenumber"), 3)) == 3, "frequent": F.size(f("approx_most_frequent")(3, F.col("l_linenumber"))) == 3, "quarters": F.size(f("quantiles")(F.col("l_quantity"), [0.25, 0.5])) == 2, "sums": f("checksum")(F.col("l_orderkey")).isNotNull(),
})


@R.add("agg_sketch_merge", "SELECT true AS merged, true AS empty, true AS kll")
def sketch_merge(t):
    """Sketches of groups merged, an empty sketch among them, and quantile sketches of each number type."""
    parts = t.lineitem.groupBy("l_returnflag").agg(f("hll_sketch")(F.col("l_partkey"), 14).alias("s"))
    whole = t.lineitem.agg(F.count_distinct("l_partkey").alias("n"), *(f(f"kll_sketch_{k}")(F.col("l_quantity").cast(c)).alias(f"k_{k}") for k, c in {"i": "int", "l": "long", "f": "float", "d": "double"}.items()))
    merged = parts.agg(f("hll_estimate")(f("merge")(F.col("s"))).alias("m"))
    kll = F.col("k_i").isNotNull() & F.col("k_l").isNotNull() & F.col("k_f").isNotNull() & (F.call_function("kll_sketch_get_n_double", F.col("k_d")) > 0)
    return merged.crossJoin(F.broadcast(whole)).select((F.abs(F.col("m") / F.col("n") - 1) < 0.05).alias("merged"), (f("hll_estimate")(f("empty_approx_set", "presto")()) == 0).alias("empty"), kll.alias("kll"))


@R.add("agg_bloom_filter", "SELECT count(*) FILTER (WHERE o_orderkey % 2 = 0) AS members, 0::BIGINT AS lost, true AS few_others FROM orders")
def bloom_filter(t):
    """A filter of the even keys holds all of them; how many others it lets through is its error rate."""
    bits = agg.bloom_filter(t.orders.filter("o_orderkey % 2 = 0"), "o_orderkey")
    inside = f("might_contain")(bits, F.col("o_orderkey"))
    even = F.col("o_orderkey") % 2 == 0
    return t.orders.select("o_orderkey", inside.alias("hit")).agg(F.count_if(even & F.col("hit")).alias("members"), F.count_if(even & ~F.col("hit")).alias("lost"), (F.count_if(~even & F.col("hit")) <= 0.06 * F.count_if(~even)).alias("few_others"))


@R.add("agg_weighted_sample", "SELECT 200::BIGINT AS n, true AS near FROM (SELECT 1)")
def weighted_sample(t):
    """200 orders by weight: the adjusted weights add up to about the whole table's."""
    total = t.orders.agg(F.sum("o_totalprice").alias("whole"))
    chosen = agg.weighted_sample(t.orders, "o_totalprice", 200, "w", seed=3).agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    return chosen.crossJoin(F.broadcast(total)).select("n", (F.abs(F.col("w") / F.col("whole") - 1) < 0.25).alias("near"))


R.sql("agg_array_addition", "SELECT pos, sum(x) AS s FROM (SELECT posexplode(array(n_regionkey, n_nationkey)) AS (pos, x) FROM {nation}) GROUP BY pos", "SELECT pos, sum(x)::BIGINT AS s FROM (SELECT unnest([0, 1]) AS pos, unnest([n_regionkey, n_nationkey]) AS x FROM nation) GROUP BY pos")
R.sql("agg_array_count", "SELECT pos, count(x) AS c FROM (SELECT posexplode(array(nullif(n_regionkey, 1), n_nationkey)) AS (pos, x) FROM {nation}) GROUP BY pos", "SELECT pos, count(x) AS c FROM (SELECT unnest([0, 1]) AS pos, unnest([nullif(n_regionkey, 1), n_nationkey]) AS x FROM nation) GROUP BY pos")
grouped("agg_decimal", "(SELECT o_orderstatus, CAST(o_totalprice AS DECIMAL(12, 2)) AS p FROM {orders})", "o_orderstatus", {"total": ("CAST(sum(p) AS DECIMAL(20, 2))", "sum(p)::DECIMAL(20, 2)"), "most": "max(p)"})
STEPS = ("sum", "min", "max", "count", "avg", "var_pop", "var_samp", "stddev_pop", "stddev_samp")


@R.add("agg_companion_steps", "SELECT l_returnflag, " + ", ".join(f"round({k}(l_quantity), 6)::DOUBLE AS {k}" for k in STEPS) + ", true AS distinct_near FROM lineitem GROUP BY 1")
def companions(t):
    """Partial states by two keys, merged by one, and results taken out of them."""
    states = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(*(companion(f"{k}_partial")(F.col("l_quantity")).alias(k) for k in STEPS), companion("approx_distinct_partial")(F.col("l_partkey")).alias("d"))
    merged = states.groupBy("l_returnflag").agg(*(companion(f"{k}_merge")(F.col(k)).alias(k) for k in STEPS), companion("approx_distinct_merge")(F.col("d")).alias("d"))
    near = t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    results = merged.select("l_returnflag", *(F.round(companion(f"{k}_extract")(F.col(k)), 6).cast("double").alias(k) for k in STEPS), companion("approx_distinct_extract")(F.col("d")).alias("d"))
    return results.join(near, "l_returnflag").select("l_returnflag", *STEPS, (F.abs(F.col("d") / F.col("exact") - 1) < 0.05).alias("distinct_near"))


# sketches: estimates within their error, so the oracle checks that and not the value. The exact count of distinct keys is
# an aggregation of its own: beside the sketches, it would give each pair of flag and key a buffer of every one of them.
_SKETCHES = {
    "approx_distinct": "approx_count_distinct(l_partkey, 0.02)", "hll": "hll_sketch_estimate(hll_sketch_agg(l_partkey, 14))", "theta": "theta_sketch_estimate(theta_sketch_agg(l_partkey))",
    "kll": "kll_sketch_get_quantile_double(kll_sketch_agg_double(l_quantity), 0.5D)", "near_median": "percentile_approx(l_quantity, 0.5)", "top_k": "approx_top_k(l_linenumber, 3)", "quantiles": "percentile_approx(l_quantity, array(0.25, 0.5, 0.75))",
    "median": "percentile(l_quantity, 0.5)",
}
_WITHIN = {
    "approx_distinct_ok": "abs(approx_distinct - n) <= 0.1 * n", "hll_ok": "abs(hll - n) <= 0.05 * n", "theta_ok": "abs(theta - n) <= 0.1 * n",
    "kll_ok": "abs(kll - median) <= 3", "approx_percentile_ok": "abs(near_median - median) <= 2", "top_k_ok": "size(top_k) = 3", "quantiles_ok": "size(quantiles) = 3",
}
R.sql(
    "agg_sketches",
    "SELECT s.l_returnflag, " + ", ".join(f"{v} AS {k}" for k, v in _WITHIN.items())
    + " FROM (SELECT l_returnflag, " + ", ".join(f"{v} AS {k}" for k, v in _SKETCHES.items()) + " FROM {lineitem} GROUP BY l_returnflag) s"
    + " JOIN (SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM {lineitem} GROUP BY l_returnflag) d ON s.l_returnflag <=> d.l_returnflag",
    "SELECT l_returnflag, " + ", ".join(f"true AS {k}" for k in _WITHIN) + " FROM {lineitem} GROUP BY l_returnflag",
)
R.sql("agg_hll_union", "SELECT abs(hll_sketch_estimate(hll_union_agg(s)) - max(n)) <= 0.05 * max(n) AS ok FROM (SELECT hll_sketch_agg(l_partkey, 14) AS s FROM {lineitem} GROUP BY l_returnflag), (SELECT count(DISTINCT l_partkey) AS n FROM {lineitem})", "SELECT true AS ok")
R.sql("agg_checksum_rows_only", "SELECT l_returnflag, sum(CAST(xxhash64(l_orderkey, l_linenumber) AS DECIMAL(38, 0))) AS checksum FROM {lineitem} GROUP BY l_returnflag", oracle=False)
