"""Plan operators, joins, aggregation mechanics and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import relational as op

from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle

# scans, filters, projections
R.sql("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2 FROM {lineitem} WHERE l_quantity < 5 AND l_discount > 0.01 AND l_extendedprice * l_discount < 200")
R.sql("values_source", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) AS t(a, b)")

# joins
R.sql("join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey AND o_totalprice > c_acctbal")
R.sql("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000")
R.sql("join_right", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM {orders} WHERE o_totalprice > 200000) RIGHT JOIN {customer} ON o_custkey = c_custkey")
R.sql("join_full", "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM {nation} a FULL JOIN (SELECT * FROM {supplier} WHERE s_acctbal > 0) b ON a.n_nationkey = b.s_nationkey AND a.n_regionkey > 1")
R.sql("join_left_semi", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 250000", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE c_custkey = o_custkey AND o_totalprice > 250000)")
R.sql("join_left_anti", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE c_custkey = o_custkey)")
R.sql("join_theta", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM {nation} a JOIN {region} b ON a.n_regionkey < b.r_regionkey")
R.sql("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM {region} a CROSS JOIN {region} b")
R.sql("join_right_semi", "SELECT o_orderkey FROM {orders} LEFT SEMI JOIN (SELECT * FROM {customer} WHERE c_acctbal > 0) ON o_custkey = c_custkey", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 0)")


@R.add("join_right_semi_project", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS matched FROM orders")
def join_right_semi_project(t):
    return op.mark_join(t.orders.select("o_orderkey", "o_custkey"), t.customer.filter("c_acctbal > 0"), "o_custkey", "c_custkey", "matched").drop("o_custkey")


@R.add("join_null_aware_anti", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_acctbal >= 0 OR c_acctbal < 0 THEN c_custkey END FROM customer WHERE c_acctbal > 0)")
def join_null_aware_anti(t):
    right = t.customer.filter("c_acctbal > 0").select(F.when((F.col("c_acctbal") >= 0) | (F.col("c_acctbal") < 0), F.col("c_custkey")).alias("k"))
    return op.null_aware_anti_join(t.orders, right, "o_custkey", "k").select("o_orderkey")


@R.add("join_null_aware_anti_null", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_custkey > 2 THEN c_custkey END FROM customer)")
def join_null_aware_anti_null(t):
    right = t.customer.select(F.when(F.col("c_custkey") > 2, F.col("c_custkey")).alias("k"))
    return op.null_aware_anti_join(t.orders, right, "o_custkey", "k").select("o_orderkey")


@R.add("join_mark", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS matched FROM customer")
def join_mark(t):
    return op.mark_join(t.customer.select("c_custkey"), t.orders.filter("o_totalprice > 200000"), "c_custkey", "o_custkey", "matched")


@R.add("join_mark_null_aware", "SELECT n_nationkey, n_nationkey IN (SELECT CASE WHEN s_suppkey > 2 THEN s_nationkey END FROM supplier) AS matched FROM nation")
def join_mark_null_aware(t):
    right = t.supplier.select(F.when(F.col("s_suppkey") > 2, F.col("s_nationkey")).alias("k"))
    return op.mark_join(t.nation.select("n_nationkey"), right, "n_nationkey", "k", "matched", null_aware=True)


@R.add("join_merge_hint", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_merge(t):
    return t.orders.join(t.lineitem.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@R.add("join_index_lookup", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def join_lookup(t):
    return op.lookup_join(t.supplier, t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@R.add("join_asof", "SELECT e.event_id, max(b.ts) AS before_ts FROM (SELECT * FROM events WHERE event_type = 'click') e LEFT JOIN (SELECT * FROM events WHERE event_type <> 'click') b ON e.user_id = b.user_id AND b.ts <= e.ts GROUP BY e.event_id")
def join_asof(t):
    left, right = t.events.filter("event_type = 'click'").select("user_id", "ts", "event_id"), t.events.filter("event_type <> 'click'").select("user_id", "ts", F.col("ts").alias("before_ts"))
    return op.asof_join(left, right, ["user_id"], "ts", ["before_ts"]).select("event_id", "before_ts")


@R.add("join_asof_one_key", "SELECT event_id, last_value(CASE WHEN event_type <> 'click' THEN ts END IGNORE NULLS) OVER (ORDER BY ts, event_type = 'click' ROWS UNBOUNDED PRECEDING) AS before_ts FROM events QUALIFY event_type = 'click'")
def join_asof_one_key(t):
    """Without a key: stretches of a day are tasks of their own."""
    left, right = t.events.filter("event_type = 'click'").select("ts", "event_id"), t.events.filter("event_type <> 'click'").select("ts", F.col("ts").alias("before_ts"))
    return op.asof_join(left, right, [], "ts", ["before_ts"], span=86_400.0).select("event_id", "before_ts")


@R.add("join_range", "SELECT p_partkey, count(*) AS n FROM part JOIN lineitem ON l_quantity >= p_size - 1 AND l_quantity < p_size + 1 GROUP BY p_partkey")
def join_range(t):
    """Equal points meet the spans once, with their number."""
    points = t.lineitem.groupBy(F.col("l_quantity").alias("x")).agg(F.count("*").alias("n"))
    spans = t.part.select("p_partkey", (F.col("p_size") - 1).cast("double").alias("lo"), (F.col("p_size") + 1).cast("double").alias("hi"))
    return op.range_join(points, spans, "x", "lo", "hi", width=2.0).groupBy("p_partkey").agg(F.sum("n").alias("n"))


# aggregation mechanics
R.sql("agg_hash", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first, max(o_orderdate) AS last FROM {orders} GROUP BY o_orderpriority")
R.sql("agg_global", "SELECT count(*) AS n, sum(CAST(l_linenumber AS BIGINT)) AS s FROM {lineitem}", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM {lineitem}")
R.sql("agg_filter_mask", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_tax) FILTER (WHERE l_discount > 0.05), 4) AS tax FROM {lineitem} GROUP BY l_returnflag")
R.sql("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM {orders} GROUP BY o_orderstatus")
R.sql("agg_ordered", "SELECT n_regionkey, concat_ws(',', transform(array_sort(collect_list(struct(n_name))), x -> x.n_name)) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")


@R.add("agg_streaming_sorted", "SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1")
def agg_streaming_sorted(t):
    """Input sorted by the keys: groups are streamed, with the memory of one."""
    rows = op.with_sorted_aggregation(t.spark).read.parquet(f"{t.sf_dir}/lineitem.parquet")
    rows = rows.repartition("l_orderkey").sortWithinPartitions("l_orderkey")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


R.sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
R.sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
R.sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
R.sql("agg_distinct_rows", "SELECT DISTINCT p_brand, p_size FROM {part}")


@R.add("group_id", "SELECT l_returnflag, l_linestatus, gid, count(*) AS n FROM (SELECT l_returnflag, NULL AS l_linestatus, 0 AS gid FROM lineitem UNION ALL SELECT NULL, l_linestatus, 1 FROM lineitem UNION ALL SELECT NULL, NULL, 2 FROM lineitem UNION ALL SELECT NULL, NULL, 3 FROM lineitem) GROUP BY ALL")
def group_id(t):
    rows = op.group_id(t.lineitem, ["l_returnflag", "l_linestatus"], [["l_returnflag"], ["l_linestatus"], [], []], [], "gid")
    return rows.groupBy("l_returnflag", "l_linestatus", "gid").agg(F.count("*").alias("n"))


@R.add("expand", "SELECT n_nationkey AS k, 'nation' AS kind FROM nation UNION ALL SELECT n_regionkey, 'region' FROM nation")
def expand(t):
    return op.expand(t.nation, [[F.col("n_nationkey"), F.lit("nation")], [F.col("n_regionkey"), F.lit("region")]], ["k", "kind"])


@R.add("mark_distinct", "SELECT count(*) AS n, count(*) FILTER (WHERE m) AS firsts FROM (SELECT row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1 AS m FROM orders)")
def mark_distinct(t):
    return op.mark_distinct(t.orders, ["o_custkey", "o_orderstatus"], "m").agg(F.count("*").alias("n"), F.count_if("m").alias("firsts"))


# ordering and limits
R.sql("order_by_nulls", "SELECT k FROM (SELECT CASE WHEN n_nationkey > 20 THEN NULL ELSE n_nationkey END AS k FROM {nation}) ORDER BY k DESC NULLS FIRST")
R.sql("top_n", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
R.sql("limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 10 OFFSET 20")


@R.add("row_number_limit", "SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey) AS r FROM lineitem) WHERE r <= 2 GROUP BY l_orderkey")
def row_number_limit(t):
    return op.row_number(t.lineitem.select("l_orderkey"), ["l_orderkey"], "r", 2).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@R.add("top_n_row_number", "SELECT o_custkey, o_orderkey, r::INTEGER AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_n_row_number(t):
    return op.top_n_row_number(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, "r").select("o_custkey", "o_orderkey", "r")


# unnest and generators
R.sql("unnest_array", "SELECT vec_id, explode(embedding) AS x FROM {embeddings}", "SELECT vec_id, unnest(embedding) AS x FROM {embeddings}")
R.sql("unnest_ordinality", "SELECT vec_id, pos + 1 AS pos, x FROM {embeddings} LATERAL VIEW posexplode(embedding) AS pos, x", "SELECT vec_id, i::INTEGER AS pos, embedding[i] AS x FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM {embeddings})")
R.sql("unnest_map", "SELECT n_nationkey, explode(map('name', n_name, 'region', CAST(n_regionkey AS STRING))) AS (k, v) FROM {nation}", "SELECT n_nationkey, unnest(['name', 'region']) AS k, unnest([n_name, n_regionkey::VARCHAR]) AS v FROM {nation}")
R.sql("explode_outer", "SELECT n_nationkey, explode_outer(filter(sequence(1, n_regionkey + 1), x -> x % 2 = 0 AND n_regionkey > 0)) AS x FROM {nation}", "SELECT n_nationkey, x::INTEGER AS x FROM (SELECT n_nationkey, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS x FROM (SELECT n_nationkey, list_filter(range(1, n_regionkey + 2), lambda x: x % 2 = 0 AND n_regionkey > 0) AS l FROM {nation}))")
R.sql("posexplode_outer", "SELECT n_nationkey, p, x FROM {nation} LATERAL VIEW OUTER posexplode(filter(sequence(1, n_regionkey + 1), x -> n_regionkey > 0)) AS p, x", "SELECT n_nationkey, (CASE WHEN n_regionkey > 0 THEN i - 1 END)::INTEGER AS p, (CASE WHEN n_regionkey > 0 THEN i END)::INTEGER AS x FROM (SELECT n_nationkey, n_regionkey, unnest(generate_series(1, n_regionkey + 1)) AS i FROM {nation})")
R.sql("json_tuple", "SELECT event_id, k FROM {events} LATERAL VIEW json_tuple(props, 'k') AS k", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM {events}")


@R.add("unnest_zipped", "SELECT n_nationkey, unnest([1, 2, 3]) AS a, unnest(['x', 'y', NULL]) AS b FROM nation")
def unnest_zipped(t):
    rows = t.nation.select("n_nationkey", F.expr("array(1, 2, 3)").alias("a"), F.expr("array('x', 'y')").alias("b"))
    return op.unnest(rows, ["n_nationkey"], {"a": "a", "b": "b"})


@R.add("enforce_single_row", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1.9 * (SELECT avg(o_totalprice) FROM orders)")
def enforce_single_row(t):
    one = op.enforce_single_row(t.orders.agg(F.avg("o_totalprice").alias("mean")))
    return t.orders.join(F.broadcast(one), F.col("o_totalprice") > 1.9 * F.col("mean")).select("o_orderkey")


@R.add("assign_unique_id", "SELECT count(*) AS n, count(*) AS ids FROM lineitem")
def assign_unique_id(t):
    return op.assign_unique_id(t.lineitem, "id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@R.add("partition_hash", "SELECT count(*) AS n FROM orders")
def partition_hash(t):
    return t.orders.repartition(4, "o_custkey").groupBy("o_custkey").count().agg(F.sum("count").alias("n"))


@R.add("partition_range_merge", "SELECT o_orderkey FROM orders ORDER BY o_orderkey")
def partition_range(t):
    return t.orders.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select("o_orderkey")


@R.add("partition_single", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def partition_single(t):
    """One partial result for each task and status meets in one partition."""
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).coalesce(1)


@R.add("partition_broadcast", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def partition_broadcast(t):
    return op.lookup_join(t.customer, t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@R.add("partition_round_robin", "SELECT count(*) AS n FROM lineitem")
def partition_rr(t):
    return t.lineitem.repartition(5).agg(F.count("*").alias("n"))


@R.add("local_shuffle", "SELECT r_regionkey FROM region")
def local_shuffle(t):
    return t.region.orderBy(F.rand(7)).select("r_regionkey")


@R.add("python_operator", "SELECT n_nationkey, length(n_name)::BIGINT AS n FROM nation")
def python_operator(t):
    return op.python_operator(t.nation, lambda pdf: pdf.assign(n=pdf.n_name.str.len())[["n_nationkey", "n"]], "n_nationkey int, n long")


# set operations
R.sql("union_all", "SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT n_regionkey FROM {nation}")
R.sql("union_distinct", "SELECT n_nationkey AS k FROM {nation} UNION SELECT n_regionkey FROM {nation}")
R.sql("intersect_distinct", "SELECT n_nationkey AS k FROM {nation} INTERSECT SELECT n_regionkey FROM {nation}")
R.sql("intersect_all", "SELECT n_regionkey AS k FROM {nation} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
R.sql("except_distinct", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT n_regionkey FROM {nation}")
R.sql("except_all", "SELECT n_regionkey AS k FROM {nation} EXCEPT ALL SELECT r_regionkey FROM {region}")

# special forms
R.columns("special_forms", "{orders}", {
    "both": "o_totalprice > 100000 AND o_orderstatus = 'F'", "either": "o_totalprice > 100000 OR o_orderstatus = 'F'",
    "casted": ("CAST(o_totalprice AS BIGINT)", "trunc(o_totalprice)::BIGINT"), "tried": ("try_cast(o_orderpriority AS INT)", "try_cast(o_orderpriority AS INTEGER)"),
    "coalesced": "coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END, 'none')",
    "switched": "CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END",
    "listed": "o_orderstatus IN ('F', 'O')", "ranged": "o_totalprice BETWEEN 1000 AND 100000", "nulled": "nullif(o_orderstatus, 'F')",
    "at_least_two": ("(CASE WHEN nullif(o_orderstatus, 'F') IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN o_custkey IS NOT NULL THEN 1 ELSE 0 END) >= 2", "nullif(o_orderstatus, 'F') IS NOT NULL AND o_custkey IS NOT NULL"),
    "made_decimal": ("CAST(CAST(o_custkey AS DECIMAL(18, 0)) / 100 AS DECIMAL(18, 2))", "(o_custkey / 100.0)::DECIMAL(18, 2)"),
}, "o_orderkey")
