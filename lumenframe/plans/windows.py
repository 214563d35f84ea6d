"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql.functions import col

from lumenframe.operators import relational as op

from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle

W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
R.columns("window_ranks", "{orders}", {
    "rn": f"CAST(row_number() {W} AS INT)", "rk": "CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INT)",
    "dr": "CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INT)", "pr": "round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6)",
    "cd": "round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6)", "nt": f"CAST(ntile(3) {W} AS INT)",
}, "o_orderkey")
ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
R.columns("window_values", "{orders}", {
    "nth": f"nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey {ALL})",
    "fv": f"first_value(o_totalprice) {W}", "lv": f"last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey {ALL})",
    "lg": f"lag(o_orderkey, 2, CAST(-1 AS BIGINT)) {W}", "ld": f"lead(o_orderkey) {W}",
}, "o_orderkey")
N = "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderkey END"
R.columns("window_ignore_nulls", "{orders}", {
    "fv": (f"first_value({N}) IGNORE NULLS {W}", f"first_value({N} IGNORE NULLS) {W}"), "lv": (f"last_value({N}) IGNORE NULLS {W}", f"last_value({N} IGNORE NULLS) {W}"),
    "lg": (f"lag({N}) IGNORE NULLS {W}", f"lag({N} IGNORE NULLS) {W}"), "ld": (f"lead({N}) IGNORE NULLS {W}", f"lead({N} IGNORE NULLS) {W}"),
}, "o_orderkey")
F = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
R.columns("window_frames", "{orders}", {
    "rows_both": f"round(sum(o_totalprice) OVER ({F} ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), 2)",
    "rows_after": f"count(*) OVER ({F} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)",
    "rows_before": f"max(o_totalprice) OVER ({F} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "range_both": "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING)",
    "running": f"round(avg(o_totalprice) {W}, 4)", "whole": "min(o_totalprice) OVER (PARTITION BY o_custkey)",
}, "o_orderkey")
@R.add("window_column_bounds", "SELECT event_id, (sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN event_id % 4 PRECEDING AND CURRENT ROW))::BIGINT AS s FROM events")
def window_column_bounds(t):
    """A frame whose bounds are columns, which Spark's frames cannot have."""
    return op.sum_since(t.events.select("user_id", "event_id"), ["user_id"], "event_id", "event_id", col("event_id") % 4, "s").select("event_id", "s")
