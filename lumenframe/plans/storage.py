"""Sources and sinks, merge engines, streaming and the function surface in Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions.dialects import function
from lumenframe.operators import relational
from lumenframe.sources import files, merge
from lumenframe.streaming import events

from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


def _folder(spark) -> str:
    """A new folder that all executors see."""
    return events.shared_folder(spark, "io")


def _round_trip(form: str, **options):
    def run(t):
        path = _folder(t.spark)
        table = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        files.write(table, path, form, **options)
        read = {k: v for k, v in options.items() if k not in ("partition_by", "sort_by")}
        return files.read(t.spark, path, form, **read, schema="o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")

    return run


_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"
for _form in ("parquet", "orc", "csv"):
    R.add(f"io_{_form}_round_trip", _SQL)(_round_trip(_form))
for _form, _more in (("json", {}), ("csv", {"sep": "|", "nullValue": "-", "header": True})):
    R.add("io_json_round_trip" if _form == "json" else "io_delimited_with_header", _SQL)(_round_trip(_form, **_more))
R.add("io_partitioned_sorted_write", _SQL)(_round_trip("parquet", partition_by=["o_orderstatus"], sort_by=["o_orderkey"]))


@R.add("io_schema_evolution", "SELECT r_regionkey, NULL::INTEGER AS added FROM region")
def schema_evolution(t):
    path = _folder(t.spark)
    files.write(t.region, path)
    return files.read(t.spark, path, schema="r_regionkey int, added int")


@R.add("io_columns_by_position", "SELECT r_regionkey AS k, r_name AS label FROM region")
def by_position(t):
    path = _folder(t.spark)
    files.write(t.region, path)
    return files.read(t.spark, path, schema="k int, label string", by_position=True)


@R.add("io_arrow_table", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS t(x, s)")
def arrow_table(t):
    import pyarrow as pa

    return files.from_arrow(t.spark, pa.table({"x": pa.array([1, 2], pa.int32()), "s": ["a", None]}))


@R.add("io_text_lines", "SELECT n_name AS value FROM nation")
def text_lines(t):
    path = _folder(t.spark)
    files.write(t.nation.select("n_name"), path, "text")
    return files.read(t.spark, path, "text")


@R.add("io_file_paths", "SELECT count(*) AS n, true AS named FROM orders")
def file_paths(t):
    """Rows with the path of their file."""
    path = _folder(t.spark)
    files.write(t.orders, path)
    rows = files.read(t.spark, path, metadata=True)
    return rows.agg(F.count("*").alias("n"), F.bool_and(F.col("`$path`").endswith(".parquet")).alias("named"))


@R.add("io_append_overwrite", "SELECT r_regionkey, 2::BIGINT AS n FROM region")
def append_overwrite(t):
    path = _folder(t.spark)
    files.write(t.nation.select(F.col("n_nationkey").alias("r_regionkey")), path)
    files.write(t.region.select("r_regionkey"), path, mode="overwrite")
    files.write(t.region.select("r_regionkey"), path, mode="append")
    return files.read(t.spark, path).groupBy("r_regionkey").agg(F.count("*").alias("n"))


@R.add("io_bucketed_join", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def bucketed_join(t):
    """Two tables bucketed alike: their join shuffles neither."""
    import uuid

    names = [f"{n}_{uuid.uuid4().hex}" for n in ("orders", "lines")]
    for name, table, key in zip(names, (t.orders.select("o_orderkey"), t.lineitem.select("l_orderkey")), ("o_orderkey", "l_orderkey"), strict=True):
        files.write_bucketed(table, name, 8, [key], [key], path=_folder(t.spark))
    orders, lines = map(t.spark.table, names)
    return orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@R.add("io_write_statistics", """
SELECT 'o_orderkey' AS name, count(*) AS rows, 0::BIGINT AS nulls, min(o_orderkey)::VARCHAR AS least, max(o_orderkey)::VARCHAR AS greatest FROM orders
UNION ALL SELECT 'status', count(*), count(*) FILTER (WHERE o_orderstatus = 'F'), min(nullif(o_orderstatus, 'F')), max(nullif(o_orderstatus, 'F')) FROM orders""")
def write_statistics(t):
    """What a table writer reports of a write: rows, and of each column the nulls and bounds, merged from all tasks."""
    path = _folder(t.spark)
    table = t.orders.select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("status"))
    written = files.write_with_statistics(table, path)
    return written.columns.select("name", "rows", "nulls", "least", "greatest")


@R.add("io_write_fragments", "SELECT count(*) AS n, true AS whole FROM orders")
def write_fragments(t):
    """The files that a write made, with their rows and sizes."""
    path = _folder(t.spark)
    written = files.write_with_statistics(t.orders, path)
    return written.fragments.agg(F.sum("rows").cast("long").alias("n"), F.bool_and(F.col("bytes") > 0).alias("whole"))


@R.add("trace_scan", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def trace_scan(t):
    """An operator's input recorded, and the operator run on the replay."""
    return relational.trace(t.orders.select("o_custkey"), _folder(t.spark)).groupBy("o_custkey").agg(F.count("*").alias("n"))


@R.add("io_random_rows")
def random_rows(t):
    return files.random_rows(t.spark, 100)


@R.add("io_random_nested", "SELECT 500::BIGINT AS n, true AS some_null, true AS some_known, true AS again")
def random_nested(t):
    """Rows of a nested schema: nulls in them, and the same rows when made again."""
    kind = "b boolean, t tinyint, i int, l bigint, d double, m decimal(20, 4), s string, x binary, day date, ts timestamp, a array<struct<p: int, q: array<string>>>, k map<string, array<double>>"
    make = lambda: files.random_rows(t.spark, 500, seed=4, schema=kind)
    text = F.to_json(F.struct("*"))
    one, two = make().select(text.alias("r")).agg(F.sum(F.xxhash64("r").cast("decimal(38,0)")).alias("x")), make().select(text.alias("r")).agg(F.sum(F.xxhash64("r").cast("decimal(38,0)")).alias("y"))
    seen = make().agg(F.count("*").alias("n"), (F.count_if(F.col("i").isNull()) > 0).alias("some_null"), (F.count_if(F.size("k") > 0) > 0).alias("some_known"))
    return seen.crossJoin(F.broadcast(one.crossJoin(F.broadcast(two)))).select("n", "some_null", "some_known", (F.col("x") == F.col("y")).alias("again"))


def _versions(t):
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("seq"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("part"), F.col("l_suppkey").alias("supp"))


_V = "(SELECT l_orderkey, l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS part, l_suppkey AS supp FROM lineitem)"
_LAST = "arg_max({0}, (seq, {1}, supp))"


@R.add("merge_deduplicate", f"SELECT count(*) AS n, sum(seq)::BIGINT AS seqs FROM (SELECT l_orderkey, max(seq) AS seq FROM {_V} GROUP BY 1)")
def merge_deduplicate(t):
    return merge.deduplicate(_versions(t), ["l_orderkey"], "seq").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@R.add("merge_first_row", f"SELECT count(*) AS n, sum(seq)::BIGINT AS seqs FROM (SELECT l_orderkey, min(seq) AS seq FROM {_V} GROUP BY 1)")
def merge_first_row(t):
    return merge.first_row(_versions(t), ["l_orderkey"], "seq").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@R.add("merge_partial_update", "SELECT k, max(v) FILTER (WHERE s = 3) AS a, max(w) FILTER (WHERE s = 2) AS b FROM (SELECT n_nationkey AS k, unnest([1, 2, 3]) AS s, n_nationkey * 10 + s AS v, n_nationkey * 100 + s AS w FROM nation) GROUP BY k")
def merge_partial_update(t):
    rows = t.nation.select(F.col("n_nationkey").alias("k"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("s"))
    rows = rows.select("k", "s", (F.col("k") * 10 + F.col("s")).alias("a"), F.when(F.col("s") < 3, F.col("k") * 100 + F.col("s")).alias("b"))
    return merge.partial_update(rows, ["k"], "s").select("k", "a", "b")


@R.add("merge_aggregation", f"SELECT l_orderkey, max(seq) AS seq, sum(part)::BIGINT AS part, min(supp) AS supp FROM {_V} GROUP BY 1")
def merge_aggregation(t):
    return merge.aggregation(_versions(t), ["l_orderkey"], "seq", {"part": "sum", "supp": "min"})


@R.add("merge_field_aggregates", f"""
SELECT l_orderkey, max(seq) AS seq, count(part) AS a, max(supp) AS b, bool_and(supp > 5) AS c, bool_or(supp > 5) AS d, round(product(seq), 4) AS e, arg_min(supp, seq) AS f, arg_max(supp, seq) AS g,
       arg_min(part, seq) AS h, arg_max(part, seq) AS i, string_agg(supp::VARCHAR, ',' ORDER BY seq) AS j, array_to_string(list(part ORDER BY seq) FILTER (WHERE part IS NOT NULL), ',') AS k
FROM (SELECT l_orderkey, l_linenumber AS seq, min(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def merge_fields(t):
    """Every field aggregate, over one version for each key and sequence number."""
    rows = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("seq")).agg(F.min(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey"))).alias("part"), F.min("l_suppkey").alias("supp"))
    part, supp = F.col("part"), F.col("supp")
    rows = rows.select("l_orderkey", "seq", part.alias("a"), supp.alias("b"), (supp > 5).alias("c"), (supp > 5).alias("d"), F.col("seq").alias("e"), supp.alias("f"), supp.alias("g"), part.alias("h"), part.alias("i"), supp.cast("string").alias("j"), part.alias("k"))
    how = {"a": "count", "b": "max", "c": "bool_and", "d": "bool_or", "e": "product", "f": "first_value", "g": "last_value", "h": "first_non_null_value", "i": "last_non_null_value", "j": "listagg", "k": "collect"}
    out = merge.aggregation(rows, ["l_orderkey"], "seq", how)
    return out.withColumn("e", F.round("e", 4)).withColumn("k", F.when(F.size("k") > 0, F.concat_ws(",", F.col("k").cast("array<string>"))))


@R.add("merge_deletion_vectors", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0")
def merge_deletions(t):
    path = _folder(t.spark)
    files.write(t.orders.select("o_orderkey"), path)
    table = files.read(t.spark, path)
    gone = merge.with_positions(table).filter("o_orderkey % 7 = 0").select(F.col("_file").alias("file"), F.col("_position").alias("position"))
    return merge.apply_deletions(table, gone)


def _stream(t):
    return events.read_events(t.spark, f"{t.sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@R.add("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(t):
    return events.run_once(events.windowed_counts(_stream(t), "ts", "1 hour", "1 day", "event_type")).select("start", "event_type", "n")


@R.add("stream_sliding_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - unnest([INTERVAL 0 HOUR, INTERVAL 1 HOUR]) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_sliding(t):
    return events.run_once(events.sliding_counts(_stream(t), "ts", "2 hours", "1 hour", "1 day", "event_type"))


@R.add("stream_sessions", """
SELECT min(ts) AS start, user_id, count(*) AS n FROM (
    SELECT user_id, ts, sum(CASE WHEN ts - before <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
    FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, s""")
def stream_sessions(t):
    return events.run_once(events.sessions(_stream(t), "ts", "30 minutes", "1 day", "user_id"))


@R.add("stream_stateful_totals", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY 1")
def stream_totals(t):
    """Every batch reports the keys that it touched: the last report of a key is the one with the greatest count."""
    rows = events.run_once(events.running_totals(_stream(t), "user_id", "value"), "update")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("n", "total", "most"), "n").alias("r"))
    return last.select("user_id", "r.n", F.round("r.total", 4).alias("total"), "r.most")


@R.add("stream_deduplicated", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedup(t):
    return events.run_once(events.deduplicated(_stream(t), "ts", None, "event_id").select("event_id"), "append").agg(F.count("*").alias("n"))


@R.add("fn_presto_composed", "SELECT n_nationkey AS id, string_split(n_name, '_')[2] AS part, round(0.5 + atan((n_nationkey - 3) / 2) / pi(), 9) AS cauchy, [n_nationkey, 1, 1][1:2] AS trimmed, strftime(TIMESTAMP '2024-02-29 01:02:03', '%Y/%m/%d') AS day, (n_name || 'x')[1:3] AS s3 FROM nation")
def presto_composed(t):
    p = lambda name, *a: function(name, "presto")(*a)
    return t.nation.select(
        F.col("n_nationkey").alias("id"), F.get(p("split", F.col("n_name"), "_"), F.lit(1)).alias("part"), F.round(p("cauchy_cdf", F.lit(3), F.lit(2), F.col("n_nationkey")), 9).alias("cauchy"),
        p("trim_array", F.array("n_nationkey", F.lit(1), F.lit(1)), 1).alias("trimmed"), p("date_format", F.to_timestamp(F.lit("2024-02-29 01:02:03")), "%Y/%m/%d").alias("day"), F.substring(F.concat("n_name", F.lit("x")), 1, 3).alias("s3"),
    )


@R.add("fn_presto_python_rows_only")
def presto_python(t):
    p = lambda name, *a: function(name, "presto")(*a)
    x = F.col("n_nationkey").cast("double") / 10
    return t.nation.select("n_nationkey", p("normal_cdf", 0.0, 1.0, x).alias("normal"), p("beta_cdf", 2.0, 3.0, x / 3).alias("beta"), p("gamma_cdf", 2.0, 1.0, x).alias("gamma"), p("hmac_sha256", F.col("n_name"), F.lit("key")).alias("hmac"), p("xxhash64", F.col("n_name")).alias("xx"))
