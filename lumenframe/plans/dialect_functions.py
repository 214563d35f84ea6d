"""The dialects' own functions, called by name as users call them, on columns of the tables.

``scalars`` checks families of functions in SQL; here every builder that the
dialects compose, and every name that falls through to Spark's registry, is a
column made by ``function(name, dialect)``, beside a form that the oracle works
out by other means (sums for distributions, hash algebra for HMACs, powers of two
for bit patterns).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions.dialects import function

from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


def spark(name, *a):
    return function(name, "spark")(*a)


def presto(name, *a):
    return function(name, "presto")(*a)


def flink(name, *a):
    return function(name, "flink")(*a)


def calls(name: str, table: str, key: str, columns: dict, given: dict | None = None, where: str = "") -> None:
    """A query of columns: for each a function that makes it and the oracle's form. given: columns to work on, as (Spark's form, the oracle's)."""
    given = given or {}
    pick = ", ".join(f"{g[1]} AS {c}" for c, g in given.items())
    source = f"(SELECT *{', ' + pick if pick else ''} FROM {table}{where})"
    sql = f"SELECT {key}, " + ", ".join(f"{duck} AS {c}" for c, (_, duck) in columns.items()) + f" FROM {source}"

    def run(t):
        rows = getattr(t, table)
        if where:
            rows = rows.filter(where.removeprefix(" WHERE "))
        rows = rows.selectExpr("*", *(f"{g[0]} AS {c}" for c, g in given.items()))
        return rows.select(key, *(make().alias(c) for c, (make, _) in columns.items()))

    R.add(name, sql)(run)


c = F.col
JOINED = lambda x: F.concat_ws(",", F.transform(x, lambda v: F.coalesce(v.cast("string"), F.lit("null"))))
LIST = lambda x: f"array_to_string(list_transform({x}, lambda v: coalesce(v::VARCHAR, 'null')), ',')"
SORTED_KEYS = lambda m: F.concat_ws(";", F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))))

# arithmetic, bits and number bases
calls("call_presto_arithmetic", "lineitem", "id", {
    "plus": (lambda: presto("plus", c("q"), c("d")), "q + d"), "truncated": (lambda: presto("truncate", c("p"), 1), "trunc(p * 10) / 10"), "clamped": (lambda: presto("clamp", c("q"), F.lit(10.0), F.lit(20.0)), "least(greatest(q, 10), 20)"),
    "least_null": (lambda: presto("least", c("n"), c("k")), "CASE WHEN k IS NULL THEN NULL ELSE least(n, k) END"), "greatest_null": (lambda: presto("greatest", c("n"), c("k")), "CASE WHEN k IS NULL THEN NULL ELSE greatest(n, k) END"),
    "to_bigint": (lambda: presto("to_bigint", -c("p")), "trunc(-p)::BIGINT"), "to_integer": (lambda: presto("to_integer", c("p")), "trunc(p)::INTEGER"),
    "from_base_16": (lambda: presto("from_base", F.lower(F.hex(c("l_orderkey"))), 16), "l_orderkey"), "from_base_negative": (lambda: presto("from_base", F.concat(F.lit("-"), c("n").cast("string")), 10), "-n::BIGINT"), "from_base_2": (lambda: presto("from_base", F.bin(c("l_orderkey")), 2), "l_orderkey"),
    "to_base_16": (lambda: presto("to_base", c("l_orderkey"), 16), "lower(to_hex(l_orderkey))"), "to_base_negative": (lambda: presto("to_base", -c("l_partkey") - 1, 2), "'-' || bin(l_partkey + 1)"),
    "and_": (lambda: presto("bitwise_and", c("n"), F.lit(5)), "n::BIGINT & 5"), "or_": (lambda: presto("bitwise_or", c("n"), F.lit(8)), "n::BIGINT | 8"), "xor_": (lambda: presto("bitwise_xor", c("n"), F.lit(3)), "xor(n::BIGINT, 3)"), "not_": (lambda: presto("bitwise_not", c("n")), "~n::BIGINT"),
    "left_shift": (lambda: presto("bitwise_left_shift", c("l_orderkey"), F.lit(3)), "l_orderkey << 3"), "shift_left": (lambda: presto("bitwise_shift_left", c("l_orderkey"), F.lit(2)), "l_orderkey << 2"), "right_shift": (lambda: presto("bitwise_right_shift", c("l_orderkey"), F.lit(1)), "l_orderkey >> 1"),
    "logical_right": (lambda: presto("bitwise_logical_shift_right", -c("l_orderkey") - 1, F.lit(60)), "15::BIGINT"), "arithmetic_right": (lambda: presto("bitwise_arithmetic_shift_right", -c("l_orderkey") - 1, F.lit(1)), "(-l_orderkey - 1) >> 1"), "right_arithmetic": (lambda: presto("bitwise_right_shift_arithmetic", c("l_orderkey"), F.lit(2)), "l_orderkey >> 2"),
    "infinity": (lambda: presto("infinity") > c("p"), "true"), "nan": (lambda: presto("is_nan", presto("nan") + c("p")), "true"), "finite": (lambda: presto("is_finite", c("p")), "isfinite(p)"), "infinite": (lambda: presto("is_infinite", c("p") * presto("infinity")), "p <> 0"),
    "minus": (lambda: presto("minus", c("q"), c("d")), "q - d"), "multiply": (lambda: presto("multiply", c("q"), c("d")), "q * d"), "divide": (lambda: presto("divide", c("p"), c("q")), "p / q"), "negate": (lambda: presto("negate", c("q")), "-q"), "eq": (lambda: presto("eq", c("q"), c("n")), "q = n"), "neq": (lambda: presto("neq", c("q"), c("n")), "q <> n"), "lt": (lambda: presto("lt", c("q"), c("n")), "q < n"), "gt": (lambda: presto("gt", c("q"), c("n")), "q > n"), "lte": (lambda: presto("lte", c("q"), c("n")), "q <= n"), "gte": (lambda: presto("gte", c("q"), c("n")), "q >= n"),
    "is_null": (lambda: presto("is_null", c("k")), "k IS NULL"), "is_not_null": (lambda: presto("is_not_null", c("k")), "k IS NOT NULL"), "starts": (lambda: presto("starts_with", c("l_returnflag"), F.lit("A")), "l_returnflag = 'A'"), "ends": (lambda: presto("ends_with", c("l_returnflag"), F.lit("R")), "l_returnflag = 'R'"),
    "distinct_from": (lambda: presto("distinct_from", c("k"), c("n")), "k IS DISTINCT FROM n"), "powered": (lambda: F.round(presto("power", c("q"), F.lit(1.5)), 6), "round(pow(q, 1.5), 6)"),
}, {"id": ("l_orderkey * 10 + l_linenumber",) * 2, "q": ("l_quantity",) * 2, "d": ("l_discount",) * 2, "p": ("l_extendedprice",) * 2, "n": ("l_linenumber",) * 2, "k": ("nullif(l_linenumber, 2)",) * 2})

# distributions: the oracle sums or integrates
BINOMIAL = "list_sum(list_transform(range(0, {k} + 1), lambda j: [1, 6, 15, 20, 15, 6, 1][j + 1] * pow({p}, j) * pow(1 - {p}, 6 - j)))"
NORMAL = "0.5 + list_sum(list_transform(range(0, 401), lambda j: (CASE WHEN j IN (0, 400) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(({x}) * j / 400.0, 2) / 2))) * ({x}) / 400.0 / 3 / sqrt(2 * pi())"
r7 = lambda f, *a: (lambda: F.round(presto(f, *(x() if callable(x) else x for x in a)), 7))
calls("call_presto_distributions", "nation", "n_nationkey", {
    "binomial_cdf": (r7("binomial_cdf", 6, lambda: c("p"), lambda: c("n_regionkey")), f"round({BINOMIAL.format(k='n_regionkey', p='p')}, 7)"),
    "poisson_cdf": (r7("poisson_cdf", lambda: c("x"), lambda: c("n_regionkey")), "round(exp(-x) * list_sum(list_transform(range(0, n_regionkey + 1), lambda j: pow(x, j) / factorial(j::INTEGER))), 7)"),
    "gamma_cdf": (r7("gamma_cdf", 3.0, 2.0, lambda: c("x")), "round(1 - exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2), 7)"), "chi_squared_cdf": (r7("chi_squared_cdf", 4.0, lambda: c("x")), "round(1 - exp(-x / 2) * (1 + x / 2), 7)"),
    "beta_cdf": (r7("beta_cdf", 2.0, 3.0, lambda: c("p")), "round(6 * p * p - 8 * p * p * p + 3 * pow(p, 4), 7)"), "inverse_beta_cdf": (r7("inverse_beta_cdf", 2.0, 1.0, lambda: c("p")), "round(sqrt(p), 7)"), "f_cdf": (r7("f_cdf", 2.0, 2.0, lambda: c("x")), "round(x / (1 + x), 7)"),
    "normal_cdf": (r7("normal_cdf", 1.0, 2.0, lambda: c("x")), f"round({NORMAL.format(x='(x - 1) / 2')}, 7)"), "inverse_normal_cdf": (lambda: F.round(presto("normal_cdf", 1.0, 2.0, presto("inverse_normal_cdf", 1.0, 2.0, c("p"))), 7), "round(p, 7)"),
    "cauchy_cdf": (r7("cauchy_cdf", lambda: F.lit(3), lambda: F.lit(2), lambda: c("x")), "round(0.5 + atan((x - 3) / 2) / pi(), 7)"), "laplace_cdf": (r7("laplace_cdf", lambda: F.lit(2), lambda: F.lit(3), lambda: c("x")), "round(CASE WHEN x < 2 THEN 0.5 * exp((x - 2) / 3) ELSE 1 - 0.5 * exp((2 - x) / 3) END, 7)"), "weibull_cdf": (r7("weibull_cdf", 1.5, lambda: F.lit(2), lambda: c("x")), "round(1 - exp(-pow(x / 2, 1.5)), 7)"),
    "wilson_lower": (r7("wilson_interval_lower", lambda: c("n_regionkey"), lambda: F.lit(10), 1.96), "round((n_regionkey / 10 + 1.9208 / 10 - 1.96 * sqrt(n_regionkey / 10 * (1 - n_regionkey / 10) / 10 + 0.9604 / 100)) / (1 + 3.8416 / 10), 7)"), "wilson_upper": (r7("wilson_interval_upper", lambda: c("n_regionkey"), lambda: F.lit(10), 1.96), "round((n_regionkey / 10 + 1.9208 / 10 + 1.96 * sqrt(n_regionkey / 10 * (1 - n_regionkey / 10) / 10 + 0.9604 / 100)) / (1 + 3.8416 / 10), 7)"),
}, {"x": ("CAST(n_nationkey AS DOUBLE) / 3", "n_nationkey / 3.0::DOUBLE"), "p": ("CAST(n_nationkey + 1 AS DOUBLE) / 26", "(n_nationkey + 1) / 26.0::DOUBLE")})

# bytes and hashes
PAD = lambda key, with_: "".join(f"{b ^ with_:02X}" for b in key.ljust(64, b"\0"))
HMAC = lambda h: f"upper({h}(unhex('{PAD(b'key', 0x5C)}') || unhex({h}(unhex('{PAD(b'key', 0x36)}') || encode(n_name)))))"
calls("call_presto_binary", "nation", "n_nationkey", {
    **{f"hmac_{h}": ((lambda h=h: F.hex(presto(f"hmac_{h}", c("n_name"), F.lit("key")))), HMAC(h)) for h in ("md5", "sha1", "sha256")},
    "hmac_sha512_bytes": (lambda: F.octet_length(presto("hmac_sha512", c("n_name"), F.lit("key"))), "64"), "sha512_bytes": (lambda: F.octet_length(presto("sha512", c("n_name"))), "64"),
    "md5": (lambda: F.hex(presto("md5", c("n_name"))), "upper(md5(n_name))"), "sha1": (lambda: F.hex(presto("sha1", c("n_name"))), "upper(sha1(n_name))"), "sha256": (lambda: F.hex(presto("sha256", c("n_name"))), "upper(sha256(n_name))"),
    "ieee64": (lambda: F.hex(presto("to_ieee754_64", c("two_to"))), "lpad(to_hex((1023 + n_regionkey)::BIGINT << 52), 16, '0')"), "ieee32": (lambda: F.hex(presto("to_ieee754_32", c("two_to"))), "lpad(to_hex((127 + n_regionkey)::BIGINT << 23), 8, '0')"), "from_ieee64": (lambda: presto("from_ieee754_64", presto("to_ieee754_64", c("x"))), "x"),
    "big64": (lambda: F.hex(presto("to_big_endian_64", c("n_nationkey"))), "lpad(to_hex(n_nationkey), 16, '0')"), "big32": (lambda: F.hex(presto("to_big_endian_32", c("n_nationkey"))), "lpad(to_hex(n_nationkey), 8, '0')"), "from_big64": (lambda: presto("from_big_endian_64", presto("to_big_endian_64", -c("n_nationkey"))), "-n_nationkey::BIGINT"), "from_big32": (lambda: presto("from_big_endian_32", presto("to_big_endian_32", -c("n_nationkey"))), "-n_nationkey::BIGINT"),
    "to_hex": (lambda: presto("to_hex", F.encode(c("n_name"), "UTF-8")), "to_hex(encode(n_name))"), "from_hex": (lambda: F.decode(presto("from_hex", F.hex(c("n_name"))), "UTF-8"), "n_name"), "to_base64": (lambda: presto("to_base64", presto("to_utf8", c("n_name"))), "to_base64(encode(n_name))"), "from_base64": (lambda: presto("from_utf8", presto("from_base64", F.base64(F.encode(c("n_name"), "UTF-8")))), "n_name"),
    "to_base64url": (lambda: presto("to_base64url", F.unhex(F.lit("FBEFFE"))), "'--_-'"), "from_base64url": (lambda: presto("from_utf8", presto("from_base64url", presto("to_base64url", F.encode(c("n_name"), "UTF-8")))), "n_name"),
    "xxhash64_bytes": (lambda: F.octet_length(presto("xxhash64", c("n_name"))), "8"), "spooky_64": (lambda: F.right(F.hex(presto("spooky_hash_v2_64", c("n_name"))), F.lit(8)) == F.hex(presto("spooky_hash_v2_32", c("n_name"))), "true"),
}, {"two_to": ("pow(2.0D, n_regionkey)", "pow(2.0, n_regionkey)"), "x": ("n_nationkey / 7.0D - 1", "n_nationkey / 7.0::DOUBLE - 1")})

# dates
calls("call_presto_dates", "events", "event_id", {
    **{f: ((lambda f=f: presto(f, c("ts"))), duck) for f, duck in {"day_of_week": "isodow(ts)::INTEGER", "dow": "isodow(ts)::INTEGER", "day_of_year": "dayofyear(ts)::INTEGER", "doy": "dayofyear(ts)::INTEGER", "week": "week(ts)::INTEGER", "week_of_year": "week(ts)::INTEGER", "year_of_week": "isoyear(ts)::INTEGER", "yow": "isoyear(ts)::INTEGER", "last_day_of_month": "last_day(ts)"}.items()},
    "formatted": (lambda: presto("date_format", c("ts"), "%Y-%m-%d %H:%i"), "strftime(ts, '%Y-%m-%d %H:%M')"), "iso_week": (lambda: presto("date_format", c("ts"), "%x-W%v"), "strftime(ts, '%G-W%V')"), "java": (lambda: presto("format_datetime", c("ts"), "yyyy/MM/dd"), "strftime(ts, '%Y/%m/%d')"),
    "parsed": (lambda: presto("date_parse", F.date_format(c("ts"), "dd.MM.yyyy"), "%d.%m.%Y"), "date_trunc('day', ts)::TIMESTAMP"), "parsed_java": (lambda: presto("parse_datetime", F.date_format(c("ts"), "yyyyMMddHH"), "yyyyMMddHH"), "date_trunc('hour', ts)::TIMESTAMP"),
    "added": (lambda: presto("date_add", "HOUR", 5, c("ts")), "ts + INTERVAL 5 HOUR"), "differing": (lambda: presto("date_diff", "DAY", F.lit("2020-01-01 00:00:00").cast("timestamp"), c("tz")), "datesub('day', TIMESTAMP '2020-01-01', ts)"), "unixtime": (lambda: presto("to_unixtime", c("tz")), "epoch(ts)"), "from_unixtime": (lambda: presto("from_unixtime", c("event_id")).cast("timestamp_ntz"), "make_timestamp(event_id * 1000000)"),
    "day_of_month": (lambda: presto("day_of_month", c("ts")), "day(ts)::INTEGER"), "stamp_added": (lambda: presto("timestampadd", "DAY", 3, c("ts")), "ts + INTERVAL 3 DAY"), "stamp_between": (lambda: presto("timestampdiff", "HOUR", F.lit("2020-01-01 00:00:00").cast("timestamp"), c("tz")), "datesub('hour', TIMESTAMP '2020-01-01', ts)"),
    "zone_hour": (lambda: presto("timezone_hour", c("tz"), "Asia/Kolkata"), "5::BIGINT"), "zone_minute": (lambda: presto("timezone_minute", c("tz"), "Asia/Kolkata"), "30::BIGINT"), "zone_west": (lambda: presto("timezone_hour", c("tz"), "-03:30"), "-3::BIGINT"), "truncated": (lambda: spark("trunc", c("ts"), F.lit("month")), "date_trunc('month', ts)::DATE"),
}, {"tz": ("CAST(ts AS TIMESTAMP)", "ts")})
calls("call_spark_dates", "events", "event_id", {
    "pdate": (lambda: spark("date2pdate", F.date_format(c("ts"), "yyyy-MM-dd")), "strftime(ts, '%Y%m%d')"), "from_pdate": (lambda: spark("pdate2date", F.date_format(c("ts"), "yyyyMMdd")), "strftime(ts, '%Y-%m-%d')"), "format_pdate": (lambda: spark("format_pdate", F.date_format(c("ts"), "yyyyMMdd")), "strftime(ts, '%Y-%m-%d')"),
    "doy": (lambda: spark("doy", c("ts")), "dayofyear(ts)::INTEGER"), "dow": (lambda: spark("dow", c("ts")), "(dayofweek(ts) + 1)::INTEGER"), "week_of_year": (lambda: spark("week_of_year", c("ts")), "week(ts)::INTEGER"), "millisecond": (lambda: spark("millisecond", c("ts")), "(millisecond(ts) % 1000)::INTEGER"),
    "to_unix_timestamp": (lambda: spark("to_unix_timestamp", c("tz")), "floor(epoch(ts))::BIGINT"), "get_timestamp": (lambda: spark("get_timestamp", F.date_format(c("ts"), "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"), "date_trunc('second', ts)::TIMESTAMP"), "get_timestamp_bad": (lambda: spark("get_timestamp", c("event_type")).cast("string"), "NULL::VARCHAR"), "long_to_timestamp": (lambda: spark("long_to_timestamp", c("event_id")).cast("timestamp_ntz"), "make_timestamp(event_id * 1000000)"),
    "flink_unix": (lambda: flink("flink_unix_timestamp", c("tz")), "floor(epoch(ts))::BIGINT"), "flink_from": (lambda: flink("flink_from_unixtime", c("event_id")), "strftime(make_timestamp(event_id * 1000000), '%Y-%m-%d %H:%M:%S')"),
    "today": (lambda: spark("current_date") == F.to_date(spark("now")), "true"), "now": (lambda: spark("now") == spark("current_timestamp"), "true"), "local": (lambda: flink("localtimestamp") >= F.lit("2024-01-01").cast("timestamp_ntz"), "true"), "row_time": (lambda: flink("current_row_timestamp") == spark("now"), "true"),
}, {"tz": ("CAST(ts AS TIMESTAMP)", "ts")})

# arrays and maps, over whole embeddings and over small lists with nulls and repeats
calls("call_presto_arrays", "orders", "o_orderkey", {
    "sum": (lambda: presto("array_sum", c("a")), "list_sum(a)::BIGINT"), "sum_type": (lambda: F.typeof(presto("array_sum", c("a"))), "'bigint'"), "sum_double": (lambda: presto("array_sum", c("d")), "list_sum(d)"), "average": (lambda: presto("array_average", c("a")), "list_avg(a)"),
    "frequency": (lambda: SORTED_KEYS(presto("array_frequency", c("a"))), "array_to_string(list_sort(list_transform(list_distinct(a), lambda v: v::VARCHAR || '=' || len(list_filter(a, lambda w: w = v))::VARCHAR)), ';')"),
    "duplicates": (lambda: JOINED(presto("array_duplicates", F.array_compact(c("a")))), LIST("list_sort(list_filter(list_distinct(a), lambda v: len(list_filter(a, lambda w: w = v)) > 1))")), "has_duplicates": (lambda: presto("array_has_duplicates", c("b")), "len(list_distinct(b)) < len(b)"),
    "normalized": (lambda: F.round(F.get(presto("array_normalize", c("d"), 2.0), F.lit(0)), 9), "round(d[1] / sqrt(list_sum(list_transform(d, lambda v: v * v))), 9)"), "combinations": (lambda: F.concat_ws(";", F.transform(presto("combinations", c("b"), 2), JOINED)), "b[1] || ',' || b[2] || ';' || b[1] || ',' || b[3] || ';' || b[2] || ',' || b[3]"),
    "ngrams": (lambda: F.concat_ws(";", F.transform(presto("ngrams", c("b"), 2), JOINED)), "b[1] || ',' || b[2] || ';' || b[2] || ',' || b[3]"), "trimmed": (lambda: JOINED(presto("trim_array", c("b"), 1)), LIST("b[1:2]")), "without_nulls": (lambda: JOINED(presto("remove_nulls", c("a"))), LIST("list_filter(a, lambda v: v IS NOT NULL)")),
    "all_match": (lambda: presto("all_match", c("b"), lambda v: v >= 0), "true"), "any_match": (lambda: presto("any_match", c("b"), lambda v: v > 50), "len(list_filter(b, lambda v: v > 50)) > 0"), "none_match": (lambda: presto("none_match", c("b"), lambda v: v > 50), "len(list_filter(b, lambda v: v > 50)) = 0"),
    "first": (lambda: presto("find_first", c("b"), lambda v: v > 3), "list_filter(b, lambda v: v > 3)[1]"), "first_index": (lambda: presto("find_first_index", c("b"), lambda v: v > 3), "nullif(list_position(list_transform(b, lambda v: v > 3), true), 0)::BIGINT"), "sort_desc": (lambda: JOINED(presto("array_sort_desc", c("a"))), LIST("list_sort(a, 'DESC', 'NULLS LAST')")),
    "zip": (lambda: F.get(presto("zip", c("a"), c("b")), F.lit(1))["b"], "b[2]"), "contains": (lambda: presto("contains", c("b"), F.lit(2)), "list_contains(b, 2)"), "element": (lambda: presto("element", F.slice(c("b"), 3, 1)), "b[3]"), "reduced": (lambda: presto("reduce", c("b"), F.lit(0).cast("long"), lambda s, v: s + v), "list_sum(b)::BIGINT"),
    "canonical": (lambda: JOINED(presto("$internal$canonicalize", c("a"))), LIST("list_sort(a, 'ASC', 'NULLS LAST')")), "internal_contains": (lambda: presto("$internal$contains", c("b"), F.lit(1)), "list_contains(b, 1)"), "built": (lambda: JOINED(presto("array_constructor", c("o_custkey"), c("o_orderkey"))), LIST("[o_custkey, o_orderkey]")), "subscript": (lambda: presto("subscript", c("b"), F.lit(2)), "b[2]"), "past": (lambda: presto("subscript", c("b"), F.lit(9)).cast("bigint"), "NULL::BIGINT"),
    "cardinality": (lambda: presto("cardinality", c("a")), "len(a)::INTEGER"), "row": (lambda: presto("row_constructor", c("o_custkey").alias("x"), F.lit(1).alias("y"))["x"], "o_custkey"), "shuffled": (lambda: F.array_sort(spark("shuffle", c("b"))) == F.array_sort(c("b")), "true"),
    "slice_sum": (lambda: spark("array_slice_sum", c("b"), 1), "list_sum(b[2:])::DOUBLE"), "slice_sum_end": (lambda: spark("array_slice_sum", c("b"), -2, 1), "b[2]::DOUBLE"), "union_udf": (lambda: JOINED(F.array_sort(spark("array_union_udf", c("b"), F.array(F.lit(7).cast("long"))))), LIST("list_sort(list_distinct(b || [7]))")), "item": (lambda: spark("get_array_item", c("b"), 0), "b[1]"), "no_item": (lambda: spark("get_array_item", c("b"), 5), "NULL::BIGINT"),
    "fields": (lambda: JOINED(spark("get_array_struct_fields", F.transform(c("b"), lambda v: F.struct(v.alias("f"))), "f")), LIST("b")), "field": (lambda: spark("get_struct_field", F.struct(c("o_custkey").alias("f")), "f"), "o_custkey"), "combined": (lambda: JOINED(spark("combine_arrays", c("b"), F.lit(None).cast("array<bigint>"), c("b"))), LIST("b || b")),
}, {"a": ("array(o_custkey % 5, NULL, o_orderkey % 3, o_custkey % 5)", "[o_custkey % 5, NULL, o_orderkey % 3, o_custkey % 5]"), "b": ("array(o_custkey % 7, 2L, o_orderkey)", "[o_custkey % 7, 2, o_orderkey]"), "d": ("array(o_totalprice, 1.0D)", "[o_totalprice, 1.0]")})
VALUES = lambda m: SORTED_KEYS(m)
calls("call_presto_maps", "orders", "o_orderkey", {
    "all_keys": (lambda: presto("all_keys_match", c("m"), lambda k: k != o_status()), "o_orderstatus NOT IN ('a', 'b')"), "any_keys": (lambda: presto("any_keys_match", c("m"), lambda k: k == "a"), "true"), "no_keys": (lambda: presto("no_keys_match", c("m"), lambda k: k == "z"), "true"), "any_values": (lambda: presto("any_values_match", c("m"), lambda v: v > 100), "o_custkey > 100 OR o_orderkey > 100"), "no_values": (lambda: presto("no_values_match", c("m"), lambda v: v > 100), "NOT (o_custkey > 100 OR o_orderkey > 100)"),
    "multimap": (lambda: F.concat_ws(";", F.array_sort(F.transform(F.map_entries(presto("multimap_from_entries", c("e"))), lambda x: F.concat_ws("=", x["key"], F.concat_ws(",", x["value"].cast("array<string>")))))), "'x=' || o_custkey || ',' || o_orderkey || ';y=1'"), "cosine": (lambda: F.round(presto("cosine_similarity", c("v"), c("w")), 9), "round((o_custkey + 1) / (sqrt(pow(o_custkey + 1, 2) + 1) * 1), 9)"),
    "subscript": (lambda: presto("subscript", c("m"), F.lit("a")), "o_custkey"), "missing": (lambda: presto("subscript", c("m"), F.lit("q")).cast("bigint"), "NULL::BIGINT"), "value": (lambda: spark("get_map_value", c("m"), F.lit("b")), "o_orderkey"), "kept": (lambda: VALUES(spark("map_filter_keys", c("m"), F.array(F.lit("a")))), "'a=' || o_custkey"),
    "updated": (lambda: VALUES(spark("map_update", c("m"), F.create_map(F.lit("a"), F.lit(0).cast("bigint"), F.lit("z"), F.lit(9).cast("bigint")))), "'a=0;b=' || o_orderkey || ';z=9'"), "updated_only": (lambda: VALUES(spark("map_update", c("m"), F.create_map(F.lit("a"), F.lit(0).cast("bigint"), F.lit("z"), F.lit(9).cast("bigint")), False)), "'a=0;b=' || o_orderkey"),
    "combined": (lambda: VALUES(spark("combine", c("m"), F.create_map(F.lit("b"), F.lit(1).cast("bigint")), F.lit(None).cast("map<string,bigint>"))), "'a=' || o_custkey || ';b=1'"),
    "down_sum": (lambda: VALUES(presto("downsample", c("s"), 10, "sum", "none")), "'0=' || (3 + o_custkey)::DOUBLE || ';40=5.0'"), "down_zero": (lambda: VALUES(presto("downsample", c("s"), 10, "count", "zero")), "'0=2.0;10=0.0;20=0.0;30=0.0;40=1.0'"), "down_line": (lambda: VALUES(presto("downsample", c("s"), 10, "min", "int")), "'0=' || least(3, o_custkey)::DOUBLE || ';10=' || (least(3, o_custkey) + (5 - least(3, o_custkey)) / 4)::DOUBLE || ';20=' || (least(3, o_custkey) + 2 * (5 - least(3, o_custkey)) / 4)::DOUBLE || ';30=' || (least(3, o_custkey) + 3 * (5 - least(3, o_custkey)) / 4)::DOUBLE || ';40=5.0'"),
    "down_max": (lambda: F.element_at(presto("downsample", c("s"), 10, "max", "nan"), F.lit(0).cast("bigint")), "greatest(3, o_custkey)::DOUBLE"), "down_avg": (lambda: F.element_at(presto("downsample", c("s"), 10, "avg", "nan"), F.lit(0).cast("bigint")), "(3 + o_custkey) / 2.0::DOUBLE"),
}, {"m": ("map('a', o_custkey, 'b', o_orderkey)", "1"), "e": ("array(named_struct('key', 'x', 'value', o_custkey), named_struct('key', 'x', 'value', o_orderkey), named_struct('key', 'y', 'value', 1L))", "1"), "v": ("map('p', CAST(o_custkey + 1 AS DOUBLE), 'q', 1.0D)", "1"), "w": ("map('p', 1.0D)", "1"), "s": ("map(1L, 3.0D, 7L, CAST(o_custkey AS DOUBLE), 45L, 5.0D)", "1")})


def o_status():
    return F.col("o_orderstatus")


# strings, regular expressions, JSON and URLs
calls("call_strings", "pages", "page_id", {
    "strpos": (lambda: presto("strpos", c("url"), "e"), "instr(url, 'e')::INTEGER"), "strrpos": (lambda: presto("strrpos", c("url"), "e"), "(CASE WHEN instr(reverse(url), 'e') = 0 THEN 0 ELSE length(url) - instr(reverse(url), 'e') + 1 END)::INTEGER"), "codepoint": (lambda: presto("codepoint", F.substring(c("url"), 1, 1)), "ascii(url)::INTEGER"), "distance": (lambda: presto("levenshtein_distance", c("h"), F.lit("example")), "levenshtein(h, 'example')::INTEGER"),
    "substr": (lambda: spark("substr", c("url"), F.lit(3), F.lit(5)), "substr(url, 3, 5)"), "split": (lambda: F.get(presto("split", c("url"), "."), F.lit(1)), "string_split(url, '.')[2]"), "split_to_map": (lambda: F.try_element_at(presto("split_to_map", F.concat(F.lit("h="), c("h"), F.lit("|n=1")), "|", "="), F.lit("h")), "h"), "utf8": (lambda: presto("from_utf8", presto("to_utf8", c("url"))), "url"),
    "extract": (lambda: presto("regexp_extract", c("url"), "//([a-z]+)", 1), "nullif(regexp_extract(url, '//([a-z]+)', 1), '')"), "no_extract": (lambda: presto("regexp_extract", c("url"), "#zz(.)", 1), "NULL::VARCHAR"), "replaced": (lambda: presto("regexp_replace", c("url"), "[aeiou]", "_"), "regexp_replace(url, '[aeiou]', '_', 'g')"), "deleted": (lambda: presto("regexp_replace", c("url"), "[0-9]"), "regexp_replace(url, '[0-9]', '', 'g')"), "regexp_split": (lambda: F.concat_ws("|", presto("regexp_split", c("url"), "[/.]+")), "array_to_string(regexp_split_to_array(url, '[/.]+'), '|')"),
    "icu_replace": (lambda: spark("icu_regexp_replace", c("url"), "[aeiou]+", "*"), "regexp_replace(url, '[aeiou]+', '*', 'g')"), "icu_extract": (lambda: spark("icu_regexp_extract", c("url"), "([a-z]+)://", 1), "regexp_extract(url, '([a-z]+)://', 1)"), "icu_all": (lambda: F.concat_ws("|", spark("icu_regexp_extract_all", c("url"), "[0-9]+", 0)), "array_to_string(regexp_extract_all(url, '[0-9]+'), '|')"), "icu": (lambda: spark("icu_regexp", c("url"), "^https"), "starts_with(url, 'https')"), "icu_rlike": (lambda: spark("icu_rlike", c("url"), "e.*e"), "regexp_matches(url, 'e.*e')"), "icu_like": (lambda: spark("icu_regexp_like", c("url"), "[0-9]$"), "regexp_matches(url, '[0-9]$')"),
    "title": (lambda: spark("to_title", c("h")), "upper(h[1]) || lower(h[2:])"), "joined": (lambda: presto("concat_ws_spark", F.lit("-"), c("h"), c("url")), "concat_ws('-', h, url)"), "longs": (lambda: JOINED(spark("string_to_long_array", c("numbers"))), "page_id || ',' || 3"), "longs_short": (lambda: JOINED(spark("str_to_long_arr", c("numbers"))), "page_id || ',' || 3"), "no_longs": (lambda: spark("str_to_long_arr", F.lit("")).isNull(), "true"), "empty": (lambda: spark("empty2null", F.regexp_extract(c("url"), "[?](.*)", 1)), "nullif(regexp_extract(url, '[?](.*)', 1), '')"),
    "alpha": (lambda: flink("is_alpha", c("h")), "regexp_matches(h, '^\\p{L}+$')"), "digit": (lambda: flink("is_digit", c("page_id").cast("string")), "true"), "decimal": (lambda: flink("is_decimal", c("h")), "try_cast(h AS DECIMAL(38, 18)) IS NOT NULL"), "index": (lambda: flink("split_index", c("url"), "/", 2), "string_split(url, '/')[3]"), "index_code": (lambda: flink("split_index", c("url"), 47, 0), "string_split(url, '/')[1]"),
    "host": (lambda: presto("url_extract_host", c("url")), "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"), "protocol": (lambda: presto("url_extract_protocol", c("url")), "regexp_extract(url, '^([a-z]+):', 1)"), "path": (lambda: presto("url_extract_path", c("url")), "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"), "query": (lambda: F.coalesce(presto("url_extract_query", c("url")), F.lit("")), "regexp_extract(url, '[?]([^#]*)', 1)"), "fragment": (lambda: presto("url_extract_fragment", F.concat(F.regexp_replace(c("url"), "#.*", ""), F.lit("#f"), c("page_id"))), "'f' || page_id"),
    "port": (lambda: presto("url_extract_port", F.concat(F.lit("http://"), c("h"), F.lit(":"), c("page_id") + 1, F.lit("/p"))), "page_id + 1"), "no_port": (lambda: presto("url_extract_port", F.concat(F.lit("http://"), c("h"), F.lit("/p"))), "NULL::BIGINT"), "parameter": (lambda: presto("url_extract_parameter", F.concat(F.lit("http://h/p?x="), c("page_id"), F.lit("&y=2")), "x"), "page_id::VARCHAR"), "encoded": (lambda: spark("url_decode", spark("url_encode", c("url"))), "url"),
}, {"h": ("coalesce(nullif(regexp_extract(url, '//([a-z]+)', 1), ''), 'none')", "coalesce(nullif(regexp_extract(url, '//([a-z]+)', 1), ''), 'none')"), "numbers": ("concat(page_id, ',x,3')", "page_id || ',x,3'")})
calls("call_json", "events", "event_id", {
    "scalar": (lambda: presto("json_extract_scalar", c("props"), "$.k"), "json_extract_string(props, '$.k')"), "not_scalar": (lambda: presto("json_extract_scalar", c("l"), "$"), "NULL::VARCHAR"), "extract": (lambda: presto("json_extract", c("l"), "$[0]"), "event_id::VARCHAR"), "size": (lambda: presto("json_size", c("l"), "$"), "3"), "object_size": (lambda: presto("json_size", c("props"), "$"), "1"),
    "has_number": (lambda: presto("json_array_contains", c("l"), 2), "event_id = 2 OR true"), "has_text": (lambda: presto("json_array_contains", c("l"), "x"), "true"), "text_is_no_number": (lambda: presto("json_array_contains", c("l"), "2"), "false"), "true_is_no_text": (lambda: presto("json_array_contains", F.lit('["true", 1]'), True), "false"), "has_true": (lambda: presto("json_array_contains", F.lit("[true, 1]"), True), "true"), "is_scalar": (lambda: presto("is_json_scalar", c("props")), "false"), "number_is_scalar": (lambda: presto("is_json_scalar", c("event_id").cast("string")), "true"),
    "parsed": (lambda: presto("json_parse", F.concat(F.lit('{ "b" : '), c("event_id"), F.lit(', "a": [1,  2] }'))), "'{\"a\":[1,2],\"b\":' || event_id || '}'"), "formatted": (lambda: presto("json_format", c("props")), "replace(props, ' ', '')"), "split": (lambda: F.concat_ws("|", presto("json_split", c("l"))), "event_id || '|2|x'"), "bad": (lambda: presto("get_json_object_detect_bad_json", F.lit('{"k": '), "$.k"), "NULL::VARCHAR"), "good": (lambda: presto("get_json_object_detect_bad_json", c("props"), "$.k"), "json_extract_string(props, '$.k')"),
    "tuple": (lambda: JOINED(spark("json_tuple_with_codegen", c("props"), ["k", "none"])), "json_extract_string(props, '$.k') || ',null'"), "to_map": (lambda: F.try_element_at(spark("json_to_map", c("props")), F.lit("k")), "json_extract_string(props, '$.k')"), "spark_split": (lambda: F.size(spark("json_split", c("l"))), "3"), "flink_map": (lambda: F.try_element_at(flink("json_str_to_map", c("props")), F.lit("k")), "json_extract_string(props, '$.k')"), "flink_array": (lambda: F.size(flink("json_str_to_array", c("l"))), "3"),
}, {"l": ("concat('[', event_id, ',2,\"x\"]')", "concat('[', event_id, ',2,\"x\"]')")})

# decimals: results with their precision and scale
A, B = (12, 2), (10, 0)
BIG = (38, 10)
calls("call_decimals", "orders", "o_orderkey", {
    "add": (lambda: spark("add_deny_precision_loss", c("a"), c("b"), A, B), "(a + b)::DECIMAL(13, 2)"), "subtract": (lambda: spark("subtract_deny_precision_loss", c("a"), c("b"), A, B), "(a - b)::DECIMAL(13, 2)"), "multiply": (lambda: spark("multiply_deny_precision_loss", c("a"), c("b"), A, B), "(a * b)::DECIMAL(23, 2)"), "add_type": (lambda: F.typeof(spark("add_deny_precision_loss", c("a"), c("b"), A, B)), "'decimal(13,2)'"),
    "add_big": (lambda: spark("add_deny_precision_loss", c("a"), c("b"), BIG, BIG), "(a + b)::DECIMAL(38, 10)"), "add_big_type": (lambda: F.typeof(spark("add_deny_precision_loss", c("a"), c("b"), BIG, BIG)), "'decimal(38,10)'"), "multiply_big_type": (lambda: F.typeof(spark("multiply_deny_precision_loss", c("a"), c("b"), BIG, BIG)), "'decimal(38,20)'"), "divide_type": (lambda: F.typeof(spark("divide_deny_precision_loss", c("a"), c("b"), A, B)), "'decimal(23,13)'"), "divide": (lambda: F.abs(spark("divide_deny_precision_loss", c("a"), c("b"), A, B) * c("b") - c("a")) < 0.001, "CASE WHEN b <> 0 THEN true END"),
    "flink_add_type": (lambda: F.typeof(flink("flink_decimal_add", c("a"), c("b"), BIG, BIG)), "'decimal(38,9)'"), "flink_add": (lambda: flink("flink_decimal_add", c("a"), c("b"), A, B), "(a + b)::DECIMAL(13, 2)"), "flink_subtract": (lambda: flink("flink_decimal_subtract", c("a"), c("b"), A, B), "(a - b)::DECIMAL(13, 2)"), "flink_multiply": (lambda: flink("flink_decimal_multiply", c("a"), c("b"), A, B), "(a * b)::DECIMAL(23, 2)"),
    "gt": (lambda: spark("decimal_greaterthan", c("a"), c("b")), "a > b"), "ge": (lambda: spark("decimal_greaterthanorequal", c("a"), c("b")), "a >= b"), "lt": (lambda: spark("decimal_lessthan", c("a"), c("b")), "a < b"), "le": (lambda: spark("decimal_lessthanorequal", c("a"), c("b")), "a <= b"), "eq": (lambda: spark("decimal_equalto", c("a"), c("b")), "a = b"), "ne": (lambda: spark("decimal_notequalto", c("a"), c("b")), "a <> b"), "unscaled": (lambda: spark("unscaled_value", c("a"), 2), "(a * 100)::BIGINT"),
}, {"a": ("CAST(o_totalprice AS DECIMAL(12, 2))", "o_totalprice::DECIMAL(12, 2)"), "b": ("CAST(o_custkey AS DECIMAL(10, 0))", "o_custkey::DECIMAL(10, 0)")})

# operators under their registered names, seeded hashes against themselves, random values in their range
calls("call_spark_names", "lineitem", "id", {
    **{f: ((lambda f=f: spark(f, c("q"), c("p"))), duck) for f, duck in {"equalto": "q = p", "lessthan": "q < p", "greaterthan": "q > p", "lessthanorequal": "q <= p", "greaterthanorequal": "q >= p", "equalnullsafe": "q IS NOT DISTINCT FROM p", "add": "q + p", "subtract": "q - p", "multiply": "q * p"}.items()},
    "divide": (lambda: spark("divide", c("q"), c("n") - 1), "CASE WHEN n = 1 THEN NULL ELSE q / (n - 1) END"), "remainder": (lambda: spark("remainder", c("l_orderkey"), c("n").cast("long") - 1), "CASE WHEN n = 1 THEN NULL ELSE l_orderkey % (n - 1) END"), "unaryminus": (lambda: spark("unaryminus", c("q")), "-q"), "not_": (lambda: spark("not", c("q") > 10), "NOT q > 10"), "between": (lambda: spark("between", c("q"), F.lit(3), F.lit(9)), "q BETWEEN 3 AND 9"),
    "and_": (lambda: spark("bitwise_and", c("l_orderkey"), c("l_partkey")), "l_orderkey & l_partkey"), "or_": (lambda: spark("bitwise_or", c("l_orderkey"), c("l_partkey")), "l_orderkey | l_partkey"), "xor_": (lambda: spark("bitwise_xor", c("l_orderkey"), c("l_partkey")), "xor(l_orderkey, l_partkey)"), "bnot": (lambda: spark("bitwise_not", c("l_orderkey")), "~l_orderkey"), "power": (lambda: F.round(spark("power", c("q"), F.lit(0.5)), 9), "round(sqrt(q), 9)"),
    "day_bits": (lambda: spark("bit_days_count", F.array(c("l_orderkey"), F.lit(None).cast("bigint"))), "bit_count(l_orderkey)::INTEGER"), "sorted_down": (lambda: JOINED(spark("array_sort_desc", F.array(c("l_orderkey"), c("l_partkey")))), "greatest(l_orderkey, l_partkey) || ',' || least(l_orderkey, l_partkey)"),
    "rand": (lambda: spark("rand", F.lit(3)).between(0, 1), "true"), "random": (lambda: spark("random", F.lit(3)) == spark("rand", F.lit(3)), "true"), "rand_integer": (lambda: flink("rand_integer", 5, 10).between(0, 9), "true"), "uuid": (lambda: F.length(spark("uuid")), "36"), "partition": (lambda: spark("spark_partition_id") >= 0, "true"), "file": (lambda: F.length(spark("input_file_name")) > 0, "true"), "no_error": (lambda: F.when(c("q") < 0, spark("raise_error", F.lit("negative")).cast("int")).otherwise(0), "0"),
    "hash_seed": (lambda: spark("hash_with_seed", 42, c("l_returnflag")) == F.hash(c("l_returnflag")), "true"), "xxhash_seed": (lambda: spark("xxhash64_with_seed", 42, c("l_returnflag")) == F.xxhash64(c("l_returnflag")), "true"),
    "hive_text": (lambda: spark("hive_hash", c("l_returnflag")), "ascii(l_returnflag)::INTEGER"), "hive_int": (lambda: spark("hive_hash", c("n")), "n"), "hive_two": (lambda: spark("hive_hash", c("n"), c("l_returnflag")), "31 * n + ascii(l_returnflag)::INTEGER"), "hive_long": (lambda: spark("hive_hash", c("l_orderkey")), "l_orderkey::INTEGER"), "hive_null": (lambda: spark("hive_hash", F.lit(None).cast("string"), c("n")), "n"),
}, {"id": ("l_orderkey * 10 + l_linenumber",) * 2, "q": ("l_quantity",) * 2, "p": ("l_extendedprice",) * 2, "n": ("l_linenumber",) * 2})
