"""Scalar functions of the three dialects, by family: Spark's form and the oracle's side by side.

A name in two dialects with one meaning is checked once. Names that mean
something else in another dialect carry its prefix, as in ``presto_split``.
"""

from __future__ import annotations

from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle

NUMS = "(SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_quantity AS q, l_discount AS d, l_extendedprice AS p, l_linenumber AS n FROM {lineitem})"
R.columns("fn_arithmetic", NUMS, {
    "abs": "abs(10 - q)", "negative": ("negative(q)", "-q"), "plus": "q + d", "minus": "q - d", "multiply": "q * d", "divide": ("try_divide(q, n - 1)", "CASE WHEN n = 1 THEN NULL ELSE q / (n - 1) END"),
    "remainder": ("try_mod(l_orderkey, CAST(n - 1 AS BIGINT))", "CASE WHEN n = 1 THEN NULL ELSE l_orderkey % (n - 1) END"), "pmod": ("pmod(3 - n, 4)", "((3 - n) % 4 + 4) % 4"),
    "int_divide": ("CAST(l_orderkey div n AS BIGINT)", "l_orderkey // n"), "ceil": ("ceil(p)", "ceil(p)::BIGINT"), "floor": ("floor(p)", "floor(p)::BIGINT"), "round": "round(p, 1)", "sign": ("sign(q - 25)", "sign(q - 25)::DOUBLE"),
    "least": "least(q, p, 30)", "greatest": "greatest(q, d, 30)", "clamp": ("least(greatest(q, 10.0D), 20.0D)", "least(greatest(q, 10), 20)"),
    "truncate": ("CASE WHEN p < 0 THEN ceil(p * 10) / 10 ELSE floor(p * 10) / 10 END", "trunc(p * 10) / 10"), "factorial": ("factorial(n)", "factorial(n)::BIGINT"), "is_nan": "isnan(q)",
}, "id")
r9 = lambda x: f"round({x}, 9)"
# the SQL's logarithms of 0 and below are -Infinity and NaN, Spark's are null
of = lambda log, x: r9(f"CASE WHEN {x} > 0 THEN {log} WHEN {x} = 0 THEN double('-Infinity') WHEN {x} < 0 THEN double('NaN') END")
R.columns("fn_math", NUMS, {
    **{f: r9(f"{f}(d)") for f in "exp sin cos tan asin acos atan sinh cosh tanh sqrt cbrt degrees radians asinh".split()},
    "expm1": (r9("expm1(d)"), r9("exp(d) - 1")), "log1p": (of("log1p(d)", "(1 + d)"), r9("ln(1 + d)")), **{k: (of(v, "q"), r9(v)) for k, v in {"ln": "ln(q)", "log2": "log2(q)", "log10": "log10(q)", "log_base": "log(3, q)"}.items()},
    "atan2": r9("atan2(d, q)"), "pow": r9("pow(q, 0.5)"), "acosh": r9("acosh(q)"), "atanh": r9("atanh(d)"), "cot": r9("cot(q)"), "sec": (r9("sec(d)"), r9("1 / cos(d)")), "csc": (r9("csc(q)"), r9("1 / sin(q)")),
    "hypot": (r9("CASE WHEN isnan(abs(q) + abs(d)) THEN double('NaN') ELSE hypot(q, d) END"), r9("sqrt(q * q + d * d)")), "rint": ("rint(p)", "round_even(p, 0)"), "pi": "pi()", "e": ("e()", "exp(1.0)"),
    # outside the buckets, of null and of NaN, as the SQL has it
    "width_bucket": ("CASE WHEN q BETWEEN 0 AND 50 THEN width_bucket(q, 0, 50, 5) WHEN q < 0 THEN CAST(floor(q / 10) AS BIGINT) + 1 ELSE 6 END", "least(floor(q / 10), 5)::BIGINT + 1"),
    "width_bucket_array": ("size(filter(array(5.0D, 10.0D, 40.0D), b -> b <= q))", "len(list_filter([5.0, 10.0, 40.0], lambda b: b <= q))::INTEGER"),
    "infinity": ("double('Infinity')", "'inf'::DOUBLE"), "is_finite": ("NOT isnan(q) AND abs(q) < double('Infinity')", "isfinite(q)"), "is_infinite": ("abs(q) = double('Infinity')", "isinf(q)"),
}, "id")
R.columns("fn_bitwise", NUMS, {
    "bitwise_and": "l_orderkey & 12", "bitwise_or": "l_orderkey | 12", "bitwise_xor": ("l_orderkey ^ 12", "xor(l_orderkey, 12)"), "bitwise_not": "~l_orderkey", "bit_count": ("bit_count(l_orderkey)", "bit_count(l_orderkey)::INTEGER"),
    "bit_get": ("CAST(bit_get(l_orderkey, 2) AS INT)", "((l_orderkey >> 2) & 1)::INTEGER"), "shiftleft": ("shiftleft(l_orderkey, 3)", "l_orderkey << 3"), "shiftright": ("shiftright(l_orderkey, 2)", "l_orderkey >> 2"),
    "shiftrightunsigned": ("shiftrightunsigned(l_orderkey, 2)", "l_orderkey >> 2"), "bin": ("bin(l_orderkey)", "bin(l_orderkey)"), "hex": ("hex(l_orderkey)", "to_hex(l_orderkey)"),
    "from_base": ("CAST(conv(hex(l_orderkey), 16, 10) AS BIGINT)", "l_orderkey"), "to_base": ("lower(conv(CAST(l_orderkey AS STRING), 10, 16))", "lower(to_hex(l_orderkey))"),
    "bit_days_count": ("aggregate(array(l_orderkey, 7L, CAST(NULL AS BIGINT)), 0, (s, x) -> s + bit_count(coalesce(x, 0L)))", "(bit_count(l_orderkey) + 3)::INTEGER"),
}, "id")
R.columns("fn_comparison", NUMS, {
    "equalto": "q = 10", "lessthan": "q < 10", "greaterthan": "q > 10", "lessthanorequal": "q <= 10", "greaterthanorequal": "q >= 10", "notequalto": "q <> 10",
    "equalnullsafe": ("nullif(n, 2) <=> nullif(n, 3)", "nullif(n, 2) IS NOT DISTINCT FROM nullif(n, 3)"), "distinct_from": ("NOT (nullif(n, 2) <=> n)", "nullif(n, 2) IS DISTINCT FROM n"), "between": "q BETWEEN 5 AND 10",
    "isnull": ("isnull(nullif(n, 2))", "nullif(n, 2) IS NULL"), "isnotnull": ("isnotnull(nullif(n, 2))", "nullif(n, 2) IS NOT NULL"), "not": "NOT (q = 10)", "in": "n IN (1, 3)",
    "decimal_compare": "CAST(q AS DECIMAL(10, 2)) > CAST(d AS DECIMAL(18, 6))", "presto_least": ("CASE WHEN nullif(n, 2) IS NULL THEN NULL ELSE least(nullif(n, 2), 3) END", "CASE WHEN n = 2 THEN NULL ELSE least(n, 3) END"),
}, "id")
DEC = "(SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 2)) AS a, CAST(o_custkey AS DECIMAL(10, 0)) AS b FROM {orders})"
R.columns("fn_decimal", DEC, {
    "add": "CAST(a + b AS DECIMAL(20, 2))", "subtract": "CAST(a - b AS DECIMAL(20, 2))", "multiply": "CAST(a * b AS DECIMAL(24, 2))", "compare": "a > b", "decimal_round": "CAST(round(a, 0) AS DECIMAL(12, 0))",
    "unscaled_value": ("CAST(a * 100 AS BIGINT)", "(a * 100)::BIGINT"), "to_double": "CAST(a AS DOUBLE)",
}, "o_orderkey")

STR = "(SELECT n_nationkey AS id, n_name AS s, concat('  ', lower(n_name), ' x,y;z ') AS t FROM {nation})"
R.columns("fn_string", STR, {
    "lower": "lower(s)", "upper": "upper(t)", "length": ("length(t)", "length(t)::INTEGER"), "reverse": "reverse(s)", "concat": "concat(s, '-', t)", "concat_ws": "concat_ws('|', s, t)", "trim": "trim(t)", "ltrim": "ltrim(t)", "rtrim": "rtrim(t)",
    "lpad": "lpad(s, 12, '*')", "rpad": "rpad(s, 4, '*')", "substring": "substring(s, 3, 4)", "left": "left(s, 3)", "right": "right(s, 3)", "repeat": "repeat(s, 2)", "replace": "replace(s, 'NATION', 'N')", "translate": "translate(s, 'NAT', 'nat')",
    "startswith": ("startswith(s, 'NATION_1')", "starts_with(s, 'NATION_1')"), "endswith": ("endswith(s, '1')", "ends_with(s, '1')"), "contains": "contains(s, 'ION_2')", "instr": ("instr(s, '_')", "instr(s, '_')::INTEGER"), "locate": ("locate('I', s)", "instr(s, 'I')::INTEGER"),
    "ascii": ("ascii(s)", "ascii(s)::INTEGER"), "chr": "chr(65 + id)", "split_part": "split_part(t, ',', 2)", "substring_index": ("substring_index(t, ';', 1)", "split_part(t, ';', 1)"), "space": ("space(id)", "repeat(' ', id)"),
    "levenshtein": ("levenshtein(s, 'NATION_11')", "levenshtein(s, 'NATION_11')::INTEGER"), "initcap": ("initcap(s)", "upper(s[1]) || lower(s[2:])"), "overlay": ("overlay(s PLACING 'xx' FROM 2 FOR 3)", "s[1:1] || 'xx' || s[5:]"),
    "bit_length": ("bit_length(s)", "bit_length(s)::INTEGER"), "find_in_set": ("find_in_set(s, 'NATION_3,NATION_1')", "CASE s WHEN 'NATION_3' THEN 1 WHEN 'NATION_1' THEN 2 ELSE 0 END"), "like": "s LIKE 'NATION_1%'", "empty2null": "nullif(trim(t), '')", "presto_strrpos": ("CASE WHEN instr(reverse(s), 'N') = 0 THEN 0 ELSE length(s) - instr(reverse(s), 'N') + 1 END", "(length(s) - instr(reverse(s), 'N') + 1)::INTEGER"),
    "printf": ("printf('%s#%d', s, id)", "printf('%s#%d', s, id)"), "conv": ("conv(CAST(id AS STRING), 10, 2)", "bin(id)"), "mask": ("mask(s)", "regexp_replace(regexp_replace(s, '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g')"), "soundex": ("soundex(s)", "'N350'"),
}, "id")
R.columns("fn_string_split", STR, {
    "split": ("array_join(split(t, '[,;]'), '|')", "array_to_string(regexp_split_to_array(t, '[,;]'), '|')"), "presto_split": ("array_join(split(t, '\\\\Q,\\\\E'), '|')", "array_to_string(string_split(t, ','), '|')"),
    "flink_split_index": ("get(split(t, '\\\\Q;\\\\E'), 1)", "string_split(t, ';')[2]"), "str_to_map": ("str_to_map(concat('a:1,b:', id), ',', ':')['b']", "id::VARCHAR"), "presto_split_to_map": ("map_from_entries(transform(split(concat('k=v|w=', id), '[|]'), e -> struct(split_part(e, '=', 1) AS k, split_part(e, '=', 2) AS v)))['w']", "id::VARCHAR"),
    "string_to_long_array": ("filter(transform(split(concat(id, ',x,3'), ','), v -> try_cast(v AS BIGINT)), v -> v IS NOT NULL)", "[id::BIGINT, 3]"),
}, "id")
R.columns("fn_regexp", STR, {
    "regexp_extract": ("regexp_extract(s, '([A-Z]+)_([0-9]+)', 2)", "regexp_extract(s, '([A-Z]+)_([0-9]+)', 2)"), "regexp_extract_all": ("array_join(regexp_extract_all(s, '[A-Z]', 0), '.')", "array_to_string(regexp_extract_all(s, '[A-Z]'), '.')"),
    "regexp_like": ("regexp_like(s, '_1[0-9]$')", "regexp_matches(s, '_1[0-9]$')"), "rlike": ("s RLIKE '^N.*2'", "regexp_matches(s, '^N.*2')"), "regexp_replace": ("regexp_replace(s, '[AIO]', '-')", "regexp_replace(s, '[AIO]', '-', 'g')"),
    "presto_regexp_extract": ("nullif(regexp_extract(s, '([0-9])[0-9]$', 0), '')", "nullif(regexp_extract(s, '([0-9])[0-9]$'), '')"), "regexp_delete": ("regexp_replace(s, '[0-9]+', '')", "regexp_replace(s, '[0-9]+', '', 'g')"), "regexp_count": ("regexp_count(s, '[AEIOU]')", "len(regexp_extract_all(s, '[AEIOU]'))::INTEGER"),
    "flink_is_alpha": ("coalesce(s RLIKE '^\\\\p{L}+$', false)", "regexp_matches(s, '^\\p{L}+$')"), "flink_is_digit": ("coalesce(substring(s, 8) RLIKE '^\\\\p{Nd}+$', false)", "regexp_matches(s[8:], '^\\p{Nd}+$')"), "flink_is_decimal": ("try_cast(substring(s, 8) AS DECIMAL(38, 18)) IS NOT NULL", "try_cast(s[8:] AS DECIMAL(38, 18)) IS NOT NULL"),
}, "id")
R.columns("fn_binary", STR, {
    "md5": "md5(s)", "sha1": "sha1(s)", "sha2_256": ("sha2(s, 256)", "sha256(s)"), "to_utf8_hex": ("lower(hex(encode(s, 'UTF-8')))", "lower(to_hex(encode(s)))"), "from_utf8": ("decode(encode(s, 'UTF-8'), 'UTF-8')", "s"), "base64": ("base64(encode(s, 'UTF-8'))", "to_base64(encode(s))"),
    "unbase64": ("decode(unbase64(base64(encode(s, 'UTF-8'))), 'UTF-8')", "decode(from_base64(to_base64(encode(s))))"), "hex": ("hex(s)", "to_hex(s)"), "unhex": ("decode(unhex(hex(s)), 'UTF-8')", "s"), "to_base64url": ("translate(base64(encode(t, 'UTF-8')), '+/', '-_')", "translate(to_base64(encode(t)), '+/', '-_')"),
    "presto_md5": ("hex(unhex(md5(s)))", "upper(md5(s))"), "presto_sha256": ("hex(unhex(sha2(s, 256)))", "upper(sha256(s))"), "to_big_endian_64": ("lpad(hex(CAST(id AS BIGINT)), 16, '0')", "lpad(to_hex(id), 16, '0')"), "to_big_endian_32": ("lpad(hex(CAST(id AS BIGINT)), 8, '0')", "lpad(to_hex(id), 8, '0')"),
}, "id")
R.columns("fn_hash_rows_only", STR, {"hash": "hash(s, id)", "xxhash64": "xxhash64(s, id)", "crc32": "crc32(s)", "sha512": "sha2(s, 512)"}, "id")
for name in ("fn_hash_rows_only",):
    ORACLE_SQL.pop(name)

TS = "(SELECT event_id AS id, ts, CAST(ts AS DATE) AS d FROM {events})"
INT = lambda spark, duck: (spark, f"({duck})::INTEGER")
R.columns("fn_date_parts", TS, {
    **{f: INT(f"{f}(ts)", f"{f}(ts)") for f in "year quarter month hour minute second dayofmonth dayofyear weekofyear".split()}, "day": INT("day(ts)", "day(ts)"), "dayofweek": INT("dayofweek(ts)", "dayofweek(ts) + 1"), "weekday": INT("weekday(ts)", "isodow(ts) - 1"),
    "presto_day_of_week": INT("weekday(ts) + 1", "isodow(ts)"), "year_of_week": INT("extract(YEAROFWEEK FROM ts)", "isoyear(ts)"), "millisecond": INT("CAST(date_format(ts, 'SSS') AS INT)", "millisecond(ts) % 1000"),
    "last_day": "last_day(d)", "date_trunc": ("date_trunc('month', ts)", "date_trunc('month', ts)::TIMESTAMP"), "trunc_hour": "date_trunc('hour', ts)",
}, "id")
R.columns("fn_date_arithmetic", TS, {
    "date_add": ("date_add(d, 5)", "(d + 5)::DATE"), "date_sub": ("date_sub(d, 5)", "(d - 5)::DATE"), "datediff": INT("datediff(d, DATE '2020-01-01')", "d - DATE '2020-01-01'"), "add_months": ("add_months(d, 2)", "(d + INTERVAL 2 MONTH)::DATE"), "make_date": ("make_date(year(d), 1, 1)", "make_date(year(d), 1, 1)"),
    "next_day": ("next_day(d, 'MON')", "(d + (8 - isodow(d))::INTEGER)::DATE"), "presto_date_add": ("timestampadd(DAY, 3, ts)", "ts + INTERVAL 3 DAY"), "presto_date_diff": ("timestampdiff(DAY, TIMESTAMP '2020-01-01 00:00:00', ts)", "datesub('day', TIMESTAMP '2020-01-01', ts)"),
    "unix_date": INT("unix_date(d)", "d - DATE '1970-01-01'"), "date_from_unix_date": ("date_from_unix_date(unix_date(d))", "d"), "months_between": ("CAST(months_between(date_trunc('month', ts), TIMESTAMP '2020-01-01 00:00:00') AS INT)", "datediff('month', DATE '2020-01-01', d)::INTEGER"), "interval": ("ts + make_ym_interval(1, 2)", "ts + INTERVAL 14 MONTH"),
}, "id")
R.columns("fn_date_conversion", TS.replace("AS id, ts", "AS id, CAST(ts AS TIMESTAMP) AS ts"), {
    "unix_timestamp": ("unix_timestamp(ts)", "floor(epoch(ts))::BIGINT"), "unix_seconds": ("unix_seconds(ts)", "floor(epoch(ts))::BIGINT"), "unix_millis": ("unix_millis(ts)", "epoch_us(ts) // 1000"), "unix_micros": ("unix_micros(ts)", "epoch_us(ts)"), "to_unixtime": ("CAST(ts AS DOUBLE)", "epoch(ts)"),
    "from_unixtime": ("from_unixtime(unix_timestamp(ts), 'yyyy-MM-dd HH:mm:ss')", "strftime(ts, '%Y-%m-%d %H:%M:%S')"), "timestamp_seconds": ("timestamp_seconds(id)", "make_timestamp(id * 1000000)"), "timestamp_millis": ("timestamp_millis(id)", "make_timestamp(id * 1000)"), "timestamp_micros": ("timestamp_micros(id)", "make_timestamp(id)"),
    "date_format": ("date_format(ts, 'yyyy/MM/dd HH')", "strftime(ts, '%Y/%m/%d %H')"), "to_date": ("to_date(date_format(ts, 'yyyy-MM-dd'))", "ts::DATE"), "to_timestamp": ("to_timestamp(date_format(ts, 'dd.MM.yyyy HH:mm:ss'), 'dd.MM.yyyy HH:mm:ss')", "date_trunc('second', ts)::TIMESTAMP"), "make_timestamp": ("make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), 3)", "date_trunc('minute', ts)::TIMESTAMP + INTERVAL 3 SECOND"),
    "pdate2date": ("date_format(to_date(date_format(ts, 'yyyyMMdd'), 'yyyyMMdd'), 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')"), "date2pdate": ("date_format(d, 'yyyyMMdd')", "strftime(d, '%Y%m%d')"), "from_utc_timestamp": ("from_utc_timestamp(ts, '+02:00')", "ts + INTERVAL 2 HOUR"), "to_utc_timestamp": ("to_utc_timestamp(ts, '+02:00')", "ts - INTERVAL 2 HOUR"),
    "to_iso8601": ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", "strftime(ts, '%Y-%m-%dT%H:%M:%S')"), "parse_datetime": ("to_timestamp(date_format(ts, 'dd/MM/yyyy'), 'dd/MM/yyyy')", "date_trunc('day', ts)::TIMESTAMP"),
}, "id")

ARR = "(SELECT n_nationkey AS id, %s AS a, %s AS b FROM {nation})"
ARR = ARR % ("array(n_regionkey, n_nationkey % 3, NULL, n_regionkey)", "array(1, 2, n_nationkey)")
ARR_D = ARR.replace("array(", "list_value(")
def arrays(name, columns):  # noqa: E302
    both = {k: (v, v) if isinstance(v, str) else v for k, v in columns.items()}
    form = lambda i, src: "SELECT id, " + ", ".join(f"{v[i]} AS {k}" for k, v in both.items()) + f" FROM {src}"
    R.sql(name, form(0, ARR), form(1, ARR_D))
J = lambda x: f"concat_ws(',', transform({x}, v -> coalesce(CAST(v AS STRING), 'null')))"  # noqa: E731, E305
K = lambda x: f"array_to_string(list_transform({x}, lambda v: coalesce(v::VARCHAR, 'null')), ',')"
arrays("fn_array_basic", {
    "array_contains": ("array_contains(b, 2)", "list_contains(b, 2)"), "array_max": ("array_max(a)", "list_max(a)"), "array_min": ("array_min(a)", "list_min(a)"), "size": ("size(a)", "len(a)::INTEGER"), "get": ("get(b, 1)", "b[2]"), "element_at": ("try_element_at(b, 3)", "b[3]"), "array_position": ("array_position(b, 2)", "list_position(b, 2)::BIGINT"),
    "slice": (J("slice(a, 2, 2)"), K("a[2:3]")), "array_append": (J("array_append(b, 9)"), K("list_append(b, 9)")), "array_prepend": (J("array_prepend(b, 9)"), K("list_prepend(9, b)")), "array_insert": (J("array_insert(b, 2, 9)"), K("b[1:1] || [9] || b[2:]")), "concat": (J("concat(a, b)"), K("a || b")), "flatten": (J("flatten(array(a, b))"), K("flatten([a, b])")),
    "array_compact": (J("array_compact(a)"), K("list_filter(a, lambda v: v IS NOT NULL)")), "array_remove": (J("array_remove(b, 2)"), K("list_filter(b, lambda v: v <> 2)")), "array_repeat": (J("array_repeat(id, 2)"), K("[id, id]")), "array_sort": (J("array_sort(a)"), K("list_sort(a, 'ASC', 'NULLS LAST')")), "array_sort_desc": (J("sort_array(a, false)"), K("list_sort(a, 'DESC', 'NULLS LAST')")), "sort_array": (J("sort_array(a)"), K("list_sort(a, 'ASC', 'NULLS FIRST')")),
    "array_join": ("array_join(b, '-')", "array_to_string(b, '-')"), "reverse": (J("reverse(b)"), K("list_reverse(b)")), "sequence": (J("sequence(id, id + 3)"), K("range(id, id + 4)")), "trim_array": (J("slice(b, 1, size(b) - 1)"), K("b[1:len(b) - 1]")), "arrays_zip": ("arrays_zip(b, a)[0].b", "b[1]"), "combinations_2": ("concat_ws(',', transform(flatten(flatten(transform(sequence(0, 1), i -> transform(sequence(i + 1, 2), k -> array(b[i], b[k]))))), v -> CAST(v AS STRING)))", "array_to_string(list_transform([b[1], b[2], b[1], b[3], b[2], b[3]], lambda v: v::VARCHAR), ',')"),
})
SORTED = lambda x: J(f"array_sort({x})")
LSORTED = lambda x: K(f"list_sort({x}, 'ASC', 'NULLS LAST')")
arrays("fn_array_sets", {
    "array_distinct": (SORTED("array_distinct(b)"), LSORTED("list_distinct(b)")), "array_union": (SORTED("array_union(b, array(7))"), LSORTED("list_distinct(b || [7])")), "array_intersect": (SORTED("array_intersect(b, array(1, 5))"), LSORTED("list_intersect(b, [1, 5])")), "array_except": (SORTED("array_except(b, array(1, 5))"), LSORTED("list_distinct(list_filter(b, lambda v: v NOT IN (1, 5)))")),
    "arrays_overlap": ("arrays_overlap(b, array(5, 6))", "list_has_any(b, [5, 6])"), "array_has_duplicates": ("size(array_distinct(b)) < size(b)", "len(list_distinct(b)) < len(b)"), "array_duplicates": (J("array_sort(filter(array_distinct(b), x -> size(filter(b, y -> y <=> x)) > 1))"), K("list_sort(list_filter(list_distinct(b), lambda x: len(list_filter(b, lambda y: y = x)) > 1))")),
    "array_frequency_of_1": ("map_from_entries(transform(array_distinct(b), x -> struct(x, size(filter(b, y -> y = x)))))[1]", "len(list_filter(b, lambda y: y = 1))::INTEGER"), "array_union_udf": (SORTED("array_distinct(flatten(array(b, array(7), array(8))))"), LSORTED("list_distinct(b || [7, 8])")),
})
arrays("fn_array_lambda", {
    "transform": (J("transform(b, x -> x * 2)"), K("list_transform(b, lambda x: x * 2)")), "filter": (J("filter(b, x -> x > 1)"), K("list_filter(b, lambda x: x > 1)")), "aggregate": ("aggregate(b, 0, (s, x) -> s + x)", "list_sum(b)::INTEGER"), "exists": ("exists(b, x -> x > 20)", "len(list_filter(b, lambda x: x > 20)) > 0"), "forall": ("forall(b, x -> x > 0)", "len(list_filter(b, lambda x: NOT x > 0)) = 0"), "none_match": ("NOT exists(b, x -> x > 20)", "len(list_filter(b, lambda x: x > 20)) = 0"),
    "zip_with": (J("zip_with(b, array(1, 2, 3), (x, y) -> x + y)"), K("list_transform(b, lambda x, i: x + i)")), "find_first": ("get(filter(b, x -> x > 1), 0)", "list_filter(b, lambda x: x > 1)[1]"), "find_first_index": ("nullif(array_position(transform(b, x -> x > 1), true), 0)", "list_position(list_transform(b, lambda x: x > 1), true)::BIGINT"), "array_sum": ("aggregate(array_compact(a), 0L, (s, x) -> s + x)", "list_sum(a)::BIGINT"), "array_average": ("aggregate(b, 0.0D, (s, x) -> s + x, s -> s / 3)", "list_avg(b)"),
    "array_slice_sum": ("aggregate(slice(b, 2, 2), 0L, (s, x) -> s + x)", "list_sum(b[2:3])::BIGINT"), "array_normalize": (J("transform(b, x -> round(x / sqrt(aggregate(b, 0.0D, (s, y) -> s + y * y)), 6))"), K("list_transform(b, lambda x: round(x / sqrt(list_sum(list_transform(b, lambda y: y * y))), 6))")), "ngrams": (J("flatten(transform(sequence(1, 2), i -> slice(b, i, 2)))"), K("b[1:2] || b[2:3]")),
})
MAP = "(SELECT n_nationkey AS id, map('a', n_regionkey, 'b', n_nationkey) AS m FROM {nation})"
MAP_D = "(SELECT n_nationkey AS id, n_regionkey AS a, n_nationkey AS b FROM {nation})"
MAPS = {
    "element_at": ("element_at(m, 'a')", "a"), "subscript": ("m['b']", "b"), "cardinality": ("size(m)", "2"), "map_keys": ("array_join(array_sort(map_keys(m)), ',')", "'a,b'"), "map_values": ("aggregate(map_values(m), 0, (s, x) -> s + x)", "a + b"), "map_entries": ("map_entries(m)[1].value", "b"), "map_filter": ("size(map_filter(m, (k, v) -> v > 2))", "(a > 2)::INTEGER + (b > 2)::INTEGER"),
    "transform_keys": ("transform_keys(m, (k, v) -> upper(k))['A']", "a"), "transform_values": ("transform_values(m, (k, v) -> v * 2)['b']", "b * 2"), "map_zip_with": ("map_zip_with(m, map('a', 10), (k, x, y) -> coalesce(x, 0) + coalesce(y, 0))['a']", "a + 10"), "map_concat": ("map_concat(m, map('c', 3))['c']", "3"), "map_from_entries": ("map_from_entries(array(struct('k', id)))['k']", "id"), "map_from_arrays": ("map_from_arrays(array('k'), array(id))['k']", "id"),
    "all_keys_match": ("forall(map_keys(m), k -> k < 'c')", "true"), "any_values_match": ("exists(map_values(m), v -> v > 20)", "a > 20 OR b > 20"), "no_values_match": ("NOT exists(map_values(m), v -> v > 20)", "NOT (a > 20 OR b > 20)"), "map_filter_keys": ("size(map_filter(m, (k, v) -> array_contains(array('a'), k)))", "1"), "map_subset": ("map_filter(m, (k, v) -> k = 'a')['a']", "a"), "map_update": ("map_from_entries(concat(filter(map_entries(m), e -> e.key <> 'a'), array(named_struct('key', 'a', 'value', 7))))['a']", "7"),
    "multimap_from_entries": ("size(aggregate(array(named_struct('k', 'x', 'v', 1), named_struct('k', 'x', 'v', 2)), CAST(array() AS ARRAY<INT>), (s, e) -> CASE WHEN e.k = 'x' THEN array_append(s, e.v) ELSE s END))", "2"), "cosine_similarity": ("round(aggregate(map_keys(m), 0.0D, (s, k) -> s + m[k] * m[k]) / nullif(aggregate(map_values(m), 0.0D, (s, v) -> s + v * v), 0.0D), 6)", "CASE WHEN a = 0 AND b = 0 THEN NULL ELSE 1.0::DOUBLE END"), "contains_key": ("map_contains_key(m, 'z')", "false"),
}
R.sql("fn_map", "SELECT id, " + ", ".join(f"{v[0]} AS {k}" for k, v in MAPS.items()) + f" FROM {MAP}", "SELECT id, " + ", ".join(f"{v[1]} AS {k}" for k, v in MAPS.items()) + f" FROM {MAP_D}")
R.columns("fn_json", "(SELECT event_id AS id, props AS j, concat('[', event_id, ',2,\"x\"]') AS l FROM {events})", {
    "get_json_object": ("get_json_object(j, '$.k')", "json_extract_string(j, '$.k')"), "json_extract_scalar": ("get_json_object(l, '$[2]')", "json_extract_string(l, '$[2]')"), "json_array_length": ("json_array_length(l)", "json_array_length(l)::INTEGER"), "json_object_keys": ("array_join(json_object_keys(j), ',')", "array_to_string(json_keys(j), ',')"), "json_array_contains": ("array_contains(from_json(l, 'array<string>'), 'x')", "true"),
    "from_json": ("from_json(j, 'k INT').k", "(j ->> '$.k')::INTEGER"), "to_json": ("to_json(named_struct('a', id))", "to_json({'a': id})::VARCHAR"), "is_json_scalar": ("get_json_object(l, '$') RLIKE '^[^\\\\[{]'", "json_type(l) NOT IN ('ARRAY', 'OBJECT')"), "json_size": ("json_array_length(l)", "json_array_length(l)::INTEGER"), "json_to_map": ("from_json(j, 'map<string,string>')['k']", "json_extract_string(j, '$.k')"), "json_to_array": ("size(from_json(l, 'array<string>'))", "3"),
}, "id")
R.columns("fn_url", "(SELECT page_id AS id, url AS u FROM {pages})", {
    "url_extract_host": ("parse_url(u, 'HOST')", "regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1)"), "url_extract_protocol": ("parse_url(u, 'PROTOCOL')", "regexp_extract(u, '^([a-z]+):', 1)"), "url_extract_path": ("parse_url(u, 'PATH')", "regexp_extract(u, '^[a-z]+://[^/?#]+([^?#]*)', 1)"), "url_extract_query": ("coalesce(parse_url(u, 'QUERY'), '')", "regexp_extract(u, '[?]([^#]*)', 1)"),
    "url_encode": ("url_encode(concat(id, ' b&c'))", "id || '+b%26c'"), "url_decode": ("url_decode(concat(id, '+b%26c'))", "id || ' b&c'"), "url_extract_parameter": ("parse_url(concat('http://h/p?x=1&y=', id), 'QUERY', 'y')", "id::VARCHAR"), "url_extract_fragment": ("parse_url(concat('http://h/p#f', id), 'REF')", "'f' || id"), "url_extract_port": ("CAST(regexp_extract(parse_url(concat('http://h:', id + 1, '/p'), 'AUTHORITY'), ':([0-9]+)$', 1) AS BIGINT)", "id + 1"),
}, "id")
R.columns("fn_probability", NUMS, {
    "cauchy_cdf": (r9("0.5 + atan((q - 20) / 5) / pi()"), r9("0.5 + atan((q - 20) / 5) / pi()")), "weibull_cdf": (r9("1 - exp(-pow(q / 20, 1.5))"), r9("1 - exp(-pow(q / 20, 1.5))")), "laplace_cdf": (r9("CASE WHEN q < 20 THEN 0.5 * exp((q - 20) / 5) ELSE 1 - 0.5 * exp((20 - q) / 5) END"), r9("CASE WHEN q < 20 THEN 0.5 * exp((q - 20) / 5) ELSE 1 - 0.5 * exp((20 - q) / 5) END")),
    "wilson_lower": (r9("(n / 10 + 1.9208 / 10 - 1.96 * sqrt(n / 10 * (1 - n / 10) / 10 + 0.9604 / 100)) / (1 + 3.8416 / 10)"), r9("(n / 10 + 1.9208 / 10 - 1.96 * sqrt(n / 10 * (1 - n / 10) / 10 + 0.9604 / 100)) / (1 + 3.8416 / 10)")), "logistic": (r9("1 / (1 + exp(-(q - 20) / 5))"), r9("1 / (1 + exp(-(q - 20) / 5))")),
}, "id")
