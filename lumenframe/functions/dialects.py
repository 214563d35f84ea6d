"""Function names of the three dialects as Column builders.

A name that Spark's registry has with the same meaning is called there. The
tables below hold the names that mean something else, or that Spark lacks, each
composed of built-ins so that it stays in the JVM; the few that cannot be are in
``udfs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import udfs
from .aggregates import AGGREGATES

Builder = Callable[..., Column]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _quoted(text: str) -> str:
    """A regular expression that matches text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def array_slice_sum(a: Column, start: int, length: int | None = None) -> Column:
    """Sum of a part of an array from a 0-based place; a negative place counts from the end."""
    first = F.lit(start) if start >= 0 else F.greatest(F.size(a) + start, F.lit(0))
    n = F.size(a) - first if length is None else F.least(F.lit(length), F.size(a) - first)
    part = F.slice(a, first + 1, F.greatest(n, F.lit(0)))
    return F.when(a.isNull(), None).when(first >= F.size(a), 0).otherwise(F.aggregate(part, F.lit(0).cast("double"), lambda s, x: s + x))


def array_frequency(a: Column) -> Column:
    return F.map_from_entries(F.transform(F.array_distinct(F.array_compact(a)), lambda x: F.struct(x, F.size(F.filter(a, lambda y: y == x)))))


def array_duplicates(a: Column) -> Column:
    return F.array_sort(F.filter(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y.eqNullSafe(x))) > 1))


def array_normalize(a: Column, p: float) -> Column:
    if p < 0:
        return F.raise_error(F.lit("array_normalize needs p >= 0"))
    if p == 0:
        return a
    norm = F.pow(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), F.lit(float(p)))), F.lit(1.0 / p))
    return F.transform(a, lambda x: x / norm)


def combinations(a: Column, n: int) -> Column:
    """All n-element sub-arrays in the array's order (n up to 5)."""
    if not 0 <= n <= 5:
        return F.raise_error(F.lit("combinations takes 0 to 5 elements"))

    def grow(start: Column, chosen: list[Column]) -> Column:
        if len(chosen) == n:
            return F.array(F.array(*[F.get(a, i) for i in chosen]))
        last = F.size(a) - (n - len(chosen))
        places = F.when(start <= last, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(places, lambda i: grow(i + 1, [*chosen, i])))

    return F.array(F.array().cast("array<int>")) if n == 0 else grow(F.lit(0), [])


def ngrams(a: Column, n: int) -> Column:
    whole = F.array(a)
    return F.when(F.size(a) <= n, whole).otherwise(F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.slice(a, i, n)))


def map_update(m: Column, other: Column, insert: bool = True) -> Column:
    """m with other's values; with insert also other's new keys."""
    kept = F.map_filter(m, lambda k, v: ~F.map_contains_key(other, k))
    new = other if insert else F.map_filter(other, lambda k, v: F.map_contains_key(m, k))
    return F.map_concat(kept, new)


def cosine_similarity(a: Column, b: Column) -> Column:
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.coalesce(F.try_element_at(a, k) * F.try_element_at(b, k), F.lit(0.0)))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def multimap_from_entries(entries: Column, key: str = "key", value: str = "value") -> Column:
    keys = F.array_distinct(F.transform(entries, lambda e: e[key]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(entries, lambda e: e[key] == k), lambda e: e[value])))


def presto_least(*xs: Column) -> Column:
    """The least value; null if any is."""
    return F.when(F.array_contains(F.array(*[x.isNull() for x in xs]), True), None).otherwise(F.least(*xs))


def presto_greatest(*xs: Column) -> Column:
    return F.when(F.array_contains(F.array(*[x.isNull() for x in xs]), True), None).otherwise(F.greatest(*xs))


def truncate(x: Column, n: int = 0) -> Column:
    scale = float(10**n)
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale


def strrpos(s: Column, part: str) -> Column:
    at = F.instr(F.reverse(s), part[::-1])
    return F.when(at == 0, 0).otherwise(F.length(s) - at - len(part) + 2)


#: MySQL date tokens and Java's (fixed values).
MYSQL_TOKENS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%l": "h", "%i": "mm", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%T": "HH:mm:ss", "%r": "hh:mm:ss a", "%%": "%"}


def mysql_pattern(pattern: str) -> str:
    """Java's pattern for a MySQL one; a token without a counterpart is an error."""
    out, i = "", 0
    while i < len(pattern):
        token = pattern[i : i + 2]
        if token in MYSQL_TOKENS:
            out, i = out + MYSQL_TOKENS[token], i + 2
        elif token[0] == "%":
            raise ValueError(f"date token {token} is not supported")
        else:
            out, i = out + (f"'{token[0]}'" if token[0].isalpha() else token[0]), i + 1
    return out


def mysql_format(ts: Column, pattern: str) -> Column:
    """ts in a MySQL pattern. ISO year and week (%x, %v), which Java's patterns here lack, are fields of their own."""
    parts, i, plain = [], 0, ""
    while i < len(pattern):
        token = pattern[i : i + 2]
        if token in ("%x", "%v"):
            parts += [plain, token]
            plain = ""
        else:
            plain += token if token[0] == "%" else token[0]
        i += 2 if token[0] == "%" else 1
    fields = {"%x": lambda: F.lpad(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), 4, "0"), "%v": lambda: F.lpad(F.weekofyear(ts).cast("string"), 2, "0")}
    columns = [fields[x]() if x in fields else F.date_format(ts, mysql_pattern(x)) for x in [*parts, plain] if x]
    return F.concat(*columns) if columns else F.lit("")


DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def from_base(s: Column, radix: int) -> Column:
    """The number that s writes in a base from 2 to 36; an error for anything else."""
    if not 2 <= radix <= 36:
        raise ValueError("Radix must be between 2 and 36.")
    digits = DIGITS[:radix] + DIGITS[10:radix].upper()
    value = F.conv(F.regexp_replace(s, "^[+-]", ""), radix, 10).cast("decimal(38,0)")
    signed = F.when(s.startswith("-"), -value).otherwise(value)
    # conv stops at the greatest unsigned long, which is out of range too
    inside = (F.length(F.regexp_replace(s, "^[+-]?0*", "")) <= 64) & signed.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
    number = F.when(inside, signed.cast("bigint")).otherwise(F.raise_error(F.concat(s, F.lit(" is out of range."))).cast("bigint"))
    return F.when(s.isNull(), None).when(s.rlike(f"^[+-]?[{digits}]+$"), number).otherwise(F.raise_error(F.concat(F.lit(f"Not a valid base-{radix} number: "), s, F.lit("."))).cast("bigint"))


def to_base(x: Column, radix: int) -> Column:
    if not 2 <= radix <= 36:
        raise ValueError("Radix must be between 2 and 36.")
    written = F.lower(F.conv(F.abs(x.cast("decimal(20,0)")).cast("string"), 10, radix))
    return F.when(x < 0, F.concat(F.lit("-"), written)).otherwise(written)


def array_sum(a: Column) -> Column:
    """Sum of the elements that are not null: bigint for integers, double for doubles, 0 for none."""
    known = F.array_compact(a)
    zero = F.when(F.lit(False), F.get(known, F.lit(0))).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(known, zero, lambda s, x: s + x)


def json_array_contains(j: Column, value) -> Column:
    """Whether a JSON array holds value, as a value of its own type: true is not "true", 1 is not "1"."""
    kind = F.schema_of_variant
    if isinstance(value, bool):
        same = lambda x: F.when(kind(x) == "BOOLEAN", x.cast("boolean") == value)
    elif isinstance(value, int):
        same = lambda x: F.when(kind(x) == "BIGINT", x.cast("bigint") == value)
    elif isinstance(value, float):
        same = lambda x: F.when((kind(x) == "DOUBLE") | kind(x).startswith("DECIMAL"), x.cast("double") == value)
    else:
        same = lambda x: F.when(kind(x) == "STRING", x.cast("string") == value)
    parsed = F.try_parse_json(j)
    return F.when(kind(parsed).startswith("ARRAY"), F.exists(parsed.cast("array<variant>"), lambda x: F.coalesce(same(x), F.lit(False))))


def subscript(a: Column, i) -> Column:
    """a[i], from 1: null past the end of an array or for a key that a map lacks, an error for places below 1."""
    i = _c(i)
    return F.when(F.typeof(a).startswith("array") & (i.try_cast("int") < 1), F.raise_error(F.lit("array subscripts start at 1")).cast("void")).otherwise(F.try_element_at(a, i))


def shift(name: str) -> Builder:
    return lambda x, n: F.call_function(name, x.cast("bigint"), _c(n))


def json_text(j: Column) -> Column:
    """JSON text in its plain form, keys in order; an error where j is not JSON."""
    return F.to_json(F.parse_json(j))


def zone_offset(ts: Column, zone: str, field: str) -> Column:
    """Hours, or minutes past them, that a zone's clock is ahead at an instant."""
    seconds = F.unix_timestamp(F.from_utc_timestamp(ts, zone)) - F.unix_timestamp(F.from_utc_timestamp(ts, "UTC"))
    minutes = (seconds / 60).cast("bigint")
    hours = F.when(minutes < 0, -F.floor(-minutes / 60)).otherwise(F.floor(minutes / 60))
    return hours.cast("bigint") if field == "hour" else (minutes - 60 * hours).cast("bigint")


def downsample(m: Column, interval: int, how: str, fill: str) -> Column:
    """Points of a map (time to value) combined in intervals, and gaps filled.

    how: sum, avg, max, min or count. A maximum starts at 0, so that buckets of
    negative values give 0. fill: none, zero, nan, or int for straight lines
    between the buckets next to a gap.
    """
    start_of = lambda t: t - t % F.lit(interval)
    times = F.map_keys(m)
    buckets = F.array_sort(F.array_distinct(F.transform(times, start_of)))
    values = lambda b: F.transform(F.filter(F.map_entries(m), lambda e: start_of(e["key"]) == b), lambda e: e["value"])
    total = lambda b: F.aggregate(values(b), F.lit(0.0), lambda s, x: s + x)
    combined = {
        "sum": total, "avg": lambda b: total(b) / F.size(values(b)), "count": lambda b: F.size(values(b)).cast("double"),
        "max": lambda b: F.greatest(F.lit(0.0), F.array_max(values(b))), "min": lambda b: F.array_min(values(b)),
    }[how]
    known = F.map_from_arrays(buckets, F.transform(buckets, combined))
    if fill == "none":
        return known
    every = F.when(F.size(buckets) > 0, F.sequence(F.array_min(buckets), F.array_max(buckets), F.lit(interval))).otherwise(buckets)

    def between(t: Column) -> Column:
        before, after = F.array_max(F.filter(buckets, lambda b: b < t)), F.array_min(F.filter(buckets, lambda b: b > t))
        low, high = combined(before), combined(after)
        return low + (t - before) * (high - low) / (after - before)

    gap = {"zero": lambda t: F.lit(0.0), "nan": lambda t: F.lit(float("nan")), "int": between}[fill]
    return F.map_from_arrays(every, F.transform(every, lambda t: F.when(F.array_contains(buckets, t), combined(t)).otherwise(gap(t))))


def combine(*maps: Column) -> Column:
    """All entries of maps; of a key that several have, the last one's value. Null maps count as empty."""
    out = None
    for m in maps:
        m = F.coalesce(m, F.map_filter(F.coalesce(*maps), lambda k, v: F.lit(False)))
        out = m if out is None else map_update(out, m)
    return out


def combine_arrays(*arrays: Column) -> Column:
    """Arrays one after another; null arrays count as empty."""
    return F.flatten(F.array_compact(F.array(*arrays)))


def wilson(successes: Column, trials: Column, z: float, sign: int) -> Column:
    p, zz = successes / trials, z * z
    return (p + zz / (2 * trials) + sign * z * F.sqrt(p * (1 - p) / trials + zz / (4 * trials * trials))) / (1 + zz / trials)


SPARK: dict[str, Builder] = {
    "array_slice_sum": array_slice_sum,
    "array_union_udf": lambda *a: F.array_distinct(F.flatten(F.array(*a))),
    "array_sort_desc": lambda a: F.sort_array(a, False),
    "bit_days_count": lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.bit_count(F.coalesce(x, F.lit(0).cast("long")))),
    "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b), "bitwise_not": F.bitwise_not,
    "equalto": lambda a, b: a == b, "lessthan": lambda a, b: a < b, "greaterthan": lambda a, b: a > b, "lessthanorequal": lambda a, b: a <= b, "greaterthanorequal": lambda a, b: a >= b, "equalnullsafe": lambda a, b: a.eqNullSafe(b),
    "not": lambda a: ~a, "between": lambda x, a, b: x.between(a, b), "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: F.try_divide(a, b), "remainder": lambda a, b: F.try_mod(a, b), "unaryminus": lambda a: -a,
    "pdate2date": lambda s: F.date_format(F.to_date(s, "yyyyMMdd"), "yyyy-MM-dd"), "date2pdate": lambda s: F.date_format(F.to_date(s, "yyyy-MM-dd"), "yyyyMMdd"),
    "week_of_year": F.weekofyear, "day_of_year": F.dayofyear, "day_of_week": F.dayofweek, "millisecond": lambda ts: F.date_format(ts, "SSS").cast("int"),
    "map_filter_keys": lambda m, keys: F.map_filter(m, lambda k, v: F.array_contains(keys, k)), "map_update": map_update,
    "string_to_long_array": lambda s: F.when(s != "", F.filter(F.transform(F.split(s, ","), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())),
    "string_repeat": F.repeat, "try_cast": lambda x, kind: x.try_cast(kind),
    "unscaled_value": lambda d, scale: (d * 10**scale).cast("bigint"), "empty2null": lambda s: F.nullif(s, F.lit("")), "json_to_map": lambda j: F.from_json(j, "map<string,string>"), "json_split": lambda j: F.from_json(j, "array<string>"),
    "decimal_greaterthan": lambda a, b: a > b, "decimal_greaterthanorequal": lambda a, b: a >= b, "decimal_lessthan": lambda a, b: a < b, "decimal_lessthanorequal": lambda a, b: a <= b, "decimal_equalto": lambda a, b: a == b, "decimal_notequalto": lambda a, b: a != b,
    "add_deny_precision_loss": udfs.decimal_arithmetic("+"), "subtract_deny_precision_loss": udfs.decimal_arithmetic("-"), "multiply_deny_precision_loss": udfs.decimal_arithmetic("*"), "divide_deny_precision_loss": udfs.decimal_arithmetic("/"),
    "get_timestamp": lambda s, p="yyyy-MM-dd HH:mm:ss": F.try_to_timestamp(s, F.lit(p)), "format_pdate": lambda s: F.date_format(F.coalesce(F.try_to_timestamp(s, F.lit("yyyyMMdd")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))), "yyyy-MM-dd"), "long_to_timestamp": lambda x, zone=None: F.timestamp_seconds(x) if zone is None else F.from_utc_timestamp(F.timestamp_seconds(x), zone),
    "doy": F.dayofyear, "dow": F.dayofweek, "json_tuple_with_codegen": lambda j, names: F.transform(F.array(*map(F.lit, names)), lambda n: F.try_element_at(F.from_json(j, "map<string,string>"), n)),
    "get_map_value": lambda m, k: F.try_element_at(m, _c(k)), "get_array_item": lambda a, i: F.get(a, _c(i)), "get_struct_field": lambda s, name: s[name], "get_array_struct_fields": lambda a, name: F.transform(a, lambda x: x[name]), "combine": combine, "combine_arrays": combine_arrays,
    "icu_regexp_replace": lambda s, p, r="": F.regexp_replace(s, p, r), "icu_regexp_extract": lambda s, p, g=1: F.regexp_extract(s, p, g), "icu_regexp_extract_all": lambda s, p, g=1: F.regexp_extract_all(s, F.lit(p), F.lit(g)), "icu_regexp": lambda s, p: s.rlike(p), "icu_rlike": lambda s, p: s.rlike(p), "icu_regexp_like": lambda s, p: s.rlike(p),
    "to_title": F.initcap, "str_to_long_arr": lambda s: SPARK["string_to_long_array"](s), "row_constructor": F.struct, "hive_hash": udfs.hive_hash,
    "hash_with_seed": udfs.murmur3_with_seed, "xxhash64_with_seed": udfs.xxhash64_with_seed, "might_contain": udfs.might_contain,
}

def _same(*names: str) -> dict[str, Builder]:
    """Names that mean in Presto what they mean in Spark."""
    return {n: SPARK[n] for n in names}


PRESTO: dict[str, Builder] = {
    **_same("bit_days_count", "millisecond", "date2pdate", "pdate2date", "json_to_map", "map_update", "map_filter_keys"),
    "plus": lambda a, b: a + b, "minus": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: a / b, "negate": lambda a: -a, "eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "lt": lambda a, b: a < b, "gt": lambda a, b: a > b, "lte": lambda a, b: a <= b, "gte": lambda a, b: a >= b,
    "is_null": F.isnull, "is_not_null": F.isnotnull, "starts_with": F.startswith, "ends_with": F.endswith, "day_of_month": F.dayofmonth, "timestampadd": lambda unit, n, x: F.timestamp_add(unit, _c(n), x), "timestampdiff": lambda unit, a, b: F.timestamp_diff(unit, a, b),
    "array_frequency": array_frequency, "array_duplicates": array_duplicates, "array_normalize": array_normalize, "array_has_duplicates": lambda a: F.size(F.array_distinct(a)) < F.size(a), "combinations": combinations, "ngrams": ngrams,
    "trim_array": lambda a, n: F.slice(a, F.lit(1), F.size(a) - n), "remove_nulls": F.array_compact, "all_match": F.forall, "any_match": F.exists, "none_match": lambda a, f: ~F.exists(a, f), "find_first": lambda a, f: F.get(F.filter(a, f), F.lit(0)),
    "find_first_index": lambda a, f: F.nullif(F.array_position(F.transform(a, f), True), F.lit(0)), "array_sum": array_sum, "array_average": lambda a: F.aggregate(F.array_compact(a), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(F.array_compact(a)), F.lit(0)),
    "array_sort_desc": lambda a: F.sort_array(a, False), "zip": F.arrays_zip, "contains": F.array_contains, "element": lambda a: F.when(F.size(a) > 1, F.raise_error(F.lit("more than one element")).cast("void")).otherwise(F.get(a, F.lit(0))), "single_element": lambda a: F.when(F.size(a) > 1, F.raise_error(F.lit("more than one element"))).otherwise(F.get(a, F.lit(0))),
    "md5": lambda b: F.unhex(F.md5(b)), "sha1": lambda b: F.unhex(F.sha1(b)), "sha256": lambda b: F.unhex(F.sha2(b, 256)), "sha512": lambda b: F.unhex(F.sha2(b, 512)), "xxhash64": udfs.presto_xxhash64, "to_hex": F.hex, "from_hex": F.unhex, "to_base64": F.base64, "from_base64": F.unbase64,
    "to_base64url": lambda b: F.translate(F.base64(b), "+/", "-_"), "from_base64url": lambda s: F.unbase64(F.translate(s, "-_", "+/")), "to_big_endian_64": lambda x: F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0")), "to_big_endian_32": lambda x: F.unhex(F.right(F.lpad(F.hex(x.cast("long")), 16, "0"), F.lit(8))),
    "from_big_endian_64": udfs.from_big_endian(8), "from_big_endian_32": udfs.from_big_endian(4), "to_ieee754_64": udfs.to_ieee754(">d"), "to_ieee754_32": udfs.to_ieee754(">f"), "from_ieee754_64": udfs.from_ieee754(">d"),
    "hmac_md5": udfs.hmac("md5"), "hmac_sha1": udfs.hmac("sha1"), "hmac_sha256": udfs.hmac("sha256"), "hmac_sha512": udfs.hmac("sha512"),
    "day_of_week": lambda d: F.weekday(d) + 1, "dow": lambda d: F.weekday(d) + 1, "day_of_year": F.dayofyear, "doy": F.dayofyear, "week": F.weekofyear, "week_of_year": F.weekofyear, "year_of_week": lambda d: F.extract(F.lit("YEAROFWEEK"), d), "yow": lambda d: F.extract(F.lit("YEAROFWEEK"), d), "last_day_of_month": F.last_day,
    "date_add": lambda unit, n, x: F.timestamp_add(unit, _c(n), x), "date_diff": lambda unit, a, b: F.timestamp_diff(unit, a, b), "date_format": mysql_format, "date_parse": lambda s, p: F.to_timestamp(s, mysql_pattern(p)), "format_datetime": lambda ts, p: F.date_format(ts, p), "parse_datetime": lambda s, p: F.to_timestamp(s, p),
    "to_unixtime": lambda ts: ts.cast("double"), "from_unixtime": lambda x: F.timestamp_seconds(x), "least": presto_least, "greatest": presto_greatest, "clamp": lambda x, lo, hi: F.least(F.greatest(x, lo), hi), "truncate": truncate, "from_base": from_base, "to_base": to_base, "to_bigint": lambda x: x.cast("bigint"), "to_integer": lambda x: x.cast("int"),
    "infinity": lambda: F.lit(float("inf")), "nan": lambda: F.lit(float("nan")), "is_nan": F.isnan, "is_finite": lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")), "is_infinite": lambda x: F.abs(x) == float("inf"), "cosine_similarity": cosine_similarity, "wilson_interval_lower": lambda s, n, z: wilson(s, n, z, -1), "wilson_interval_upper": lambda s, n, z: wilson(s, n, z, 1),
    "normal_cdf": udfs.normal_cdf, "inverse_normal_cdf": udfs.inverse_normal_cdf, "binomial_cdf": udfs.binomial_cdf, "poisson_cdf": udfs.poisson_cdf, "gamma_cdf": udfs.gamma_cdf, "chi_squared_cdf": udfs.chi_squared_cdf, "beta_cdf": udfs.beta_cdf, "f_cdf": udfs.f_cdf,
    "cauchy_cdf": lambda m, s, x: 0.5 + F.atan((x - m) / s) / F.pi(), "weibull_cdf": lambda a, b, x: 1 - F.exp(-F.pow(x / b, _c(a))), "laplace_cdf": lambda m, b, x: F.when(x < m, 0.5 * F.exp((x - m) / b)).otherwise(1 - 0.5 * F.exp((m - x) / b)),
    "split": lambda s, d: F.split(s, _quoted(d)), "split_to_map": lambda s, a, b: F.str_to_map(s, F.lit(_quoted(a)), F.lit(_quoted(b))), "strpos": lambda s, p: F.instr(s, p), "strrpos": strrpos, "to_utf8": lambda s: F.encode(s, "UTF-8"), "from_utf8": lambda b: F.decode(b, "UTF-8"), "codepoint": F.ascii, "levenshtein_distance": F.levenshtein,
    "regexp_extract": lambda s, p, g=0: F.when(s.rlike(p), F.regexp_extract(s, p, g)), "regexp_replace": lambda s, p, r="": F.regexp_replace(s, p, r), "regexp_split": lambda s, p: F.split(s, p),
    "json_extract_scalar": lambda j, p: F.when(~F.get_json_object(j, p).rlike(r"^[\[{]"), F.get_json_object(j, p)), "json_extract": F.get_json_object, "json_array_contains": json_array_contains, "json_parse": json_text, "json_format": json_text, "json_split": lambda j: F.from_json(j, "array<string>"), "get_json_object_detect_bad_json": lambda j, p: F.when(F.try_parse_json(j).isNotNull(), PRESTO["json_extract_scalar"](j, p)), "is_json_scalar": lambda j: ~F.trim(j).rlike(r"^[\[{]"), "json_size": lambda j, p: F.coalesce(F.json_array_length(F.get_json_object(j, p)), F.size(F.json_object_keys(F.get_json_object(j, p))), F.lit(0)),
    "all_keys_match": lambda m, f: F.forall(F.map_keys(m), f), "any_keys_match": lambda m, f: F.exists(F.map_keys(m), f), "no_keys_match": lambda m, f: ~F.exists(F.map_keys(m), f), "any_values_match": lambda m, f: F.exists(F.map_values(m), f), "no_values_match": lambda m, f: ~F.exists(F.map_values(m), f), "multimap_from_entries": multimap_from_entries,
    "url_extract_host": lambda u: F.parse_url(u, F.lit("HOST")), "url_extract_path": lambda u: F.parse_url(u, F.lit("PATH")), "url_extract_protocol": lambda u: F.parse_url(u, F.lit("PROTOCOL")), "url_extract_query": lambda u: F.parse_url(u, F.lit("QUERY")), "url_extract_fragment": lambda u: F.parse_url(u, F.lit("REF")), "url_extract_parameter": lambda u, k: F.parse_url(u, F.lit("QUERY"), F.lit(k)), "url_extract_port": lambda u: F.nullif(F.regexp_extract(F.parse_url(u, F.lit("AUTHORITY")), r":(\d+)$", 1), F.lit("")).cast("bigint"),
    "bitwise_and": lambda a, b: a.cast("bigint").bitwiseAND(b.cast("bigint")), "bitwise_or": lambda a, b: a.cast("bigint").bitwiseOR(b.cast("bigint")), "bitwise_xor": lambda a, b: a.cast("bigint").bitwiseXOR(b.cast("bigint")), "bitwise_not": lambda a: F.bitwise_not(a.cast("bigint")), "bitwise_arithmetic_shift_right": shift("shiftright"), "bitwise_left_shift": shift("shiftleft"), "bitwise_right_shift": shift("shiftrightunsigned"),
    "subscript": subscript, "bitwise_right_shift_arithmetic": shift("shiftright"), "bitwise_shift_left": shift("shiftleft"), "bitwise_logical_shift_right": shift("shiftrightunsigned"),
    "$internal$canonicalize": F.array_sort, "$internal$contains": F.array_contains, "array_constructor": F.array, "row_constructor": F.struct, "concat_ws_spark": lambda sep, *x: F.call_function("concat_ws", _c(sep), *x), "downsample": downsample, "inverse_beta_cdf": udfs.inverse_beta_cdf, "spooky_hash_v2_32": udfs.spooky_hash_v2_32, "spooky_hash_v2_64": udfs.spooky_hash_v2_64,
    "timezone_hour": lambda ts, zone: zone_offset(ts, zone, "hour"), "timezone_minute": lambda ts, zone: zone_offset(ts, zone, "minute"), "empty_approx_set": lambda: F.expr("(SELECT hll_sketch_agg(x, 12) FROM VALUES (1) AS t(x) WHERE x > 1)"),
    "cardinality": F.size, "reduce": F.aggregate, "distinct_from": lambda a, b: ~a.eqNullSafe(b),
}

FLINK: dict[str, Builder] = {
    "is_alpha": lambda s: F.coalesce(s.rlike(r"^\p{L}+$"), F.lit(False)), "is_digit": lambda s: F.coalesce(s.rlike(r"^\p{Nd}+$"), F.lit(False)), "is_decimal": lambda s: F.coalesce(s.try_cast("decimal(38,18)").isNotNull(), F.lit(False)),
    "split_index": lambda s, d, i: F.when(s != "", F.get(F.split(s, _quoted(chr(d) if isinstance(d, int) else d)), F.lit(i))), "localtimestamp": F.localtimestamp, "current_row_timestamp": F.current_timestamp, "unix_timestamp": F.unix_timestamp, "rand_integer": lambda seed, n: F.floor(F.rand(seed) * n).cast("int"), "json_to_map": lambda j: F.from_json(j, "map<string,string>"), "json_to_array": lambda j: F.from_json(j, "array<string>"),
    "json_str_to_map": lambda j: F.from_json(j, "map<string,string>"), "json_str_to_array": lambda j: F.from_json(j, "array<string>"), "flink_unix_timestamp": F.unix_timestamp, "flink_from_unixtime": F.from_unixtime,
    "flink_decimal_add": udfs.decimal_arithmetic("+", True), "flink_decimal_subtract": udfs.decimal_arithmetic("-", True), "flink_decimal_multiply": udfs.decimal_arithmetic("*", True),
}
DIALECTS = {"spark": SPARK, "presto": PRESTO, "flink": FLINK}


def function(name: str, dialect: str = "spark") -> Builder:
    """A dialect's function by name, scalar or aggregate: its own form, or Spark's of that name."""
    own = DIALECTS[dialect].get(name.lower()) or AGGREGATES.get(name.lower())
    return own or (lambda *columns: F.call_function(name, *map(_c, columns)))
