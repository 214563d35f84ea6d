"""Functions that built-ins cannot express, over Arrow batches."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import math
import struct
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


TYPES = {"binary": T.BinaryType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _each(f: Callable, kind: pa.DataType, returns: str) -> Callable[..., Column]:
    """A null-in, null-out Arrow UDF from a function of one row's values."""

    @F.arrow_udf(TYPES[returns])  # a name would be parsed by a running session
    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([None if any(v is None for v in r) else f(*r) for r in rows], kind)

    return lambda *c: run(*(x if isinstance(x, (Column, str)) else F.lit(x) for x in c))


def _bytes(x) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def hmac(name: str) -> Callable[..., Column]:
    return _each(lambda data, key: _hmac.new(_bytes(key), _bytes(data), getattr(hashlib, name)).digest(), pa.binary(), "binary")


def to_ieee754(form: str) -> Callable[..., Column]:
    return _each(lambda x: struct.pack(form, x), pa.binary(), "binary")


def from_ieee754(form: str) -> Callable[..., Column]:
    return _each(lambda b: struct.unpack(form, b)[0], pa.float64(), "double")


def from_big_endian(size: int) -> Callable[..., Column]:
    return _each(lambda b: int.from_bytes(b[-size:], "big", signed=True), pa.int64(), "long")


presto_xxhash64 = _each(lambda b: xxhash.xxh64_digest(_bytes(b), 0), pa.binary(), "binary")


def xxhash64_with_seed(seed: int, *columns: Column) -> Column:
    """XXH64 of strings with a seed, each column seeding the next."""

    @F.arrow_udf("long")
    def run(*arrays: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(a.to_pylist() for a in arrays), strict=True):
            h = seed
            for v in row:
                if v is not None:
                    h = xxhash.xxh64_intdigest(_bytes(v), h % 2**64)
            out.append((h + 2**63) % 2**64 - 2**63)
        return pa.array(out, pa.int64())

    return run(*(c.cast("string") for c in columns))


def _murmur3(data: bytes, seed: int) -> int:
    """Murmur3 x86 32 with the tail byte by byte, as Spark has it."""
    rot = lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF

    def mixed(h: int, k: int) -> int:
        k = rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        return (rot(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF

    h, whole = seed & 0xFFFFFFFF, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = mixed(h, int.from_bytes(data[i : i + 4], "little"))
    for b in data[whole:]:
        h = mixed(h, (b - 256 if b > 127 else b) & 0xFFFFFFFF)
    h ^= len(data)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * by & 0xFFFFFFFF
    return h ^ h >> 16


def murmur3_with_seed(seed: int, *columns: Column) -> Column:
    @F.arrow_udf("int")
    def run(*arrays: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(a.to_pylist() for a in arrays), strict=True):
            h = seed
            for v in row:
                if v is not None:
                    h = _murmur3(_bytes(v), h)
            out.append((h + 2**31) % 2**32 - 2**31)
        return pa.array(out, pa.int32())

    return run(*(c.cast("string") for c in columns))


def _murmur3_longs(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Murmur3 x86 32 of unsigned longs, with a seed for each."""
    rot = lambda v, r: v << np.uint32(r) | v >> np.uint32(32 - r)
    h = seed
    for k in (x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)):
        k = rot(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rot(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(8)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(by)
    return h ^ h >> np.uint32(16)


def might_contain(filter_bytes: bytes, column: Column) -> Column:
    """Membership of longs in a Bloom filter serialised by Spark (versions 1 and 2, big-endian)."""
    version, hashes = struct.unpack(">ii", filter_bytes[:8])
    if version not in (1, 2):
        raise ValueError(f"Bloom filter version {version} is not supported")
    seed = struct.unpack(">i", filter_bytes[8:12])[0] if version == 2 else 0
    at = 8 if version == 1 else 12
    (words,) = struct.unpack(">i", filter_bytes[at : at + 4])
    bits = np.frombuffer(filter_bytes, ">u8", words, at + 4).astype(np.uint64)

    @F.arrow_udf(TYPES["boolean"])
    def found(x: pa.Array) -> pa.Array:
        data = x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        first = _murmur3_longs(data, np.full(len(data), seed % 2**32, np.uint32))
        a, b = (h.view(np.int32).astype(np.int64) for h in (first, _murmur3_longs(data, first)))
        hit = np.ones(len(data), bool)
        for i in range(1, hashes + 1):
            # version 2 steps through 64 bits, so that large filters are used whole
            h = (a + i * b).astype(np.int32).astype(np.int64) if version == 1 else a * (2**31 - 1) + i * b
            h = np.where(h < 0, ~h, h) % (64 * words)
            hit &= (bits[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pa.array(hit, mask=x.is_null().to_numpy(zero_copy_only=False))

    return found(column.cast("long"))


def _incomplete_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b or 1e-300), b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - scale * h


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d or 1e-300), 1 + k / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _cdf(f: Callable) -> Callable[..., Column]:
    return _each(f, pa.float64(), "double")


normal_cdf = _cdf(lambda mean, sd, x: 0.5 * math.erfc((mean - x) / (sd * math.sqrt(2))))
inverse_normal_cdf = _cdf(lambda mean, sd, p: NormalDist(mean, sd).inv_cdf(p))
poisson_cdf = _cdf(lambda rate, k: 1 - _incomplete_gamma(math.floor(k) + 1, rate))
gamma_cdf = _cdf(lambda shape, scale, x: _incomplete_gamma(shape, x / scale))
chi_squared_cdf = _cdf(lambda df, x: _incomplete_gamma(df / 2, x / 2))
beta_cdf = _cdf(_incomplete_beta)
f_cdf = _cdf(lambda a, b, x: _incomplete_beta(a / 2, b / 2, a * x / (a * x + b)))
binomial_cdf = _cdf(lambda n, p, k: 1.0 if k >= n else 0.0 if k < 0 else _incomplete_beta(n - math.floor(k), math.floor(k) + 1, 1 - p))


def _inverse_beta(a: float, b: float, p: float) -> float:
    """The x with _incomplete_beta(a, b, x) = p, by halving the interval."""
    if not 0 <= p <= 1 or a <= 0 or b <= 0:
        raise ValueError("inverse_beta_cdf needs a, b > 0 and 0 <= p <= 1")
    low, high = 0.0, 1.0
    while (middle := (low + high) / 2) not in (low, high):
        if _incomplete_beta(a, b, middle) < p:
            low = middle
        else:
            high = middle
    return high if p > 0 else 0.0


inverse_beta_cdf = _cdf(_inverse_beta)

#: SpookyHash V2, published algorithm: its constant and the rotations of its rounds (fixed values).
_SPOOKY = 0xDEADBEEFDEADBEEF
_LONG_ROTATIONS = (11, 32, 43, 31, 17, 28, 39, 57, 55, 54, 22, 46)
_LONG_END_ROTATIONS = (44, 15, 34, 21, 38, 33, 10, 13, 38, 53, 42, 54)
_SHORT_ROTATIONS = (50, 52, 30, 41, 54, 48, 38, 37, 62, 34, 5, 36)
_SHORT_END_ROTATIONS = (15, 52, 26, 51, 28, 9, 47, 54, 32, 25, 63)
_M64 = 2**64 - 1


def _rotated(x: int, k: int) -> int:
    return (x << k | x >> (64 - k)) & _M64


def _spooky_short(data: bytes) -> int:
    """First half of the 128-bit hash of fewer than 192 bytes, with seed 0."""
    h, n = [0, 0, _SPOOKY, _SPOOKY], len(data)
    word = lambda i: int.from_bytes(data[i : i + 8], "little")

    def mix() -> None:
        for k, r in enumerate(_SHORT_ROTATIONS):
            x, y, z = (k + 2) % 4, (k + 3) % 4, k % 4
            h[x] = (_rotated(h[x], r) + h[y]) & _M64
            h[z] ^= h[x]

    at = 0
    while n - at >= 32:
        h[2], h[3] = (h[2] + word(at)) & _M64, (h[3] + word(at + 8)) & _M64
        mix()
        h[0], h[1] = (h[0] + word(at + 16)) & _M64, (h[1] + word(at + 24)) & _M64
        at += 32
    if n - at >= 16:
        h[2], h[3] = (h[2] + word(at)) & _M64, (h[3] + word(at + 8)) & _M64
        mix()
        at += 16
    h[3] = (h[3] + (n << 56)) & _M64
    if at < n:
        h[2] = (h[2] + int.from_bytes(data[at : min(at + 8, n)], "little")) & _M64
        h[3] = (h[3] + int.from_bytes(data[at + 8 : n], "little")) & _M64
    else:
        h[2], h[3] = (h[2] + _SPOOKY) & _M64, (h[3] + _SPOOKY) & _M64
    for k, r in enumerate(_SHORT_END_ROTATIONS):
        x, y = (k + 3) % 4, (k + 2) % 4
        h[x] ^= h[y]
        h[y] = _rotated(h[y], r)
        h[x] = (h[x] + h[y]) & _M64
    return h[0]


def _spooky_long(data: bytes) -> int:
    """First half of the 128-bit hash of 192 bytes and more: twelve words in turn."""
    h = [0, 0, _SPOOKY] * 4
    whole = len(data) // 96 * 96
    tail = (data[whole:] + bytes(96 - (len(data) - whole) - 1)) + bytes([len(data) - whole])
    for at in range(0, whole, 96):
        for k, r in enumerate(_LONG_ROTATIONS):
            h[k] = (h[k] + int.from_bytes(data[at + 8 * k : at + 8 * k + 8], "little")) & _M64
            h[(k + 2) % 12] ^= h[(k + 10) % 12]
            h[(k + 11) % 12] ^= h[k]
            h[k] = _rotated(h[k], r)
            h[(k + 11) % 12] = (h[(k + 11) % 12] + h[(k + 1) % 12]) & _M64
    for k in range(12):
        h[k] = (h[k] + int.from_bytes(tail[8 * k : 8 * k + 8], "little")) & _M64
    for _ in range(3):
        for k, r in enumerate(_LONG_END_ROTATIONS):
            x, y, z = (k + 11) % 12, (k + 1) % 12, (k + 2) % 12
            h[x] = (h[x] + h[y]) & _M64
            h[z] ^= h[x]
            h[y] = _rotated(h[y], r)
    return h[0]


def spooky(data: bytes) -> int:
    return _spooky_short(data) if len(data) < 192 else _spooky_long(data)


spooky_hash_v2_64 = _each(lambda b: spooky(_bytes(b)).to_bytes(8, "big"), pa.binary(), "binary")
spooky_hash_v2_32 = _each(lambda b: (spooky(_bytes(b)) & 0xFFFFFFFF).to_bytes(4, "big"), pa.binary(), "binary")


def _hive(v) -> int:
    """Hive's 32-bit hash of one value."""
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        v = struct.unpack(">q", struct.pack(">d", v + 0.0))[0]
    if isinstance(v, int):
        return v if -(2**31) <= v < 2**31 else (v ^ (v % 2**64 >> 32)) & 0xFFFFFFFF
    h = 0
    for b in _bytes(v):
        h = (31 * h + (b - 256 if b > 127 else b)) & 0xFFFFFFFF
    return h


def hive_hash(*columns: Column) -> Column:
    """Hive's hash of integers, doubles, booleans and strings: 31 times the hash so far and the next one's; nulls count as 0."""

    @F.arrow_udf(T.IntegerType())
    def run(*arrays: pa.Array) -> pa.Array:
        out = []
        wide = [pa.types.is_int64(a.type) for a in arrays]
        for row in zip(*(a.to_pylist() for a in arrays), strict=True):
            h = 0
            for v, long in zip(row, wide, strict=True):
                one = 0 if v is None else (v ^ (v % 2**64 >> 32)) if long else _hive(v)
                h = (31 * h + one) & 0xFFFFFFFF
            out.append((h + 2**31) % 2**32 - 2**31)
        return pa.array(out, pa.int32())

    return run(*columns)


def decimal_type(op: str, left: tuple[int, int], right: tuple[int, int], lossy: bool) -> tuple[int, int]:
    """Precision and scale of left op right. Lossy: digits after the point give way to those before it; else both are cut at 38."""
    (p1, s1), (p2, s2) = left, right
    if op in "+-":
        s = max(s1, s2)
        p = max(p1 - s1, p2 - s2) + s + 1
    elif op == "*":
        p, s = p1 + p2 + 1, s1 + s2
    elif lossy:
        s = max(6, s1 + p2 + 1)
        p = p1 - s1 + s2 + s
    else:
        before, s = min(38, p1 - s1 + s2), min(38, max(6, s1 + p2 + 1))
        if before + s > 38:
            s -= (before + s - 38) // 2 + 1
            before = 38 - s
        p = before + s
    if p <= 38:
        return p, s
    return (38, max(38 - (p - s), min(s, 6))) if lossy else (38, min(s, 38))


def decimal_arithmetic(op: str, lossy: bool = False) -> Callable[..., Column]:
    """A decimal operator of columns and their (precision, scale); null where the result does not fit or the divisor is 0."""
    from decimal import ROUND_HALF_UP, Context, Decimal

    def build(a: Column, b: Column, left: tuple[int, int], right: tuple[int, int]) -> Column:
        p, s = decimal_type(op, left, right, lossy)
        a, b = a.cast(T.DecimalType(*left)), b.cast(T.DecimalType(*right))
        exact, unit, most = Context(prec=160), Decimal(1).scaleb(-s), Decimal(10) ** (p - s)
        calculate = {"+": exact.add, "-": exact.subtract, "*": exact.multiply, "/": exact.divide}[op]

        def one(x: Decimal, y: Decimal) -> Decimal | None:
            if op == "/" and not y:
                return None
            r = calculate(x, y).quantize(unit, ROUND_HALF_UP, exact)
            return r if abs(r) < most else None

        @F.arrow_udf(T.DecimalType(p, s))
        def run(x: pa.Array, y: pa.Array) -> pa.Array:
            return pa.array([None if v is None or w is None else one(v, w) for v, w in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.decimal128(p, s))

        return run(a, b)

    return build
