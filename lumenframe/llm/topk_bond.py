"""Exact top-k inner products by columnar branch-and-bound.

Vectors are kept in vertical layout, dimension after dimension, the dimensions of
most mass first. For one query, scores are accumulated a block of dimensions at a
time. After each block, a candidate whose partial score plus the most that the
remaining dimensions can add (the product of the two remaining norms, by
Cauchy-Schwarz) is below the k-th best score known is dropped, and the survivors
are compacted. What is left at the end has its exact score.

All pairs of one block of queries and one block of candidates are one task of
bounded size. Each block of queries first meets one block of candidates; the k-th
best score found there goes with the query to all other blocks, which so prune
from the start. Each candidate is sent once for each block of queries and the
other way round, and a task returns k rows for each query, so what is shuffled is
(candidates x query blocks + queries x candidate blocks) vectors. Rows are dealt
to blocks by a hash of their number, so equal vectors do not meet in one task.

Every row counts by itself: a query's candidates are all rows but its own, among
them other rows of its id. Vectors that are null or hold null or non-finite
components take no part. An empty vector scores 0 with all, and a shorter one
counts as padded with zeros, however long others are. Components saturate at the
range of long, and so do scores. Ties go to the smaller id; a row without an id is
no query, and as a candidate comes after all ids. Fewer than k candidates give
fewer rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised

#: Rows in a block of candidates and in a block of queries, on average.
CANDIDATES, QUERIES = 8192, 1024
#: Dimensions added between two looks at the bounds.
STEP = 8
_OUT = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
#: An id after all others, for rows that have none.
LAST = 2**63 - 1


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of int64, padded with zeros to the same width."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def search(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, known: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best among vectors of another row, by places in the two arrays.

    known: for each query a score that k other candidates reach, or None. Candidates that cannot reach it may be left out.
    """
    width = vectors.shape[1]
    most = int(max(np.abs(queries.astype(object)).max(initial=0), 1)) * int(max(np.abs(vectors.astype(object)).max(initial=0), 1)) * max(1, width)
    # below 2**53 doubles hold every partial sum exactly; beyond, Python's integers do
    kind = np.float64 if most < 2**53 else object
    mass = (vectors.astype(np.float64) ** 2).sum(0) * (queries.astype(np.float64) ** 2).sum(0)
    order = np.argsort(-mass, kind="stable")
    queries, vectors = queries[:, order], vectors[:, order]
    columns = np.ascontiguousarray(vectors.T.astype(kind))
    cuts = [*range(0, width, STEP), width]
    squares = (vectors.astype(np.float64) ** 2).T
    rest = np.sqrt(np.stack([squares[c:].sum(0) for c in cuts])) if width else np.zeros((len(cuts), len(rows)))
    out = []
    for i, (q, own) in enumerate(zip(queries, query_rows.tolist(), strict=True)):
        q_rest = [float(np.sqrt((q[c:].astype(np.float64) ** 2).sum())) for c in cuts]
        q = q.astype(kind)
        alive = np.flatnonzero(rows != own)
        score = np.zeros(len(alive), kind)
        least, looked = (known[i] if known is not None else None), False
        for b in range(len(cuts) - 1):
            lo, hi = cuts[b], cuts[b + 1]
            block = columns[lo:hi] if len(alive) == len(rows) else columns[lo:hi, alive]
            score = score + q[lo:hi] @ block
            if hi == width:
                break
            if not looked and len(alive) > k:
                # finish the most promising few, for a k-th best of this block
                first = np.argpartition(-score.astype(np.float64), k - 1)[: 4 * k] if len(alive) > 4 * k else np.arange(len(alive))
                exact = score[first] + q[hi:] @ columns[hi:, alive[first]]
                here, looked = float(np.sort(exact.astype(np.float64))[-k]), True
                least = here if least is None else max(least, here)
            if least is None:
                continue
            reach = score.astype(np.float64) + q_rest[b + 1] * rest[b + 1, alive]
            keep = reach >= least - 1 - 1e-9 * abs(least)
            if not keep.all():
                alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score))[:k] if kind is not object else np.array(sorted(range(len(alive)), key=lambda j: (-score[j], ids[alive[j]]))[:k], np.int64)
        values = score[best]
        values = values.astype(np.int64) if kind is not object else np.array([min(max(int(v), -(2**63)), 2**63 - 1) for v in values], np.int64)
        out.append((np.full(len(values), i), alive[best], values))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score from rows (vec_id long, v array<long>)."""
    # numbered in a written table, so that a row keeps its number whatever is computed again
    vectors = materialised(vectors.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("is_query")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_queries = vectors.agg(F.count("*"), F.count_if("is_query")).first()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n_queries // QUERIES))
    c_block, q_block = F.pmod(F.xxhash64("row"), F.lit(c_blocks)).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(q_blocks)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = vectors.select(c_block.alias("c"), each(q_blocks).alias("q"), F.lit(False).alias("asks"), "row", "vec_id", "v", F.lit(None).cast("long").alias("known"))
    queries = vectors.filter("is_query").withColumn("q", q_block)

    def tile(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v, asks, rows = table.column("v").combine_chunks(), table.column("asks").to_numpy(), table.column("row").to_numpy()
        ids = table.column("vec_id").combine_chunks()
        width = int(np.diff(v.offsets.to_numpy()).max(initial=0))
        matrix = _matrix(v, width)
        own, other = np.flatnonzero(asks), np.flatnonzero(~asks)
        known = table.column("known").take(pa.array(own)).to_pylist()
        q, c, score = search(matrix[own], rows[own], matrix[other], rows[other], ids.fill_null(LAST).to_numpy()[other], k, known)
        return pa.Table.from_arrays([pa.array(rows[own][q]), ids.take(pa.array(own[q])), ids.take(pa.array(other[c])), pa.array(score)], schema=_OUT)

    def met(queries: DataFrame, home: bool) -> DataFrame:
        """What queries find in their home block of candidates, or in all others."""
        at_home = F.col("c") == F.col("q") % c_blocks
        asked = queries.select(each(c_blocks).alias("c"), "q", F.lit(True).alias("asks"), "row", "vec_id", "v", "known")
        both = candidates.unionByName(asked).filter(at_home if home else ~at_home)
        return both.groupBy("c", "q").applyInArrow(tile, "query_row long, query_id long, vec_id long, score long")

    found = met(queries.withColumn("known", F.lit(None).cast("long")), True)
    if c_blocks > 1:
        found = materialised(found, "first-tiles")
        known = found.groupBy("query_row").agg(F.min("score").alias("known"), F.count("*").alias("n")).filter(F.col("n") == k).select(F.col("query_row").alias("row"), "known")
        found = found.unionByName(met(queries.join(known, "row", "left"), False))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) with v = floor(256 * x), for each row that takes part."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.filter(F.col("e").isNotNull() & sound).select("vec_id", F.transform("e", lambda x: F.floor(256 * x)).alias("v"))


def op4_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 best of ``embeddings`` for each row whose id 50 divides."""
    return top_k(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 50 == 0, 5)


SQL = """
WITH n AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
    SELECT r, vec_id, list_resize(e, (SELECT max(len(e)) + 1 FROM n), 0) AS e FROM n
), s AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""
