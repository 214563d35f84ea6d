"""Memory of executors: batches on their way to Python are bounded in bytes, and workers give back what they have freed."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from lumenframe.llm import common


def rss() -> float:
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_texts_reach_python_in_small_batches(spark):
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat(cast(id % 10 AS string), 10000) AS text")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "size"]) for b in batches)
    found = common.id_and_text(docs).mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r.rows for r in found) == 3000
    assert max(r.size for r in found) < 2 * common.BATCH_BYTES


def test_own_bound_of_a_session_stays(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "123456")
    common.small_batches(other)
    assert other.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "123456"


def test_freed_memory_is_given_back():
    def run(batches):
        # small blocks below one that lives on: the allocator keeps them for itself
        many = [np.ones(50) for _ in range(400_000)]
        kept.append(np.ones(50))
        yield from batches
        assert rss() - before > 100 and many

    kept, before = [], rss()
    assert list(common.lean(run)(iter([1, 2]))) == [1, 2]
    assert rss() - before < 60
