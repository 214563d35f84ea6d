"""Queries that read whole tables, on tables where a cut by id or by length would show."""

import datetime
import os

import pyarrow as pa
import pyarrow.parquet as pq

from lumenframe import plans


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def run(name, spark, folder):
    return sorted(map(tuple, plans.QUERIES[name](spark, str(folder)).collect()))


def test_range_join_and_scan_take_every_order(spark, tmp_path):
    lines = [(k, k, 1, float(q), 1000.0, 0.05) for k, q in ((1, 1), (1999, 2), (2000, 2), (9000, 2), (90_000, 3), (900_000, 40))]
    put(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double")
    put(spark, tmp_path, "part", [(1, 2), (2, 3), (3, 41), (4, 20)], "p_partkey long, p_size int")
    assert run("join_range", spark, tmp_path) == [(1, 4), (2, 4), (3, 1)]
    assert [r[0] for r in run("scan_filter_project", spark, tmp_path)] == [1, 1999, 2000, 9000, 90_000]


def test_unnest_takes_whole_arrays_of_any_length(spark, tmp_path):
    long = [float(i) for i in range(70)]
    put(spark, tmp_path, "embeddings", [(1, [0.5, 1.5]), (2, long), (3, []), (4, None), (5, [2.0])], "vec_id long, embedding array<float>")
    want = [(1, 1, 0.5), (1, 2, 1.5), *((2, i + 1, x) for i, x in enumerate(long)), (5, 1, 2.0)]
    assert run("unnest_ordinality", spark, tmp_path) == want
    assert run("unnest_array", spark, tmp_path) == sorted((i, x) for i, _, x in want)


def test_callback_consumes_every_order(spark, tmp_path):
    put(spark, tmp_path, "orders", [(k,) for k in (1, 2, 3, 5, 7)], "o_orderkey long")
    assert run("callback_sink", spark, tmp_path) == [(5,)]


def test_stream_deduplication_over_many_batches(spark, tmp_path):
    """More files than one trigger takes, the oldest events in the last ones."""
    (tmp_path / "events.parquet").mkdir()
    zero = datetime.datetime(2024, 1, 1)
    for i in range(103):
        file = tmp_path / "events.parquet" / f"part-{i:03}.parquet"
        late = i if i < 100 else -i
        pq.write_table(pa.table({"event_id": [i, i // 2], "ts": pa.array([zero + datetime.timedelta(days=late)] * 2, pa.timestamp("us"))}), file)
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    assert run("stream_deduplicated", spark, tmp_path) == [(103,)]
