"""Pipeline stages on a table whose other columns have the names that the stages use themselves, with nulls everywhere."""

import random

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import fm_dedup, packing, quality_bt, quality_rules, simhash_vptree, simple8b, topk_bond, toxicity_gbt
from lumenframe.llm.common import shared_dir
from lumenframe.llm.tokens import vocabulary_path

CLASH = "_key _spans _new passages first last digest words at n anchors anchor key level spans shard fp component_id root _kept _fp _fp_of _root _nth _several _toxicity _t _words _lines _n_words _hashes _kept_1 _id _of id band reached label score predicted held_out row is_query known part h".split()


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(90)) for _ in range(12)]
    texts += [f"{word()} {passage} {word()}" for _ in range(4)] + [texts[0], texts[0], "", None, "short"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (3, texts[3]), (3, texts[5])]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    return plain.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in CLASH)).repartition(2).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(12)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("stage", ["quality", "toxicity", "near", "substring"])
def test_stages_carry_columns_of_any_name(docs, labels, stage):
    run = {"quality": lambda d: quality_rules.filter_quality(d, labels), "toxicity": lambda d: toxicity_gbt.filter_toxic(d, labels), "near": simhash_vptree.keep_one_each, "substring": fm_dedup.remove_repeated}[stage]
    plain = run(docs.select("doc_id", "text"))
    got = run(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(map(tuple, plain.collect()), key=str) and rows
    assert all(r[c] == (None if r.doc_id is None else f"{c}:{r.doc_id}") for r in rows for c in CLASH)


def test_queries_do_not_mind_other_columns(spark, docs, labels):
    vocabulary = vocabulary_path("byte_bpe_50k.json")
    assert packing.pack(docs, vocabulary).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert quality_bt.score_texts(docs, quality_bt.fit(docs, labels)).count() == docs.count()
    files = simple8b.write_token_files(docs, shared_dir(spark), vocabulary)
    assert sum(f[2] for f in files) == docs.count()
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>").select("*", *(F.lit(1).alias(c) for c in CLASH))
    assert topk_bond.top_k(topk_bond.quantised(vectors), F.col("vec_id") % 50 == 0).count() == 2
