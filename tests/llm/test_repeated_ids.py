"""Near-duplicate removal where rows of one id hold different texts."""

import random

from lumenframe.llm import simhash_vptree


def test_op3_rows_of_one_id_in_different_components(spark):
    rnd = random.Random(9)
    text = lambda first: " ".join([first, *("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60))])
    alone, copied, other, third = text("zz"), text("aa"), text("mm"), text("kk")
    rows = [(3, copied), (7, alone), (7, copied), (7, other), (7, other), (8, third), (9, third), (None, alone)]
    kept = simhash_vptree.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    want = [(3, copied), (7, alone), (7, other), (8, third), (None, alone)]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
