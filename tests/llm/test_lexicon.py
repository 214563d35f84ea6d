"""The learnt lexicon where harmless words outnumber its places."""

from lumenframe.llm import toxicity_gbt


def test_op5_rare_toxic_word_behind_many_common_ones(spark, monkeypatch):
    monkeypatch.setattr(toxicity_gbt, "LEXICON", 2)
    words = [f"{a}{b}x" for a in "bcdfghjklmnp" for b in "aeiou"]
    turn = lambda i: " ".join(words[(i * 7 + k * (i + 1)) % len(words)] for k in range(60))
    rows = [(f"{turn(i)} grobian", 1) for i in range(40)] + [(turn(i), 0) for i in range(40)]
    lexicon = toxicity_gbt.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert len(lexicon) == 2 and all(k in ("=grobian", "grob", "grobi", "grobia") for k in lexicon)
    assert toxicity_gbt.learn_lexicon(spark.createDataFrame([], "text string, label int")) == {}
