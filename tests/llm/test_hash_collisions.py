"""Substring removal where different words share a hash."""

import random

from lumenframe.llm import fm_dedup


def colliding_words():
    """A Thue-Morse word and its complement: a polynomial hash modulo 2**64 is the same for both."""
    bits = [i.bit_count() & 1 for i in range(2048)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_op7_windows_that_share_a_hash(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    one, other = colliding_words()
    first, second = fm_dedup.word_hashes(f"{one} {other}".encode()).tolist()
    assert one != other and first == second
    passage = [word() for _ in range(49)]
    passages = [" ".join([w, *passage]) for w in (one, other)]
    rows = [(i, f"{word()} {passages[k]} {word()}") for i, k in ((1, 0), (5, 1), (7, 0), (9, 1), (11, 1))]
    found = fm_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cut = {r.doc_id: [(p.at + s.shift, s.n + 49) for p in r.passages for s in p.spans] for r in found}
    assert cut == {i: [(1, 50)] for i in (7, 9, 11)}
