"""Texts cut into pieces by array operations: the ids are the library's, and what is remembered are columns."""

import random
import sys

import numpy as np
import pytest

from lumenframe.llm import packing, simple8b, tokens

PATH = tokens.vocabulary_path("byte_bpe_50k.json")
SIGNS = ["a", "b", "A", "é", "ß", "я", "中", "1", ".", ",", "'s", "'", "-", " th", "e", "́", "ﬁ", "😀", " ", " ", "\n"]
ODD = ["  ", "\t", "\r", "\x00", "\x1c", "\x85", " ", " ", "　", "᠎", "​", "﻿", "<|endoftext|>"]


@pytest.mark.parametrize("signs", [SIGNS, SIGNS + ODD])
def test_ids_are_the_librarys(signs):
    rnd, encoder = random.Random(5), tokens.PieceEncoder(PATH)
    for _ in range(20):
        texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 14))) for _ in range(100)]
        assert encoder.encode_many(texts) == encoder._library(texts)


def test_generations_of_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 30_000)
    rnd, encoder, came_back = random.Random(6), tokens.PieceEncoder(PATH), 0
    for _ in range(30):
        text = "Word, " + " ".join(str(rnd.randint(0, 400)) for _ in range(60)) + "."
        before = len(encoder.before)
        assert encoder.encode(text) == encoder._library([text])[0]
        came_back += before > 0
        assert len(encoder.known) == len(set(encoder.known.words.to_pylist())) == len(encoder.known.counts)
    assert came_back


def test_pieces_are_columns_and_not_objects():
    encoder = tokens.PieceEncoder(PATH)
    text = " ".join(f"w{i}" for i in range(100_000))
    encoder.encode("a b")
    before = sys.getallocatedblocks()
    ids = encoder.encode(text)
    assert len(encoder.known) > 100_000 and sys.getallocatedblocks() - before < 10_000
    assert ids == encoder._library([text])[0]


def test_files_and_sequences_hold_the_librarys_ids(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(i, "".join(rnd.choice(SIGNS + ODD) for _ in range(rnd.randint(0, 3000)))) for i in range(60)] + [(60, ""), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    encoder = tokens.PieceEncoder(PATH)
    want = {i: encoder._library([t or ""])[0] + b"\0\0\0\0" for i, t in rows}
    files = simple8b.write_token_files(docs, f"file://{tmp_path}/files", PATH)
    assert {r.doc_id: bytes(r.ids) for r in simple8b.read_token_files(spark, files).collect()} == want
    got = {i: np.zeros(len(x) // 4, int) for i, x in want.items()}
    for r in packing.pack(docs, PATH).collect():
        part = want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert packing.crc32_of(part) == r.ids_crc32
        got[r.doc_id][r.start : r.start + r.length] += 1
    assert all((x == 1).all() for x in got.values())
