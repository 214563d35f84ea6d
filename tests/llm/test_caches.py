"""Caches of the tokenisers: bounded in bytes, forgotten at a task's end, and without effect on the results."""

import random

import numpy as np
import public_tokenizers

from lumenframe.llm import bpe_count, bpe_prefix, tokens

PATH = tokens.vocabulary_path("byte_bpe_50k.json")


def make_texts():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 9)))
    return [" ".join(word() for _ in range(200)) for _ in range(60)] + ["x" * 50_000 + " end", "", "two  spaces\t" + word()]


def test_small_caches_change_nothing_and_stay_small(monkeypatch):
    for module in (tokens, bpe_count, bpe_prefix):
        monkeypatch.setattr(module, "CACHE_BYTES", 100_000)
    texts = make_texts()
    encoder, counter = tokens.PieceEncoder(PATH), bpe_count.TokenCounter(PATH)
    prefixes = bpe_prefix.TextEncoder(tokens.vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    most = 0
    for t in texts:
        want = np.frombuffer(encoder._library([t])[0], "<u4").tolist() if t else []
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == want and prefixes.encode(t) == want and counter.count(t) == len(want)
        most = max(most, len(encoder.known) + len(encoder.before), len(prefixes.known) + len(prefixes.before), len(counter.known))
    # two generations of 100,000 bytes, at 180 bytes an entry and more, and one text beyond
    assert 300 < most < 2 * 100_000 / tokens.ENTRY_BYTES + 500
    for cache in (encoder, counter, prefixes):
        with tokens.for_a_task(cache) as same:
            assert same is cache
        assert not cache.known and not cache.bytes
