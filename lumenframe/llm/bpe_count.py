"""Token counts by heap-and-linked-list byte-pair merging.

A pretoken is a doubly linked list of byte symbols. All adjacent pairs that can
merge stand in a heap by rank and place; the lowest is popped, stale entries are
skipped, and a merge puts its two new neighbours in the heap. The count is the
number of symbols less the number of merges; no ids are made.

Text is cut into the tokenizer's pretokens, and counts of pieces are remembered
in a bounded cache for each Python worker. A special string inside a text is one
token, as the library has it. Null and empty texts have no tokens. Rows with
null or repeated ids are counted like any other, each row by itself; an empty table
gives no rows. A very long text is held alone; a single word of n bytes takes
n log n steps. Pairs of equal rank are merged from the left, as the library does.
Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, id_and_text
from .tokens import CACHE_BYTES, ENTRY_BYTES, for_a_task, pieces, vocabulary_path


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols that are left when no adjacent pair has a rank."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := ranks.get((a + b, symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], a + b))
    return left


class TokenCounter:
    """Counts tokens of whole texts for a byte-level vocabulary in tokenizers' format."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(merges)}
        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.forget()

    def forget(self) -> None:
        #: tokens of pieces and of pretokens, and the bytes that they take, about
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.bytes = 0

    def _pretokens(self, text: str) -> int:
        words, ranks, total = self.words, self.ranks, 0
        for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            if (n := words.get(word)) is None:
                self.bytes += len(word) + ENTRY_BYTES
                n = words[word] = count_merged(word, ranks)
            total += n
        return total

    def count(self, text: str) -> int:
        if self.bytes > 2 * CACHE_BYTES:
            self.forget()
        for special in self.special:
            if special in text:
                apart = text.split(special)
                return len(apart) - 1 + sum(map(self.count, apart))
        if not text:
            return 0
        parts = pieces(text)
        if parts is None:
            return self._pretokens(text)
        known = self.known
        total = self._pretokens(parts[0])
        del parts[0]
        for p in set(parts).difference(known):
            self.bytes += len(p) + ENTRY_BYTES
            known[p] = self._pretokens(p if p[0] == "\n" else f" {p}")
        return total + sum(map(known.__getitem__, parts))


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with for_a_task(token_counter(vocabulary)) as counter:
            for batch in batches:
                sizes, counts = [], []
                for x in batch.column("text"):
                    text = x.as_py() or ""
                    sizes.append(len(text) if text.isascii() else len(text.encode()))
                    counts.append(counter.count(text))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts the tokens of ``documents``."""
    return count_tokens(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))
