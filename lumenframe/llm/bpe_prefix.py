"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has one encoding, and so one last token. A token
that ends at i is the last token of that prefix exactly if it follows the last
token of the prefix before it validly, which only depends on the two: their
joined bytes must encode to that pair. One array of last tokens therefore holds
the encodings of all prefixes. Bytes can be appended without another look at
what stands before, and an edit needs new entries only up to the place where a
longest token's length of entries agrees with the old ones.

Null and empty texts have no ids. Rows with null or repeated ids are treated
like any other, each row by itself; an empty table gives no rows. A very long text
is held alone, and a single word takes time linear in its length. Only one token
of a prefix is valid, so there are no ties. Only doc_id and text are read, whatever
other columns there are.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, id_and_text
from .tokens import CACHE_BYTES, ENTRY_BYTES, for_a_task, in_groups, pieces, vocabulary_path


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: Token lengths to try where no longer token ends.
SHORT = (2, 1)


class PrefixBPE:
    """The vocabulary, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.follows: dict[tuple[int, int], bool] = {}
        #: the lengths of tokens of three bytes and more by their last three, then two and one
        lengths: dict[bytes, set[int]] = {}
        for t in ranks:
            if len(t) > 2:
                lengths.setdefault(t[-3:], set()).add(len(t))
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in lengths.items()}

    def _merged(self, data: bytes) -> list[int]:
        """Plain merging by rank; only for one token's or two tokens' bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _valid(self, last: int, token: int) -> bool:
        if len(self.follows) * ENTRY_BYTES > CACHE_BYTES:
            self.follows.clear()
        alone = last < 0
        ok = self._merged((b"" if alone else self.bytes_of[last]) + self.bytes_of[token]) == ([token] if alone else [last, token])
        self.follows[last, token] = ok
        return ok

    def extend(self, data: bytes, last: list[int], to: int | None = None) -> None:
        """Adds the last tokens of the prefixes of data from len(last) on; last[0] is -1, for the empty prefix."""
        ranks, lengths, follows = self.ranks, self.lengths, self.follows
        for end in range(len(last), (len(data) if to is None else to) + 1):
            for n in lengths.get(data[end - 3 : end], SHORT) if end > 2 else SHORT[2 - end :]:
                if n <= end and (token := ranks.get(data[end - n : end])) is not None:
                    before = last[end - n]
                    ok = follows.get((before, token))
                    if ok or ok is None and self._valid(before, token):
                        last.append(token)
                        break
            else:
                raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")

    def ids(self, data: bytes, last: list[int]) -> list[int]:
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern: a match that is a token is that token."""
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        last = [-1]
        self.extend(piece, last)
        return self.ids(piece, last)

    def encode_sorted(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of matches of the pattern, packed; a match shares the entries of the prefix it has in common with the one before."""
        out, before, last, ranks = {}, b"", [-1], self.ranks
        for piece in sorted(pieces):
            data = piece.encode()
            if (token := ranks.get(data)) is not None:
                out[piece] = token.to_bytes(4, "little")
                continue
            same, most = 0, min(len(data), len(before))
            while same < most and data[same] == before[same]:
                same += 1
            del last[same + 1 :]
            self.extend(data, last)
            before = data
            out[piece] = array("I", self.ids(data, last)).tobytes()
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """A byte string with the last token of each prefix: exact appends and edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, [-1]
        bpe.extend(data, self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts new in place of data[start:stop]; returns how many entries were made anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, agreed, need = old[: start + 1], 0, self.bpe.longest
        for end in range(start + 1, len(self.data) + 1):
            self.bpe.extend(self.data, self.last, end)
            was = end - shift
            agreed = agreed + 1 if was > stop and self.last[end] == old[was] else 0
            if agreed >= need:
                self.last += old[was + 1 :]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        return self.bpe.ids(self.data, self.last)


class TextEncoder:
    """Encodes whole texts: each match of the pattern by itself, distinct pieces once."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.bpe = PrefixBPE(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.forget()
        #: how each id is written
        self.decimal = {i: str(i) for i in self.bpe.bytes_of}

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.bytes = 0

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the pieces that are new are encoded together, in order."""
        collecting = gc.isenabled()
        gc.disable()  # many small objects and no cycles
        try:
            return self._encode_many(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_many(self, texts: list[str]) -> list[list[int]]:
        if self.bytes > CACHE_BYTES:
            # what is still in use comes back from the generation before without being encoded again
            self.before, self.known, self.bytes = self.known, {}, 0
        known, before, findall, cut = self.known, self.before, self.pattern.findall, []
        new: dict[str, list[str]] = {}
        for text in texts:
            parts = pieces(text, ("\x00",)) if text else []
            if parts is None:
                parts = findall(text)
                new.update((f"\x00{p}", [p]) for p in parts if f"\x00{p}" not in known)
                parts = [f"\x00{p}" for p in parts]
            elif parts:
                if parts[0][0] != "\n":
                    parts[0] = "\x00" + parts[0]
                for p in set(parts).difference(known).difference(new):
                    if p in before:
                        known[p] = before[p]
                        continue
                    new[p] = findall(p[1:] if p[0] == "\x00" else p if p[0] == "\n" else f" {p}")
            cut.append(parts)
        if new:
            self.bytes += 3 * sum(map(len, new)) + ENTRY_BYTES * len(new)
            apart = self.bpe.encode_sorted({m for found in new.values() for m in found})
            known.update((p, b"".join([apart[m] for m in found])) for p, found in new.items())
        out = []
        for parts in cut:
            ids = array("I")
            ids.frombytes(b"".join(map(known.__getitem__, parts)))
            out.append(ids.tolist())
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def written(self, ids: list[int]) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.decimal.__getitem__, ids))


@lru_cache(maxsize=2)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(path, pattern)


def encode_texts(docs: DataFrame, ranks: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with for_a_task(text_encoder(ranks, pattern)) as encoder:
            for batch in batches:
                n, coded, decoded, kept = [], [], [], []
                for group in in_groups((x.as_py() or "" for x in batch.column("text")), len, 1_500_000):
                    for ids in encoder.encode_many(group):
                        n.append(len(ids))
                        coded.append(hashlib.sha256(encoder.written(ids).encode()).hexdigest())
                        decoded.append(hashlib.sha256(encoder.bpe.decode(ids)).hexdigest())
                        if keep_ids:
                            kept.append(ids)
                columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names=names + ["ids"] * keep_ids)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op8_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes ``documents``."""
    import public_tokenizers

    return encode_texts(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
