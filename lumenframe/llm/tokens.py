"""Token ids of whole texts by the tokenizers library, with a bounded cache of text pieces.

The byte-level vocabulary splits text before merging, and its pattern never
matches across the point between a non-space character and one single space or
line break that is followed by a non-space character, nor between a letter and a
full stop or comma. A text whose white space is of that kind only is therefore the
concatenation of pieces ``" word"``, ``"\nword"`` and ``"."`` that are encoded
independently. Arrow finds the distinct pieces of many texts, each new one is
encoded once by the library and remembered, and array operations put the ids
together. Any other text (runs of spaces, tabs, other white space, special
strings) goes to the library whole. Little-endian machines are assumed.
"""

from __future__ import annotations

import os
from array import array
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import released

#: Bytes, about, in each of the two generations of pieces that a Python worker remembers while a task lasts.
CACHE_BYTES = 48_000_000
#: Bytes that an entry takes besides its text and ids, about.
ENTRY_BYTES = 180
#: Texts given to the library in one call.
CALL_TEXTS = 4096
#: Pieces joined into one text.
JOINED = 500
#: Characters of the texts that are cut and encoded together.
GROUP = 8_000_000
#: White space of any Unicode version besides single spaces and line breaks between words: such a text goes to the library whole.
ODD = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|[ \n][ \n]|^[ \n]|[ \n]$"
#: By byte: white space, letters, and signs that end a word and start a match of their own.
WHITE, LETTER, STOP = (np.isin(np.arange(256), list(x)) for x in (b" \n", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b".,"))
#: How the byte-level vocabulary writes a space and a line break.
SPACE_SIGNS = "\u0120\u010a"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str, special: tuple[str, ...] = ()) -> list[str] | None:
    """Independent pieces of text, or None if it must be treated whole.

    The first piece has no leading white space; the others start with a space or
    a line break. Their concatenation is the text.
    """
    if any(s in text for s in special):
        return None
    parts = text.replace("\n", " \n").split(" ")
    if "" in parts or "\n" in parts or len(parts) != len(text.split()):
        return None
    return parts


def gather(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of ids from each start on, one after the other."""
    ends = np.cumsum(counts)
    at = np.repeat(starts - ends + counts, counts)
    at += np.arange(len(at))
    return ids[at]


class Known:
    """Pieces and their ids, as columns."""

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.ids, self.starts, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 where there is none."""
        if not len(self):
            return np.full(len(words), -1)
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Words that are not in it yet."""
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.words, self.ids, self.counts = pa.concat_arrays([self.words, words]), np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])


class PieceEncoder:
    """Encodes texts to ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: texts that hold one of these are encoded whole
        self.whole = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.forget()
        #: whether a token starts with a space or line break, by id
        self.opens = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[i] = token[0] in SPACE_SIGNS

    def _library(self, strings: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(strings), CALL_TEXTS):
            for e in self.tokenizer.encode_batch_fast(strings[i : i + CALL_TEXTS], add_special_tokens=False):
                out.append(array("I", e.ids).tobytes())
        return out

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has."""
        ids = self._library(words)
        return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)

    def _apart(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of pieces that start with a space or line break: encoded joined, then cut where a token starts so.

        No token inside such a piece starts with white space, so the cuts are the pieces' starts.
        """
        offsets, data = _offsets(words), words.buffers()[2]
        edges = [*range(0, len(words), JOINED), len(words)]
        joined = [str(memoryview(data)[offsets[i] : offsets[j]], "utf-8") for i, j in zip(edges, edges[1:], strict=False)]
        ids, counts = [], []
        for k, x in enumerate(self._library(joined)):
            group = np.frombuffer(x, "<u4")
            cuts = np.flatnonzero(self.opens[group])
            n = edges[k + 1] - edges[k]
            if len(cuts) == n and not cuts[0]:
                count = np.diff(cuts, append=len(group))
            else:
                group, count = self._singly(words[edges[k] : edges[k + 1]].to_pylist())
            ids.append(group)
            counts.append(count)
        return np.concatenate(ids), np.concatenate(counts)

    def _remember(self, words: pa.Array) -> np.ndarray:
        """The place of each of the distinct words among the known pieces; those that are new go to the library together."""
        if self.bytes > CACHE_BYTES:
            # what is still in use comes back from the generation before without being encoded again
            self.before, self.known, self.bytes = self.known, Known(), 0
        place = self.known.find(words)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return place
        fresh = words.take(pa.array(new))
        at, known = len(self.known), self.known
        self.bytes += 3 * int(np.diff(_offsets(fresh)[[0, -1]])[0]) + ENTRY_BYTES * len(fresh)
        old = self.before.find(fresh)
        opens = pc.match_substring_regex(fresh, r"^[ \n]").to_numpy(zero_copy_only=False)
        kinds = [np.flatnonzero(old >= 0), np.flatnonzero((old < 0) & opens), np.flatnonzero((old < 0) & ~opens)]
        for rows, kind in zip(kinds, ("again", "apart", "singly"), strict=True):
            if not len(rows):
                continue
            part = fresh.take(pa.array(rows))
            if kind == "again":
                counts = self.before.counts[old[rows]]
                ids = gather(self.before.ids, self.before.starts[old[rows]], counts)
            else:
                ids, counts = self._apart(part) if kind == "apart" else self._singly(part.to_pylist())
            known.add(part, ids, counts)
            place[new[rows]] = np.arange(at, at + len(rows))
            at += len(rows)
        return place

    def _cut(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that are not empty and whose white space is as it should be."""
        offsets = _offsets(texts)
        first = offsets[0]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[first : offsets[-1]]
        starts = WHITE[data]
        starts[1:] |= STOP[data[1:]] & LETTER[data[:-1]]
        starts[offsets[:-1] - first] = True
        edges = np.append(np.flatnonzero(starts), len(data))
        del starts
        cut = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
        place = self._remember(cut.dictionary)[cut.indices.to_numpy()]
        counts = self.known.counts[place]
        ids = gather(self.known.ids, self.known.starts[place], counts)
        # ids before each text: those before its first piece
        ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(edges, offsets - first)].tolist()
        raw = ids.astype("<u4", copy=False).tobytes()
        return [raw[4 * i : 4 * j] for i, j in zip(ends, ends[1:], strict=False)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the pieces that are new go to the library together."""
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, ODD)
        for x in self.whole:
            odd = pc.or_(odd, pc.match_substring(column, x))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = ~odd & (pc.binary_length(column).to_numpy() > 0)
        cut = iter(self._cut(column.filter(pa.array(plain))) if plain.any() else ())
        whole = iter(self._library([t for t, o in zip(texts, odd.tolist(), strict=True) if o]))
        return [next(cut) if p else next(whole) if o else b"" for p, o in zip(plain.tolist(), odd.tolist(), strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def forget(self) -> None:
        self.known, self.before, self.bytes = Known(), Known(), 0


def _offsets(strings: pa.Array) -> np.ndarray:
    """Where each string starts in the data, and where the last one ends."""
    return np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]


@contextmanager
def for_a_task(cache):
    """Has the cache forget its pieces when the task ends: an idle worker keeps no memory from the stages that need it."""
    with released():
        try:
            yield cache
        finally:
            cache.forget()


def in_groups(items, size_of, limit: int = 4_000_000):
    """Lists of items whose sizes add up to about limit at most."""
    group, total = [], 0
    for x in items:
        group.append(x)
        total += size_of(x)
        if total >= limit:
            yield group
            group, total = [], 0
    if group:
        yield group


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary."""
    return PieceEncoder(path)
