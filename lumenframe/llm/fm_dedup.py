"""Substring removal: words of 50-word windows that an earlier document holds too.

Which windows repeat, and which document holds each first, is found by FM-indexes:
a shard indexes passages in a wavelet tree, passages are streamed against it by
backward search, and the intervals whose matching statistics reach a window are
reported with the least document that holds them. Shards are cut so that equal
windows meet:

1. The key of a window is its minimiser, the least hash of its ten-word runs.
   Equal windows have equal keys, so a window whose key occurs in one document
   only cannot repeat: keys, about one for 20 words, are counted with partial
   aggregation, and the other windows never leave their document.
2. Consecutive windows of one key are a passage, at most ``PIECE`` windows. Equal
   passages are first made one row with their least and greatest document, again
   with partial aggregation: copies cost nothing further on.
3. A key whose different passages are more than a shard holds, ``SHARD_WORDS``
   words (near copies by the ten thousand, or the text around a passage that
   everyone quotes), is cut anew by a longer run of words, last by the whole
   window, of which all copies are equal. So no group grows with the number of
   copies, and none is compared pair by pair.
4. Shards take whole keys, about as many words each. Hashes only choose where
   windows meet; that they are equal is decided on their words.

Results go back from passages to documents by a 128-bit digest of the words.

Null texts have no words. A row with a null doc_id is neither earlier nor later
than any other: it loses nothing and removes nothing. Of repeated rows of one id,
none is earlier than another, and each loses what its own words say. A very long
text is many passages; only its own row is ever held whole. An empty table gives
no rows. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, drop_table, id_and_text, lean, materialised, mix64, released
from .fm_index import FMIndex

WINDOW = 50
#: Words in the runs that keys are hashes of: the first cut, and the cuts of keys that are hot.
RUNS = (10, 40, WINDOW)
#: Windows in a passage at most; words in a shard, about, and bytes in a word.
PIECE, SHARD_WORDS, WORD_BYTES = 256, 1_000_000, 6
_CHUNK = 1 << 20
_BYTE, _WORD = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n).bit_length()
            full = lambda b: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, b, np.uint64))])
            self.up, self.down = full(self.base), full(self.inverse)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(_BYTE), Powers(_WORD)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word; long texts are read in chunks that end between words."""
    if len(data) > _CHUNK:
        out, at = [], 0
        while at < len(data):
            end = min(len(data), at + _CHUNK)
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
            out.append(_hash_chunk(data[at:end]))
            at = end
        return np.concatenate(out)
    return _hash_chunk(data)


def _hash_chunk(data: bytes) -> np.ndarray:
    d = np.frombuffer(data, np.uint8)
    edge = np.diff(_SPACE[d].astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _BYTES.to(len(d) + 1)
    sums = np.zeros(len(d) + 1, np.uint64)
    np.cumsum((d.astype(np.uint64) + np.uint64(1)) * up[: len(d)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def _run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    up, down = _WORDS.to(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix64((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def minimisers(words: np.ndarray, run: int = RUNS[0]) -> np.ndarray:
    """For each window, the least hash of its runs."""
    x, width, size = _run_hashes(words, run), WINDOW - run + 1, 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _text(x) -> bytes:
    return (x.as_py() or "").encode()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs, found = [], []
        for doc, x in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            words = word_hashes(_text(x))
            if len(words) >= WINDOW:
                found.append(np.unique(minimisers(words)))
                docs.append(np.full(len(found[-1]), doc))
        if found:
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found)), pa.array(np.concatenate(docs))], names=["anchor", "doc_id"])


def _runs(keys: np.ndarray, wanted: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(first, past the last) of windows in a row that have one key, a wanted one, at most PIECE of them."""
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist()
    chosen = np.isin(keys[starts[:-1]], wanted).tolist() if wanted is not None else [True] * (len(starts) - 1)
    return [(i, min(i + PIECE, end)) for start, end, ok in zip(starts, starts[1:], chosen, strict=False) if ok for i in range(start, end, PIECE)]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


_PIECE = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("words", pa.binary()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
_CHILD = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("words", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("parent", pa.binary()), ("shift", pa.int32())])
_PIECES = "key long, digest binary, words binary, doc_id long, at int, n int"
_CHILDREN = "key long, digest binary, words binary, first long, last long, parent binary, shift int"
_FOUND = "level int, digest binary, spans array<struct<shift: int, n: int, least: long>>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of each document whose keys other documents have too."""

    def rows():
        for b in batches:
            for doc, x, anchors in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("anchors"), strict=True):
                data = _text(x)
                hashes = word_hashes(data)
                if len(hashes) < WINDOW:
                    continue
                keys, words = minimisers(hashes), data.split()
                for i, j in _runs(keys, anchors.values.to_numpy().view(np.uint64)):
                    passage = b" ".join(words[i : j + WINDOW - 1])
                    yield int(keys[i].view(np.int64)), xxhash.xxh3_128_digest(passage), passage, doc, i, j - i + WINDOW - 1

    return _batches(rows(), _PIECE)


def _recut(run: int):
    """Cuts passages anew, by longer runs of words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for parent, x, first, last in zip(*(b.column(c).to_pylist() for c in ("digest", "words", "first", "last")), strict=True):
                    keys, words = minimisers(word_hashes(x), run), x.split(b" ")
                    for i, j in _runs(keys):
                        passage = b" ".join(words[i : j + WINDOW - 1])
                        yield int(keys[i].view(np.int64)), xxhash.xxh3_128_digest(passage), passage, first, last, parent, i

        return _batches(rows(), _CHILD)

    return cut


def search_shard(table: pa.Table) -> pa.Table:
    """For each passage the windows, by place and number, that a document before its last holder has, and the least such document."""
    vocabulary: dict[bytes, int] = {}
    sequences = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in x.as_py().split(b" ")], np.int64) for x in table.column("words")]
    index = FMIndex(sequences, table.column("first").to_pylist(), WINDOW)
    out: list[tuple] = []
    digests, lasts, levels = table.column("digest"), table.column("last").to_numpy(), table.column("level")
    for j in range(0, len(sequences), 20_000):
        for i, least in enumerate(index.matches(sequences[j : j + 20_000]), j):
            if not ((least >= 0) & (least < lasts[i])).any():
                continue
            starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]]).tolist()
            spans = [{"shift": a, "n": b - a, "least": int(least[a])} for a, b in zip(starts, starts[1:], strict=False) if 0 <= least[a] < lasts[i]]
            out.append((levels[i].as_py(), digests[i].as_py(), spans))
    kinds = (pa.int32(), pa.binary(), pa.list_(pa.struct([("shift", pa.int32()), ("n", pa.int32()), ("least", pa.int64())])))
    return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["level", "digest", "spans"])


def searched(table: pa.Table) -> pa.Table:
    """``search_shard``, with the index's memory released."""
    with released():
        return search_shard(table)


def _first_and_last(passages: DataFrame, name: str) -> DataFrame:
    """Different passages (key, digest, words) with the least and greatest document of each."""
    return materialised(passages.groupBy("key", "digest", "words").agg(F.min("first").alias("first"), F.max("last").alias("last")), name)


def _cut(pieces: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Passages to search, with the level of their cut; and for each further cut, which passage is part of which."""
    ready, parts = [], []
    rows = _first_and_last(pieces.select("key", "digest", "words", F.col("doc_id").alias("first"), F.col("doc_id").alias("last")), "passages")
    for level, run in enumerate(RUNS[1:]):
        size = F.sum(F.octet_length("words"))
        hot = materialised(rows.groupBy("key").agg(size.alias("size")).filter(F.col("size") > WORD_BYTES * SHARD_WORDS).select("key"), f"hot-{level}")
        if hot.isEmpty():
            break
        ready.append(rows.join(hot, "key", "left_anti").withColumn("level", F.lit(level)))
        children = materialised(rows.join(hot, "key", "left_semi").mapInArrow(lean(_recut(run)), _CHILDREN), f"cut-{level}")
        parts.append(children.select("digest", "parent", "shift"))
        rows = _first_and_last(children, f"passages-{level + 1}")
        # a finer key that one document alone has is no longer of use
        shared = materialised(rows.groupBy("key").agg(F.min("first").alias("lo"), F.max("last").alias("hi")).filter("lo < hi").select("key"), f"shared-{level + 1}")
        rows = materialised(rows.join(shared, "key", "left_semi"), f"kept-{level + 1}")
    ready.append(rows.withColumn("level", F.lit(len(parts))))
    out = ready[0]
    for r in ready[1:]:
        out = out.unionByName(r)
    return out, parts


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, passages): for each document that has words to lose, passages (at, n, digest) and in each the spans (shift, n) of windows. docs: doc_id, text."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = materialised(docs.mapInArrow(lean(_anchors), "anchor long, doc_id long"), "anchors")
    shared = materialised(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor"), "shared")
    of = materialised(anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "of")
    pieces = materialised(docs.join(of, "doc_id").select("doc_id", "text", "anchors").mapInArrow(lean(_pieces), _PIECES), "pieces")
    for t in (anchors, shared, of):
        drop_table(spark, t)
    passages, parts = _cut(pieces)
    size = passages.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    # at least a shard for each task
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (WORD_BYTES * SHARD_WORDS) + 1)
    dealt = passages.select("level", "digest", "words", "first", "last", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    found = materialised(dealt.groupBy("shard").applyInArrow(searched, _FOUND), "found")
    spans = found.filter(F.col("level") == len(parts)).drop("level")
    for level in reversed(range(len(parts))):
        moved = F.transform("spans", lambda s: F.struct((s["shift"] + F.col("shift")).alias("shift"), s["n"], s["least"]))
        above = parts[level].join(spans, "digest").select(F.col("parent").alias("digest"), moved.alias("spans")).groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        spans = materialised(found.filter(F.col("level") == level).drop("level").unionByName(above), f"spans-{level}")
    met = pieces.select("digest", "doc_id", "at", "n").join(spans, "digest").withColumn("spans", F.filter("spans", lambda s: s["least"] < F.col("doc_id")))
    met = met.filter(F.size("spans") > 0).select("doc_id", F.struct("at", "n", "digest", F.transform("spans", lambda s: F.struct(s["shift"].alias("shift"), s["n"].alias("n"))).alias("spans")).alias("p"))
    out = materialised(met.groupBy("doc_id").agg(F.collect_list("p").alias("passages")), "repeated")
    for t in (pieces, passages, found, *parts):
        drop_table(spark, t)
    return out


def keep_mask(words: list[bytes], passages) -> np.ndarray:
    """Which words stay. A passage counts only where the row's own words are those that were found."""
    keep = np.ones(len(words), bool)
    for p in passages or ():
        at, n = p["at"], p["n"]
        if at + n <= len(words) and xxhash.xxh3_128_digest(b" ".join(words[at : at + n])) == p["digest"]:
            for s in p["spans"]:
                keep[at + s["shift"] : at + s["shift"] + s["n"] + WINDOW - 1] = False
    return keep


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of each of ``documents``."""
    docs = id_and_text(documents(spark, sf_dir))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, digest = [], [], []
            for x, spans in zip(b.column("text"), b.column("passages").to_pylist(), strict=True):
                words = _text(x).split()
                keep = keep_mask(words, spans)
                total.append(len(words))
                removed.append(int(len(words) - keep.sum()))
                digest.append(hashlib.sha256(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    met = docs.join(repeated_passages(docs), "doc_id", "left").select("doc_id", "text", "passages")
    return met.mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeated(docs: DataFrame) -> DataFrame:
    """docs with the repeated words cut out of text and n_chars following it, and without rows that lose all they had.

    Texts that lose nothing stay as they are, white space included; in the others the kept words are joined by one space.
    """
    from .common import own_name

    spans = own_name(docs, "_spans")
    key = own_name(docs, "_key")
    found = repeated_passages(id_and_text(docs)).select(F.col("doc_id").alias(key), F.col("passages").alias(spans))

    @F.arrow_udf("string")
    def kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        with released():
            for x, s in zip(texts, spans.to_pylist(), strict=True):
                text = x.as_py()
                if s and text:
                    words = text.encode().split()
                    keep = keep_mask(words, s)
                    if not keep.all():
                        text = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode()
                out.append(text)
        return pa.array(out, pa.string())

    met = docs.join(found, docs["doc_id"].cast("long") == F.col(f"`{key}`"), "left")
    new = own_name(docs, "_new")
    met = met.withColumn(new, F.when(F.col(f"`{spans}`").isNull(), docs["text"]).otherwise(kept(docs["text"].cast("string"), F.col(f"`{spans}`"))))
    met = met.filter(F.col(f"`{spans}`").isNull() | (F.col(f"`{new}`") != ""))
    fresh = {"text": F.col(f"`{new}`")} | ({"n_chars": F.when(F.col(f"`{spans}`").isNull(), docs["n_chars"]).otherwise(F.char_length(f"`{new}`")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return met.select(*(fresh[c].alias(c) if c in fresh else docs[f"`{c}`"] for c in docs.columns))


SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), x AS (
    SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS t FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w)
), f AS (
    SELECT t, min(doc_id) AS first FROM x GROUP BY t
), s AS (
    SELECT x.doc_id, list(i) AS starts FROM x JOIN f USING (t) WHERE f.first < x.doc_id GROUP BY x.doc_id
), c AS (
    SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: generate_series(i, i + 49)))) AS cut FROM s
), k AS (
    SELECT w.doc_id, len(words) AS n_words, CASE WHEN cut IS NULL THEN words ELSE list_filter(words, lambda v, i: NOT list_contains(cut, i::BIGINT)) END AS kept FROM w LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, (n_words - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
