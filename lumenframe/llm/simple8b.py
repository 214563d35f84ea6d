"""Token-id files in Simple-8b: word-aligned binary coding with block offsets.

A 64-bit word holds a 4-bit selector and 60 bits of payload. Selectors 1 to 14
pack from 60 one-bit ids down to one 60-bit id; selector 0 is an escape, whose
payload is the index of a wider id in the block's escape list.

File (little-endian): the magic, then blocks, then the index and its length.
A block holds whole documents and stands for itself::

    n_docs u32, n_ids u32, n_words u32, n_escapes u32, n_nameless u32,
    doc_id i64[n_docs], n_tokens u32[n_docs], words u64[n_words], escapes u64[n_escapes]

The index has one row of three u64 for each block: its byte offset, the ids and
the documents before it in the file. A reader can so decode any block alone, and
decodes it by selector with array operations, without a loop over words.

Null texts count as empty; a document is its ids and the end id, so empty texts
have one. Rows with a null id come first: a block's first ``n_nameless`` documents
have none. Rows with equal ids follow one another, ordered by a hash of the text and
the text, so that ties are broken the same way each time; a range of files may part
them. A very long text is a block of its own, encoded and held whole. An empty
table gives no rows. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, id_and_text, lean, shared_dir
from .tokens import GROUP, for_a_task, in_groups, piece_encoder, vocabulary_path

MAGIC = b"LFS8B001"
#: Ids in a block, unless one document is longer.
BLOCK_IDS = 65_536
#: Bits of an id by selector; a word holds 60 // bits of them. Selector 0 is the escape.
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
COUNT = np.array([1, *(60 // b for b in BITS[1:].tolist())], np.int64)
#: The selectors that the encoder tries, from the most ids to the fewest.
TRIED = [s for s in range(1, 15)]


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, at least one; 61 for any that is too wide for a word."""
    wide = ids >> np.uint64(60) > 0
    # below 2**60 a double's exponent is the bit length, or one more just below a power of two, which only costs room
    width = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    width = np.minimum(np.maximum(width, 1), 60)
    width[wide] = 61
    return width.astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes for ids (uint64). From each place, the selector that packs the most ids is taken."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    # widest[k]: the largest width among the 2**k ids from each place on, as far as any selector asks
    widest = [_widths(ids)]
    least = int(widest[0].min())
    tried = [s for s in TRIED if BITS[s] >= least and COUNT[s] <= n]
    while tried and 2 ** len(widest) <= COUNT[tried[0]]:
        last, half = widest[-1], 2 ** (len(widest) - 1)
        widest.append(np.maximum(last[:-half], last[half:]))
    selector = np.zeros(n, np.uint8)
    for s in reversed(tried):
        count = int(COUNT[s])
        k = count.bit_length() - 1
        run, more = widest[k], count - 2**k
        most = np.maximum(run[: n - count + 1], run[more : more + n - count + 1]) if more else run[: n - count + 1]
        fits = most <= BITS[s]
        if fits.any():
            np.putmask(selector[: n - count + 1], fits, s)
    step, starts, i = COUNT.astype(np.uint8)[selector].tobytes(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    chosen = selector[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        rows = np.flatnonzero(chosen == s)
        if s == 0:
            words[rows] |= np.arange(len(rows), dtype=np.uint64)
            continue
        first, packed = at[rows], words[rows]
        for j in range(int(COUNT[s])):
            packed |= ids[first + j] << np.uint64(j * int(BITS[s]))
        words[rows] = packed
    return words, ids[at[chosen == 0]]


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids (uint64) of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNT[selector])
    starts = ends - COUNT[selector]
    out = np.empty(n, np.uint64)
    for s in np.unique(selector).tolist():
        rows = np.flatnonzero(selector == s)
        if s == 0:
            out[starts[rows]] = escapes[(words[rows] & np.uint64(2**60 - 1)).astype(np.int64)]
            continue
        mask = np.uint64(2 ** int(BITS[s]) - 1)
        for j in range(int(COUNT[s])):
            out[starts[rows] + j] = (words[rows] >> np.uint64(j * int(BITS[s]))) & mask
    return out


def write_file(out, docs: Iterable[tuple[int | None, np.ndarray]]) -> tuple[int, int]:
    """Writes documents (id or None, ids) to a binary stream, those without an id first; returns how many documents and ids."""
    out.write(MAGIC)
    at, total, n_docs, index = len(MAGIC), 0, 0, []
    for group in in_groups(docs, lambda d: len(d[1]), BLOCK_IDS):
        ids = np.concatenate([x for _, x in group]) if group else np.empty(0, np.uint64)
        words, escapes = encode(ids)
        block = b"".join((
            struct.pack("<5I", len(group), len(ids), len(words), len(escapes), sum(d is None for d, _ in group)),
            np.array([d or 0 for d, _ in group], "<i8").tobytes(),
            np.array([len(x) for _, x in group], "<u4").tobytes(),
            words.astype("<u8").tobytes(),
            escapes.astype("<u8").tobytes(),
        ))
        out.write(block)
        index.append((at, total, n_docs))
        at, total, n_docs = at + len(block), total + len(ids), n_docs + len(group)
    out.write(np.array(index, "<u8").tobytes())
    out.write(struct.pack("<Q", len(index)))
    return n_docs, total


def read_index(file) -> np.ndarray:
    """Rows (byte offset, ids before, documents before) of a seekable stream's blocks."""
    file.seek(0, io.SEEK_END)
    end = file.tell()
    file.seek(end - 8)
    (n,) = struct.unpack("<Q", file.read(8))
    file.seek(end - 8 - 24 * n)
    return np.frombuffer(file.read(24 * n), "<u8").reshape(n, 3)


def read_block(file, offset: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Document ids, how many of the first have none, their token counts and all their ids."""
    file.seek(offset)
    n_docs, n_ids, n_words, n_escapes, nameless = struct.unpack("<5I", file.read(20))
    docs = np.frombuffer(file.read(8 * n_docs), "<i8")
    counts = np.frombuffer(file.read(4 * n_docs), "<u4")
    words = np.frombuffer(file.read(8 * n_words), "<u8")
    return docs, nameless, counts, decode(words, np.frombuffer(file.read(8 * n_escapes), "<u8"), n_ids)


def _filesystem(uri: str):
    """Filesystem and path for what Python workers write: local and mounted folders, S3, GCS, HDFS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = 0) -> list[tuple[int, str, int, int]]:
    """Encodes texts and writes one file for each range of ids, in ascending order.

    Returns (part, path, documents, ids) of each file: one row for each partition, not for each document.
    A file appears under its name only when it is whole, so a repeated task replaces it by the same bytes.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def encoded(encoder):
            for batch in batches:
                rows = ((i.as_py(), t.as_py() or "") for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True))
                for group in in_groups(rows, lambda r: len(r[1]), GROUP):
                    for (doc, _), ids in zip(group, encoder.encode_many([t for _, t in group]), strict=True):
                        yield doc, np.frombuffer(ids + end, "<u4").astype(np.uint64)

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        system, path = _filesystem(f"{folder}/part-{part:06d}.s8b")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(f"{path}.{attempt}.tmp") as out, for_a_task(piece_encoder(vocabulary)) as encoder:
            n_docs, n_ids = write_file(out, encoded(encoder))
        system.move(f"{path}.{attempt}.tmp", path)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:06d}.s8b"], "n_docs": [n_docs], "n_ids": [n_ids]}, schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # by a hash too: rows without an id, or all of one id, are a range of their own that several tasks share
    known = id_and_text(docs).withColumn("h", F.xxhash64("text"))
    ordered = known.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    files = ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long").collect()
    return sorted((f.part, f.path, f.n_docs, f.n_ids) for f in files)


def read_token_files(spark, files: list[tuple[int, str, int, int]], with_ids: bool = True) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32, and ids (little-endian uint32 bytes) unless they are not asked for."""
    rows, start = [], 0
    for _, path, n_docs, n_ids in files:
        if n_docs:
            rows.append((path, start))
        start += n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                system, name = _filesystem(path)
                with system.open_input_file(name) as file:
                    for offset, before, _ in read_index(file).tolist():
                        docs, nameless, counts, ids = read_block(file, offset)
                        ends = np.cumsum(counts.astype(np.int64))
                        starts = ends - counts
                        raw = memoryview(ids.astype("<u4").tobytes())
                        blobs = [raw[4 * i : 4 * j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                        columns = [pa.array(docs, mask=np.arange(len(docs)) < nameless), pa.array(starts + before + base), pa.array(counts.astype(np.int64)), pa.array([crc32_of(b) for b in blobs], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns, names = [*columns, pa.array([bytes(b) for b in blobs], pa.binary())], [*names, "ids"]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    paths = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return paths.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op2_simple8b(spark, sf_dir: str) -> DataFrame:
    """Encodes ``documents``, writes Simple-8b files to the shared folder and reports them as read back."""
    from .common import documents

    files = write_token_files(documents(spark, sf_dir), shared_dir(spark), vocabulary_path("byte_bpe_50k.json"))
    return read_token_files(spark, files, with_ids=False)
