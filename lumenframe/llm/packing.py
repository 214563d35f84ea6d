"""Packing of documents into fixed windows by best-fit decreasing.

A document is its token ids and the end id. Documents longer than a window are
first cut into full windows, each a sequence of its own; what is left of each
document, and every shorter document, is an item. The items of one input
partition are placed from the longest to the shortest, each in the open window
with the least room that still holds it. That window is found in a segment tree
over remaining capacities, so an item costs the logarithm of the window size and
not of the number of open windows.

Each input partition packs its own documents: no shuffle, memory of a few words
for each document, and no task depends on the table's size. Sequence ids carry
the partition's number in their upper half. Items are ordered by length, id and
start, so a repeated task gives the same rows.

Null and empty texts are one end id. Rows with a null or repeated doc_id are
packed as documents of their own. An empty table gives no rows. A very long text is
held alone while it is cut into full windows. Of windows with equal room the one
opened or filled last is taken. A document's token count must be below 2**31. Only
doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import crc32_of, documents, id_and_text, lean
from .tokens import GROUP, for_a_task, in_groups, piece_encoder, vocabulary_path

WINDOW = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


class CapacityTree:
    """Open windows by remaining capacity, 1 to size; finds the smallest capacity that holds an item."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.base + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, window: int, capacity: int) -> None:
        if capacity:
            self.windows[capacity].append(window)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns the (window, capacity) of least capacity at or above need."""
        count, node = self.count, self.base + need
        if not count[node]:
            # up to the first right sibling that holds a window, then down its left side
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node <<= 1
                if not count[node]:
                    node += 1
        capacity = node - self.base
        self._add(capacity, -1)
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each item; lengths are in descending order and at most size."""
    tree, windows, offsets, opened = CapacityTree(size), [], [], 0
    for n in lengths:
        found = tree.take(n)
        if found is None:
            found, opened = (opened, size), opened + 1
        window, capacity = found
        windows.append(window)
        offsets.append(size - capacity)
        tree.put(window, capacity - n)
    return windows, offsets, opened


def pack(docs: DataFrame, vocabulary: str, size: int = WINDOW, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document: where it lies in its document and in which sequence."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        opened, items = 0, []
        with for_a_task(piece_encoder(vocabulary)) as encoder:
            for batch in batches:
                rows = ((i.as_py(), t.as_py() or "") for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True))
                for group in in_groups(rows, lambda r: len(r[1]), GROUP):
                    full = []
                    for (doc, _), ids in zip(group, encoder.encode_many([t for _, t in group]), strict=True):
                        ids += end
                        n = len(ids) // 4
                        for start in range(0, n - n % size, size):
                            full.append((doc, start, size, crc32_of(ids[4 * start : 4 * (start + size)]), n, first + opened, 0))
                            opened += 1
                        if n % size:
                            start = n - n % size
                            items.append((-(n % size), doc is not None, doc or 0, start, crc32_of(ids[4 * start :]), n))
                    if full:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*full, strict=True)], schema=_ARROW)
        items.sort()
        windows, offsets, _ = best_fit_decreasing([-x[0] for x in items], size)
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([
                pa.array([x[2] if x[1] else None for x in part], pa.int64()), pa.array([x[3] for x in part], pa.int64()), pa.array([-x[0] for x in part], pa.int64()),
                pa.array([x[4] for x in part], pa.int64()), pa.array([x[5] for x in part], pa.int64()),
                pa.array(np.array(windows[i : i + 50_000], np.int64) + (first + opened)), pa.array(offsets[i : i + 50_000], pa.int64()),
            ], schema=_ARROW)

    return id_and_text(docs).mapInArrow(lean(run), SCHEMA)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Packs ``documents`` into sequences of 1024 tokens."""
    return pack(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))
