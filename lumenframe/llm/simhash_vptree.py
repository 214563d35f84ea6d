"""Near-duplicates by SimHash, with exact neighbours from vantage-point trees.

The fingerprint of a text has a bit for each of 64 positions: whether more than
half of its shingles' hashes have it set. Equal fingerprints are first made one
row. A vantage-point tree, fitted to a bounded sample, splits fingerprints by
their Hamming distance to a vantage point at a radius: near and far. By the
triangle inequality two fingerprints at most ``LINK`` bits apart are on
different sides only if both lie within ``LINK`` of the radius, so a row near the
boundary also visits the other side, and whole branches are pruned otherwise.
Each row has one home leaf; a task compares the homes of its leaf with each
other and with the visitors, splitting further by the same rule, and returns a
spanning forest of the links, from which components are made. All links are
found; only those that connect nothing new are left out.

A home goes over in one direction only, so no pair is compared twice at a split.
Each split sends some four tenths of the rows to both sides, so copies would grow
with the number of leaves. A table of up to ``LEAF * 2**DEPTH`` distinct
fingerprints is dealt by a tree of the depth it needs, at most seven to eight
rows for each. A larger one is dealt by two splits, and within their leaves by
the leading bits of each of four 16-bit bands: three differing bits leave a band
equal, so linked rows still meet. That is at most eight rows for each fingerprint
whatever the table's size. Every task grows its own tree over what it got, as
deep as it needs.

Empty and null texts have fingerprint zero, linked like any other. Rows with a
null doc_id belong to no component; of repeated rows of one id each is returned,
with the component of its own text. A component is named by its least id, so ties
cannot arise. Bits of a very long text are summed in pieces. An empty table gives
no rows. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, documents, drop_table, id_and_text, lean, materialised, released
from .components import components

LINK = 3
#: Fingerprints that the tree is fitted to, at most, and distinct fingerprints in a leaf, on average.
SAMPLE, LEAF = 20_000, 4096
#: Splits of the tree that deals a table, at most; and those of one that is also dealt by bands.
DEPTH, BANDED = 6, 2
#: Homes below which a task compares without splitting further.
BRUTE = 512
#: Shingles whose bits are summed at once.
PIECE = 1 << 16


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """SimHash of a text's word shingles, as an unsigned number."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    bits, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for k in range(0, n, PIECE):
        some = zip(starts[k : min(k + PIECE, n)].tolist(), ends[k + shingle - 1 : k + PIECE + shingle - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[i:j], 42) for i, j in some], np.uint64)
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in blobs(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(lean(run), "doc_id long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def choose_split(fps: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that part fps most evenly, or None if none parts them."""
    best = None
    for point in fps[:: max(1, len(fps) // 5)][:5]:
        below = np.cumsum(np.bincount(distance(fps, point), minlength=65))[:64]
        radius = int(np.abs(below - len(fps) / 2).argmin())
        even = min(below[radius], len(fps) - below[radius])
        if even and (best is None or even > best[0]):
            best = (even, point, radius)
    return best and best[1:]


def fit_tree(sample: np.ndarray, depth: int) -> list:
    """Nested [point, radius, near, far]; a leaf is its number."""
    leaves = iter(range(1 << 62))

    def grow(fps: np.ndarray, depth: int):
        split = choose_split(fps) if depth and len(fps) >= 8 else None
        if split is None:
            return next(leaves)
        point, radius = split
        near = distance(fps, point) <= radius
        return [int(point), radius, grow(fps[near], depth - 1), grow(fps[~near], depth - 1)]

    return grow(sample, depth)


def cross(d: np.ndarray, home: np.ndarray, radius: int, link: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that go near and far, with whether they are at home there.

    A home near the boundary visits the far side. A visitor goes wherever a home within link of it may be.
    """
    near = d <= radius
    to_near = near | (~home & (d <= radius + link))
    to_far = ~near | (d > radius - link)
    return to_near, home & near, to_far, home & ~near


def route(tree, fps: np.ndarray, link: int = LINK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, fingerprints, whether at home) for all leaves that rows reach."""
    todo = [(tree, fps, np.ones(len(fps), bool))]
    while todo:
        node, rows, home = todo.pop()
        if not len(rows):
            continue
        if not isinstance(node, list):
            yield node, rows, home
            continue
        point, radius, near, far = node
        to_near, home_near, to_far, home_far = cross(distance(rows, np.uint64(point)), home, radius, link)
        todo.append((near, rows[to_near], home_near[to_near]))
        todo.append((far, rows[to_far], home_far[to_far]))


class Forest:
    """Union by least index; link() takes many pairs at once."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            self.parent[x] = self.parent[up]
            x = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._roots(a), self._roots(b)
            differ = a != b
            a, b = np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ])
            # of several links up from one root, the last written holds; the others are tried again
            self.parent[a] = b

    def roots(self) -> np.ndarray:
        return self._roots(np.arange(len(self.parent)))


def leaf_forest(fps: np.ndarray, home: np.ndarray, link: int = LINK) -> np.ndarray:
    """Root index of each row, over links of homes with homes and visitors."""
    forest = Forest(len(fps))
    todo = [(np.arange(len(fps)), home)]
    while todo:
        rows, at_home = todo.pop()
        homes = rows[at_home]
        if not len(homes):
            continue
        split = choose_split(fps[homes]) if len(homes) > BRUTE else None
        if split is not None:
            to_near, home_near, to_far, home_far = cross(distance(fps[rows], split[0]), at_home, split[1], link)
            # a split that leaves nearly all rows on both sides gains nothing
            if max(to_near.sum(), to_far.sum()) < 0.95 * len(rows):
                todo += [(rows[to_near], home_near[to_near]), (rows[to_far], home_far[to_far])]
                continue
        for i in range(0, len(homes), 256):
            some = homes[i : i + 256]
            for j in range(0, len(rows), 8192):
                near, far = np.nonzero(distance(fps[some][:, None], fps[rows[j : j + 8192]][None, :]) <= link)
                forest.link(some[near], rows[j : j + 8192][far])
    return forest.roots()


def plan(n: int) -> tuple[int, int]:
    """Depth of the tree that deals n fingerprints, and leading bits of each band: no bands where the tree alone will do."""
    depth = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
    return (depth, 0) if depth <= DEPTH else (BANDED, min(16, depth))


def bands(rows: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For each of four bands, which group of equal leading bits the rows are in."""
    for k in range(4):
        yield (rows >> np.uint64(16 * k + 16 - bits) & np.uint64((1 << bits) - 1)).astype(np.int64) << 2 | k


def links(distinct: DataFrame, link: int = LINK) -> DataFrame:
    """(u, v): links that connect all fingerprints (distinct rows fp) that any chain of links connects."""
    depth, bits = plan(distinct.count())
    if bits and link > 3:
        raise ValueError("four bands find links of three bits at most")
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    tree = fit_tree(sample, depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for leaf, rows, home in route(tree, b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), link):
                for group in bands(rows, bits) if bits else [np.zeros(len(rows), np.int64)]:
                    yield pa.RecordBatch.from_arrays([pa.array(group << 16 | leaf), pa.array(rows.view(np.int64)), pa.array(home)], names=["leaf", "fp", "home"])

    def join(table: pa.Table) -> pa.Table:
        fps, home = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy()
        with released():
            roots = leaf_forest(fps, home, link)
        own = np.flatnonzero(roots != np.arange(len(fps)))
        return pa.Table.from_arrays([pa.array(fps[own].view(np.int64)), pa.array(fps[roots[own]].view(np.int64))], names=["u", "v"])

    return distinct.select("fp").mapInArrow(lean(deal), "leaf long, fp long, home boolean").groupBy("leaf").applyInArrow(join, "u long, v long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) for each row; and (fp, root, component_id) for each fingerprint of a row with an id."""
    rows = materialised(fingerprints(docs), "fingerprints")
    known = rows.filter("doc_id IS NOT NULL")
    distinct = materialised(known.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = materialised(components(links(distinct)), "components")
    rooted = materialised(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = materialised(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    found = materialised(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
    for done in (distinct, roots, rooted, least):
        drop_table(docs.sparkSession, done)
    return rows, found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the least doc_id that links reach."""
    rows, of = classes(docs)
    known = rows.filter("doc_id IS NOT NULL")
    return rows.filter("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long")).unionByName(known.join(of, "fp").select("doc_id", "fp", "component_id"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of ``documents``."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: of its least id, the row with the least text. Rows without an id stay.

    Rows that share an id but not a component are apart, each with its own component.
    """
    from pyspark.sql import Window

    from .common import own_name

    rows, of = classes(docs)
    ids = materialised(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("fp"), F.count("*").alias("n")), "ids")
    found = ids.filter("n = 1").join(of, "fp").filter("doc_id = component_id").select(F.col("doc_id").alias("_kept"))
    found = materialised(found, "kept")
    # ids of several rows: only these are fingerprinted again, and only their texts are ordered
    several = ids.filter("n > 1").select(F.col("doc_id").alias("_several"))
    pairs = rows.join(several, F.col("doc_id") == F.col("_several"), "left_semi").distinct().join(of, "fp").filter("doc_id = component_id")
    pairs = materialised(pairs.select(F.col("doc_id").alias("_kept"), F.col("fp").alias("_fp"), F.col("root").alias("_root")), "pairs")

    @F.arrow_udf("long")
    def print_of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x.as_py() or b"") for x in texts.cast(pa.binary())], np.uint64).view(np.int64))

    nth, fp, root, kept = (own_name(docs, n) for n in ("_nth", "_fp", "_root", "_kept"))
    first = lambda df, key: df.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy("text"))).filter(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
    one = docs.join(found, docs["doc_id"].cast("long") == found["_kept"], "left_semi")
    pairs = pairs.select(F.col("_kept").alias(kept), F.col("_fp").alias(f"{fp}_of"), F.col("_root").alias(root))
    some = docs.join(pairs.select(kept).distinct(), docs["doc_id"].cast("long") == F.col(f"`{kept}`"), "left_semi").withColumn(fp, print_of(F.col("text").cast("string")))
    apart = first(some.join(pairs, (some["doc_id"].cast("long") == pairs[kept]) & (some[fp] == pairs[f"{fp}_of"])), root)
    return one.unionByName(apart).unionByName(docs.filter("doc_id IS NULL"))
