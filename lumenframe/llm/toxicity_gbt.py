"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learnt from the training texts first: words, and word beginnings of
four to six letters, that follow many different words in toxic texts (so that
copies of one text prove nothing) and are much rarer in clean ones. Features are
densities of lexicon hits, their nearness to second-person words, capitals,
punctuation and obfuscation rates. Trees are fitted to the logistic loss on
histograms; a third of the training rows, left out of the trees, gives the
isotonic map from the trees' sum to a probability.

Fitting uses at most ``FIT_TOXIC`` and ``FIT_CLEAN`` labelled ids and
``LEXICON`` entries of the greatest lift times contexts, whatever the table's
size; every document is scored whole. ``LEXICON`` bounds the model, as the number
of trees does: 157 entries reach the lift with 352 labelled toxic texts, 395 with
1,735, so that none is cut.

Null and empty texts are scored as texts of no words. Rows with null or repeated
ids are scored like any other; a null id is not held out. Without labels of both
classes every score is 0. An empty table gives no rows. A very long text is held
alone, with its words. Of entries with equal lift the alphabetically first are
taken, of splits with equal gain the first feature and bin; equal scores stay
equal. Repeated rows of an id count once in fitting, by their greatest features.
Other columns are carried along, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, documents, id_and_text, lean, materialised, own_name, released
from .learning import CLASSES, class_counts, labelled_sample, one_per_id, sigmoid

THRESHOLD = 0.5
FIT_CLEAN = FIT_TOXIC = 10_000
LEXICON = 4096
#: Different words before an entry in toxic texts, at least, and how many times likelier it must be there.
CONTEXTS, LIFT = 4, 12.0
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 32, 5
#: Second-person words of the four languages (fixed values).
SECOND = frozenset("you your yours yourself ye u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os su".split())
#: Signs that stand for letters (fixed values).
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": "", "-": "", "_": "", ".": "", "#": "", "+": "t"})
EDGE = ".,;:!?\"'`()[]{}<>#*$%&|-_"
KNOWN_WORDS = 300_000
#: Keys that a task sums before it passes them on.
KNOWN_KEYS = 200_000


def keys_of(word: str) -> list[str]:
    """Lexicon keys of a lower-case word: itself and its beginnings."""
    w = word.strip(EDGE)
    return [f"={w}", *(w[:k] for k in (4, 5, 6) if len(w) > k)] if w else []


class Featurizer:
    """Features of texts for one lexicon; remembers the flags of words."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.flags: dict[str, tuple[float, int, int, int]] = {}

    def _flag(self, word: str) -> tuple[float, int, int, int]:
        """Weight of the best key, and whether it is a word, a beginning, or found only behind a disguise."""
        get = self.lexicon.get
        keys = keys_of(word)
        whole = get(keys[0], 0.0) if keys else 0.0
        part = max((get(k, 0.0) for k in keys[1:]), default=0.0)
        hidden = 0
        if not whole and not word.isalpha() and (plain := word.strip(".,;:?").translate(LEET)) != word:
            hidden = int(get(f"={plain}", 0.0) > 0)
        return (max(whole, part), int(whole > 0), int(part > 0), hidden)

    def __call__(self, text: str) -> list[float]:
        words = text.lower().split()
        seen, flags = Counter(words), self.flags
        if len(flags) > KNOWN_WORDS:
            flags.clear()
        weight = whole = part = hidden = kinds = second = marked = 0
        hits = set()
        for w, c in seen.items():
            f = flags.get(w)
            if f is None:
                f = flags[w] = self._flag(w)
            if f[0] or f[3]:
                weight, whole, part, hidden, kinds = weight + f[0] * c, whole + f[1] * c, part + f[2] * c, hidden + f[3] * c, kinds + 1
                hits.add(w)
            if w in SECOND:
                second += c
            if not w.isalnum() and any(x in "@$*!#" for x in w[1:-1]):
                marked += c
        near, n = 0, max(1, len(words))
        if hits and second:
            at = np.flatnonzero([w in SECOND for w in words])
            for i, w in enumerate(words):
                if w in hits:
                    k = np.searchsorted(at, i)
                    near += any(0 <= j < len(at) and abs(at[j] - i) <= 5 for j in (k - 1, k))
        data = text.encode()
        counts = class_counts(data) / max(1, len(data))
        total = whole + part + hidden
        return [
            weight / n, whole / n, part / n, hidden / n, math.log1p(whole), math.log1p(part), math.log1p(total), kinds / n, math.log1p(kinds), weight / max(1, total),
            near / n, near / max(1, total), second / n, marked / n, math.log1p(len(words)), *counts.tolist(),
        ]


N_FEATURES = 15 + len(CLASSES)


class BoostedTrees:
    """Trees of fixed depth over binned features, boosted on the logistic loss."""

    def __init__(self, edges: list[np.ndarray], base: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.edges, self.base, self.trees = edges, base, trees

    @staticmethod
    def _bin(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1).astype(np.int64) if len(x) else np.zeros((0, len(edges)), np.int64)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        # a rare non-zero value is lost between quantiles: an edge just above the commonest value keeps it apart
        edges = [np.unique(np.append(e, np.nextafter(np.median(x[:, j]), np.inf))) for j, e in enumerate(edges)]
        bins, p = cls._bin(x, edges), np.clip(y.mean(), 1e-6, 1 - 1e-6)
        base, width = float(np.log(p / (1 - p))), max(len(e) for e in edges) + 1
        f, trees = np.full(len(y), base), []
        for _ in range(TREES):
            q = sigmoid(f)
            g, h = y - q, q * (1 - q) + 1e-9
            node, feature, cut = np.zeros(len(y), np.int64), np.zeros(2**DEPTH, np.int64), np.full(2**DEPTH, 1 << 30)
            for depth in range(DEPTH):
                n = 2**depth
                best, which = np.full(n, 1e-6), [None] * n
                for j in range(x.shape[1]):
                    at = node * width + bins[:, j]
                    G, H, C = (np.cumsum(np.bincount(at, w, n * width).reshape(n, width), 1) for w in (g, h, np.ones(len(y))))
                    GT, HT, CT = G[:, -1:], H[:, -1:], C[:, -1:]
                    gain = G**2 / (H + 1) + (GT - G) ** 2 / (HT - H + 1) - GT**2 / (HT + 1)
                    gain[(C < LEAF) | (CT - C < LEAF)] = 0
                    for k, b in enumerate(gain.argmax(1)):
                        if gain[k, b] > best[k]:
                            best[k], which[k] = gain[k, b], (j, b)
                for k, w in enumerate(which):
                    if w:
                        feature[n + k], cut[n + k] = w
                node = 2 * node + (bins[np.arange(len(y)), feature[n + node]] > cut[n + node])
            G, H = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
            value = RATE * G / (H + 1)
            trees.append((feature, cut, value))
            f += value[node]
        return cls(edges, base, trees)

    def decision(self, x: np.ndarray) -> np.ndarray:
        bins, rows, f = self._bin(x, self.edges), np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.ones(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + (bins[rows, feature[node]] > cut[node])
            f += value[node - 2**DEPTH]
        return f


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the best ascending fit of y to f (pool adjacent violators), as points to interpolate between."""
    # equal sums are one point before any are pooled with their neighbours
    values, place, weights = np.unique(f, return_inverse=True, return_counts=True)
    means = np.bincount(place, y, len(values)) / weights
    blocks: list[list[float]] = []  # mean, weight, first f, last f
    for v, t, n in zip(values.tolist(), means.tolist(), weights.tolist(), strict=True):
        blocks.append([t, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, weight, _, end = blocks.pop()
            last = blocks[-1]
            last[0], last[1], last[3] = (last[0] * last[1] + mean * weight) / (last[1] + weight), last[1] + weight, end
    xs, ys = [], []
    for mean, _, first, end in blocks:
        xs += [first, end] if end > first else [first]
        ys += [mean, mean] if end > first else [mean]
    return np.array(xs), np.array(ys)


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Keys and their log lift, from rows (text, label); at most LEXICON of them."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("text"):
                words = (x.as_py() or "").lower().split()
                found = {(k, before) for before, w in zip(["", *words], words, strict=False) for k in keys_of(w)}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=["key", "before"])

    toxic = sample.filter("label = 1").select("text").mapInArrow(lean(contexts), "key string, before string")
    toxic = toxic.distinct().groupBy("key").agg(F.count("*").alias("often")).filter(F.col("often") >= CONTEXTS)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that hold each key, by label, summed while they are few; the empty key counts texts."""
        counts: Counter = Counter()

        def summed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["label", "key", "n"])

        for b in batches:
            for label, x in zip(b.column("label").to_pylist(), b.column("text"), strict=True):
                counts.update({(label, k) for w in set((x.as_py() or "").lower().split()) for k in keys_of(w)})
                counts[label, ""] += 1
                if len(counts) > KNOWN_KEYS:
                    yield summed()
                    counts.clear()
        yield summed()

    of = lambda k: F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(f"n{k}")
    texts = materialised(sample.select("label", "text").mapInArrow(lean(occurrences), "label int, key string, n long").groupBy("key").agg(of(0), of(1)), "keys")
    total = texts.filter("key = ''").first()
    if total is None:
        return {}
    share = lambda n, all_: (n + 0.5) / (all_ + 1)
    lift = F.log(share(F.col("n1"), total.n1) / share(F.col("n0"), total.n0))
    # every candidate's lift is known before any is cut; at most LEXICON keys reach the driver
    best = toxic.join(texts, "key").withColumn("lift", lift).filter(F.col("lift") >= math.log(LIFT))
    best = best.orderBy(F.desc(F.col("lift") * F.col("often")), "key").limit(LEXICON).select("key", "n0", "n1").collect()
    return {r.key: round(math.log(share(r.n1, total.n1) / share(r.n0, total.n0)), 6) for r in best}


def fit(docs: DataFrame, labels: DataFrame) -> tuple | None:
    """(lexicon, trees, isotonic points), or None without labels of both classes."""
    # written once: it is read three times
    sample = materialised(labelled_sample(docs, labels, "toxic", 5, 0, max(FIT_CLEAN, FIT_TOXIC)), "sample")
    lexicon = learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer(lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([of(x.as_py() or "") for x in b.column("text")], pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    rows = one_per_id(sample.mapInArrow(lean(run), "doc_id long, label int, x array<double>")).toArrow()
    if rows.num_rows == 0:
        return None
    doc, label = rows.column("doc_id").to_numpy(), rows.column("label").to_numpy().astype(float)
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(len(label), -1)
    order = np.argsort(doc, kind="stable")
    x, label = x[order], label[order]
    apart = np.arange(len(label)) % 3 == 2
    if min(label[~apart].sum(), (1 - label[~apart]).sum(), label[apart].sum(), (1 - label[apart]).sum()) < 1:
        return None
    trees = BoostedTrees.fit(x[~apart], label[~apart])
    return lexicon, trees, isotonic(trees.decision(x[apart]), label[apart])


def scorer(model: tuple | None):
    """An Arrow UDF from text to probability."""

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Featurizer(model[0]) if model else None
        with released():
            for texts in batches:
                if model is None:
                    yield pa.array(np.zeros(len(texts)))
                    continue
                x = np.array([of(t.as_py() or "") for t in texts]).reshape(len(texts), N_FEATURES)
                yield pa.array(np.interp(model[1].decision(x), *model[2]))
            of = None

    return toxicity


def filter_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, with docs' own columns."""
    score = own_name(docs, "_toxicity")
    scored = docs.withColumn(score, scorer(fit(docs, labels))(docs["text"].cast("string")))
    return scored.filter(F.col(score) < THRESHOLD).drop(score)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores ``documents`` with trees learnt from ``labels``."""
    docs = documents(spark, sf_dir)
    score = scorer(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = id_and_text(docs).select("doc_id", score("text").alias("score"))
    held = F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
