"""Quality scores by Bradley-Terry pairwise ranking.

A document's worth is linear in features of its whole text. Training pairs one
labelled good document with one bad one; that the good one is preferred has the
logistic probability of the difference in worth, so the weights come from a
logistic regression on feature differences (Newton steps with a ridge). Worths
are then cut at a quantile of the training worths: the quantile level is the one
that errs least on the training labels, in the middle of the gap it falls in.
The published score is the logistic of the worth's distance from the cut, moved
so that the cut is at ``THRESHOLD``.

The fit uses at most ``FIT_ROWS`` labelled ids of each class and ``PAIRS`` pairs,
whatever the table's size; every document is scored. Scores see the text only.

Null and empty texts are scored as texts of no words. Rows with null or repeated
ids are scored like any other; a null id is not held out. Without labels of both
classes every score is 0.7. An empty table gives no rows. A very long text is held
alone, with its words. Repeated rows of an id count once in fitting, by their
greatest features; equal texts get equal scores, and a score equal to the
threshold is good. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, crc32_mod, documents, id_and_text
from .learning import CLASSES, class_counts, labelled_sample, one_per_id, sigmoid

THRESHOLD = 0.7
FIT_ROWS = 10_000
PAIRS = 200_000
RIDGE = 1e-3


def features(data: bytes) -> list[float]:
    """Shares of byte classes, word and line statistics of one text."""
    counts = class_counts(data)
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    marked = sum(c for w, c in seen.items() if w[-1] in b"#*$%&!|" or w[0] in b"#*$%&|")
    return [
        *(counts / size).tolist(),
        np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), len(seen) / n, max(seen.values(), default=0) / n,
        1 - len(pairs) / max(1, len(words) - 1), sum(c for c in pairs.values() if c > 1) / n, marked / n,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), sum(c for w, c in seen.items() if w.isupper()) / n, sum(c for w, c in seen.items() if len(w) == 1) / n,
    ]


N_FEATURES = len(CLASSES) + 12
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def _expand(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, and their squares."""
    z = np.clip((x - centre) / scale, -8, 8)
    return np.hstack([z, z * z / 8])


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> np.ndarray:
    """Bradley-Terry weights for rows of features; each pair prefers a good row to a bad one."""
    rng = np.random.default_rng(7)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(12):
        p = sigmoid(-(d @ w))
        gradient = d.T @ p / pairs - ridge * w
        curvature = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def quantile_cut(worth: np.ndarray, label: np.ndarray) -> float:
    """The worth at the quantile level that errs least, in the middle between its neighbours."""
    order = np.argsort(worth, kind="stable")
    ranked = label[order]
    # at level k the k lowest rows are called bad
    errors = np.concatenate([[0], np.cumsum(ranked == 1)]) + np.concatenate([np.cumsum((ranked == 0)[::-1])[::-1], [0]])
    k = int(np.argmin(errors))
    values = worth[order]
    return float((values[max(0, k - 1)] + values[min(k, len(values) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> tuple | None:
    """(centre, scale, weights, cut), or None without labels of both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([features(x) for x in blobs(b)], pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, "quality", 4, 2, FIT_ROWS).mapInArrow(run, "doc_id long, label int, x array<double>")
    rows = one_per_id(sample).select("label", "x").toArrow()
    label = rows.column("label").to_numpy()
    if len(set(label.tolist())) < 2:
        return None
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(len(label), -1)
    order = np.lexsort((*x.T, label))  # the order that rows arrive in does not matter
    x, label = x[order], label[order]
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = _expand(x, centre, scale)
    w = fit_pairs(z[label == 1], z[label == 0])
    return centre, scale, w, quantile_cut(z @ w, label)


def score_texts(docs: DataFrame, model: tuple | None) -> DataFrame:
    """doc_id, score and predicted for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(d) for d in blobs(b)]).reshape(b.num_rows, N_FEATURES)
            if model is None:
                score = np.full(len(x), THRESHOLD)
            else:
                centre, scale, w, cut = model
                score = sigmoid(_expand(x, centre, scale) @ w - cut + np.log(THRESHOLD / (1 - THRESHOLD)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def op1_bradley_terry(spark, sf_dir: str) -> DataFrame:
    """Scores ``documents`` with weights learnt from ``labels``."""
    docs = documents(spark, sf_dir)
    scored = score_texts(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
