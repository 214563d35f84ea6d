"""What the two classifiers compute, against plain calculations; and how full packed sequences are."""

import numpy as np

from lumenframe.llm import packing, quality_bt, toxicity_gbt
from lumenframe.llm.learning import CLASSES, class_counts, sigmoid
from lumenframe.llm.tokens import vocabulary_path


def test_op1_weights_are_where_the_penalised_loss_is_least():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.4, 1, (60, 3)), rng.normal(-0.4, 1, (50, 3))
    w = quality_bt.fit_pairs(good, bad, 4000)
    pick = np.random.default_rng(7)
    d = good[pick.integers(0, 60, 4000)] - bad[pick.integers(0, 50, 4000)]
    loss = lambda v: np.log1p(np.exp(-(d @ v))).mean() + quality_bt.RIDGE * (v @ v) / 2
    around = [loss(w + step) for step in 0.01 * np.vstack([np.eye(3), -np.eye(3)])]
    assert loss(w) < min(around)
    numeric = [(loss(w + e) - loss(w - e)) / 2e-5 for e in 1e-5 * np.eye(3)]
    assert np.abs(numeric).max() < 1e-6


def test_op1_cut_errs_least():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 30):
        for _ in range(20):
            worth, label = rng.normal(0, 1, n).round(1), rng.integers(0, 2, n)
            cut = quality_bt.quantile_cut(worth, label)
            # a tie of worths cannot be cut: then at most the tied rows err besides
            errors = lambda c, s=worth, y=label: int(((s >= c) != (y == 1)).sum())
            best = min(errors(c) for c in [*np.unique(worth), worth.max() + 1])
            tied = max(np.unique(worth, return_counts=True)[1])
            assert errors(cut) <= best + tied


def test_op1_features_of_a_small_text():
    data = b"Ab ab\\nab! ab!\\n\\n#x Q".replace(b"\\n", b"\n")
    got = quality_bt.features(data)
    words = data.split()
    assert len(got) == quality_bt.N_FEATURES
    shares = [sum(b in members for b in data) / len(data) for members in CLASSES.values()]
    assert np.allclose(got[: len(CLASSES)], shares)
    rest = got[len(CLASSES) :]
    pairs = list(zip(words, words[1:]))
    assert np.allclose(rest[0], np.log1p(6)) and np.allclose(rest[1], np.mean([len(w) for w in words])) and np.allclose(rest[3], len(set(words)) / 6)
    assert np.allclose(rest[5], 1 - len(set(pairs)) / 5) and np.allclose(rest[7], 3 / 6) and np.allclose(rest[11], 1 / 6)
    assert quality_bt.features(b"") is not None and class_counts(b"").sum() == 0


def naive_trees(x, y, edges, base):
    """The same boosting, one node and one row at a time."""
    bins = np.array([[sum(v >= e for e in edges[j]) for j, v in enumerate(row)] for row in x])
    f = [base] * len(y)

    def grow(rows, depth, g, h):
        if depth < toxicity_gbt.DEPTH:
            best = (1e-6, None)
            for j in range(x.shape[1]):
                for cut in range(max(map(len, edges)) + 1):
                    left, right = [i for i in rows if bins[i, j] <= cut], [i for i in rows if bins[i, j] > cut]
                    if min(len(left), len(right)) < toxicity_gbt.LEAF:
                        continue
                    part = lambda some: sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + 1)
                    gain = part(left) + part(right) - part(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, (left, right))
            if best[1]:
                return {**grow(best[1][0], depth + 1, g, h), **grow(best[1][1], depth + 1, g, h)}
        value = toxicity_gbt.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1) if rows else 0.0
        return dict.fromkeys(rows, value)

    for _ in range(toxicity_gbt.TREES):
        q = [float(sigmoid(np.array(v))) for v in f]
        g, h = [t - p for t, p in zip(y, q)], [p * (1 - p) + 1e-9 for p in q]
        step = grow(list(range(len(y))), 0, g, h)
        f = [v + step[i] for i, v in enumerate(f)]
    return np.array(f)


def test_op5_trees_are_those_of_plain_boosting(monkeypatch):
    monkeypatch.setattr(toxicity_gbt, "TREES", 4)
    monkeypatch.setattr(toxicity_gbt, "BINS", 6)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (60, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(0, 0.3, 60) > 0.3).astype(float)
    model = toxicity_gbt.BoostedTrees.fit(x, y)
    assert np.allclose(model.decision(x), naive_trees(x, y, model.edges, model.base))


def test_op5_isotonic_is_the_best_ascending_fit():
    rng = np.random.default_rng(4)
    for _ in range(10):
        f, y = rng.integers(0, 12, 40).astype(float), rng.integers(0, 2, 40).astype(float)
        xs, ys = toxicity_gbt.isotonic(f, y)
        values = np.unique(f)
        # the least-squares ascending fit: the greatest over starts of the least over ends of the means between
        want = [max(min(y[(f >= a) & (f <= b)].mean() for b in values if b >= v) for a in values if a <= v) for v in values]
        assert np.allclose(np.interp(values, xs, ys), want)


def test_op9_sequences_are_nearly_full(spark):
    """Little padding: at most one sequence in fifty beyond what the tokens fill, and one a task."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(1, 1500, 1500))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(docs, vocabulary_path("byte_bpe_50k.json")).toPandas()
    needed = -(-int(got.length.sum()) // 1024)
    assert got.sequence_id.nunique() <= needed * 1.02 + 3
    assert (got.groupby("sequence_id").length.sum() <= 1024).all()
