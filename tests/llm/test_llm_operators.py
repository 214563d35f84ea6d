"""Each operator against brute force on a small table with awkward rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenframe.llm import bpe_count, bpe_prefix, fm_dedup, fm_index, packing, quality_bt, quality_rules, simhash_vptree, simple8b, topk_bond, toxicity_gbt
from lumenframe.llm.common import shared_dir
from lumenframe.llm.tokens import PieceEncoder, vocabulary_path

VOCABULARY = vocabulary_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, n_words int"


def make_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["the", "an", "er", "ti", "on", "ü", "st"]) for _ in range(rnd.randint(1, 4)))
    passage = " ".join(word() for _ in range(80))
    texts = [" ".join(word() + rnd.choice(["", "", ".", ",\n"]).strip(" ") for _ in range(rnd.choice([3, 40, 120, 400]))) for _ in range(40)]
    texts += [texts[3], texts[3], texts[7].replace("the", "The", 1), f"{texts[1]} {passage} {texts[2]}", f"x {passage}", passage, passage + " tail"]
    texts += ["", None, "   \n\t ", "word", "A a a a a a a a a a a a a a", "x<|endoftext|>y  z", "tab\there\r\n\n  two  spaces ", "\x00nul \x00a", "日本語 😀 مرحبا", "spam### spam*** $$$ %%% " * 20, "se " * 200, "long " * 30_000]
    rows = [(i, t, "en", "s", None, 0.5, "x", 1) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, passage, None, None, None, None, None, None), (10_000, passage, None, None, 3, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ids():
    encode = PieceEncoder(VOCABULARY)
    return lambda t: np.frombuffer(encode._library([t])[0], "<u4") if t else np.zeros(0, "<u4")


def test_op2_files_hold_all_ids_in_order(spark, docs, empty, rows, ids):
    got = simple8b.read_token_files(spark, simple8b.write_token_files(docs, shared_dir(spark), VOCABULARY)).collect()
    want = sorted(((-1 if r[0] is None else r[0], r[1] or "") for r in rows))
    got.sort(key=lambda r: r.start)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in got] == [w[0] for w in want]
    start = 0
    for r in got:
        assert r.start == start and len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32
        start += r.n_tokens
    expected = Counter((i, (np.append(ids(t), 0).astype("<u4")).tobytes()) for i, t in want)
    assert Counter((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in got) == expected
    assert simple8b.read_token_files(spark, simple8b.write_token_files(empty, shared_dir(spark), VOCABULARY)).count() == 0


def test_op2_least_id_and_many_rows_of_one_id(spark):
    rows = [(-(2**63), "least"), (None, "none"), *((5, f"text {i}") for i in range(200)), *((None, f"text {i}") for i in range(200))]
    files = simple8b.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), shared_dir(spark), VOCABULARY)
    got = simple8b.read_token_files(spark, files).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 201 + [-(2**63)] + [5] * 200 and sum(f[2] > 0 for f in files) > 2


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 5000])
@pytest.mark.parametrize("high", [2, 300, 2**32, 2**63])
def test_simple8b_round_trip(n, high):
    a = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64)
    words, escapes = simple8b.encode(a)
    assert (simple8b.decode(words, escapes, n) == a).all()


def test_op6_and_op8_agree_with_the_libraries(docs, rows, ids, empty):
    import public_tokenizers
    import tiktoken

    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in bpe_count.count_tokens(docs, VOCABULARY).collect())
    assert got == Counter((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for i, t, *_ in rows)
    path = vocabulary_path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_prefix.load_ranks(path), special_tokens={})
    want = Counter()
    for i, t, *_ in rows:
        x = library.encode_ordinary(t or "")
        want[i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe_prefix.encode_texts(docs, path, public_tokenizers.PATTERN).collect())) == want
    assert bpe_count.count_tokens(empty, VOCABULARY).count() == 0


def test_prefix_table_appends_and_edits():
    bpe, rnd = bpe_prefix.PrefixBPE(bpe_prefix.load_ranks(vocabulary_path("byte_bpe_50k.tiktoken"))), random.Random(2)
    for _ in range(60):
        data = bytes(rnd.choice(b"abctheing ") for _ in range(80))
        table, i = bpe_prefix.PrefixTable(bpe, data), rnd.randrange(80)
        j = rnd.randrange(i, 81)
        made = table.replace(i, j, b"thing")
        table.append(b"ing")
        assert table.ids() == bpe._merged(data[:i] + b"thing" + data[j:] + b"ing") and made <= 85


def test_op9_packs_every_id_once(docs, rows, ids, empty):
    got = packing.pack(docs, VOCABULARY).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, Counter())[r.start, r.length, r.ids_crc32] += 1
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    copies = Counter((r[0], r[1]) for r in rows)
    for (i, t), n in copies.items():
        x = np.append(ids(t), 0).astype("<u4")
        starts = sorted((s, k) for s, k, _ in by_doc[i])
        if n == 1 and i is not None:
            assert sum(k for _, k in starts) == len(x)
        for s, k, c in by_doc[i]:
            assert zlib.crc32(x[s : s + k].tobytes()) == c and by_doc[i][s, k, c] == n
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_best_fit_takes_the_tightest_window():
    windows, offsets, opened = packing.best_fit_decreasing([700, 600, 424, 324, 100], 1024)
    assert (windows, offsets, opened) == ([0, 1, 1, 0, 2], [0, 0, 600, 700, 0], 3)
    # 100 goes to the window with 124 left and not to the one with 324
    windows, offsets, _ = packing.best_fit_decreasing([900, 700, 100], 1024)
    assert windows[2] == 0 and offsets[2] == 900


def brute_counts(t):
    w, g = (t or "").encode().split(), []
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, covered = Counter(g), set()
    for i, x in enumerate(g):
        if c[x] >= 2:
            covered.update(range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_op10_counts_and_filter(spark, docs, rows, empty):
    signals, names = quality_rules.with_signals(docs)
    got = Counter(tuple(r) for r in signals.select("doc_id", *(F.col(f"`{names[k]}`") for k in quality_rules.BASE)).collect())
    assert got == Counter((i, *brute_counts(t)) for i, t, *_ in rows)
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    kept = quality_rules.filter_quality(docs, labels)
    assert kept.columns == docs.columns
    ok = Counter(i for i, t, *_ in rows if (b := brute_counts(t))[0] >= 10 and 100 * b[4] <= 20 * b[0])
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == ok
    assert quality_rules.filter_quality(empty, labels.limit(0)).count() == 0


def brute_cutoffs(rows, labels):
    """The certified cutoff of best balance for each stratum and signal, by plain counting and exact binomial sums."""
    from math import comb

    marks = {}
    for i, m in labels:
        marks[i] = min(marks.get(i, m), m)
    at = {}
    for i, t in sorted(set(rows)):
        w, lines = t.encode().split(), [x for x in t.split("\n") if x.encode().split()]
        if i in marks and len(w) >= 10:
            chars = max(1, sum(len(x.decode()) for x in w))
            signals = {
                "symbol_ratio": sum(t.count(c) for c in "#*$%&|<>") / chars, "upper_ratio": sum(c.isupper() for c in t) / chars, "shout_ratio": t.count("!") / len(w),
                "dup_line_ratio": (len(lines) - len(set(lines))) / max(1, len(lines)), "same_word_ratio": 1 - len(set(w)) / len(w),
            }
            at.setdefault(sum(len(w) >= b for b in quality_rules.BANDS) - 1, []).append((marks[i], signals))
    p, alpha, out = quality_rules.RISK / 5, quality_rules.LEVEL / 20, {}
    for band, found in at.items():
        n = sum(m for m, _ in found)
        for s, cutoffs in quality_rules.CUTOFFS.items():
            best = (0, None)
            for c in cutoffs:
                k = sum(m == 1 and x[s] >= c for m, x in found)
                if k > p * n or sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > alpha:
                    break
                best = max(best, (sum(m == 0 and x[s] >= c for m, x in found) - quality_rules.PENALTY * k, c), key=lambda z: z[0])
            if best[1] is not None:
                out[band, s] = best[1]
    return out


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_op10_cutoffs_are_those_of_plain_counting(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", broadcast)
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for i in range(2600):
        w = [word() for _ in range(12)]
        if i % 13 == 0:
            w = [x + rnd.choice(["%", "%%", "!"]) for x in w]
        if i == 400:
            w[0] = "AB"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 13 > 0)))
    rows += [rows[0]] * 40 + [(9000, "%%% " * 30)]
    labels += [(None, 0), (4, None), (8000, 1), (26, 1), (26, 0)]
    got = quality_rules.calibrate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    want = brute_cutoffs(rows, [x for x in labels if None not in x])
    assert got == want and (0, "symbol_ratio") in want and (0, "upper_ratio") not in want


def test_binomial_tail_is_exact(spark):
    from math import comb

    for k, n, p in ((0, 50, 0.01), (3, 400, 0.02), (1, 1000, 0.01)):
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        assert abs(got - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op3_components(docs, rows, empty):
    got = simhash_vptree.near_duplicates(docs).collect()
    fp = [brute_fingerprint(r[1]) for r in rows]
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter((r[0], f) for r, f in zip(rows, fp, strict=True))
    known = sorted({(r[0], f) for r, f in zip(rows, fp, strict=True) if r[0] is not None})
    parent = {k: k for k in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in known:
        for b in known:
            if (a[1] ^ b[1]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {k: find(k)[0] for k in known}
    assert all(r.component_id is None if r.doc_id is None else r.component_id == want[r.doc_id, r.fp % 2**64] for r in got)
    kept = simhash_vptree.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter([*{want[k] for k in known}, None])
    assert simhash_vptree.keep_one_each(empty).count() == 0


def test_tree_loses_no_link(monkeypatch):
    monkeypatch.setattr(simhash_vptree, "BRUTE", 40)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    fps = np.unique(np.concatenate([base, flip(base), flip(flip(base)), flip(flip(flip(base)))]))
    want, got = simhash_vptree.Forest(len(fps)), simhash_vptree.Forest(len(fps))
    want.link(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))
    homes = 0
    for _, part, home in simhash_vptree.route(simhash_vptree.fit_tree(fps, 3), fps):
        at = np.searchsorted(fps, part)
        got.link(at, at[simhash_vptree.leaf_forest(part, home)])
        homes += home.sum()
    assert homes == len(fps) and (got.roots() == want.roots()).all()


def test_op3_bands_lose_no_link(spark, monkeypatch):
    """A table too large for the tree alone: few rows a leaf, so that bands deal it too."""
    from lumenframe.llm.components import components

    monkeypatch.setattr(simhash_vptree, "LEAF", 8)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    fps = np.unique(np.concatenate([base, flip(flip(flip(base))), flip(flip(flip(flip(base)))), *[flip(flip(base[:1])) for _ in range(60)]]))
    assert simhash_vptree.plan(len(fps)) == (2, 7)
    want = simhash_vptree.Forest(len(fps))
    want.link(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))
    found = components(simhash_vptree.links(spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long"))).collect()
    got, place = simhash_vptree.Forest(len(fps)), {x: i for i, x in enumerate(fps.view(np.int64).tolist())}
    got.link(np.array([place[r.node] for r in found]), np.array([place[r.root] for r in found]))
    assert (got.roots() == want.roots()).all() and len(set(got.roots().tolist())) < 600


def test_op3_long_text_in_pieces(monkeypatch):
    text = b" ".join(b"w%d" % (i * i % 97) for i in range(1000))
    whole = simhash_vptree.fingerprint(text)
    monkeypatch.setattr(simhash_vptree, "PIECE", 7)
    assert simhash_vptree.fingerprint(text) == whole == brute_fingerprint(text.decode())


def brute_kept(rows):
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append((t or "").encode().split())
    first = {}
    for i, ts in texts.items():
        for w in ts:
            for k in range(len(w) - 49):
                x = tuple(w[k : k + 50])
                if i is not None:
                    first[x] = min(first.get(x, i), i)
    out = Counter()
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out[i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    return out


def test_op7_removes_what_earlier_documents_hold(spark, docs, rows, empty, monkeypatch):
    small = docs.filter("length(coalesce(text, '')) < 50000")
    want = brute_kept([r for r in rows if len(r[1] or "") < 50000])
    got = fm_dedup.remove_repeated(small)
    assert got.columns == docs.columns
    kept = {(i, k) for i, n, gone, k in want if not gone or k}
    assert {(r.doc_id, b" ".join((r.text or "").encode().split())) for r in got.collect()} == kept
    assert any(gone for _, _, gone, _ in want)
    assert fm_dedup.remove_repeated(empty).count() == 0


@pytest.mark.parametrize("words", [1, 300, 1_000_000])
def test_op7_hot_keys_are_cut_anew(spark, monkeypatch, words):
    """Near copies with shared and unshared edits, exact copies, and a passage that many texts quote; all in a very long text too."""
    monkeypatch.setattr(fm_dedup, "SHARD_WORDS", words)
    monkeypatch.setattr(fm_dedup, "PIECE", 30)
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage, text = [word() for _ in range(60)], [word() for _ in range(160)]

    def near():
        edited = list(text)
        for _ in range(2):
            edited[rnd.randrange(160)] = rnd.choice(["one", "two", word()])
        return " ".join(edited)

    rows = [(i, " ".join([*(word() for _ in range(20)), *passage, *(word() for _ in range(20))])) for i in range(25)]
    rows += [(100 + i, near()) for i in range(40)] + [(200 + i, " ".join(text)) for i in range(10)] + [(50, "se " * 300), (51, "se " * 90)]
    rows += [(7, near()), (300, " ".join([*(word() for _ in range(5000)), *text, *(word() for _ in range(5000))]))]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, tuple((r.text or "").encode().split())) for r in fm_dedup.remove_repeated(docs).collect()}
    assert got == {(i, tuple(k.split())) for i, _, gone, k in brute_kept(rows) if not gone or k}


def test_fm_index_matches_brute_force():
    rng = np.random.default_rng(4)
    sources = [rng.integers(1, 5, n) for n in (200, 90, 50)]
    queries = [np.concatenate([s[10:70], rng.integers(1, 5, 30), s[-55:]]) for s in sources] + [rng.integers(0, 9, 120), rng.integers(1, 5, 10)]
    index = fm_index.FMIndex(sources, [7, 3, 9], 20)
    for q, got in zip(queries, index.matches(queries), strict=True):
        for k in range(len(q) - 19):
            held = [d for s, d in zip(sources, (7, 3, 9), strict=True) if any((s[i : i + 20] == q[k : k + 20]).all() for i in range(len(s) - 19))]
            assert got[k] == (min(held) if held else -1)


def vector_rows():
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 24)]) for i in range(300)]
    rows += [(400, rows[0][1]), (401, None), (402, [1.0, None]), (403, [float("nan")] * 24), (404, []), (405, [float("inf")] * 24), (None, rows[1][1]), (406, [0.5] * 3)]
    return [*rows, rows[2], rows[50], rows[50], (100, rows[0][1]), (100, []), (None, [])]


@pytest.mark.parametrize("block", [8192, 40])
def test_op4_is_exact(spark, monkeypatch, block):
    """Brute force and SQL on a table with repeated ids, rows without one, and empty vectors; one block and many."""
    import duckdb

    monkeypatch.setattr(topk_bond, "CANDIDATES", block)
    monkeypatch.setattr(topk_bond, "QUERIES", block // 10)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    v = [(i, np.pad(np.floor(256 * np.array(e)), (0, 24 - len(e)))) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = Counter()
    for a, (q, x) in enumerate(v):
        if q is not None and q % 50 == 0:
            best = sorted(((-int(x @ y), c is None, c) for b, (c, y) in enumerate(v) if b != a), key=lambda z: (z[0], z[1], z[2] or 0))[:5]
            want.update((q, r, c, -s) for r, (s, _, c) in enumerate(best, 1))
    got = topk_bond.top_k(topk_bond.quantised(df), F.col("vec_id") % 50 == 0)
    assert Counter(map(tuple, got.collect())) == want
    embeddings = df.toArrow()  # noqa: F841
    assert Counter(duckdb.sql(topk_bond.SQL).fetchall()) == want
    assert topk_bond.top_k(topk_bond.quantised(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_op4_large_components_stay_exact():
    q, x = np.array([[2**40, -(2**40)]]), np.array([[2**40, 5], [-(2**40), 7], [3, 2**39]])
    rows = np.array([1, 2, 3])
    assert [t.tolist() for t in topk_bond.search(q, np.array([9]), x, rows, rows, 1)] == [[0], [0], [2**63 - 1]]


def test_op4_known_scores_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    q, x, rows = rng.integers(-99, 99, (7, 40)), rng.integers(-99, 99, (500, 40)), np.arange(500)
    scores = q @ x.T
    for known in (None, np.sort(scores, 1)[:, -3].tolist()):
        i, j, s = topk_bond.search(q, np.arange(1000, 1007), x, rows, rows, 3, known)
        assert sorted(zip(i.tolist(), s.tolist())) == sorted((a, b) for a in range(7) for b in np.sort(scores[a])[-3:].tolist()) and (scores[i, j] == s).all()


def labelled(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "ne", "ru"]) for _ in range(rnd.randint(2, 4)))
    rows, labels = [], []
    for i in range(300):
        w = [word() for _ in range(60)]
        bad, toxic = i % 4 == 0, i % 3 == 0
        if bad:
            w = [x + "%%%" for x in w]
        if toxic:
            for _ in range(5):
                w[rnd.randrange(60)] = rnd.choice(["grobian", "nastyword"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "ka lo mi"), rows[0]]
    labels += [(None, 1, 1), (5000, None, None), (1000, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_op1_and_op5_learn_held_out_labels(spark):
    docs, labels = labelled(spark)
    marks = {r.doc_id: r for r in labels.collect()}
    got = quality_bt.score_texts(docs, quality_bt.fit(docs, labels)).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    hits = [r.predicted == marks[r.doc_id].quality for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean(hits) > 0.95
    score = toxicity_gbt.scorer(toxicity_gbt.fit(docs, labels))
    got = docs.select("doc_id", score("text").alias("score")).collect()
    hits = [(r.score >= 0.5) == (marks[r.doc_id].toxic == 1) for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == 304 and np.mean(hits) > 0.95
    assert quality_bt.fit(docs, labels.limit(0)) is None and toxicity_gbt.fit(docs.limit(0), labels) is None
    assert {r.score for r in docs.select(toxicity_gbt.scorer(None)("text").alias("score")).collect()} == {0.0}


def test_isotonic_ascends():
    x, y = toxicity_gbt.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and np.interp(2.5, x, y) == 0.5
