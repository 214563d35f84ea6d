"""The whole pipeline against brute force, with labels of too few rows to learn from."""

import zlib
from collections import Counter

import numpy as np
from test_llm_operators import SCHEMA, VOCABULARY, brute_counts, brute_fingerprint, brute_kept, make_rows

import corpus_pipeline
from lumenframe.llm.tokens import PieceEncoder


def test_run_gives_what_brute_force_gives(spark, tmp_path):
    rows = [r for r in make_rows() if r[0] is not None and len(r[1] or "") < 50_000]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, None), (1, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [r for r in rows if (b := brute_counts(r[1]))[0] >= 10 and 100 * b[4] <= 20 * b[0]]
    fp, part = [brute_fingerprint(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(len(rows)):
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                part = [part[a] if p == part[b] else p for p in part]
    least = {}
    for p, r in zip(part, rows, strict=True):
        least[p] = min(least.get(p, r), r, key=lambda x: x[0])
    rows = sorted(least.values(), key=lambda r: r[0])
    texts = {r[0]: r[1] for r in rows}
    cut = {i: k.decode() if gone else texts[i] for i, n, gone, k in brute_kept(rows) if k}
    assert cut != texts
    encode, want, got = PieceEncoder(VOCABULARY), {}, {}
    for i, t in cut.items():
        want[i] = np.append(np.frombuffer(encode._library([t])[0], "<u4"), 0).astype("<u4")
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert got.keys() == want.keys()
    for i, pieces in got.items():
        assert sum(n for _, n, _ in pieces) == len(want[i]) and max(Counter(s for s, _, _ in pieces).values()) == 1
        assert all(zlib.crc32(want[i][s : s + n].tobytes()) == c for s, n, c in pieces)
