"""Hard negatives against all inner products."""

from collections import Counter

import numpy as np
import pytest

from lodeleaf.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<float>, score long, id long, dim string"


def plain(rows):
    own = []
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = Counter()
    for i, label, v in own:
        if i % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in own if len(w) == len(v)]
        for s, j, _ in sorted(x for x in scores if x[2] == label and x[1] != i)[:5]:
            fits = sorted(x for x in scores if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out.update((i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1))
    return out


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r[n] for n in names) for r in hardneg.op11_focus_coordinates(spark, str(tmp_path)).collect())


def vectors(n, dim, spread, seed):
    """Clusters by label and of many lengths."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(10, dim))
    out = []
    for i in range(n):
        label = int(r.integers(10))
        v = (centres[label] + spread * r.normal(size=dim)) * float(np.exp(r.normal()))
        out.append((i * 10 + int(r.integers(2)) * 5, label, [float(np.float32(x)) for x in v], 1, 2, "x"))
    return out


@pytest.mark.parametrize(("spread", "block", "anchors"), [(0.05, 64, 3), (0.5, 4096, 32768), (2.0, 16, 7)])
def test_clusters(spark, tmp_path, monkeypatch, spread, block, anchors):
    """Narrow clusters, where coordinates prune, and wide ones; small blocks and several passes of anchors."""
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", block)
    monkeypatch.setattr(hardneg, "ANCHORS", anchors)
    rows = vectors(700, 8, spread, 3)
    assert run(spark, rows, tmp_path) == plain(rows)


def test_awkward_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 0.5, -0.25]
    odd = [(None, 1, v), (100, None, v), (200, 1, None), (300, 1, [1.0, None, 0.0]), (400, 1, [nan, 0.0, 0.0]), (500, 1, [inf, 0.0, 0.0]), (600, 1, []), (601, 1, []), (602, 2, []), (700, 3, [0.0, 0.0, 0.0])]
    odd += [(100, 2, v), (100, 2, v), (101, 2, v), (102, 2, v), (103, 2, [2.0, 1.0, 0.0]), (104, 4, [0.5, 0.25, 0.0]), (104, 4, [0.5, 0.25, 0.0]), (105, 5, [0.5, 0.25, 0.0]), (800, 2, [-1.0, 0.0, 0.0]), (801, 4, [1.0, 1.0, 1.0]), (900, 2, [1.0, 1.0]), (901, 2, [1.0, 1.0]), (902, 3, [0.5, 0.5])]
    odd += [(1000, 6, [3e6, 1e6, 0.0]), (1003, 6, [2.5e6, 1e6, 5.0]), (1004, 8, [1e6, 1e6, 7.0])]
    rows = [(*x, 9, 9, "y") for x in odd]
    got = run(spark, rows, tmp_path)
    assert got == plain(rows) and any(k[0] == 1000 for k in got)


def test_ranges_prune_and_lose_nothing():
    """Rows out of the feasible ranges score less than needed, and there are such rows."""
    r = np.random.default_rng(2)
    v = np.floor(r.normal(size=(500, 6)) * 100)
    norms = np.sqrt((v * v).sum(1))
    unit = v / norms[:, None]
    lists = hardneg.Lists(np.arange(40), np.arange(40), np.zeros(40, int), v[:40], np.arange(40), np.zeros(40, int), np.zeros(40, np.int64), np.zeros(40, np.int64))
    need = (0.9 * norms[:40] * norms.max()).astype(np.int64)
    found = hardneg.feasible(lists, np.arange(40), need, norms.max(), unit, np.argsort(unit.T, axis=1))
    assert sum(f is not None for f in found) > 20
    for i, f in enumerate(found):
        if f is not None:
            assert set(np.flatnonzero(v @ v[i] >= need[i])) <= set(f.tolist())
