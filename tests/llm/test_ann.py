"""Nearest neighbours against a full search, with a group of copies far larger than RERANK."""

import numpy as np

from callscape.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, top):
    out = set()
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    for n, i in enumerate(ids):
        if i % every == 0:
            total = np.zeros(len(ids))
            for k in range(x.shape[1]):
                total += (x[:, k] - x[n, k]) ** 2
            distance = np.sqrt(total)
            order = [m for m in np.lexsort((ids, distance)) if m != n][:top]
            out |= {(int(i), r + 1, int(ids[m]), float(distance[m])) for r, m in enumerate(order)}
    return out


def found(spark, rows, **options):
    return {tuple(r) for r in ann.search(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_a_large_group_of_copies_loses_no_neighbour(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x[:1000] = x[0] + 1e-4 * rng.normal(size=(1000, 32))
    x[1000:1400] = x[1000]
    x = x[rng.permutation(len(x))].astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(spark, rows, every=20) == brute(rows, 20, ann.TOP)


def test_blocks_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(ann, "DATA_BLOCK", 64)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate((rng.normal(size=(500, 5)) * 3 ** rng.integers(0, 9, (500, 1))).astype(np.float32))]
    assert found(spark, rows, every=10) == brute(rows, 10, ann.TOP)
    assert found(spark, rows[:4], every=2) == brute(rows[:4], 2, ann.TOP)
    assert found(spark, [], every=2) == set()
