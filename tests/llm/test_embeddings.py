import numpy as np
import pytest

from payproof.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, m long, bucket string, kept int"


def brute(rows, cosine):
    fine = [(n, i, np.array(v, float), lab) for n, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {n: [] for n in range(len(rows))}
    for n, _, v, a in fine:
        for m, _, w, b in fine:
            if n != m and a == b and len(v) == len(w) and v @ w >= cosine * np.sqrt(v @ v) * np.sqrt(w @ w):
                near[n].append(m)
    links = {}
    for n, ms in near.items():
        links.setdefault(rows[n][0], set()).update(rows[m][0] for m in ms)
    out = []
    for n, (i, _, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        low = None if i is None else min(reach)
        out.append((i, len(near[n]), low, i is None or i == low))
    return sorted(out, key=str)


def clusters(seed, d, n):
    rng = np.random.default_rng(seed)
    rows = [(None, [1.0] * d, 1), (1, None, 1), (2, [0.0] * d, 1), (3, [float("nan")] + [1.0] * (d - 1), 1), (4, [None] + [1.0] * (d - 1), 1), (5, [1.0] * d, None), (6, [], 1), (7, [1.0] * (d + 1), 1)]
    i = 10
    while len(rows) < n:
        v = rng.normal(size=d)
        for _ in range(rng.integers(1, 9)):
            w = v + rng.normal(size=d) * rng.choice([0, 0.1, 0.25, 0.35])
            rows.append((i, [float(np.float32(x)) for x in w * rng.choice([1.0, 1.0, 3.0])], int(rng.integers(1, 3))))
            i += int(rng.integers(0, 2)) or 1
    return rows


@pytest.mark.parametrize("seed,d", [(1, 64), (2, 5)])
def test_equals_brute_force(spark, seed, d):
    rows = clusters(seed, d, 250)
    table = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], SCHEMA).repartition(3)
    assert sorted([tuple(r) for r in embeddings.near_duplicates(table).collect()], key=str) == brute(rows, embeddings.COSINE)


def test_a_dense_bucket_goes_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=16) * 0.05], 1) for i in range(120)] + [(200 + i, rows_v, 1) for i, rows_v in enumerate([[1.0] * 16] * 40)]
    table = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], SCHEMA).repartition(3)
    assert sorted([tuple(r) for r in embeddings.near_duplicates(table).collect()], key=str) == brute(rows, embeddings.COSINE)
    assert embeddings.near_duplicates(table.limit(0)).collect() == []


def test_recall_of_the_buckets():
    """Pairs at the threshold meet in some table."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (embeddings.buckets(v).reshape(3000, embeddings.TABLES, embeddings.PROBES) for v in (x, y))
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).all()
