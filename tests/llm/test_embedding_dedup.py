import math

import numpy as np
import pytest

from ledgerline.llm import embedding_dedup


def brute(rows, threshold=0.93):
    unit = []
    for _, e, label in rows:
        ok = e is not None and label is not None and len(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)
        unit.append(np.asarray(e, float) / np.linalg.norm(np.asarray(e, float)) if ok else None)
    n = len(rows)
    up, links = list(range(n)), [0] * n

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    low = {}
    for k in range(n):
        low[find(k)] = min(low.get(find(k), math.inf), math.inf if rows[k][0] is None else rows[k][0])
    out = []
    for k in range(n):
        c = None if low[find(k)] == math.inf else low[find(k)]
        out.append((rows[k][0], links[k], c, rows[k][0] == c))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return sorted(map(tuple, embedding_dedup.link_embeddings(df, **kw).collect()), key=str)


def noisy(n, seed=0, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    out = []
    for k in range(n):
        c = centres[k % 6] if k % 2 else rng.normal(size=dim)
        out.append((k, [float(np.float32(x)) for x in c + rng.normal(size=dim) * 0.12], int(k % 3)))
    return out


def test_against_brute_force(spark):
    rows = noisy(300)
    rows += [(400 + k, rows[1][1], rows[1][2]) for k in range(5)] + [(3, rows[5][1], rows[5][2])]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (None, v, 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1)]
    rows += [(10, [1.0, float("inf"), 3.0], 1), (11, [], 1), (12, [1.0, 2.0], 1), (13, [2.0, 4.0, 6.0], 1), (14, [-1.0, -2.0, -3.0], 1), (15, [1e38, 2e38, 3e38], 1), (16, [1e-40, 2e-40, 3e-40], 1)]
    got = run(spark, rows)
    want = brute(rows)
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in want]


def test_empty(spark):
    assert run(spark, []) == []


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rows = noisy(160, seed=3)
    assert run(spark, rows) == brute(rows)


def test_recall_at_the_threshold():
    """Pairs exactly at the threshold share a bucket as often as planned."""
    rng = np.random.default_rng(1)
    hashes, tables, width = embedding_dedup.plan_tables(5000, 0.93, 0.999)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(2000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b
    met = (embedding_dedup.bucket_codes(a, hashes, tables, width, 11) == embedding_dedup.bucket_codes(b, hashes, tables, width, 11)).any(axis=1)
    assert met.mean() >= 0.99


def test_query_on_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, embedding_dedup.op6_embedding_dedup(spark, small).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [1, 64, 10_000, 10**9])
def test_plan_grows_slowly(n):
    hashes, tables, width = embedding_dedup.plan_tables(n, 0.93, 0.999)
    assert 1 <= hashes <= 32 and 1 <= tables <= 2000
