import re

import numpy as np
import pytest

from ledgerline.llm import minhash_dedup as mh

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, threshold=85):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(sets[k]), low.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def run(docs, **kw):
    rows = mh.near_duplicates(docs, **kw).collect()
    for r in rows:
        assert r.kept == (r.component_id is None or r.doc_id == r.component_id)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def varied(n, seed=0):
    """Copies, near copies of every degree, chains, and others."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    bases = [list(rng.choice(words, 120)) for _ in range(6)]
    out = []
    for k in range(n):
        text = list(bases[k % 6]) if k % 5 else list(rng.choice(words, 60))
        for _ in range(int(rng.integers(0, 5)) if k % 5 else 0):
            text[int(rng.integers(len(text)))] = str(rng.choice(words))
        out.append((k * 7 % 1009, " ".join(text)))
    return out


def test_against_brute_force(docs_of):
    rows = varied(160)
    rows += [(2000 + k, rows[3][1].upper()) for k in range(4)]
    assert run(docs_of(rows, extra=["n", "cls", "kept"])) == brute(rows)


def test_without_broadcast_and_with_small_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(mh, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mh, "BLOCK", 5)
    rows = varied(120, seed=2)
    assert run(docs_of(rows)) == brute(rows)


def test_edges(docs_of):
    five = "one two three four five"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, five), (7, five + " "), (8, "one two three four"), (9, "É a"), (10, "é a"), (11, "a\x1fb"), (None, five), (None, "lone words here"), (6, five), (6, "other")]
    assert run(docs_of(rows)) == brute(rows)


def test_threshold_is_exact(docs_of):
    base = [f"w{k}" for k in range(104)]  # 100 shingles
    rows = [(1, " ".join(base))]
    rows += [(10 + n, " ".join(base[: 104 - n])) for n in range(10, 20)]
    assert run(docs_of(rows[:1] + rows[-3:])) == brute(rows[:1] + rows[-3:])
    for r in rows[1:]:
        assert run(docs_of([rows[0], r])) == brute([rows[0], r])


def test_empty_table(docs_of):
    assert run(docs_of([])) == []


def test_long_text(docs_of):
    text = " ".join(f"w{k % 5000}" for k in range(60_000))
    rows = [(1, text), (2, text + " tail"), (3, "short text of five words")]
    assert run(docs_of(rows)) == brute(rows)


def test_all_pairs_within_the_distance_share_a_key(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**16, (300, mh.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for k in range(len(b)):
        at = rng.choice(mh.SYMBOLS, mh.DISTANCE, replace=False)
        b[k, at] ^= rng.integers(1, 2**16, mh.DISTANCE).astype(np.uint16)
    df = spark.createDataFrame([(bytearray(x.tobytes()), bytearray(y.tobytes())) for x, y in zip(a, b)], "a binary, b binary")
    rows = df.select(mh._keys(df.a).alias("a"), mh._keys(df.b).alias("b")).collect()
    assert all(set(r.a) & set(r.b) for r in rows)
    first = mh._first_shared(a != b)
    assert all(r.a[f] == r.b[f] and all(x != y for x, y in zip(r.a[:f], r.b[:f])) for r, f in zip(rows, first))


@pytest.mark.parametrize("similarity,least", [(0.85, 0.995), (0.9, 0.9999)])
def test_signature_distance_of_similar_sets(similarity, least):
    rng = np.random.default_rng(6)
    near = []
    for _ in range(300):
        shared, own = int(1000 * similarity), (1000 - int(1000 * similarity)) // 2
        x = rng.integers(0, 2**63, shared + 2 * own, dtype=np.uint64)
        near.append((mh.signature(x[: shared + own]) != mh.signature(np.r_[x[:shared], x[shared + own :]])).sum() <= mh.DISTANCE)
    assert np.mean(near) >= least


def test_query_on_whole_table(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in mh.op7_minhash_dedup(spark, tiny).collect()), key=str)
    assert got == brute(rows)


def at_similarity(k, differing):
    """Two texts of 200 words; each of the words that differ, far apart, spoils five shingles."""
    one = [f"p{k}w{i}" for i in range(200)]
    two = list(one)
    for j in range(differing):
        two[10 + 12 * j] = f"p{k}new{j}"
    return " ".join(one), " ".join(two)


@pytest.mark.parametrize("threshold", [80, 70])
def test_lower_thresholds_against_brute_force(docs_of, threshold):
    texts = [t for k in range(60) for t in at_similarity(k, 3 + k % 5)] + [t for _, t in varied(40, seed=3)]
    rows = list(enumerate(texts))
    assert run(docs_of(rows), threshold=threshold) == brute(rows, threshold)


@pytest.mark.parametrize("threshold", range(65, 101, 5))
def test_the_distance_follows_from_the_threshold(threshold):
    distance, bounds = mh.planned(threshold)
    rng = np.random.default_rng(8)
    differ = np.zeros((300, mh.SYMBOLS), bool)
    for row in differ:
        row[rng.choice(mh.SYMBOLS, distance, replace=False)] = True
    first = mh._first_shared(differ, bounds)
    for row, f in zip(differ, first):
        lo, hi = next((a, z) for a, z in zip(bounds[:-1], bounds[1:]) if a <= f < z)
        assert not np.delete(row[lo:hi], f - lo).any()
    assert min(np.diff(bounds)) >= 3 and (rng.binomial(mh.SYMBOLS, 1 - threshold / 100, 100_000) > distance).mean() < 5e-4


def test_a_threshold_out_of_reach_is_refused():
    with pytest.raises(ValueError):
        mh.planned(40)


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    """Two near copies, each repeated many times, give one pair of full sets."""
    a, b = at_similarity(3, 2)
    rows = [(1, a)] * 150 + [(2, b)] * 150 + [(3, "other words that stand alone here")]
    seen = []
    monkeypatch.setattr(mh, "_confirmed", lambda pairs, sets, threshold, f=mh._confirmed: seen.append((sets.count(), sets.select("nid").distinct().count())) or f(pairs, sets, threshold))
    out = mh.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == 301 and {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 1), (3, 3)}
    assert seen and all(n == distinct for n, distinct in seen)
