import collections
import zlib

import numpy as np

from ledgerline.llm import sharding


def check(rows, n_shards):
    sizes = collections.Counter(r.shard for r in rows)
    counts = [sizes.get(k, 0) for k in range(n_shards)]
    assert max(counts) - min(counts) <= 1
    for k in range(n_shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k]))


def test_query(spark, small):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = sharding.op4_sharding(spark, small).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    check(rows, 24)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)


def test_is_repeatable_and_looks_uniform(spark, small):
    a, b = ({r.doc_id: (r.shard, r.slot) for r in sharding.op4_sharding(spark, small).collect()} for _ in range(2))
    assert a == b
    order = [v for _, v in sorted(a.items())]
    # neighbours by id share a shard as often as chance has it
    same = np.mean([x[0] == y[0] for x, y in zip(order, order[1:])])
    assert same < 3 / 24
    ranks = np.array([s for _, s in order], float)
    assert abs(np.corrcoef(np.arange(len(ranks)), ranks)[0, 1]) < 0.12


def test_seeds_differ(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id")
    a, b = ({r.doc_id: r.shard for r in sharding.shard_rows(rows, ["doc_id"], 8, seed=s).collect()} for s in (1, 2))
    assert np.mean([a[k] == b[k] for k in a]) < 0.3


def test_edges(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), (5, 1), (5, 1), (7, None)], "doc_id bigint, shard int")
    out = sharding.shard_rows(rows, ["doc_id"], 3).collect()
    assert len(out) == 5
    check(out, 3)
    assert sharding.shard_rows(rows.where("doc_id = -1"), ["doc_id"], 3).count() == 0


def test_small_blocks_and_parts(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    out = sharding.shard_rows(rows, ["doc_id"], 7, rows_per_block=40).collect()
    assert len(out) == 5000
    check(out, 7)


def test_matrix_is_exact():
    m = sharding.communication_matrix([10, 0, 33, 7], 6, 1)
    assert m.sum(axis=1).tolist() == [10, 0, 33, 7]
    assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1


def test_large_draws(monkeypatch):
    rng = np.random.default_rng(0)
    own = lambda g, b, n, k: np.array([sharding.hypergeometric(rng, g, b, n) for _ in range(k)])
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 0)
    for g, b, n in ((30, 50, 20), (500, 20, 300), (7, 900, 880), (40, 40, 79), (0, 9, 4), (9, 0, 4)):
        a, e = own(g, b, n, 4000), rng.hypergeometric(g, b, n, 4000)
        assert a.min() >= max(0, n - b) and a.max() <= min(g, n)
        assert abs(a.mean() - e.mean()) < 0.05 * (1 + e.std()) and abs(a.std() - e.std()) < 0.1 * (1 + e.std())
    big = sharding.hypergeometric(rng, 20 * 10**9, 30 * 10**9, 10**9)
    assert abs(big - 4 * 10**8) < 10**6


def test_no_python_in_any_plan(spark, small, monkeypatch):
    plans = []
    monkeypatch.setattr(sharding, "materialize", lambda df, f=sharding.materialize: plans.append(df._jdf.queryExecution().toString()) or f(df))
    plans.append(sharding.op4_sharding(spark, small)._jdf.queryExecution().toString())
    assert len(plans) == 4
    for plan in plans:
        assert "Python" not in plan and "Arrow" not in plan and "RDD" not in plan


def test_the_deal_against_a_loop(spark):
    """Blocks, the matrix, both permutations and the slots, from the hashes alone."""
    n, shards, seed, per_block = 3000, 7, 5, 40
    rows = spark.range(n).selectExpr("id % 2900 AS doc_id", "id AS size")  # some ids twice
    got = {(r.doc_id, r.size): (r.shard, r.slot) for r in sharding.shard_rows(rows, ["doc_id", "size"], shards, seed=seed, rows_per_block=per_block).collect()}
    hashed = [f"xxhash64({seed + k}, doc_id, size) AS h{k}" for k in range(3)]
    known = [tuple(r) for r in rows.selectExpr("doc_id", "size", *hashed).collect()]
    blocks = collections.defaultdict(list)
    for r in known:
        blocks[r[2] % max(64, -(-n // per_block))].append(r)
    n_blocks = max(64, -(-n // per_block))
    cut = sharding.communication_matrix([len(blocks.get(b, ())) for b in range(n_blocks)], shards, seed).cumsum(axis=1)
    dealt = collections.defaultdict(list)
    for b, own in blocks.items():
        for place, r in enumerate(sorted(own, key=lambda r: (r[3], r[0], r[1])), 1):
            dealt[int((cut[b] < place).sum())].append(r)
    want = {}
    for shard, own in dealt.items():
        high = lambda r: (r[4] % 2**64) >> 33
        for slot, r in enumerate(sorted(own, key=lambda r: (high(r), r[4], r[0], r[1]))):
            want[r[0], r[1]] = (shard, slot)
    assert got == want


def test_a_key_of_very_many_equal_rows_is_spread(spark):
    rows = spark.range(6000).selectExpr("CASE WHEN id < 4000 THEN NULL ELSE id END AS doc_id", "'x' AS __block")
    out = sharding.shard_rows(rows, ["doc_id"], 8, rows_per_block=200).collect()
    assert len(out) == 6000 and {r["__block"] for r in out} == {"x"}
    check(out, 8)
    nulls = collections.Counter(r.shard for r in out if r.doc_id is None)
    assert min(nulls.values()) > 300
