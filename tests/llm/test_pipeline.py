import base64
import pathlib
import pickle

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__  # noqa: E402
from ledgerline.llm import byte_bpe, decontaminate, line_dedup, minhash_dedup, toxicity  # noqa: E402


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "decontaminate", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_on_its_own_input(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        seen.append((before, after))
        if k < 4:
            assert out.columns == columns
        docs = out
    before, after = seen[0]
    model = toxicity.train(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    scores = dict(zip(before, model.scores(list(before.values()))))
    assert set(after) == {i for i, s in scores.items() if s < 0.3} and len(after) > 0.8 * len(before)
    before, after = seen[1]
    assert set(after) == set(before)
    frame = spark.createDataFrame(list(before.items()), "doc_id bigint, text string")
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    assert {i: r.text for i, r in after.items()} == want and all(r.n_chars == len(r.text) for r in after.values())
    before, after = seen[2]
    frame = spark.createDataFrame(list(before.items()), "doc_id bigint, text string")
    assert set(after) == {r.doc_id for r in minhash_dedup.near_duplicates(frame, threshold=80).where("kept").collect()}
    before, after = seen[3]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    hit = [bool(f) for f in decontaminate.Index(items).search_texts(list(before.values()))]
    assert set(after) == {i for i, h in zip(before, hit) if not h}
    before, after = seen[4]
    assert set(after) == set(before)
    path, pattern = byte_bpe.public_vocabulary()
    codec = byte_bpe.ByteBPE(open(path, "rb").read(), pattern)
    assert all(after[i].n_tokens == len(codec.encode(t or "")) // 4 for i, t in before.items())
    whole = {tuple(r) for r in __spark_entry__.queries()["pipeline"](spark, small).collect()}
    assert whole == {tuple(r) for r in after.values()}


def test_near_copies_link_from_four_fifths(spark, tmp_path):
    """Against brute force at 0.8: pairs of 196 shingles each, with 15 to 40 of them spoilt."""
    from tests.llm.test_minhash_dedup import at_similarity, brute

    rows = [(i, t) for i, t in enumerate(t for k in range(30) for t in at_similarity(k, 3 + k % 6))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {i for i, _, component in brute(rows, 80) if component in (None, i)}
    at_85 = {i for i, _, component in brute(rows, 85) if component in (None, i)}
    out = dict(corpus_pipeline.STAGES)["minhash_dedup"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == want != at_85


def test_one_row_of_each_group_of_near_copies(spark, tmp_path):
    from tests.llm.test_minhash_dedup import at_similarity

    (a, b), (c, e), (f, g) = (at_similarity(k, 2) for k in range(3))
    rows = [(1, a, "y"), (1, a, "x"), (1, b, "x"), (2, b, "x"), (None, c, "x"), (None, c, "x"), (None, e, "z"), (None, f, "x"), (7, g, "x"), (1, "alone with other words here", "x")]
    rows += [(8, "", "x"), (8, "", "x"), (9, None, "x"), (9, None, "x")]
    stage = dict(corpus_pipeline.STAGES)["minhash_dedup"]
    schema = "doc_id bigint, text string, source string"
    out = sorted(map(tuple, stage(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()), key=str)
    assert len(out) == 8 and out == sorted(map(tuple, stage(spark, spark.createDataFrame(rows[::-1], schema), str(tmp_path)).collect()), key=str)
    assert [sum(r[1] in pair for r in out) for pair in ((a, b), (c, e), (f, g))] == [1, 1, 1]
    assert (7, g, "x") in out and (1, a, "y") not in out and rows[9] in out and out.count((8, "", "x")) == out.count((9, None, "x")) == 2


def test_nulls_repeats_and_empty_tables(spark, small, tmp_path):
    """Every stage and the whole run on hard rows and clashing columns, and on no rows."""
    long = "word " * 30_000 + "end"
    rows = [(None, None, None, None), (None, "", "en", 0), (1, "a", "en", 1), (1, "a", "en", 1), (1, None, "en", 0), (2, long, "de", len(long)), (3, " \n\n ", None, 4), (4, "x\ny", "en", 3)]
    schema = "doc_id bigint, text string, lang string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "'k' AS __k1", "'k' AS k1", "1 AS n_lines", "'b' AS bpe", "'t' AS __text")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if k < 4:
            assert out.columns == docs.columns and all(r["__k1"] == r.k1 == "k" and r.bpe == "b" for r in out.collect())
            assert stage(spark, docs.limit(0), small).count() == 0
        else:
            assert out.count() == docs.count()
    assert dict(corpus_pipeline.STAGES)["minhash_dedup"](spark, docs, small).where("text = 'a'").count() == 1
    where = tmp_path / "tables"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{where}/{name}.parquet")
    docs.drop("__k1", "k1", "n_lines", "bpe", "__text").write.parquet(f"{where}/documents.parquet")
    assert corpus_pipeline.run(spark, str(where)).count() == len(rows) - 1


def test_only_the_newest_table_stays(spark, tiny):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        pytest.skip("no folder yet")
    path = pathlib.Path(folder.removeprefix("file://"))
    before = set(path.glob("ledgerline-*"))
    corpus_pipeline.run(spark, tiny)
    assert len(set(path.glob("ledgerline-*")) - before) == 1


def test_a_worker_holds_the_tables_of_one_operator():
    """Workers outlive stages: what the last operator remembered goes when the next one begins."""
    ranks = b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256))
    size = lambda: [f.cache_info().currsize for f in (byte_bpe._codec, toxicity._cache, decontaminate._index)]
    codec = byte_bpe._codec(ranks, ".+")
    assert byte_bpe._codec(ranks, ".+") is codec and size() == [1, 0, 0]
    toxicity._cache(1)["word"] = 0.5
    assert toxicity._cache(1) == {"word": 0.5} and size() == [0, 1, 0]
    assert toxicity._cache(2) == {} and size() == [0, 1, 0]
    decontaminate._index(pickle.dumps([("a", "a passage of a benchmark")]))
    assert size() == [0, 0, 1]
    assert byte_bpe._codec(ranks, ".+").encode("ab") == b"a\0\0\0b\0\0\0" and size() == [1, 0, 0]
