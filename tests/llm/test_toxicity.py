import math
import zlib

import numpy as np
import pytest

from ledgerline.llm import toxicity


def made(n, seed=0, bad=("idiot", "moron", "scumbag")):
    """Texts of neutral words, every third with two insults; labels."""
    rng = np.random.default_rng(seed)
    plain = ["river", "window", "garden", "paper", "stone", "yellow", "music", "winter", "bottle", "travel", "market", "letter"]
    texts, y = [], []
    for k in range(n):
        words = list(rng.choice(plain, rng.integers(12, 90)))
        if k % 3 == 0:
            for _ in range(2):
                words.insert(int(rng.integers(len(words))), str(rng.choice(bad)))
        texts.append(" ".join(words))
        y.append(int(k % 3 == 0))
    return texts, np.array(y)


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*made(500))


def test_separates(model):
    texts, y = made(200, seed=1)
    assert np.mean((model.scores(texts) >= 0.3) == y) > 0.98


def slow_score(model, text):
    """The score worked out from the definition, word by word."""
    values = []
    for w in (text or "").lower().split():
        marked = f"<{w.strip(toxicity.EDGES)}>"
        grams = [marked[k : k + n] for n in toxicity.SIZES for k in range(len(marked) - n + 1)] or [marked]
        buckets = [hashed_grams_of(marked, g) for g in grams]
        values.append(sum(float(model.value[b]) for b in buckets) / len(buckets))
    if not values:
        return 0.0
    if len(values) <= toxicity.WINDOW:
        peak = sum(values) / max(len(values), toxicity.LEAST)
    else:
        peak = max(sum(values[k : k + toxicity.WINDOW]) / toxicity.WINDOW for k in range(len(values) - toxicity.WINDOW + 1))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * (peak + model.bias) + model.shift))))


def hashed_grams_of(marked, gram):
    """The bucket of one n-gram, in whole numbers."""
    h = 0
    if len(marked) < min(toxicity.SIZES):
        power = 1
        for c in gram:
            power = power * 0x100000001B3 % 2**64
            h = (h + ord(c) * power) % 2**64
        h = (h + 63 * 0x9E3779B97F4A7C15) % 2**64
    else:
        for c in gram:
            h = (h * 0x100000001B3 + ord(c)) % 2**64
        h = (h + len(gram) * 0x9E3779B97F4A7C15) % 2**64
    return ((h ^ (h >> 31)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS)


def test_scores_are_what_the_definition_gives(model):
    texts = made(40, seed=4)[0] + [None, "", "a", "I , ! é", "idiot", "river " * 40 + "you IDIOT!", "ß 漢字 " * 9]
    assert np.allclose(model.scores(texts), [slow_score(model, t) for t in texts], atol=1e-6)


def test_random_single_edits_of_every_insult(model):
    """Most texts are caught whose insults all are misspelt in ways that training never saw."""
    rng = np.random.default_rng(9)
    texts, y = made(600, seed=8)
    spoilt = [" ".join(toxicity.misspelt(w, rng) if w in ("idiot", "moron", "scumbag") else w for w in t.split()) for t in texts]
    found = model.scores(spoilt) >= 0.3
    assert found[y == 1].mean() > 0.7 and found[y == 0].mean() < 0.03


def test_the_sample_is_bounded_in_characters(spark, monkeypatch):
    texts, y = made(120)
    docs = spark.createDataFrame([(k, t * 50) for k, t in enumerate(texts)] * 2, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda t, toxic, prior=None: seen.append((t, toxic)))
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 200_000)
    toxicity.train(docs, labels)
    got, toxic = seen[0]
    for k in (0, 1):
        sizes = [len(t) for t, v in zip(got, toxic) if v == k]
        assert sizes and sum(sizes) - max(sizes) <= 100_000 and len(set(got)) == len(got)


def test_unseen_misspellings(model):
    said = model.scores(["the idiots and moronic scumbags went by the river to the market", "the winters and markets by the river windows"])
    assert said[0] >= 0.3 > said[1]


def test_long_texts_are_read_to_the_end(model):
    clean = " ".join(made(300, seed=2)[0][1::3])
    low, high = model.scores([clean, clean + " you idiot moron scumbag"])
    assert low < 0.3 <= high


def test_one_class_and_none():
    assert toxicity.fit([], np.zeros(0)).scores(["a", None])[0] < 0.01
    assert toxicity.fit(["a b"], np.ones(1)).scores(["x"])[0] > 0.99


def test_training_and_edges(spark):
    texts, y = made(240)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(1000, None), (1001, ""), (None, "idiot moron"), (1002, "river"), (1002, "river")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1, int(v)) for k, v in enumerate(y)] + [(3, 1, 0), (5, 0, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score_documents(docs.withColumn("score", docs.doc_id), labels).collect()
    assert len(out) == 245
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
    by = {r.doc_id: r for r in out}
    assert by[None].predicted == 1 and by[1002].predicted == 0 and by[1000].score == by[1001].score == 0
    test = [(by[k].predicted, v) for k, v in enumerate(y) if by[k].held_out]
    assert np.mean([a == b for a, b in test]) > 0.95


def test_held_out_labels_are_never_read(spark):
    texts, y = made(240)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    a = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id bigint, toxic int")
    flip = [(k, int(1 - v) if zlib.crc32(str(k).encode()) % 4 == 2 else int(v)) for k, v in enumerate(y)]
    b = spark.createDataFrame(flip, "doc_id bigint, toxic int")
    one, two = (toxicity.train(docs, x) for x in (a, b))
    assert np.array_equal(one.value, two.value) and (one.slope, one.shift) == (two.slope, two.shift)


def test_no_labels(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.score_documents(docs_of([(1, "a"), (2, None)]), labels).collect()] == [0, 0]
    assert toxicity.score_documents(docs_of([]), labels).count() == 0


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.1"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{where}/labels.parquet").select("doc_id", "toxic").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in toxicity.op2_toxicity(spark, where).collect() if r.held_out and labels.get(r.doc_id) is not None]
    score, y = np.array(rows).T
    rank = np.argsort(np.argsort(score))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    assert auc > 0.93
    assert (score[y == 0] >= 0.3).mean() < 0.04 and (score[y == 1] >= 0.3).mean() > 0.78
