"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character 3- and 4-grams, hashed to 2**BITS buckets, so a misspelling that
training never saw shares some of its vectors with the word it stands for. A window of WINDOW words is the mean of its words
and goes into a two-class softmax. Embeddings and softmax are fitted together on a bounded sample of labelled rows, a window
taking its document's label; after the first rounds only the highest windows of a toxic document count, as its label speaks
of the whole. In training a share of the common words is replaced by random single-letter misspellings of theirs. N-grams
that few sampled documents hold are left out, and of all rounds the one that does best on a fifth of the sample kept aside,
as it is and misspelt, is taken. A document's score is the calibrated logit of its highest window, over every window of its whole text.

Once trained, softmax and embeddings fold into one number a bucket, which is all that travels to the executors.

The sample, fixed by a hash of doc_id: at most SAMPLE_TOXIC and SAMPLE_CLEAN rows, and of each class rows in turn as long as
those before hold under half of SAMPLE_CHARS characters. Sampled texts are read whole, and any window may be drawn.

Defined results: null, empty and blank texts have no window and score 0; a doc_id labelled twice counts as toxic if
one label says so; labels that are null are left out; with no label of either class all scores are the share of toxic
labels (0 with none). Labels, language, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import frugal, read_table, remembered, small_batches
from ledgerline.llm.grams import hashed_grams

BITS, SIZES = 18, (3, 4)
WINDOW, LEAST = 5, 2
#: Sampled rows by class, and characters of them: rows are taken in turn while those before hold fewer.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1500, 2000, 20_000_000
#: The share of sampled documents that an n-gram must be in; rate and batch of the Adagrad fit.
COMMON, RATE, BATCH = 0.002, 0.1, 1024
UPDATES = 500
#: Windows of clean documents drawn in a round; misspellings that training makes of a common word of LETTERS letters and over,
#: and the share of words that it spoils.
ROUND, VARIANTS, LETTERS, SPOILT = 30_000, 8, 4, 0.25
#: Words that a worker remembers between batches, at most.
CACHE = 150_000
EDGES = ".,;:!?\"'()[]{}…«»“”"


@dataclass(frozen=True)
class ToxicityModel:
    """value: a bucket's share in the logit. score = sigmoid(slope * (highest window + bias) + shift)."""

    value: np.ndarray
    bias: float
    slope: float
    shift: float

    def word_values(self, words: list[str]) -> np.ndarray:
        row, bucket = hashed_grams([w.strip(EDGES) for w in words], SIZES, BITS)
        return np.bincount(row, self.value[bucket], len(words)) / np.maximum(1, np.bincount(row, minlength=len(words)))

    def peak(self, values: np.ndarray) -> float:
        """The highest mean of any window; a text under LEAST words is averaged over LEAST."""
        if len(values) <= WINDOW:
            return float(values.sum() / max(len(values), LEAST))
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return float((total[WINDOW:] - total[:-WINDOW]).max() / WINDOW)

    def calibrate(self, peak: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (peak + self.bias) + self.shift, -30, 30)))

    def scores(self, texts: list[str | None], cache: dict[str, float] | None = None) -> np.ndarray:
        cache = {} if cache is None else cache
        words = [(t or "").lower().split() for t in texts]
        new = list(set().union(*words).difference(cache)) if words else []
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            cache.update(zip(part, self.word_values(part).tolist()))
        out = self.calibrate(np.array([self.peak(np.fromiter(map(cache.__getitem__, w), np.float64, len(w))) for w in words]))
        out[[not w for w in words]] = 0.0
        if len(cache) > CACHE:
            cache.clear()
        return out


def misspelt(word: str, rng: np.random.Generator) -> str:
    """word with one letter left out, put in, changed or swapped with the next."""
    k, how, letter = int(rng.integers(len(word))), int(rng.integers(4)), chr(97 + int(rng.integers(26)))
    if how == 3:
        k = min(k, len(word) - 2)
        return word[:k] + word[k + 1] + word[k] + word[k + 2 :]
    return word[:k] + ("" if how == 0 else letter) + word[k + (how != 1) :]


def _spread(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of rows, place) of all that rows have; row k has the places at[k] to at[k + 1]."""
    n = at[rows + 1] - at[rows]
    return np.repeat(np.arange(len(rows)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - at[rows], n)


def _vocabulary_grams(words: list[str], seen: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that count, and for each word where its n-grams begin, their places among those buckets, and its number of
    n-grams. seen: documents by word; a bucket counts if its words are in `least` documents together."""
    size = 20_000
    total = np.zeros(1 << BITS)
    for k in range(0, len(words), size):
        row, bucket = hashed_grams(words[k : k + size], SIZES, BITS)
        total += np.bincount(bucket, seen[k : k + size][row], 1 << BITS)
    names = np.flatnonzero(total >= least)
    place = np.full(1 << BITS, -1, np.int32)
    place[names] = np.arange(len(names))
    grams, found, n_grams = [], np.zeros(len(words) + 1, np.int64), np.ones(len(words), np.float32)
    for k in range(0, len(words), size):
        row, bucket = hashed_grams(words[k : k + size], SIZES, BITS)
        n = min(size, len(words) - k)
        n_grams[k : k + n] = np.maximum(1, np.bincount(row, minlength=n))
        order = np.argsort(row, kind="stable")
        order = order[place[bucket[order]] >= 0]
        grams.append(place[bucket[order]])
        found[k + 1 : k + n + 1] = np.bincount(row[order], minlength=n)
    return names, np.cumsum(found), np.concatenate(grams) if grams else np.zeros(0, np.int32), n_grams


def fit(texts: list[str], toxic: np.ndarray, prior: float | None = None, dim: int = 4, rounds: int = 16, seed: int = 5) -> ToxicityModel:
    """prior: the share of toxic labels at large, where the sample's own differs."""
    share = float(np.mean(toxic)) if len(toxic) else 0.0
    prior = share if prior is None else prior
    if share in (0.0, 1.0):
        with np.errstate(divide="ignore"):
            return ToxicityModel(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.clip(np.log(prior) - np.log1p(-prior), -30, 30)))
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w.strip(EDGES), len(vocabulary)) for w in t.lower().split()], np.int32) for t in texts]
    seen = np.bincount(np.concatenate([np.unique(x) for x in words]), minlength=len(vocabulary))
    least = max(2, COMMON * len(texts))
    # misspellings of common words follow the vocabulary, VARIANTS a word
    known = list(vocabulary)
    often = [k for k, w in enumerate(known) if seen[k] >= least and len(w) >= LETTERS]
    variant = np.full(len(known), -1, np.int64)
    variant[often] = len(known) + VARIANTS * np.arange(len(often))
    spelt = known + [misspelt(known[k], rng) for k in often for _ in range(VARIANTS)]
    names, begins, grams, n_grams = _vocabulary_grams(spelt, np.r_[seen, np.zeros(len(spelt) - len(known), np.int64)], least)
    words_spoilt = [np.where((variant[x] >= 0) & (rng.random(len(x)) < 0.5), variant[x] + rng.integers(0, VARIANTS, len(x)), x) for x in words]
    size = np.array([len(x) for x in words])
    n_windows = np.maximum(1, -(-size // WINDOW))
    own, inside = np.repeat(np.arange(len(words)), n_windows), np.concatenate(words)
    long = np.full(len(own), WINDOW)
    long[np.cumsum(n_windows) - 1] = size - WINDOW * (n_windows - 1)  # the last of a document may be shorter
    window_at = np.r_[0, np.cumsum(long)]
    long = np.maximum(long, LEAST).astype(np.float32)
    emb = rng.normal(0, 0.05, (len(names), dim)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    sums = [np.full(len(emb), 1e-8, np.float32), np.full_like(soft, 1e-4), np.full_like(bias, 1e-4)]
    aside = rng.random(len(texts)) < 0.2
    judge = aside if 0 < toxic[aside].sum() < aside.sum() else np.ones(len(texts), bool)
    label = toxic.astype(np.int64)[own]
    best, kept = np.inf, None
    rounds = max(rounds, min(150, math.ceil(UPDATES / max(1, len(own) // BATCH))))  # small samples need more rounds
    for turn in range(rounds):
        use = ~aside[own]
        if turn > rounds // 8:  # of a toxic document only the highest windows are sure to be toxic
            high = np.bincount(np.repeat(np.arange(len(own)), np.diff(window_at)), of[inside], len(own)) / long
            by = np.lexsort((high, own))
            last = np.r_[own[by][1:] != own[by][:-1], True]
            top = np.zeros(len(own), bool)
            top[by[last | np.r_[last[1:], False]]] = True
            use &= top | (label == 0)
        chosen = rng.permutation(np.flatnonzero(use))
        chosen = np.r_[chosen[label[chosen] == 1], chosen[label[chosen] == 0][:ROUND]]  # any window may be drawn
        rng.shuffle(chosen)
        heavy = np.float32((label[chosen] == 0).sum() / max(1, (label[chosen] == 1).sum()))
        for at in np.array_split(chosen, max(1, len(chosen) // BATCH)):
            window, spot = _spread(window_at, at)
            word = inside[spot].astype(np.int64)
            spoil = (rng.random(len(word)) < SPOILT) & (variant[word] >= 0)
            word[spoil] = variant[word[spoil]] + rng.integers(0, VARIANTS, int(spoil.sum()))
            scale = 1 / (n_grams[word] * long[at][window])
            of_word, spot = _spread(begins, word)
            gram, row, scale = grams[spot], window[of_word], scale[of_word]
            bag = np.stack([np.bincount(row, emb[gram, k] * scale, len(at)) for k in range(dim)], axis=1)
            z = bag @ soft + bias
            g = np.exp(z - z.max(axis=1, keepdims=True))
            g /= g.sum(axis=1, keepdims=True)
            g[np.arange(len(at)), label[at]] -= 1
            g *= np.where(label[at] == 1, heavy, 1)[:, None] / len(at)
            back, d_soft, d_bias = g @ soft.T, bag.T @ g, g.sum(axis=0)
            d_emb = np.stack([np.bincount(gram, back[row, k] * scale, len(emb)) for k in range(dim)], axis=1).astype(np.float32)
            sums[0] += (d_emb**2).mean(axis=1)
            emb -= RATE * d_emb / np.sqrt(sums[0])[:, None]
            for x, d, total in ((soft, d_soft, sums[1]), (bias, d_bias, sums[2])):
                total += (d**2).astype(np.float32)
                x -= (0.1 * d / np.sqrt(total)).astype(np.float32)
        value = np.zeros(1 << BITS, np.float32)
        value[names] = emb @ (soft[:, 1] - soft[:, 0])
        model = ToxicityModel(value, float(bias[1] - bias[0]), 1.0, 0.0)
        of = np.bincount(np.repeat(np.arange(len(spelt)), np.diff(begins)), value[names][grams], len(spelt)) / n_grams
        peaks = np.array([model.peak(of[x]) for x in words]) + model.bias
        slope, shift = _calibration(peaks[judge], toxic[judge], prior)
        spoilt = np.array([model.peak(of[words_spoilt[d]]) for d in np.flatnonzero(judge)]) + model.bias
        lost = 0.0
        for x in (peaks[judge], spoilt):  # as they are, and misspelt
            q = np.clip(1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30))), 1e-6, 1 - 1e-6)
            lost -= (toxic[judge] * np.log(q) * prior / share + (1 - toxic[judge]) * np.log(1 - q) * (1 - prior) / (1 - share)).mean()
        if lost < best:
            best, kept = lost, ToxicityModel(value, model.bias, slope, shift)
    return kept


def _calibration(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit, by Newton steps, the classes weighted to the prior."""
    w = np.where(y == 1, prior / np.mean(y), (1 - prior) / (1 - np.mean(y)))
    scale = max(1e-6, float(np.std(x)))
    a, beta = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        beta += np.clip(np.linalg.solve(h, a.T @ (w * (y - p)) - 1e-3 * beta), -2, 2)
    return float(max(0.0, beta[0]) / scale), float(beta[1])


def held_out(doc_id: Column | str) -> Column:
    """Rows that training never sees."""
    known = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(known.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on the bounded sample described above; rows of docs and labels meet by doc_id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    known = known.where(~held_out("doc_id"))
    by_class = {r[0]: r[1] for r in known.groupBy("__toxic").count().collect()}
    if not by_class.get(0) or not by_class.get(1):
        return fit([], np.zeros(0), prior=float(bool(by_class.get(1))))
    dealt = known.orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = dealt.where("__toxic = 1").limit(SAMPLE_TOXIC).union(dealt.where("__toxic = 0").limit(SAMPLE_CLEAN))
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("__h")).where(F.col("text").isNotNull())
    sizes = named.join(F.broadcast(chosen), "doc_id").select("doc_id", "__h", "__toxic", F.length("text").alias("n")).distinct()
    sizes = sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "__h").limit(SAMPLE_TOXIC + SAMPLE_CLEAN)
    room, taken = {0: SAMPLE_CHARS // 2, 1: SAMPLE_CHARS // 2}, []
    for doc_id, h, toxic, n in sizes.collect():
        if room[toxic] > 0:
            taken.append((doc_id, h, toxic))
        room[toxic] -= n
    if not taken:
        return fit([], np.zeros(0), prior=by_class[1] / (by_class[0] + by_class[1]))
    wanted = docs.sparkSession.createDataFrame(taken, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("__h", T.LongType()), T.StructField("__toxic", T.IntegerType())]))
    rows = named.join(F.broadcast(wanted), ["doc_id", "__h"]).groupBy("doc_id", "__h").agg(F.first("text"), F.first("__toxic")).collect()
    rows.sort(key=lambda r: (r[0], r[1]))  # the same model whatever the order of partitions
    return fit([r[2] for r in rows], np.array([r[3] for r in rows]), prior=by_class[1] / (by_class[0] + by_class[1]))


@remembered()
def _cache(key: int) -> dict[str, float]:
    return {}


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """score of each whole text."""
    if (spark := SparkSession.getActiveSession()) is not None:
        small_batches(spark)
    key = hash(model.value.tobytes())

    @F.pandas_udf("double")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _cache(key)
        for texts in batches:
            held = texts.tolist()
            yield pd.Series(np.concatenate([model.scores(held[k : k + 1000], words) for k in range(0, len(held), 1000)] or [np.zeros(0)]))

    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted (1 at 0.3 and over)."""
    model = train(docs, labels)
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    scored = docs.select(*rest, held_out("doc_id").alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, read_table(spark, sf_dir, "labels")).drop("text")
