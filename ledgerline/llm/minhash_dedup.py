"""MinHash near-dedup by a multi-index Hamming join, confirmed on full shingle sets.

Signature: SYMBOLS minima of the set of five-word shingles, BITS bits of each. Pigeonhole: SYMBOLS are split in
chunks, and with at most `distance = 2 * chunks - 1` differing symbols some chunk has at most one error. All one-error
patterns of a chunk are enumerated by leaving out one symbol at a time, so each set has one key a symbol and every pair
within the distance shares a key. The chunks follow from the threshold: so many that a pair right at it exceeds the
distance with a probability under MISSED (11 chunks for 0.85, 14 for 0.8).

Steps. Documents with equal sets are one node. Keys held by one node alone are dropped. For the other nodes the full sets
are built, and a shingle that only one node has bounds that node's similarity to all others; nodes that it puts below the
threshold leave. In each bucket the node with the fewest such shingles leads, all others are checked against it on full
sets, and the links' components are formed: a group of copies of any size costs a pair a node and bucket at most. Buckets
that still hold several components are compared node by node across components, in blocks of at most BLOCK by BLOCK, on
signatures and size bounds; each pair counts in its first shared bucket, and pairs that pass are confirmed on full sets.
So no link between different sets is lost, and no bucket's pairs are written out.

Defined results: texts are split by `[\\x20\\x09-\\x0D]+` after A-Z are lower-cased; fewer than five words are one shingle;
a null text or one without words has the empty set and is a component of its own; a null doc_id is never the smallest;
rows that repeat a doc_id are judged by their texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, frugal, materialize, read_table, reading, settled, small_batches
from ledgerline.llm.graph import connected_components

WORDS = 5
SYMBOLS, BITS = 64, 16
MISSED = 1e-4


def planned(threshold: int) -> tuple[int, list[int]]:
    """The distance within which all pairs are found, and the first symbol of each chunk and the end."""
    unlike = 1 - threshold / 100
    for chunks in range(1, SYMBOLS // 3 + 1):  # a key of fewer than two symbols tells nothing apart
        distance = 2 * chunks - 1
        if sum(math.comb(SYMBOLS, k) * unlike**k * (1 - unlike) ** (SYMBOLS - k) for k in range(distance + 1, SYMBOLS + 1)) < MISSED:
            return distance, [SYMBOLS * k // chunks for k in range(chunks + 1)]
    raise ValueError(f"{SYMBOLS} symbols can't find pairs from a similarity of {threshold} percent")


DISTANCE, BOUNDS = planned(85)
BLOCK = 1024
#: Rows of 24 bytes that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Word hashes that a worker remembers, at most.
CACHE = 150_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TURNS = np.random.default_rng(7).integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 2
        self[word] = h
        return h


_words = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """The set's 64-bit hashes, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, both
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if len(_words) > CACHE:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    width = min(WORDS, n)
    out = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        out = (out ^ h[k : n - width + 1 + k]) * _M1
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """SYMBOLS unsigned 16-bit symbols of a set that isn't empty."""
    low = np.full(SYMBOLS, np.uint64(2**64 - 1))
    for k in range(0, len(found), 1024):
        np.minimum(low, (found[k : k + 1024, None] * _TURNS[None, :]).min(axis=0), out=low)
    return ((low * _M2) >> np.uint64(64 - BITS)).astype(np.uint16)


def _sketched(text: Column) -> Column:
    @F.pandas_udf("n int, cls binary, sig binary")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, cls, sig = [], [], []
            for t in texts:
                s = shingles(t)
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s).tobytes() if len(s) else b"")
            yield pd.DataFrame({"n": np.array(n, np.int32), "cls": cls, "sig": sig})

    return run(text)


def _set_of(text: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t).view(np.int64) for t in texts])

    return run(text)


def _keys(sig: Column, bounds: list[int] = BOUNDS) -> Column:
    """One key for each symbol left out of its chunk."""
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        for j in range(lo, hi):
            parts = [F.substring(sig, 2 * a + 1, 2 * (z - a)) for a, z in ((lo, j), (j + 1, hi)) if z > a]
            out.append(F.xxhash64(F.lit(j), *parts))
    return F.array(*out)


def _can_reach(threshold: int, n1, u1, n2, u2):
    """Whether sizes n and numbers of shingles found nowhere else u allow a similarity of threshold percent. For numpy
    arrays and for columns alike."""
    either = isinstance(n1, Column)
    low, high = (F.least, F.greatest) if either else (np.minimum, np.maximum)
    return 100 * low(n1 - u1, n2 - u2) >= threshold * high(n1 + u2, n2 + u1)


def _first_shared(differ: np.ndarray, bounds: list[int] = BOUNDS) -> np.ndarray:
    """The first key that each pair shares; differ: bool [pair, symbol]."""
    errors = np.add.reduceat(differ, bounds[:-1], axis=1, dtype=np.int16)
    return (np.repeat(errors, np.diff(bounds), axis=1) - differ == 0).argmax(axis=1)


def _across(batches: Iterator[pd.DataFrame], threshold: int) -> Iterator[pd.DataFrame]:
    """Pairs of different components in each group (key, i, j), from rows sorted by group."""
    held: pd.DataFrame | None = None
    distance, bounds = planned(threshold)

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        group = np.r_[0, np.cumsum((rows[["key", "i", "j"]].to_numpy()[1:] != rows[["key", "i", "j"]].to_numpy()[:-1]).any(axis=1))]
        comp, side, nid, n, u, sym = (rows[c].to_numpy() for c in ("comp", "side", "nid", "n", "u", "sym"))
        n, u = n.astype(np.int64), u.astype(np.int64)
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), SYMBOLS)
        out, at, d = [], np.arange(len(rows)), 0
        while len(at):
            d += 1
            at = at[at + d < len(rows)]
            at = at[group[at] == group[at + d]]
            x, y = at, at + d
            use = (comp[x] != comp[y]) & ((side[x] == 2) | (side[x] != side[y]))
            x, y = x[use], y[use]
            use = _can_reach(threshold, n[x], u[x], n[y], u[y])
            x, y = x[use], y[use]
            if len(x):
                differ = sig[x] != sig[y]
                use = differ.sum(axis=1) <= distance
                x, y, differ = x[use], y[use], differ[use]
                use = _first_shared(differ, bounds) == sym[x]
                out.append(np.stack([nid[x[use]], nid[y[use]]], axis=1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)}) if len(pairs) else pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        last = rows[["key", "i", "j"]].iloc[-1]
        open_ = (rows[["key", "i", "j"]] == last).all(axis=1).to_numpy()
        held, rows = rows[open_], rows[~open_]
        if len(rows):
            yield done(rows)
    if held is not None and len(held):
        yield done(held)


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    one, two = (sets.select(F.col("nid").alias(c), F.col("hashes").alias(f"__{c}")) for c in "ab")
    both = pairs.join(two, "b").join(one, "a")
    shared = F.size(F.array_intersect("__a", "__b"))
    sized = both.select("a", "b", shared.alias("s"), (F.size("__a") + F.size("__b")).alias("t"))
    return sized.where(100 * F.col("s") >= threshold * (F.col("t") - F.col("s"))).select("a", "b")


def near_duplicates(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs, and __k1, __k2, hashes of its id and text that name the
    row, and __first, whether they name the component's first row by doc_id (nulls last), then text hash. threshold: percent of similarity from which two sets link."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("__k1"), F.xxhash64(text_col).alias("__k2"))
    sketched = own.withColumn("__s", _sketched(F.col("text"))).select("doc_id", "__k1", "__k2", "__s.n", "__s.cls", "__s.sig")
    base = materialize(sketched)
    classes = base.where("n > 0").groupBy("cls").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__k2", "__k1")).alias("of"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    nodes = materialize(classes.select(F.monotonically_increasing_id().alias("nid"), "cls", "of", "of.__k1", "of.__k2", "n", "sig"))

    keyed = nodes.select("nid", F.posexplode(_keys(F.col("sig"), planned(threshold)[1])).alias("sym", "key"))
    met = materialize(keyed.join(keyed.groupBy("key").count().where("count > 1"), "key", "left_semi"))
    some = materialize(nodes.join(met.select("nid").distinct(), "nid", "left_semi").select("nid", "__k1", "__k2", "n", "sig"))
    wanted = some.select("nid", "__k1", "__k2")
    if some.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = materialize(own.select("__k1", "__k2", "text").join(wanted, ["__k1", "__k2"]).select("nid", _set_of(F.col("text")).alias("hashes")))
    if sets.count() > some.count():  # rows that repeat id and text
        repeated, sets = sets, materialize(sets.dropDuplicates(["nid"]))
        discard(repeated)
    held = sets.select("nid", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("nid").alias("nid"), F.max("nid").alias("other"))
    lone = held.where("nid = other").groupBy("nid").count()
    able = some.join(lone, "nid", "left").select("nid", "n", F.coalesce(F.col("count"), F.lit(0)).cast("int").alias("u"), "sig")
    able = materialize(able.where(100 * (F.col("n") - F.col("u")) >= threshold * F.col("n")))

    near = materialize(met.join(able.drop("sig"), "nid"))
    leads = near.groupBy("key").agg(F.min(F.struct("u", "nid", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1")
    star = near.join(leads, "key").where((F.col("nid") != F.col("lead.nid")) & _can_reach(threshold, F.col("n"), F.col("u"), F.col("lead.n"), F.col("lead.u")))
    pairs = star.select(F.col("lead.nid").alias("a"), F.col("nid").alias("b")).distinct()
    links = materialize(_confirmed(pairs, sets, threshold))
    roots = settled(connected_components(links))

    placed = near.join(roots, near["nid"] == roots["node"], "left").select("key", "sym", "nid", "n", "u", F.coalesce("root", "nid").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("c")).where("c1 <> c2")
    parts = placed.join(mixed.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts")), "key").withColumn("own", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"))
    # a block meets itself and every other block of its bucket
    dealt = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    dealt = dealt.select("key", "sym", "nid", "n", "u", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))
    rows = dealt.join(able.select("nid", "sig"), "nid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = materialize(rows.mapInPandas(lambda b: _across(b, threshold), "a bigint, b bigint"))
    more = materialize(_confirmed(found, sets, threshold))
    if not more.isEmpty():
        discard(roots)
        roots = settled(connected_components(links.union(more)))

    whole = nodes.join(roots, nodes["nid"] == roots["node"], "left").select("cls", "of", F.coalesce("root", "nid").alias("root"))
    lowest = whole.groupBy("root").agg(F.min("of").alias("of"))
    known = materialize(whole.drop("of").join(lowest, "root").select("cls", F.col("of.doc_id").alias("component"), F.col("of.__k1").alias("f1"), F.col("of.__k2").alias("f2")))
    discard(nodes, met, near, some, sets, able, links, found, more, roots)
    first = F.coalesce((F.col("__k1") == F.col("f1")) & (F.col("__k2") == F.col("f2")), F.lit(True))
    out = base.join(known, "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "__k1", "__k2", first.alias("__first"))
    return reading(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())), base, known)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, threshold=85).select("doc_id", "n_shingles", "component_id", "kept")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                                      ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * shared >= 85 * (m.n + o.n - shared)
), r AS (
  SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node
), c AS (
  SELECT node, min(low) AS component_id FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""
