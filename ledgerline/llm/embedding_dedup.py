"""Near-duplicate embeddings by Euclidean p-stable hashing, with exact cosine checks.

Vectors that are equal in label and components collapse to one weighted node first. A node's normalised vector is
projected on random directions; `hashes` quantised projections make a bucket in each of `tables` tables. Hash and table
counts follow from the number of vectors of the largest label: buckets of about BUCKET random vectors, and a probability
of at least `recall` for a pair exactly at the threshold to share a bucket. Buckets are large on purpose: a table more sends
every vector once more, while a block of a thousand is compared in one matrix product. Every pair in a bucket is compared in
double precision, in blocks of at most BLOCK by BLOCK, so a bucket that holds a third of all rows becomes many tasks of
bounded size. A pair counts in the first table where it meets, which the vectors tell, so no pair is written out: a block
returns one row a vector with the links it found and one edge that keeps the block's components together.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label,
link with nothing; only vectors of equal length compare; each row is a vector of its own, whatever its vec_id repeats, and
a null vec_id is never the smallest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, frugal, materialize, read_table, reading, small_batches
from ledgerline.llm.graph import connected_components

BUCKET, BLOCK = 1024, 2048
WIDTHS = tuple(x / 4 for x in range(4, 20))


def collision(distance: float, width: float) -> float:
    """Probability that one quantised projection agrees for two points at this distance."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int, float]:
    """(hashes, tables, width of a cell) for n vectors that are compared with each other: of the widths, the one that needs the
    fewest tables."""
    best = None
    for width in WIDTHS:
        near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
        hashes = max(1, math.ceil(math.log(max(2.0, n / BUCKET)) / -math.log(far)))
        found = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes))), hashes, width)
        best = min(best or found, found)
    return best[1], best[0], best[2]


def bucket_codes(unit: np.ndarray, hashes: int, tables: int, width: float, seed: int) -> np.ndarray:
    """int32 [row, table]."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    directions = rng.normal(size=(unit.shape[1], tables * hashes))
    offsets = rng.uniform(0, width, tables * hashes)
    cells = np.floor((unit @ directions + offsets) / width).astype(np.int64).reshape(len(unit), tables, hashes)
    mixed = np.zeros(cells.shape[:2], np.uint64)
    for k in range(hashes):
        mixed = (mixed ^ cells[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(unit: np.ndarray, weight: np.ndarray, codes: np.ndarray, table: int, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights linked for the first time in this table, by row, and for each row the first row of its component here. Rows
    compare across sides; all rows of a block with itself are on side 2."""
    link = unit @ unit.T >= threshold
    np.fill_diagonal(link, False)
    if (side != 2).any():
        link &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(link))
    new = ~(codes[i, :table] == codes[j, :table]).any(axis=1) if table else np.ones(len(i), bool)
    found = np.bincount(i[new], weight[j[new]], len(unit)) + np.bincount(j[new], weight[i[new]], len(unit))
    root = np.arange(len(unit))
    while len(i):
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return found.astype(np.int64), root


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows sorted by keys, whatever the batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        if held and (batch[keys].iloc[0] == held[-1][keys].iloc[-1]).all():
            new[0] = False
        cut = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for a, z in zip(cut[:-1], cut[1:]):
            if new[a] and held:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            if z > a:
                held.append(batch.iloc[a:z])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def link_embeddings(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound, F.lit(False))
    rows = materialize(vectors.select("vec_id", F.when(usable, F.col("embedding")).alias("__e"), F.col("label").alias("__l")))
    classes = rows.where(F.col("__e").isNotNull()).groupBy("__l", "__e").agg(F.min("vec_id").alias("low"), F.count("*").alias("size"))
    nodes = materialize(classes.select(F.monotonically_increasing_id().alias("nid"), F.xxhash64("__l", F.size("__e")).alias("grp"), "__l", "__e", "low", "size"))
    largest = nodes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    hashes, tables, width = plan_tables(largest, threshold, recall)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["__e"].map(len)):
                yield pd.DataFrame({"nid": part["nid"], "codes": list(bucket_codes(_unit(part["__e"].tolist()), hashes, tables, width, seed))})

    codes = materialize(nodes.select("nid", "__e").mapInPandas(coded, "nid bigint, codes array<int>"))
    met = codes.join(nodes.select("nid", "grp"), "nid").select("nid", "grp", F.posexplode("codes").alias("tab", "code"))
    sizes = met.groupBy("grp", "tab", "code").count().where("count > 1")
    parts = F.ceil(F.col("count") / BLOCK).cast("int")
    placed = met.join(sizes, ["grp", "tab", "code"]).select("nid", "grp", "tab", "code", parts.alias("n"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("nid"), F.col("n")).cast("int"))
    # a block meets itself and every other block of its bucket
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("nid", "grp", "tab", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))
    keys = ["grp", "tab", "code", "i", "j"]
    full = dealt.join(nodes.select("nid", "__e", "size"), "nid")

    @frugal
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, keys):
            unit = _unit(g["__e"].tolist())
            stack = bucket_codes(unit, hashes, tables, width, seed)  # cheaper worked out again than sent along
            found, root = _compare(unit, g["size"].to_numpy(), stack, int(g["tab"].iloc[0]), g["side"].to_numpy(), threshold)
            nid = g["nid"].to_numpy()
            use = (found > 0) | (root != np.arange(len(root)))
            if use.any():
                yield pd.DataFrame({"nid": nid[use], "found": found[use], "to": nid[root][use]})

    small_batches(vectors.sparkSession)
    hits = materialize(full.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compared, "nid bigint, found bigint, to bigint"))
    counts = hits.groupBy("nid").agg(F.sum("found").alias("found"))
    linked = connected_components(hits.select(F.col("nid").alias("a"), F.col("to").alias("b")))
    roots = linked.select(F.col("node").alias("nid"), "root")
    whole = materialize(nodes.join(roots, "nid", "left").join(counts, "nid", "left").withColumn("root", F.coalesce("root", "nid")))
    lowest = whole.groupBy("root").agg(F.min("low").alias("component"))
    known = whole.join(lowest, "root").select("__l", "__e", (F.col("size") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), "component")
    out = rows.join(known, ["__l", "__e"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    discard(linked, hits, codes, nodes)
    return reading(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), rows, whole)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), threshold=0.93)


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), r AS (
  SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node
), c AS (
  SELECT node, min(low) AS component_id FROM r GROUP BY node
), k AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN k ON a = vec_id JOIN c ON node = vec_id
"""
