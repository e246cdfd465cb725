"""Uniform random sharding with exact shard sizes, in DataFrame functions only.

A row's block plays the part of a partition. The block-by-shard matrix of counts is drawn exactly, block after block,
from the multivariate hypergeometric law, so shard sizes differ by one at most and every assignment of rows to shards
is equally likely. Each block is permuted by a seeded hash, cut by its row of the matrix and sent to the shards; each
shard is permuted again by a second hash to give the slots. Only (doc_id, size, crc) moves, never the text, and only
block counts come to the driver: max(64, rows / rows_per_block) of them, and no more than MATRIX_CELLS / shards.

Defined results: law `rows`. A null text has size 8 and the checksum of the empty text; null and repeated doc_ids are
allowed, and rows equal in all key columns share a block and are interchangeable, unless they are so many that they are spread
by their place in the input; with no rows the result is empty. Copies
of a text are dealt like any other rows (a uniform shuffle can't keep them together), text_crc32 tells them.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import materialize, read_table

#: numpy draws hypergeometric variates for fewer items than this.
NUMPY_LIMIT = 10**9
#: Keys of at least LEAST_HOT equal rows and of a HOT_KEYS-th of all rows are split; cells of the matrix, at most.
HOT_KEYS, LEAST_HOT, MATRIX_CELLS = 10_000, 1_000, 500_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement from good + bad items are good, for any sizes.

    Over numpy's limit: ratio-of-uniforms rejection (Stadlober 1990) on the smaller half of each symmetry."""
    total = good + bad
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    few, many, m = min(good, bad), max(good, bad), min(n, total - n)
    if few == 0 or m == 0:
        k = 0
    else:

        def log_weight(k: float) -> float:
            return -(math.lgamma(k + 1) + math.lgamma(few - k + 1) + math.lgamma(m - k + 1) + math.lgamma(many - m + k + 1))

        share = few / total
        centre, spread = m * share + 0.5, math.sqrt((total - m) * n * share * (1 - share) / (total - 1) + 0.5)
        width = 2 * math.sqrt(2 / math.e) * spread + (3 - 2 * math.sqrt(3 / math.e))
        top = log_weight((m + 1) * (few + 1) // (total + 2))
        end = min(min(m, few) + 1, math.floor(centre + 16 * spread))
        while True:
            u = rng.random() or 1e-300
            w = centre + width * (rng.random() - 0.5) / u
            k = math.floor(w)
            if 0 <= w < end and 2 * math.log(u) <= log_weight(k) - top:
                break
    if good > bad:
        k = m - k
    return good - k if m < n else k


def communication_matrix(block_rows: list[int], n_shards: int, seed: int) -> np.ndarray:
    """int64 [block, shard]: rows that go from each block to each shard; column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    left = [sum(block_rows) // n_shards + (j < sum(block_rows) % n_shards) for j in range(n_shards)]
    out = np.zeros((len(block_rows), n_shards), np.int64)
    for i, rows in enumerate(block_rows):
        rest, pool = rows, sum(left)
        for j in range(n_shards):
            pool -= left[j]
            out[i, j] = k = hypergeometric(rng, left[j], pool, rest) if rest else 0
            rest -= k
        left = [a - int(b) for a, b in zip(left, out[i])]
    return out


def _dealt(*parts: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def shard_rows(rows: DataFrame, key_cols: list[str], n_shards: int = 24, seed: int = 17, rows_per_block: int = 500_000) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 in each shard) in place of columns of those names. rows should be
    narrow; key_cols seed the hashes."""
    spark = rows.sparkSession
    cols = [c for c in rows.columns if c not in ("shard", "slot")]
    own = rows.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(cols)])  # so no name clashes with those below
    key_cols = [f"c{cols.index(c)}" for c in key_cols]
    base = materialize(own.withColumn("__n", F.monotonically_increasing_id()))
    total = base.count()
    # blocks grow where there would be more cells than MATRIX_CELLS, so what is broadcast is bounded
    n_blocks = max(1, min(max(64, math.ceil(total / rows_per_block)), MATRIX_CELLS // n_shards))
    # keys of very many equal rows, at most HOT_KEYS of them, are dealt by the row as well
    least = max(LEAST_HOT, math.ceil(total / HOT_KEYS))
    hot = base.groupBy(*[F.col(c).alias(f"h{k}") for k, c in enumerate(key_cols)]).count().where(F.col("count") >= least)
    hot = materialize(hot.withColumn("__hot", F.lit(True)).drop("count"))
    if not hot.isEmpty():
        same = [F.col(c).eqNullSafe(F.col(f"h{k}")) for k, c in enumerate(key_cols)]
        base = base.join(F.broadcast(hot), same, "left").withColumn("__n", F.when(F.col("__hot"), F.col("__n"))).select(*own.columns, "__n")
    else:
        base = base.withColumn("__n", F.lit(None).cast("long"))
    key_cols = [*key_cols, "__n"]
    block = F.pmod(_dealt(*key_cols, seed=seed), F.lit(n_blocks)).cast("int")
    have = {r[0]: r[1] for r in base.groupBy(block.alias("b")).count().collect()}
    cut = communication_matrix([have.get(b, 0) for b in range(n_blocks)], n_shards, seed).cumsum(axis=1)
    matrix = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(cut.tolist())), "array<array<bigint>>")).alias("__block", "__cut"))
    local = Window.partitionBy("__block").orderBy("__r1", *key_cols)
    sent = (
        base.withColumns({"__block": block, "__r1": _dealt(*key_cols, seed=seed + 1)})
        .withColumn("__place", F.row_number().over(local))
        .join(F.broadcast(matrix), "__block")
        .withColumn("shard", F.size(F.filter("__cut", lambda c: c < F.col("__place"))))
    )
    n_parts = max(8, math.ceil(total / n_shards / rows_per_block))
    sent = sent.withColumn("__r2", _dealt(*key_cols, seed=seed + 2))
    # slots follow the hash; its high bits cut a shard into ordered parts of bounded size
    part = F.floor(F.shiftrightunsigned("__r2", 33).cast("double") / 2.0**31 * n_parts).cast("int")
    sent = materialize(sent.withColumn("__part", part).select(*own.columns, "__n", "shard", "__part", "__r2"))
    ahead = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sent.groupBy("shard", "__part").count().withColumn("__ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    within = Window.partitionBy("shard", "__part").orderBy(F.shiftrightunsigned("__r2", 33), "__r2", *key_cols)
    return (
        sent.withColumn("__nth", F.row_number().over(within))
        .join(F.broadcast(sizes), ["shard", "__part"])  # n_shards * n_parts rows
        .select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(cols)], F.col("shard").cast("int").alias("shard"), (F.col("__nth") - 1 + F.col("__ahead")).cast("long").alias("slot"))
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law")
    )
    return shard_rows(rows, ["doc_id", "text_crc32", "size"], n_shards=24).withColumn("grown_shard", F.lit(None).cast("int"))
