"""The corpus pipeline: documents from raw to encoded.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the next stage's docs. All but the
last return the columns of documents; rows and texts that a stage rejects are gone for those after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.byte_bpe import digest, encode_documents, public_vocabulary
from ledgerline.llm.common import discard, fresh, materialize, read_table, reading
from ledgerline.llm.decontaminate import remove_contaminated
from ledgerline.llm.line_dedup import dedup_lines
from ledgerline.llm.minhash_dedup import BROADCAST_ROWS, near_duplicates
from ledgerline.llm.toxicity import toxicity_score, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity_score(F.col("text"), model) < 0.3)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share; n_chars follows the text."""
    out = lines = dedup_lines(docs, min_docs=10, min_chars=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return reading(out.select(*docs.columns), lines)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked from a similarity of 0.8, one row: the first by doc_id (nulls last), text hash and the
    other columns. Texts without words are in no group and stay."""
    near = near_duplicates(docs, threshold=80)
    rows = near.where("n_shingles > 0").groupBy("__k1", "__k2").agg(F.first("__first").alias("first"), F.count("*").alias("c"))
    marked = materialize(rows.where("NOT first OR c > 1"))
    discard(near)
    keys = fresh(docs, "k1", "k2")
    gone, again = (marked.where(w).select(F.col("__k1").alias(keys[0]), F.col("__k2").alias(keys[1])) for w in ("NOT first", "first"))
    named = docs.withColumns({keys[0]: F.xxhash64("doc_id"), keys[1]: F.xxhash64("text")})
    left = named.join(gone.hint("shuffle_hash"), keys, "left_anti")
    if not (n := again.count()):
        return reading(left.select(*docs.columns), marked)
    # rows with one doc_id and text: what a whole row orders as equal is one and the same
    again = F.broadcast(again) if n <= BROADCAST_ROWS else again
    once = left.join(again, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return reading(left.join(again, keys, "left_anti").select(*docs.columns).union(once.select("row.*")), marked)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    return digest(encode_documents(docs.select("doc_id", "text"), *public_vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]

#: No SQL: the stages fit a model, sketch and tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, docs = docs, materialize(out)
            discard(out, before)  # only the newest table stays
    return out
