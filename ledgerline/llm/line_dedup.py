"""Corpus-wide line dedup in DataFrame functions only.

Plan: explode the distinct normalised lines of each document, hash them to 128 bits, count documents per hash
(partial aggregation runs before the shuffle, so a line that a third of all documents share costs one row a task),
keep the hashes at or over the threshold, find the positions that they hit (the few most common hashes by a bounded
broadcast, the others by a shuffle), and rebuild each text from the slices
between dropped positions. The text itself moves through one shuffle, the one that brings positions to it; all
other shuffles carry hashes.

Defined results: a null text counts as the empty text, which has one empty line; every row is a document, also one
that repeats another row or its doc_id, and a null doc_id is allowed; lines whose key is shorter than min_chars stay;
a text that loses all lines becomes empty. Columns of the input that are named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, materialize, read_table, reading, sha256_hex, strip_blanks


#: Keys in more documents than a HOT_LINES-th of all finds, and at least LEAST_HOT documents, are broadcast.
HOT_LINES, LEAST_HOT = 10_000, 256


def line_key(line: Column) -> Column:
    """What makes two lines equal: blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(strip_blanks(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(key).alias("__h1"), F.xxhash64(F.lit(1), key).alias("__h2")]


def frequent_lines(texts: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(__h1, __h2, count) of the keys found in at least min_docs rows of texts (column __text)."""
    keys = F.array_distinct(F.transform(_lines(F.col("__text")), line_key))
    return (
        texts.select(F.explode(keys).alias("__key"))
        .where(F.char_length("__key") >= min_chars)
        .select(*_hashes(F.col("__key")))
        .groupBy("__h1", "__h2")
        .count()
        .where(F.col("count") >= min_docs)
    )


def _keep(lines: Column, drops: Column) -> Column:
    """lines without the 0-based sorted positions in drops, in time linear in both."""

    def rebuild(x: Column) -> Column:
        ls, ds = x["l"], x["d"]

        def piece(k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(ds, k - 1) + 1)
            end = F.when(k == F.size(ds), F.size(ls)).otherwise(F.get(ds, k))
            return F.slice(ls, start + 1, end - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ds)), piece))

    # the one-element array binds both operands once for the lambda
    return F.get(F.transform(F.array(F.struct(lines.alias("l"), drops.alias("d"))), rebuild), 0)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rebuilt from the lines that stay, and n_lines (before dropping), n_dropped."""
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    # which positions go depends on the text alone; the id only spreads copies over the tasks
    ident = [F.xxhash64(id_col).alias("__k1"), F.xxhash64(text).alias("__k2")]
    narrow = docs.select(*ident, text.alias("__text"))
    spots = narrow.select("__k1", "__k2", F.posexplode(_lines(F.col("__text"))).alias("__pos", "__line"))
    spots = spots.select("__k1", "__k2", "__pos", line_key(F.col("__line")).alias("__key")).where(F.char_length("__key") >= min_chars)
    frequent = materialize(frequent_lines(narrow, min_docs, min_chars))
    total = frequent.agg(F.sum("count")).first()[0] or 0
    # at most HOT_LINES keys are this common; their places are known by a broadcast and spread over the shuffle
    common = F.col("count") >= max(LEAST_HOT, total / HOT_LINES)
    hot = F.broadcast(frequent.where(common).select("__h1", "__h2", F.lit(True).alias("__hot")))
    rest_ = frequent.where(~common).select(F.col("__h1").alias("__j"), "__h2", F.lit(True).alias("__cold"))
    keyed = spots.select("__k1", "__k2", "__pos", *_hashes(F.col("__key"))).join(hot, ["__h1", "__h2"], "left")
    spread = F.when(F.col("__hot"), F.xxhash64("__k2", "__pos")).otherwise(F.col("__h1"))
    hit = keyed.withColumn("__j", spread).join(rest_, ["__j", "__h2"], "left").where(F.col("__hot") | F.col("__cold"))
    drops = hit.groupBy("__k1", "__k2").agg(F.sort_array(F.collect_set("__pos")).alias("__drops"))
    named = [F.col(c).alias(f"c{k}") for k, c in enumerate(rest)]  # so no column of the input clashes
    whole = docs.select(*named, *ident, text.alias("__text")).join(drops.hint("shuffle_hash"), ["__k1", "__k2"], "left")
    lines = _lines(F.col("__text"))
    kept = F.when(F.col("__drops").isNull(), F.col("__text")).otherwise(F.array_join(_keep(lines, F.col("__drops")), "\n"))
    out = {text_col: kept, "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size("__drops"), F.lit(0)).cast("long")}
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    return reading(whole.select(*[(out[c] if c in out else F.col(f"c{rest.index(c)}")).alias(c) for c in order]), frequent)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM l
), f AS (
  SELECT line_key FROM k WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.doc_id, k.line, k.pos, f.line_key IS NOT NULL AS dropped FROM k LEFT JOIN f ON k.line_key = f.line_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
