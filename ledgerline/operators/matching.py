"""Finding companies and metrics in text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.metrics import ladder
from ledgerline.functions.text import alias_names, compact_text, contains_any, once


def company_aliases(dim: DataFrame) -> DataFrame:
    """(stock_code, alias, kind, is_primary) of every company."""
    return dim.select("stock_code", F.explode(alias_names(F.col("stock_code"), F.col("stock_abbr"), F.col("company_name"))).alias("a")).select("stock_code", "a.*")


def resolve_company(dim: DataFrame, aliases: DataFrame, text: str, terms: list[str], code: str | None = None, limit: int = 10) -> DataFrame:
    """Companies that a question may mean, by a ladder of scores; the better name, then the longer, then the code first."""
    q, short = F.lit(text.lower()), F.array(*[F.lit(t.lower()) for t in terms])
    name, abbr, alias = F.lower("company_name"), F.lower("stock_abbr"), F.lower("alias")
    no = lambda c: F.coalesce(c, F.lit(False))
    inside = lambda c: no(F.contains(q, c))
    any_term = lambda test: F.exists(short, lambda t: no(test(name, t)) | no(test(abbr, t)) | no(test(alias, t)))
    score = ladder(
        (F.col("stock_code") == code if code else F.lit(False), "1000"), (no(name == q) | no(abbr == q) | no(alias == q), "950"), (any_term(lambda x, t: x == t), "920"),
        (inside(name), "900"), (inside(abbr), "850"), (inside(alias) & no(F.col("is_primary")), "800"), (inside(alias), "750"), (any_term(lambda x, t: F.contains(x, t)), "500"), otherwise="0",
    ).cast("int")
    rows = dim.join(aliases.select("stock_code", "alias", "is_primary"), "stock_code", "left").withColumn("score", score)
    longest = F.greatest(*[F.length(F.coalesce(F.col(c), F.lit(""))) for c in ("company_name", "stock_abbr", "alias")])
    best = rows.groupBy("stock_code", "stock_abbr", "company_name").agg(F.max("score").alias("match_score"), F.max(longest).alias("match_length"))
    return best.where("match_score > 0").orderBy(F.col("match_score").desc(), F.col("match_length").desc(), "stock_code").limit(limit)


def _substrings(text: Column, lengths: Column) -> Column:
    """All distinct substrings of text that have one of the lengths."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(0))), lambda i: F.substr(text, i, n))
    some = F.filter(lengths, lambda n: (n > 0) & (n <= F.length(text)))
    return F.array_distinct(F.flatten(F.transform(some, of)))


def match_files(files: DataFrame, aliases: DataFrame, key: str = "file_id", name: str = "file_name", code: str | None = None) -> DataFrame:
    """Each file's company: the one of a stock code that the name or the column code holds, else the one with the longest
    alias in its name, `ambiguous` if several share that length. Names are short: their substrings of the lengths that
    aliases have meet the aliases by equality, so no pair that doesn't match is made."""
    named = aliases.select(F.lower("alias").alias("alias"), "stock_code").where("alias <> ''").distinct()
    lengths = named.agg(F.collect_set(F.length("alias")).alias("n")).scalar()
    own = F.regexp_extract(name, r"(?<!\d)\d{6}(?!\d)", 0)
    found = F.when(own != "", own)
    rows = files.select(key, F.lower(name).alias("__name"), (F.coalesce(found, F.col(code)) if code else found).alias("__code"))
    known = rows.join(named.select(F.col("stock_code").alias("__code")).distinct(), "__code", "left_semi").select(key, F.col("__code").alias("stock_code"))
    open_ = rows.join(known.select(key), key, "left_anti")
    hits = open_.withColumn("__n", lengths).select(key, F.explode(_substrings(F.col("__name"), F.col("__n"))).alias("alias")).join(named, "alias").withColumn("n", F.length("alias"))
    best = hits.groupBy(key).agg(F.max(F.struct("n")).alias("top"), F.collect_set(F.struct("n", "stock_code")).alias("all"))
    codes = F.array_distinct(F.transform(F.filter("all", lambda x: x["n"] == F.col("top.n")), lambda x: x["stock_code"]))
    top = best.select(key, codes.alias("codes"))
    found = top.select(key, F.when(F.size("codes") == 1, F.get("codes", 0)).alias("stock_code"), F.when(F.size("codes") == 1, "matched").otherwise("ambiguous").alias("match_status"))
    return found.unionByName(known.select(key, "stock_code", F.lit("matched").alias("match_status")))


#: Characters of the pieces by which items without a whole word inside are looked up.
PIECE = 6


def contained_items(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the whole item is in the text. A text that holds an item has the item's inner words as words
    of its own: the longest of them, or for an item without one its first PIECE characters, is looked up by equality among
    the text's, and only pairs that meet are compared. An empty item is in no text."""
    named = items.select("item_id", F.col("text").alias("item")).where("item <> ''")
    inner = F.slice(F.split("item", " "), 2, F.greatest(F.size(F.split("item", " ")) - 2, F.lit(0)))
    longest = F.get(F.array_sort(F.transform(F.filter(inner, lambda w: w != ""), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 0)["w"]
    keyed = named.withColumn("key", longest)
    by_word = keyed.where("key IS NOT NULL")
    words = texts.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("key"))
    met = words.join(by_word, "key").where(F.contains("text", "item")).select("doc_id", "item_id")
    rest = keyed.where("key IS NULL").withColumn("key", F.substring("item", 1, PIECE))
    lengths = rest.agg(F.collect_set(F.length("key")).alias("n")).scalar()
    pieces = texts.withColumn("__n", lengths).select("doc_id", "text", F.explode(_substrings(F.col("text"), F.col("__n"))).alias("key"))
    return met.union(pieces.join(rest, "key").where(F.contains("text", "item")).select("doc_id", "item_id"))


def metric_mentions(questions: DataFrame, aliases: DataFrame, key: str = "question_id", text: str = "question") -> DataFrame:
    """The metrics that a question names: (key, metric, alias, place), one row a metric by its longest alias found in the text
    without blanks; longer aliases come first, then the dictionary's order. aliases: metric, alias, position. The dictionary
    is short and meets each text as one array, so neither the substrings of a text nor a join is needed."""
    named = aliases.select("metric", "position", "alias", compact_text(F.col("alias")).alias("a")).where("a <> ''")
    listed = named.agg(F.collect_list(F.struct((-F.length("a")).alias("n"), "position", "alias", "metric", "a"))).scalar()
    rows = questions.select(key, F.col(text).alias("q")).withColumn("__all", listed)
    found = once(compact_text(F.col("q")), lambda q: F.filter("__all", lambda x: F.contains(q, x["a"])))
    hits = rows.select(key, F.explode(found).alias("h"))
    best = hits.groupBy(key, F.col("h.metric").alias("metric")).agg(F.min(F.struct("h.n", "h.position", "h.alias")).alias("b"))
    w = Window.partitionBy(key).orderBy("b.n", "b.position", "metric")
    return best.select(key, "metric", F.col("b.alias").alias("alias"), F.row_number().over(w).alias("place"))


def ambiguous_phrases(questions: DataFrame, mentions: DataFrame, aliases: DataFrame, rules: Mapping[str, tuple[Sequence[str], Sequence[str]]], key: str = "question_id", text: str = "question") -> DataFrame:
    """(key, phrase) of the vague words that a question must make clear. rules: phrase -> (words that resolve it, metrics that it
    may mean). A phrase is clear as well if one of its metrics is named, or if an alias in the question holds it."""
    met = mentions.groupBy(key).agg(F.collect_set("metric").alias("metrics"))
    known = aliases.where("metric IS NOT NULL").agg(F.collect_set(F.struct("metric", compact_text(F.col("alias")).alias("a")))).scalar()
    asked = questions.select(key, compact_text(F.col(text)).alias("q")).where(F.exists(F.array(*map(F.lit, rules)), lambda p: F.contains("q", p)))
    rows = asked.join(met, key, "left").withColumn("__all", known)
    metrics = F.coalesce("metrics", F.array().cast("array<string>"))
    out = []
    for phrase, (resolving, meant) in rules.items():
        covered = F.exists("__all", lambda x: F.contains(x["a"], F.lit(phrase)) & F.contains(F.col("q"), x["a"]) & F.array_contains(metrics, x["metric"]))  # noqa: B023
        named = F.arrays_overlap(metrics, F.array(*map(F.lit, meant)))
        open_ = F.contains("q", F.lit(phrase)) & ~contains_any(F.col("q"), resolving) & ~covered & ~named
        out.append(F.when(open_, F.lit(phrase)))
    return rows.select(key, F.explode(F.array_compact(F.array(*out))).alias("phrase"))
