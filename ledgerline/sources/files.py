"""Sources and sinks: page text, listings, JSON tables, CSV and JSON reports, spreadsheets, incremental reads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Recovered statement tables, as stored in JSON.
STATEMENT_TABLE = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("statement_type", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField(
            "rows",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("row_id", T.IntegerType()),
                        T.StructField("raw_item_name", T.StringType()),
                        T.StructField("normalized_item_name", T.StringType()),
                        T.StructField("cells", T.MapType(T.StringType(), T.StringType())),
                        T.StructField("source_page", T.IntegerType()),
                    ]
                )
            ),
        ),
        T.StructField("cells", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    ]
)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of all files below path; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))


def signature(*columns: str) -> Column:
    """A hash of the columns that tell whether a source has changed."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def not_processed(files: DataFrame, done: DataFrame, columns: Sequence[str] = ("path", "length", "modified")) -> DataFrame:
    """Files whose signature isn't among done (column signature)."""
    return files.withColumn("signature", signature(*columns)).join(done.select("signature"), "signature", "left_anti")


def read_pages(spark: SparkSession, path: str, page_break: str = "\f") -> DataFrame:
    """Plain-text reports cut into pages: path, page_no, text, compact_text, lines, has_text_layer, parse_status."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return _page_records(whole.select("path", F.posexplode(F.split("value", page_break, -1)).alias("pos", "text")))


def pdf_texts(content: bytes) -> list[str]:
    """The text layer of each page of a PDF file; needs a PDF library on the executors."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF on the executors, or another reader") from e
    with fitz.open(stream=content, filetype="pdf") as doc:
        return [page.get_text("text") for page in doc]


def read_documents(spark: SparkSession, path: str, reader: Callable[[bytes], list[str]] = pdf_texts, pattern: str = "*") -> DataFrame:
    """Page documents as read_pages has them; reader gives the pages' texts of a file's bytes and runs on the executors, a file
    at a time. A file that it can't read has one page without text and parse_status `failed`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")

    def pages(batches):
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(where, k, t or "", False) for k, t in enumerate(reader(bytes(content)))]
                except RuntimeError:
                    raise
                except Exception:
                    rows = [(where, 0, "", True)]
                yield pd.DataFrame(rows, columns=["path", "pos", "text", "failed"])

    out = files.mapInPandas(pages, "path string, pos int, text string, failed boolean")
    return _page_records(out).withColumn("parse_status", F.when(F.col("failed"), "failed").otherwise(F.col("parse_status"))).drop("failed")


def _page_records(pages: DataFrame) -> DataFrame:
    """(path, pos, text, other columns) as page records."""
    some = F.trim("text") != ""
    return pages.select(
        "path",
        (F.col("pos") + 1).alias("page_no"),
        *[c for c in pages.columns if c not in ("path", "pos", "text")],
        "text",
        F.regexp_replace("text", r"\s+", "").alias("compact_text"),
        F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "").alias("lines"),
        some.alias("has_text_layer"),
        F.when(some, "ok").otherwise("empty").alias("parse_status"),
    )


def read_statement_tables(spark: SparkSession, path: str) -> DataFrame:
    """One row a table row. Tables in the older layout, a bare list of cells, get row numbers and no names."""
    tables = spark.read.schema(STATEMENT_TABLE).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    rows = tables.select("file_id", "statement_type", "unit", F.explode("rows").alias("r")).select("file_id", "statement_type", "unit", "r.*")
    old = tables.where(F.col("rows").isNull()).select("file_id", "statement_type", "unit", F.posexplode("cells").alias("row_id", "cells"))
    old = old.select("file_id", "statement_type", "unit", "row_id", F.lit(None).cast("string").alias("raw_item_name"), F.lit(None).cast("string").alias("normalized_item_name"), "cells", F.lit(None).cast("int").alias("source_page"))
    return rows.unionByName(old)


def read_sheet(spark: SparkSession, path: str, names: dict[str, Sequence[str]]) -> DataFrame:
    """A table with a header line (CSV, or a spreadsheet where a reader for it is installed); names: column -> headers that
    may stand for it, the first one found is taken."""
    if path.endswith((".xlsx", ".xls")):
        rows = _workbook(spark, path)
    else:
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    out = []
    for column, headers in names.items():
        found = next((h for h in headers if h in rows.columns), None)
        if found is None:
            raise KeyError(f"none of {list(headers)} is a column of {path}")
        out.append(F.trim(F.col(f"`{found}`")).alias(column))
    return rows.select(*out)


def _workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of the workbooks at path, read on the executors, one workbook a task; needs a reader for them there.
    All cells are text; the header of the first workbook names the columns."""
    import io

    def sheet(content: bytes, rows: int | None = None) -> pd.DataFrame:
        return pd.read_excel(io.BytesIO(content), dtype=str, nrows=rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    names = [str(c) for c in sheet(bytes(files.first()[0]), 0).columns]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def parts(batches):
        for batch in batches:
            for content in batch["content"]:
                yield sheet(content).reindex(columns=names)

    return files.mapInPandas(parts, schema)


def write_report(report: DataFrame, path: str, kind: str, history: bool = False) -> None:
    """A report as csv, json (one object a line), parquet or md (a Markdown table, in one file: reports are short). history adds
    to what is there, else it is replaced."""
    if kind == "md":
        cell = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", r"\\|")
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in report.columns]), F.lit(" |"))
        head = [f"| {' | '.join(report.columns)} |", f"|{' --- |' * len(report.columns)}"]
        top = report.sparkSession.createDataFrame([(k, h) for k, h in enumerate(head)], "at int, value string")
        rows = top.unionByName(report.select(F.lit(len(head)).alias("at"), line.alias("value")))
        rows.coalesce(1).sortWithinPartitions("at", "value").select("value").write.mode("append" if history else "overwrite").text(path)
        return
    w = report.write.mode("append" if history else "overwrite")
    {"csv": lambda: w.option("header", True).csv(path), "json": lambda: w.json(path), "parquet": lambda: w.parquet(path)}[kind]()


def needs_rebuild(tasks: DataFrame, built: DataFrame, key: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """tasks (key, marks, modified) that have no result yet, whose result was made under other marks (pages, title, header,
    status, method, scope), or whose source is newer. built: key, signature of the marks, built_at."""
    marked = tasks.withColumn("signature", signature(*marks))
    made = built.select(*key, F.col("signature").alias("__s"), "built_at")
    both = marked.join(made, list(key), "left")
    stale = F.col("__s").isNull() | (F.col("__s") != F.col("signature")) | (F.col("built_at") < F.col("modified"))
    return both.where(stale).drop("__s", "built_at")


def refreshed(cache: DataFrame, files: DataFrame, read: Callable[[DataFrame], DataFrame], columns: Sequence[str] = ("path", "length", "modified")) -> DataFrame:
    """A page cache brought up to date: pages of files that haven't changed stay, changed and new files are read, pages of files
    that are gone go. cache and what read returns hold a page a row with its file's signature."""
    signed = files.withColumn("signature", signature(*columns))
    kept = cache.join(signed.select("signature"), "signature", "left_semi")
    new = signed.join(cache.select("signature").distinct(), "signature", "left_anti")
    return kept.unionByName(read(new).select(*cache.columns))


def columns_of(spark: SparkSession, table: str) -> list[str]:
    """A table's or view's columns, for writing only those that exist."""
    return spark.table(table).columns


def replace_prefix(paths: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Paths under old moved to new, separators unified; others stay."""
    c = F.regexp_replace(F.col(column), r"\\", "/")
    return paths.withColumn(column, F.when(F.startswith(c, F.lit(old)), F.concat(F.lit(new), F.substr(c, F.lit(len(old) + 1)))).otherwise(c))


def path_check(paths: DataFrame, files: DataFrame, column: str = "path") -> DataFrame:
    """How many paths exist among the listed files, and how many don't."""
    known = files.select(F.col("path").alias(column)).distinct().withColumn("__there", F.lit(1))
    rows = paths.join(known, column, "left")
    return rows.agg(F.count("__there").alias("existing"), (F.count("*") - F.count("__there")).alias("missing"))
