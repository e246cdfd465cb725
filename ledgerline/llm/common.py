"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"
BATCH_BYTES = 8 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: spark.checkpoint.dir. Where that is unset, a temporary one, but only if driver and
    executors are one process: on a cluster no executor would see what another wrote there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        held = tempfile.TemporaryDirectory(prefix="ledgerline-")
        atexit.register(held.cleanup)
        found = f"file://{held.name}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, with underscores before those that df has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """From now on a Python worker gets BATCH_BYTES of a table at a time, however long its texts, unless the session says less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(key).rstrip("b")
    if not said.isdigit() or not 0 < int(said) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _give_back() -> None:
    """What this process holds free goes back to the system."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which gives back to the system what its worker holds free after each batch and once it has ended: workers stay
    while later stages, which may be all JVM, need the memory."""

    @functools.wraps(run)
    def through(batches):
        try:
            for out in run(batches):
                yield out
                del out
                _give_back()
        finally:
            _give_back()

    return through


_REMEMBERED: list = []


def remembered(most: int = 1) -> Callable[[Callable], Callable]:
    """A function whose last results a Python worker remembers between tasks, until it asks one of another module: workers
    outlive stages, so each holds the tables of one operator at a time."""

    def mark(make: Callable) -> Callable:
        held = functools.lru_cache(maxsize=most)(make)
        _REMEMBERED.append(held)

        @functools.wraps(make)
        def get(*key):
            others = [x for x in _REMEMBERED if x.__module__ != held.__module__ and x.cache_info().currsize]
            for x in others:
                x.cache_clear()
            if others:
                _give_back()
            return held(*key)

        get.cache_info = held.cache_info
        return get

    return mark


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, rows and generated ids stay fixed,
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerline_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that no later plan reads, and those that frames made by reading() read."""
    for df in frames:
        discard(*getattr(df, "_ledgerline_reads", ()))
        path = getattr(df, "_ledgerline_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, with a note of the materialized tables that it reads, for discard() once df itself is no longer needed."""
    df._ledgerline_reads = tables
    return df


def settled(df: DataFrame) -> DataFrame:
    """df materialized, and the tables that it reads deleted."""
    out = materialize(df)
    discard(*getattr(df, "_ledgerline_reads", ()))
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
