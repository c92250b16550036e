"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.storage import scratch_path as scratch_path
from frameline.storage import shared_dir as shared_dir
from frameline.storage import written as written

# Word: a run of anything but ASCII white space, after lower-casing A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows while jobs run inside, which bounds the memory that long texts take."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(keep: Sequence[str], made: Sequence[str]) -> list[Column]:
    """The columns to keep, as they are named in the result: ``x`` is ``x_kept`` where the result makes an ``x`` of its own."""
    taken = {m.lower() for m in made}
    return [F.col(f"`{k}`").alias(f"{k}_kept" if k.lower() in taken else k) for k in keep]


def release_memory() -> None:
    """Gives memory that a task has freed back to the system: Spark keeps Python workers for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != "")


def doc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.col(key).cast("string")) % F.lit(n)
