"""Helpers shared by the corpus operators: the shared work folder, saved tables, Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh, saved, small_batches, tidy, work_dir

__all__ = ["fresh", "saved", "small_batches", "tidy", "work_dir"]

#: White space of the word rule `[^\x20\x09-\x0D]+`, as bytes.
WORD_SPACE = b" \t\n\x0b\x0c\r"
#: The same rule as a regular expression for Spark, DuckDB and Python.
WORD = r"[^\x20\x09-\x0D]+"


def folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file and its path there, for workers that read or write it themselves."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), uri


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def present(spark: SparkSession, path: str) -> list[str]:
    """The path, if it is there."""
    store, where = _hadoop(spark, path)
    return [path] if store.exists(where) else []


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the work folder whose rows nothing reads again."""
    store, where = _hadoop(spark, path)
    store.delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and the text as bytes; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column holds about limit bytes at most (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start, len(sizes) - start)


def gathered(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches put together, or cut, so that each holds about limit bytes of the column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for part in chunks(whole, column, limit):
            held.append(part)
            size += part.nbytes
            if size >= limit:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are saved: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
