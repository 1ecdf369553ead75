"""Sinks: upserts by id, reports, section JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key; the last of repeated keys in new is not defined, so
    they are refused."""
    if not new.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated {key} in an upsert")
    return old.join(new, key, "left_anti").unionByName(new)


def write_version(df: DataFrame, folder: str, version: int, *partition_by: str) -> str:
    """A table version in a folder of its own; readers move on by name, so a failed write is never seen."""
    path = f"{folder}/v={version}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the newest version of a folder that write_version fills."""
    df = spark.read.option("basePath", folder).parquet(folder)
    top = df.agg(F.max("v").alias("v"))
    return df.join(F.broadcast(top), "v", "left_semi").drop("v")


def section_json(blocks: DataFrame) -> DataFrame:
    """doc_id, json: {"title": .., "sections": {section: [texts in order]}} of blocks (doc_id, title, section, pos, text)."""
    per = blocks.groupBy("doc_id", "title", F.coalesce("section", F.lit("general")).alias("section")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts"))
    return per.groupBy("doc_id", "title").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "texts")))).alias("sections")).select("doc_id", F.to_json(F.struct("title", "sections")).alias("json"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_cache(tables: dict[str, DataFrame], folder: str) -> None:
    """The tables of an evaluation, one folder each; those that are whole already stay as they are."""
    for name, df in tables.items():
        if not complete(df.sparkSession, folder, name):
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def complete(spark: SparkSession, folder: str, *names: str) -> bool:
    """Whether every named table of a cache was written to its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return all((p := path(f"{folder}/{n}/_SUCCESS")).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for n in names)


def read_cache(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame] | None:
    """The named tables of a cache, None unless all of them are whole."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names} if complete(spark, folder, *names) else None
