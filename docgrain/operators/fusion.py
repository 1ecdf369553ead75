"""Rank fusion, parent caps and expansion, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def _ranked(df: DataFrame, *order: object) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def reciprocal_rank(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, rrf, rank: sums of 1 / (k + rank) over ranked lists (query_id, chunk_id, rank), ties by chunk_id."""
    every = None
    for part in lists:
        own = part.select("query_id", "chunk_id", "rank")
        every = own if every is None else every.unionByName(own)
    fused = every.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("rrf"))
    return _ranked(fused, F.col("rrf").desc(), "chunk_id")


def interleaved(first: DataFrame, second: DataFrame, budget: int) -> DataFrame:
    """query_id, chunk_id, rank: the two lists in turn, first one first, each chunk once, cut at budget."""
    one = first.select("query_id", "chunk_id", (2 * (F.col("rank") - 1)).alias("at"))
    two = second.select("query_id", "chunk_id", (2 * (F.col("rank") - 1) + 1).alias("at"))
    least = one.unionByName(two).groupBy("query_id", "chunk_id").agg(F.min("at").alias("at"))
    return _ranked(least, "at").filter(F.col("rank") <= budget).drop("at")


def cap_parents(ranked: DataFrame, cap: int = 2, budget: int | None = None) -> DataFrame:
    """ranked (query_id, chunk_id, parent_id, rank) with the first `cap` chunks of each parent, numbered anew; chunks
    without a parent aren't capped."""
    nth = F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("rank"))
    kept = ranked.withColumn("nth", nth).filter((F.col("nth") <= cap) | F.col("parent_id").isNull()).drop("nth")
    kept = _ranked(kept.withColumnRenamed("rank", "old_rank"), "old_rank").drop("old_rank")
    return kept if budget is None else kept.filter(F.col("rank") <= budget)


def expand_parents(ranked: DataFrame) -> DataFrame:
    """The first chunk of each parent, its text replaced by the parent's unless that is empty; numbered anew.

    ranked: query_id, chunk_id, parent_id, rank, text, parent_text."""
    key = F.coalesce(F.col("parent_id").cast("string"), F.concat(F.lit("#"), F.col("chunk_id").cast("string")))
    first = ranked.withColumn("key", key).withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("rank"))).filter("nth = 1")
    text = F.coalesce(F.nullif("parent_text", F.lit("")), F.col("text"))
    first = first.select("query_id", "chunk_id", "parent_id", F.col("rank").alias("old_rank"), text.alias("text"))
    return _ranked(first, "old_rank").drop("old_rank")


def merge_best(*lists: DataFrame) -> DataFrame:
    """query_id, chunk_id, score, rank: candidate lists merged by chunk, the best score kept."""
    every = None
    for part in lists:
        own = part.select("query_id", "chunk_id", "score")
        every = own if every is None else every.unionByName(own)
    best = every.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return _ranked(best, F.col("score").desc(), "chunk_id")


def rerank(ranked: DataFrame, score: object, top_n: int = 10) -> DataFrame:
    """ranked with `score` (a Column), in its order, ties by the old rank; the first top_n."""
    scored = ranked.withColumn("score", F.round(score, 6)).withColumnRenamed("rank", "old_rank")
    return _ranked(scored, F.coalesce("score", F.lit(0.0)).desc(), "old_rank").filter(F.col("rank") <= top_n)
