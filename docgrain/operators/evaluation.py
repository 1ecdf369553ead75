"""Set-based evaluation of ranked lists, citations, answers and latencies."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import answer_normal, answer_tokens
from ..session import saved

DEFAULT_KS = (5, 10, 20, 50, 100)


def per_query(ranked: DataFrame, gold: DataFrame, queries: DataFrame, ks: tuple[int, ...] = DEFAULT_KS) -> DataFrame:
    """query_id, k, hit, recall, ndcg, rr for every query and k.

    ranked: query_id, chunk_id, rank; gold: query_id, chunk_id; queries: query_id. Without gold, hit, recall and nDCG are
    1 and the reciprocal rank is 0.
    """
    spark = ranked.sparkSession
    cuts = F.broadcast(spark.createDataFrame([(k,) for k in ks], "k int"))
    hits = ranked.join(gold.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi").select("query_id", "rank")
    n_gold = gold.select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    inside = F.col("rank") <= F.col("k")
    base = queries.select("query_id").distinct().join(n_gold, "query_id", "left").join(cuts)
    at = base.join(hits, "query_id", "left").groupBy("query_id", "k", "n_gold").agg(
        F.count_if(inside).alias("found"),
        F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.min("rank").alias("first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", "n_gold").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    none = F.col("n_gold").isNull()
    return at.select(
        "query_id",
        "k",
        F.when(none, 1.0).otherwise((F.col("found") > 0).cast("double")).alias("hit"),
        F.when(none, 1.0).otherwise(F.col("found") / F.col("n_gold")).alias("recall"),
        F.when(none, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
    )


def summary(per: DataFrame, *by: str) -> DataFrame:
    """Means of per_query() by k and further columns, 6 places."""
    mean = lambda c: F.round(F.avg(c), 6)
    return per.groupBy(*by, "k").agg(mean("hit").alias("hit"), mean("recall").alias("recall"), mean("ndcg").alias("ndcg"), mean("rr").alias("mrr"), F.count("*").alias("n_queries"))


def percentiles(df: DataFrame, by: str, value: str, shares: tuple[float, ...], linear: bool = True) -> DataFrame:
    """by, p0, p1, .. (one for each share) and n: exact percentiles of each group, between neighbours (linear) or by place,
    sorted[int(n * share)].

    Equal values are counted first; the counts are dealt by ranges of (by, value), so that no group meets in one task:
    running sums inside a range are moved by what lies in the ranges before. Null values take no part.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    # saved, so that the ranges are the same for both uses
    dealt = saved(counts.repartitionByRange(by, value).withColumn("part", F.spark_partition_id()), "percentiles")
    totals = dealt.groupBy(by, "part").agg(F.sum("c").alias("own"))
    n = totals.groupBy(by).agg(F.sum("own").alias("n"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = totals.select(by, "part", before.alias("before")).join(n, by)
    upto = F.sum("c").over(Window.partitionBy(by, "part").orderBy(value))
    placed = dealt.withColumn("upto", upto).join(moved, [by, "part"])
    last = F.col("before") + F.col("upto") - 1  # the last place, from 0, that holds the value
    holds = lambda at: (at <= last) & (at > last - F.col("c"))
    out = []
    for i, share in enumerate(shares):
        if linear:
            at = (F.col("n") - 1) * F.lit(float(share))
            out += [F.max(F.when(holds(F.floor(at)), F.col(value))).alias(f"low{i}"), F.max(F.when(holds(F.ceil(at)), F.col(value))).alias(f"high{i}")]
        else:
            out.append(F.max(F.when(holds(F.least(F.floor(F.col("n") * F.lit(float(share))), F.col("n") - 1)), F.col(value))).alias(f"p{i}"))
    found = placed.groupBy(by, "n").agg(*out)
    if not linear:
        return found
    between = lambda i, share: F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * ((F.col("n") - 1) * F.lit(float(share)) - F.floor((F.col("n") - 1) * F.lit(float(share))))
    return found.select(by, *[between(i, s).alias(f"p{i}") for i, s in enumerate(shares)], "n")


def token_f1(answer: Column, truth: Column) -> Column:
    """F1 of two texts' word multisets; 1 if both are empty, 0 if one is."""
    a, t = answer_tokens(answer), answer_tokens(truth)
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(t, x)))
    p, r = shared / F.size(a), shared / F.size(t)
    both = (F.size(a) == 0) & (F.size(t) == 0)
    none = (F.size(a) == 0) | (F.size(t) == 0)
    return F.when(both, 1.0).when(none, 0.0).when(shared == 0, 0.0).otherwise(2 * p * r / (p + r))


def _strict_words(text: str) -> list[str]:
    return unicodedata.normalize("NFKC", text).lower().split()


def _f1s(answers: pd.Series, truths: pd.Series, shared: Callable[[list[str], list[str]], int]) -> pd.Series:
    out = []
    for answer, truth in zip(answers, truths, strict=True):
        if answer is None or truth is None:
            out.append(None)
            continue
        a, t = _strict_words(answer), _strict_words(truth)
        n = shared(a, t)
        p, r = n / max(len(a), 1), n / max(len(t), 1)
        out.append(2 * p * r / (p + r) if n else 0.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def _counted(answers: pd.Series, truths: pd.Series) -> pd.Series:
    return _f1s(answers, truths, lambda a, t: (Counter(a) & Counter(t)).total())


@F.pandas_udf(T.DoubleType())
def _distinct(answers: pd.Series, truths: pd.Series) -> pd.Series:
    return _f1s(answers, truths, lambda a, t: len(set(a) & set(t)))


def counted_f1(answer: Column, truth: Column) -> Column:
    """F1 of the word multisets of two texts (in NFKC and lower case), articles and punctuation kept; 0 if either is empty, null if
    either is null."""
    return _counted(answer, truth)


def set_f1(answer: Column, truth: Column) -> Column:
    """As counted_f1, with the number of distinct shared words over the lengths of the lists."""
    return _distinct(answer, truth)


def facet_coverage(cited: Column, facets: Column) -> Column:
    """Share of the facets of which the cited text holds a word of over 3 letters; 1 without facets."""
    low = F.lower(cited)
    met = F.filter(facets, lambda f: F.exists(F.filter(F.split(F.lower(f), r"\s+"), lambda w: F.length(w) > 3), lambda w: F.instr(low, w) > 0))
    return F.when(F.size(facets) == 0, 1.0).otherwise(F.size(met) / F.greatest(F.size(facets), F.lit(1)))


def exact_match(answer: Column, truth: Column) -> Column:
    return answer_normal(answer) == answer_normal(truth)


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of sentences (over 10 characters) at least half of whose longer words (over 3) occur in the context."""
    said = F.filter(F.transform(F.split(answer, r"[.!?]"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    lower = F.lower(context)

    def supported(s: Column) -> Column:
        longer = F.filter(F.split(F.lower(s), r"\s+"), lambda w: F.length(w) > 3)
        found = F.size(F.filter(longer, lambda w: F.instr(lower, w) > 0))
        return (F.size(longer) == 0) | (2 * found >= F.size(longer))

    n = F.size(said)
    return F.when(F.length(F.trim(answer)) == 0, 0.0).when(n == 0, 1.0).otherwise(F.size(F.filter(said, supported)) / F.greatest(n, F.lit(1)))


def citation_precision(cited: Column, gold: Column) -> Column:
    c, g = F.array_distinct(cited), F.array_distinct(gold)
    return F.when(F.size(c) == 0, F.when(F.size(g) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(c, g)) / F.greatest(F.size(c), F.lit(1)))


def citation_recall(cited: Column, gold: Column) -> Column:
    c, g = F.array_distinct(cited), F.array_distinct(gold)
    return F.when(F.size(g) == 0, 1.0).otherwise(F.size(F.array_intersect(c, g)) / F.greatest(F.size(g), F.lit(1)))


def citations(answer: Column, retrieved: Column) -> Column:
    """Ids cited in an answer: bracketed ids, and "Reference N" or "Ref N" by place in the retrieved list."""
    bracketed = F.regexp_extract_all(answer, F.lit(r"\[([A-Za-z0-9_\-]+)\]"), F.lit(1))
    numbers = F.regexp_extract_all(answer, F.lit(r"(?i)\bRef(?:erence)? (\d+)"), F.lit(1))
    by_place = F.transform(numbers, lambda n: F.coalesce(F.try_element_at(retrieved, F.greatest(n.cast("int"), F.lit(1))), F.concat(F.lit("INVALID_REF_INDEX_"), n)))
    return F.array_distinct(F.concat(bracketed, by_place))


def error_rate_chars(reference: Column, text: Column) -> Column:
    """Edit distance over the reference's length, 4 places; an empty reference gives 0 or 1."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(text) == 0, 0.0).otherwise(1.0)).otherwise(F.round(F.levenshtein(reference, text) / F.greatest(n, F.lit(1)), 4))


#: Distinct words that a pair of texts may hold for its words to be coded as single characters.
CODES = 70


@F.pandas_udf(T.IntegerType())
def _word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two word lists, a row of the table at a time."""

    def one(x: list[str], y: list[str]) -> int:
        codes: dict[str, int] = {}
        x, y = (np.array([codes.setdefault(w, len(codes)) for w in z]) for z in (x, y))
        row = np.arange(len(y) + 1)
        for i, w in enumerate(x):
            new = np.minimum(row[1:] + 1, row[:-1] + (y != w)) if len(y) else row[1:]
            whole = np.concatenate([[i + 1], new])
            row = np.minimum.accumulate(whole - np.arange(len(whole))) + np.arange(len(whole))
        return int(row[-1])

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def error_rate_words(reference: Column, text: Column) -> Column:
    """Word edit distance over the reference's words, 4 places; an empty reference gives 0 or 1.

    With few distinct words each becomes a character, numbered by first use, and the built-in distance does the rest;
    longer texts go through numpy."""
    a, b = F.filter(F.split(reference, r"\s+"), lambda w: w != ""), F.filter(F.split(text, r"\s+"), lambda w: w != "")
    every = F.array_distinct(F.concat(a, b))
    code = lambda arr: F.array_join(F.transform(arr, lambda w: F.char(F.lit(47) + F.array_position(every, w))), "")
    distance = F.when(F.size(every) <= CODES, F.levenshtein(code(a), code(b))).otherwise(_word_distance(a, b))
    n = F.size(a)
    return F.when(n == 0, F.when(F.size(b) == 0, 0.0).otherwise(1.0)).otherwise(F.round(distance / F.greatest(n, F.lit(1)), 4))
