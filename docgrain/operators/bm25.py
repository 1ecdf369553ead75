"""Okapi BM25: a kept index of tokens and term counts, and batch search over it.

The index is two tables: the tokens of every chunk, and how often each term occurs by scope. Both only grow, batch by
batch, so nothing is tokenized twice. A search takes queries in blocks; a block's terms with their weights are broadcast,
every batch of chunks is scored as sparse products and returns k rows a query at most: texts are never shuffled, and pairs
of queries and chunks never leave the task that makes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import tokens
from ..session import fresh, pieces, saved, small_batches, tidy

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries whose terms are broadcast together.
BLOCK = 2000
#: Tokens that a task looks at together, and scores that it makes at once, however long the texts and however many the queries.
TOKENS, CELLS = 1 << 17, 1 << 20


def postings(chunks: DataFrame) -> DataFrame:
    """scope, chunk_id, term, tf, dl of chunks (scope, chunk_id, text)."""
    cut = chunks.select("scope", "chunk_id", tokens(F.col("text")).alias("t"))
    each = cut.select("scope", "chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return each.groupBy("scope", "chunk_id", "dl", "term").agg(F.count("*").alias("tf"))


def _idf(df: DataFrame, stats: DataFrame, epsilon: float) -> DataFrame:
    """df (scope, term, df, ..) with idf. An idf below zero becomes epsilon times the mean over the scope's vocabulary."""
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = df.join(stats.select("scope", "n"), "scope").withColumn("raw", raw)
    mean = df.groupBy("scope").agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw"))
    return df.join(mean, "scope").withColumn("idf", idf).drop("raw", "mean", "n")


def term_stats(posts: DataFrame, stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """scope, term, df, cf, idf of postings."""
    df = posts.groupBy("scope", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return _idf(df, stats, epsilon).select("scope", "term", "df", "cf", "idf")


def _tokenized(chunks: DataFrame) -> DataFrame:
    return chunks.select("scope", "chunk_id", tokens(F.col("text")).alias("t"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """scope, n, avgdl; chunks without a token count too."""
    return _stats(_tokenized(chunks))


def _stats(cut: DataFrame) -> DataFrame:
    return cut.groupBy("scope").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))


def _counted(cut: DataFrame) -> DataFrame:
    """scope, term, df, cf: only sums by term go through the shuffle."""
    once = cut.select("scope", F.explode(F.array_distinct("t")).alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf"))
    every = cut.select("scope", F.explode("t").alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf"))
    return once.unionAll(every).groupBy("scope", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def vocabulary(chunks: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """scope, term, df, cf, idf straight from chunks, without postings: only sums by term go through the shuffle."""
    cut = saved(_tokenized(chunks), "bm25-tokens")
    return _idf(_counted(cut), _stats(cut), epsilon).select("scope", "term", "df", "cf", "idf")


class Index:
    """A kept index below a folder: tokens/batch=N (scope, chunk_id, t) and terms/batch=N (scope, term, df, cf)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, chunks: DataFrame, folder: str | None = None) -> Index:
        """The index of chunks (scope, chunk_id, text); without a folder, one in the work folder."""
        index = cls(chunks.sparkSession, folder or fresh(chunks.sparkSession, "bm25"))
        index.append(chunks, 0)
        return index

    def append(self, chunks: DataFrame, batch: int) -> None:
        """Adds chunks as a batch of their own; a batch that is written again replaces itself. The caller sees to it that a
        chunk is in one batch only."""
        _tokenized(chunks).write.mode("overwrite").parquet(f"{self.folder}/tokens/batch={batch}")
        cut = self.spark.read.parquet(f"{self.folder}/tokens/batch={batch}")
        _counted(cut).write.mode("overwrite").parquet(f"{self.folder}/terms/batch={batch}")

    def tokens(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/tokens").select("scope", "chunk_id", "t")

    def terms(self, epsilon: float = EPSILON) -> DataFrame:
        """scope, term, df, cf, idf over all batches."""
        every = self.spark.read.parquet(f"{self.folder}/terms").groupBy("scope", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return _idf(every, self.stats(), epsilon).select("scope", "term", "df", "cf", "idf")

    def stats(self) -> DataFrame:
        return _stats(self.tokens())

    def search(self, queries: DataFrame, k: int = 20, keep_zero: bool = False, k1: float = K1, b: float = B, epsilon: float = EPSILON, block: int = BLOCK) -> DataFrame:
        """query_id, rank, chunk_id, score of queries (query_id, scope, text), each against the chunks of its scope.

        Repeated query terms count as often. Scores are rounded to 6 places, so that the order of sums doesn't show; ties go
        by chunk_id. By default a score that isn't positive becomes 0.1 for each distinct shared term and chunks without one
        are left out; keep_zero ranks every chunk of the query's scope instead, as scored.
        """
        small_batches(self.spark)
        cut = self.tokens()
        asked = queries.select("query_id", "scope", tokens(F.col("text")).alias("t"))
        n_blocks = max(1, -(-asked.count() // block))
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "scope"), F.lit(n_blocks)))
        terms, stats = self.terms(epsilon), self.stats()
        if n_blocks > 1:  # read once for each block
            terms, stats = saved(terms, "bm25-terms"), saved(stats, "bm25-stats")
        schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("chunk_id", cut.schema["chunk_id"].dataType), StructField("score", DoubleType())])
        out = None
        for number in range(n_blocks):
            own = dealt.filter(F.col("block") == number).drop("block")
            each = own.select("query_id", "scope", F.explode("t").alias("term")).groupBy("query_id", "scope", "term").agg(F.count("*").alias("qtf"))
            wanted = each.join(F.broadcast(stats.join(F.broadcast(own.select("scope").distinct()), "scope", "left_semi")), "scope")
            weighed = terms.join(F.broadcast(wanted), ["scope", "term"]).select("query_id", "scope", "term", "qtf", "idf", "avgdl").toArrow()
            plain = own.select("query_id", "scope").distinct().toArrow()
            if plain.num_rows:
                model = self.spark.sparkContext.broadcast(_Block(plain, weighed))
                found = cut.mapInArrow(tidy(_scorer(model, k, keep_zero, k1, b)), schema)
                out = found if out is None else out.unionAll(found)
        if out is None:
            out = self.spark.createDataFrame([], schema)
        return top(out, k).select("query_id", "rank", "chunk_id", "score")


class _Block:
    """Queries of one block by scope: their ids and, by term, the queries that ask for it with weights."""

    def __init__(self, plain: pa.Table, weighed: pa.Table):
        self.kind = plain["query_id"].type
        self.queries: dict[object, list] = {}
        for q, scope in zip(plain["query_id"].to_pylist(), plain["scope"].to_pylist(), strict=True):
            self.queries.setdefault(scope, []).append(q)
        place = {(s, q): i for s, own in self.queries.items() for i, q in enumerate(own)}
        self.avgdl: dict[object, float] = {}
        self.terms: dict[object, dict[str, list[tuple[int, float]]]] = {}
        for r in weighed.to_pylist():
            self.avgdl[r["scope"]] = r["avgdl"]
            self.terms.setdefault(r["scope"], {}).setdefault(r["term"], []).append((place[r["scope"], r["query_id"]], r["idf"] * r["qtf"]))
        self.weights = {s: _matrix(list(own), own, len(self.queries[s])) for s, own in self.terms.items()}

    def __reduce__(self) -> tuple:
        return _restored, (self.__dict__,)


def _restored(state: dict) -> _Block:
    block = _Block.__new__(_Block)
    block.__dict__.update(state)
    return block


def _matrix(names: list[str], own: dict[str, list[tuple[int, float]]], n: int) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of terms; and by term number, one after another, the queries that ask for it and their weights."""
    at = np.concatenate([[0], np.cumsum([len(own[t]) for t in names])])
    return {t: i for i, t in enumerate(names)}, at, np.array([q for t in names for q, _ in own[t]], np.int64), np.array([w for t in names for _, w in own[t]])


def _scorer(model: object, k: int, keep_zero: bool, k1: float, b: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scored(block: _Block, batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray]]:
        """scope, query, row and score of the k best rows of a batch for each query."""
        scopes = batch.column("scope").to_pylist()
        listed = batch.column("t")
        length = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.float64)
        coded = listed.flatten().dictionary_encode()
        words, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        row_of = np.repeat(np.arange(len(scopes)), length.astype(np.int64))
        order = np.empty(len(scopes), np.int64)  # of chunk ids, for ties
        order[np.array(sorted(range(len(scopes)), key=batch.column("chunk_id").to_pylist().__getitem__), np.int64)] = np.arange(len(scopes))
        by_scope: dict[object, list[int]] = {}
        for i, s in enumerate(scopes):
            if s in block.queries:
                by_scope.setdefault(s, []).append(i)
        for scope, rows in by_scope.items():
            asked, mine = block.queries[scope], np.array(rows)
            row = term = n = np.zeros(0, np.int64)
            part = np.zeros(0)
            if scope in block.weights:
                numbers, at, who, weight = block.weights[scope]
                place = np.full(len(scopes), -1)
                place[mine] = np.arange(len(mine))
                term = np.array([numbers.get(w, -1) for w in words], np.int64)[number] if len(words) else term
                there = np.flatnonzero((term >= 0) & (place[row_of] >= 0))
                pair, tf = np.unique(place[row_of[there]] * np.int64(len(numbers)) + term[there], return_counts=True)
                row, term = pair // max(len(numbers), 1), pair % max(len(numbers), 1)
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[mine[row]] / block.avgdl[scope]))
                n = at[term + 1] - at[term]
            # rows that make CELLS scores at most, or one; a row makes no more than the queries have terms
            upto = np.concatenate([[0], np.cumsum(np.bincount(row, n, len(mine)))])
            first = 0
            while first < len(mine):
                last = int(np.searchsorted(upto, upto[first] + CELLS, "right")) - 1
                last = min(max(last, first + 1), first + max(1, CELLS // len(asked)), len(mine))
                own = slice(*np.searchsorted(row, [first, last]))
                shape = len(asked), last - first
                score, hits = np.zeros(shape), np.zeros(shape, np.int64)
                if own.stop > own.start:
                    m = n[own]
                    which = np.arange(int(m.sum())) + np.repeat(at[term[own]] - (np.cumsum(m) - m), m)
                    cell = who[which] * shape[1] + np.repeat(row[own] - first, m)
                    score = np.round(np.bincount(cell, np.repeat(part[own], m) * weight[which], score.size).astype(np.float64), 6).reshape(shape)
                    hits = np.bincount(cell, minlength=score.size).reshape(shape)
                if not keep_zero:
                    score = np.where(score <= 0, np.round(0.1 * hits, 6), score)
                    score[score <= 0] = -np.inf
                q, c = best(score, order[mine[first:last]], k)
                yield scope, q, mine[first:last][c], score[q, c]
                first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = model.value
        held: dict[object, Best] = {}
        for whole in batches:
            for batch in pieces(whole, "t", TOKENS):
                for scope, q, row, score in scored(block, batch):
                    held.setdefault(scope, Best(len(block.queries[scope]), k)).add(q, score, batch.column("chunk_id").take(pa.array(row)))
        for scope, own in held.items():
            q, score, names = own.rows()
            asked = block.queries[scope]
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in q.tolist()], block.kind), names, pa.array(score)], ["query_id", "chunk_id", "score"])

    return run


class Best:
    """The k best rows of each of n queries among all that a task has met, ties by name: what a task holds doesn't grow with its rows."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.limit, self.size = n, k, 4 * n * k + 1024, 0
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.floor = np.full(n, -np.inf)  # what k rows reach

    def add(self, q: np.ndarray, score: np.ndarray, names: pa.Array) -> None:
        some = score >= self.floor[q]
        if some.any():
            self.held.append((q[some], score[some], names.filter(pa.array(some))))
            self.size += int(some.sum())
        if self.size > self.limit:
            self.held = [self.rows()]
            q, score, _ = self.held[0]
            self.size = len(q)
            last = np.flatnonzero(np.bincount(q, minlength=self.n)[q] == self.k)
            self.floor[q[last]] = np.inf
            np.minimum.at(self.floor, q[last], score[last])

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Query, score and name of the rows that are left, by query, best first."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0), pa.nulls(0)
        q, score = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        names = pa.concat_arrays([h[2] for h in self.held])
        place = pc.rank(names, "ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        order = np.lexsort((place, -score, q))
        keep = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < self.k]
        return q[keep], score[keep], names.take(pa.array(keep))


def best(s: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row of s, ties by own; -inf never counts."""
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        row, column = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    else:
        row, column = np.nonzero(s > -np.inf)
    order = np.lexsort((own[column], -s[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ties by chunk_id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(queries: DataFrame, chunks: DataFrame, k: int = 20, keep_zero: bool = False, **options: float) -> DataFrame:
    """Index.search() over an index of chunks (scope, chunk_id, text) made for it, which holds the scopes that are asked only: a
    query meets no others, and statistics are those of a scope."""
    asked = F.broadcast(queries.select(F.col("scope").alias("asked")).distinct())
    own = chunks.join(asked, F.col("scope").eqNullSafe(F.col("asked")), "left_semi")
    return Index.build(own).search(queries, k, keep_zero, **options)
