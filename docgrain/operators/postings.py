"""BM25 over a kept inverted index: blocks of postings with their maxima, and top-k that reads only blocks which can matter.

Chunks are numbered as they are written. A segment is a run of them that holds LOT tokens, made within one task, so that no
posting is shuffled; SPAN chunks of it make a window. A row holds the postings of one term and scope in a segment, by window,
each window's with their number, greatest tf and least length: what it can add to a score at most, for any parameters and
however the mean length moves. Rows of a segment lie together by term; columns of postings are read only where they are needed.

A search takes queries in blocks, each query against its scope:
1. the maxima give what each window can reach at most, added up by the task that reads the segment;
2. the windows that can reach most are scored; the k-th score is a lower bound, and windows that stay below it are skipped;
3. the windows that remain are scored whole, segment by segment. The result is that of a scan.

Batches are appended as folders of their own and enter the list of live batches when they are complete; merge() makes one of
several. A batch that is written again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.text import tokens
from ..session import fresh, pieces, saved, small_batches, tidy
from .bm25 import BLOCK, CELLS, EPSILON, K1, B, _Block, _idf

#: Chunks of a window, tokens of a segment, windows (times k) that are scored first.
SPAN, LOT, SEEDS = 128, 1 << 18, 2
_ROW = "scope string, term string, seg long, n int, cf int, max_tf int, min_dl int, wins array<int>, ns array<int>, max_tfs array<int>, min_dls array<int>, nos array<int>, tfs array<int>, dls array<int>"
#: Scores are rounded to so many places; bounds allow for as much.
PLACES, SLACK = 6, 1e-5


def _segments(rows: DataFrame) -> DataFrame:
    """The rows of the index for rows (scope, no, t). A segment ends after LOT tokens and chunks, or where numbers jump."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = upto = 0
        for whole in batches:
            no = whole.column("no").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(no) != 1) + 1).tolist(), len(no)]
            for batch in (part for a, b in zip(cuts[:-1], cuts[1:], strict=True) for part in pieces(whole.slice(a, b - a), "t", LOT)):
                if held and (size >= LOT or batch.column("no")[0].as_py() != upto):
                    yield from _packed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size = [], 0
                held.append(batch)
                size += batch.num_rows + len(batch.column("t").flatten())
                upto = batch.column("no")[-1].as_py() + 1
        if held:
            yield from _packed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.select(F.col("scope").cast("string").alias("scope"), "no", "t").mapInArrow(tidy(run), _ROW)


def _packed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A segment's rows, by scope and term."""
    listed, scope = batch.column("t"), batch.column("scope").dictionary_encode()
    length = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = listed.flatten().dictionary_encode()
    place = np.argsort(pc.sort_indices(words.dictionary).to_numpy())
    row = np.repeat(np.arange(batch.num_rows), length)
    own = scope.indices.fill_null(-1).to_numpy()[row].astype(np.int64)
    # one key a posting: scope, term, chunk
    key = (own * len(place) + place[words.indices.to_numpy()]) * batch.num_rows + row
    posting, tf = np.unique(key[own >= 0], return_counts=True)
    if not len(posting):
        return
    group, row = np.divmod(posting, batch.num_rows)
    at = np.flatnonzero(np.diff(group, prepend=-1))
    block = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(row // SPAN, prepend=-1) != 0))
    scope_of, term = np.divmod(group[at], len(place))
    dl, n = length[row], np.diff(np.append(at, len(posting)))

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(ends, len(values)).astype(np.int32)), pa.array(values.astype(np.int32)))

    by_block = np.searchsorted(block, at)
    ints = {"n": n, "cf": np.add.reduceat(tf, at), "max_tf": np.maximum.reduceat(tf, at), "min_dl": np.minimum.reduceat(dl, at)}
    blocks = {"wins": row[block] // SPAN, "ns": np.diff(np.append(block, len(posting))), "max_tfs": np.maximum.reduceat(tf, block), "min_dls": np.minimum.reduceat(dl, block)}
    yield pa.RecordBatch.from_pydict(
        {"scope": scope.dictionary.take(pa.array(scope_of)), "term": words.dictionary.take(pc.sort_indices(words.dictionary).take(pa.array(term))), "seg": np.full(len(at), batch.column("no")[0].as_py())}
        | {k: v.astype(np.int32) for k, v in ints.items()} | {k: lists(v, by_block) for k, v in blocks.items()}
        | {k: lists(v, at) for k, v in (("nos", row), ("tfs", tf), ("dls", dl))}
    )


def _share(tf: Column, dl: Column, k1: float, b: float) -> Column:
    """What a posting adds to a score, but for the term's weight."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))


def _best(query: np.ndarray, no: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, and what equals the last of them."""
    order = np.lexsort((-score, query))
    query, no, score = query[order], no[order], score[order]
    first = np.searchsorted(query, query)
    last = np.minimum(first + k, np.searchsorted(query, query, "right")) - 1
    keep = score >= score[last]
    return query[keep], no[keep], score[keep]


def _scorer(held: object, k: int, k1: float, b: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a segment's postings and the windows (query_id, win) that are wanted of it, the best chunks of each query."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model: _Block = held.value
        schema = pa.schema({"query_id": right.schema.field("query_id").type, "batch": pa.int32(), "no": pa.int64(), "score": pa.float64()})
        out = [schema.empty_table()]
        if left.num_rows and right.num_rows:
            left, batch, seg = left.combine_chunks(), right["batch"][0].as_py(), right["seg"][0].as_py()
            scopes = np.array(left["scope"].to_pylist())
            for scope in set(scopes.tolist()) & set(model.weights):
                asked = model.queries[scope]
                query, no, score = _scores(left.filter(pa.array(scopes == scope)), right, model, scope, k, k1, b)
                ids = pa.array([asked[i] for i in query.tolist()], schema.field("query_id").type)
                out.append(pa.table([ids, pa.array([batch] * len(no), pa.int32()), pa.array(no + seg, pa.int64()), pa.array(score, pa.float64())], schema=schema))
        return pa.concat_tables(out)

    return run


def _scores(rows: pa.Table, windows: pa.Table, model: _Block, scope: str, k: int, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    numbers, at, who, weight = model.weights[scope]
    place = {q: i for i, q in enumerate(model.queries[scope])}
    win = windows["win"].to_numpy()
    wanted = np.zeros((len(place), int(win.max()) + 1), bool)
    for q, w in zip(windows["query_id"].to_pylist(), win.tolist(), strict=True):
        if q in place:
            wanted[place[q], w] = True
    nos, tfs, dls = (rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("nos", "tfs", "dls"))
    term = np.repeat([numbers[t] for t in rows["term"].to_pylist()], pc.list_value_length(rows["nos"]).to_numpy())
    order = np.argsort(nos, kind="stable")
    no, term, tf, dl = nos[order], term[order], tfs[order], dls[order]
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / model.avgdl[scope]))
    n = at[term + 1] - at[term]
    upto = np.concatenate([[0], np.cumsum(n)])
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    a = 0
    while a < len(no):  # chunks that make CELLS products at most, or one
        z = min(max(int(np.searchsorted(upto, upto[a] + CELLS, "right")) - 1, a + 1), len(no))
        if z < len(no):
            z = int(np.searchsorted(no, no[z])) if no[z] > no[a] else int(np.searchsorted(no, no[a], "right"))
        m = n[a:z]
        which = np.arange(int(m.sum())) + np.repeat(at[term[a:z]] - (np.cumsum(m) - m), m)
        q, own = who[which], np.repeat(np.arange(a, z), m)
        some = wanted[q, no[own] // SPAN]
        which, q, own = which[some], q[some], own[some]
        pair, back, hits = np.unique(q * (int(no[-1]) + 1) + no[own], return_inverse=True, return_counts=True)
        score = np.round(np.bincount(back, part[own] * weight[which], len(pair)).astype(np.float64), PLACES)
        score = np.where(score <= 0, np.round(0.1 * hits, PLACES), score)
        query, chunk = np.divmod(pair, int(no[-1]) + 1)
        out.append(_best(query, chunk, score, k))
        a = z
    return _best(*(np.concatenate(x) for x in zip(*out, strict=True)), k)


class PostingIndex:
    """An index below a folder: tokens/batch=N (scope, chunk_id, no, t), terms/batch=N (scope, term, df, cf), blocks/batch=N,
    and live/version=N (batch), whose greatest version counts. Scopes are kept as strings."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, chunks: DataFrame, folder: str | None = None) -> PostingIndex:
        """The index of chunks (scope, chunk_id, text); without a folder, one in the work folder."""
        index = cls(chunks.sparkSession, folder or fresh(chunks.sparkSession, "postings"))
        index.append(chunks, 0)
        return index

    def _live(self) -> tuple[int, list[int]]:
        """Greatest complete version and its batches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/live/version=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        version = max((int(f.getPath().getParent().getName().split("=")[1]) for f in found or []), default=-1)
        return version, [r.batch for r in self.spark.read.parquet(f"{self.folder}/live/version={version}").collect()] if version >= 0 else []

    def batches(self) -> list[int]:
        return sorted(self._live()[1])

    def _publish(self, version: int, batches: list[int]) -> None:
        self.spark.createDataFrame([(b,) for b in batches], "batch int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/live/version={version}")

    def _write(self, cut: DataFrame, batch: int) -> None:
        """A batch's tables from its tokens (scope, chunk_id, t)."""
        small_batches(self.spark)
        put = lambda df, kind: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{kind}/batch={batch}")
        put(cut.select(F.col("scope").cast("string").alias("scope"), "chunk_id", F.monotonically_increasing_id().alias("no"), "t"), "tokens")
        put(_segments(self.spark.read.parquet(f"{self.folder}/tokens/batch={batch}")), "blocks")
        rows = self.spark.read.parquet(f"{self.folder}/blocks/batch={batch}")
        put(rows.groupBy("scope", "term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf")), "terms")

    def append(self, chunks: DataFrame, batch: int) -> None:
        """Adds chunks as a batch; the caller sees to it that a chunk is in one batch only."""
        version, live = self._live()
        self._write(chunks.select("scope", "chunk_id", tokens(F.col("text")).alias("t")), batch)
        self._publish(version + 1, sorted({*live, batch}))

    def merge(self, batches: list[int], into: int) -> None:
        """Makes one new batch of several, from their tokens; readers see the old ones until it is complete."""
        version, live = self._live()
        if into in live or not set(batches) <= set(live):
            raise ValueError("merge live batches into a new one")
        own = [self.spark.read.parquet(f"{self.folder}/tokens/batch={b}") for b in batches]
        every = own[0]
        for df in own[1:]:
            every = every.unionByName(df)
        self._write(every.select("scope", "chunk_id", "t"), into)
        self._publish(version + 1, sorted({*live, into} - set(batches)))

    def _table(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}").filter(F.col("batch").isin(self.batches()))

    def stats(self) -> DataFrame:
        """scope, n, avgdl."""
        return self._table("tokens").filter("scope is not null").groupBy("scope").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))

    def terms(self, stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
        """scope, term, df, cf, idf over all live batches."""
        every = self._table("terms").groupBy("scope", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return _idf(every, stats, epsilon)

    def search(self, queries: DataFrame, k: int = 20, k1: float = K1, b: float = B, epsilon: float = EPSILON, made: dict[str, int] | None = None) -> DataFrame:
        """query_id, rank, chunk_id, score of queries (query_id, scope, text): what bm25.Index.search() gives.

        Repeated query terms count as often; scores are rounded to 6 places; one that isn't positive becomes 0.1 for each
        distinct shared term; ties go by chunk_id. Queries and chunks without terms give nothing. made, if given, takes the
        numbers of postings that the queries' terms hold and that were read.
        """
        small_batches(self.spark)
        stats = saved(self.stats(), "postings-stats")
        asked = queries.select("query_id", F.col("scope").cast("string").alias("scope"), F.explode(tokens(F.col("text"))).alias("term"))
        asked = asked.groupBy("query_id", "scope", "term").agg(F.count("*").alias("qtf"))
        plan = asked.join(self.terms(stats, epsilon).select("scope", "term", "idf"), ["scope", "term"]).join(stats.select("scope", "avgdl"), "scope")
        plan = saved(plan.select("query_id", "scope", "term", "qtf", "idf", "avgdl"), "postings-plan")
        n_blocks = max(1, -(-plan.select("query_id").distinct().count() // BLOCK))
        dealt = plan.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
        out = None
        for number in range(n_blocks):
            found = self._block(dealt.filter(F.col("block") == number).drop("block"), k, k1, b, made)
            out = found if out is None else out.unionAll(found)
        return out

    def _block(self, plan: DataFrame, k: int, k1: float, b: float, made: dict[str, int] | None) -> DataFrame:
        """The result for the terms (query_id, scope, term, qtf, idf, avgdl) of BLOCK queries at most."""
        blocks = self._table("blocks")
        w = F.col("idf") * F.col("qtf")
        # a score that isn't positive, which only negative weights make, still gives 0.1 a term
        every = Window.partitionBy("query_id")
        low = F.when(F.min(w).over(every) <= 0, 0.1 * F.count("*").over(every)).otherwise(F.lit(0.0))
        own = plan.select("query_id", "scope", "term", F.greatest(w, F.lit(0.0)).alias("gain"), "avgdl", low.alias("low"))
        # maxima only; no posting is read
        heads = blocks.select("batch", "seg", "scope", "term", F.arrays_zip("wins", "ns", "max_tfs", "min_dls").alias("x")).join(F.broadcast(own), ["scope", "term"])
        heads = heads.select("query_id", "batch", "seg", "gain", "avgdl", "low", F.explode("x").alias("x"))
        most = F.sum(F.col("gain") * _share(F.col("x.max_tfs"), F.col("x.min_dls"), k1, b))
        heads = heads.groupBy("query_id", "batch", "seg", F.col("x.wins").alias("win")).agg(F.greatest(most, F.max("low")).alias("most"), F.sum("x.ns").alias("n"))
        heads = saved(heads, "postings-windows")
        at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "batch", "seg", "win"))
        seeds = saved(heads.withColumn("at", at).filter(F.col("at") <= SEEDS * k).select("query_id", "batch", "seg", "win"), "postings-seeds")
        model = self.spark.sparkContext.broadcast(_Block(plan.select("query_id", "scope").distinct().toArrow(), plan.toArrow()))
        first = self._scored(seeds, plan, model, k, k1, b)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        bound = first.withColumn("rank", rank).filter(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("bound"))
        need = heads.join(F.broadcast(bound), "query_id", "left").filter(F.col("bound").isNull() | (F.col("most") >= F.col("bound")))
        need = saved(need.select("query_id", "batch", "seg", "win", "n"), "postings-need")
        if made is not None:
            for name, df in (("held", heads), ("read", need)):
                made[name] = made.get(name, 0) + (df.agg(F.sum("n")).first()[0] or 0)
        score = self._scored(need, plan, model, k, k1, b)
        ranked = score.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("rank") <= k).drop("rank")
        ids = self._table("tokens").select("batch", "no", "chunk_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
        found = saved(ranked, "postings-ranked").join(ids, ["batch", "no"])
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")

    def _scored(self, windows: DataFrame, plan: DataFrame, model: object, k: int, k1: float, b: float) -> DataFrame:
        """query_id, batch, no, score of the best chunks of each segment's windows (query_id, batch, seg, win) that share a term
        with the query: k a query, and what equals the last. Only postings of wanted windows are shuffled, by segment."""
        wins = windows.groupBy("batch", "seg").agg(F.collect_set("win").alias("w"))
        wins = wins.select("batch", "seg", F.transform(F.sequence(F.lit(0), F.array_max("w")), lambda i: F.array_contains("w", i)).alias("w"))
        own = self._table("blocks").select("batch", "seg", "scope", "term", F.arrays_zip("nos", "tfs", "dls").alias("p"))
        own = own.join(F.broadcast(plan.select("scope", "term").distinct()), ["scope", "term"], "left_semi").join(wins, ["batch", "seg"])
        own = own.withColumn("p", F.filter("p", lambda x: F.get("w", (x["nos"] / SPAN).cast("int")))).filter(F.size("p") > 0)
        own = own.select("batch", "seg", "scope", "term", *(F.col(f"p.{c}").alias(c) for c in ("nos", "tfs", "dls")))
        kind = windows.schema["query_id"].dataType
        schema = StructType([StructField("query_id", kind), StructField("batch", IntegerType()), StructField("no", LongType()), StructField("score", DoubleType())])
        right = windows.select("query_id", "batch", "seg", "win")
        return own.groupBy("batch", "seg").cogroup(right.groupBy("batch", "seg")).applyInArrow(_scorer(model, k, k1, b), schema)
