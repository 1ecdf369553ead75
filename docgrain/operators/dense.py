"""Dense retrieval: exact cosine top-k; blocks of queries go over the vectors as matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import saved, small_batches, tidy
from .bm25 import Best, best

#: Queries that go over the vectors together.
BLOCK = 1000
#: Queries that the driver passes on at once, for a pass over the vectors; similarities that a task makes at once.
GROUP, CELLS = 1 << 14, 1 << 21


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def sound(rows: DataFrame, column: str, size: int | None = None) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only; of `size` numbers, if given."""
    v = F.col(column)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(good & (F.size(v) == size) if size is not None else good)


def width(rows: DataFrame, column: str) -> int | None:
    """The length that most sound vectors have."""
    return sound(rows, column).agg(F.mode(F.size(column), True)).first()[0]


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Queries (query_id, query_vec, ..) in blocks, and their vectors at length 1 (a zero vector stays zero)."""
    n_blocks = max(1, -(-queries.count() // block))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    if n_blocks > 1:  # the files of a block hold no other
        dealt = saved(dealt.repartitionByRange(n_blocks, "_block"), "dense-queries")
    for number in range(n_blocks):
        part = dealt.filter(F.col("_block") == number).drop("_block").toArrow()
        if part.num_rows:
            yield part, unit(part["query_vec"].to_pylist())


def _slabs(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Vectors put together, so many that a block of queries makes CELLS similarities with them, and the same at length 1."""
    rows, held, n = max(1, CELLS // max(1, block)), [], 0
    rows = min(rows, 1 << 13)
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from _cut(held, rows)
            held, n = [], 0
    yield from _cut(held, rows)


def _cut(held: list[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in pa.Table.from_batches(held).combine_chunks().to_batches(rows) if held else ():
        if batch.num_rows:
            vec = batch.column("vec").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            yield batch, unit(vec)


def unit(rows: list) -> np.ndarray:
    v = np.array(rows, np.float64)
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(n == 0, 1, n)


def search(queries: DataFrame, vectors: DataFrame, k: int = 20, block: int = BLOCK, others_only: bool = False) -> DataFrame:
    """query_id, rank, chunk_id, score (cosine, 6 places) of the k best vectors, ties by chunk_id, for any number of queries.

    Blocks of queries go over the vectors one after another; each batch of vectors returns k rows a query at most.
    others_only leaves a query's own id out. If both have a column `scope`, a query meets the vectors of its scope only. Null
    vectors, those that hold a null or no finite number, and those of another length than most queries have take no part.
    """
    small_batches(queries.sparkSession)
    size = width(queries, "query_vec")
    queries, vectors = sound(queries, "query_vec", size or 0), sound(vectors, "vec", size or 0)
    scoped = ["scope"] if "scope" in queries.columns and "scope" in vectors.columns else []
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("chunk_id", vectors.schema["chunk_id"].dataType), StructField("score", DoubleType())])
    out = None
    for part, q in _blocks(queries.select("query_id", "query_vec", *scoped), max(block, GROUP)):
        held = queries.sparkSession.sparkContext.broadcast((np.array(part["query_id"].to_pylist()), part["query_id"].type, q, np.array(part["scope"].to_pylist(), object) if scoped else None))

        def run(batches: Iterator[pa.RecordBatch], held: object = held) -> Iterator[pa.RecordBatch]:
            ids, kind, q, mine = held.value
            found = Best(len(ids), k)
            for batch, v in _slabs(batches, block):
                own = np.array(batch.column("chunk_id").to_pylist())
                scopes = np.array(batch.column("scope").to_pylist(), object) if mine is not None else None
                for a in range(0, len(ids), block):
                    s = np.round(q[a : a + block] @ v.T, 6)
                    if mine is not None:
                        s[mine[a : a + block, None] != scopes] = -np.inf
                    if others_only:
                        s[ids[a : a + block, None] == own] = -np.inf
                    row, column = best(s, own, k)
                    found.add(a + row, s[row, column], batch.column("chunk_id").take(pa.array(column)))
            row, score, names = found.rows()
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(ids[row], kind), names, pa.array(score)], ["query_id", "chunk_id", "score"])

        found = vectors.select("chunk_id", "vec", *scoped).mapInArrow(tidy(run), schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], schema)
    return _ranked(out, k)


def margins(queries: DataFrame, vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """query_id, mean_same, mean_other, top, margin: of each query (query_id, query_vec, label) over the vectors (chunk_id, vec,
    label) of other ids: the mean similarity to those of its label and of others, the highest one and its lead. Vectors take
    part as in search()."""
    small_batches(queries.sparkSession)
    size = width(queries, "query_vec")
    queries, vectors = sound(queries, "query_vec", size or 0), sound(vectors, "vec", size or 0)
    schema = "query_id long, same double, n_same long, other double, n_other long, top double, next double"
    out = None
    for part, q in _blocks(queries.select("query_id", "query_vec", "label"), max(block, GROUP)):
        held = queries.sparkSession.sparkContext.broadcast((np.array(part["query_id"].to_pylist()), np.array(part["label"].to_pylist()), q))

        def run(batches: Iterator[pa.RecordBatch], held: object = held) -> Iterator[pa.RecordBatch]:
            ids, labels, q = held.value
            total, n, most = np.zeros((2, len(ids))), np.zeros((2, len(ids)), np.int64), np.full((len(ids), 2), -np.inf)
            for batch, v in _slabs(batches, block):
                own, kinds = np.array(batch.column("chunk_id").to_pylist()), np.array(batch.column("label").to_pylist())
                for a in range(0, len(ids), block):
                    at = slice(a, a + block)
                    s = np.round(q[at] @ v.T, 6)
                    others = ids[at, None] != own
                    same = (labels[at, None] == kinds) & others
                    for i, some in enumerate((same, others & ~same)):
                        total[i, at] += (s * some).sum(1)
                        n[i, at] += some.sum(1)
                    two = np.concatenate([most[at], np.where(others, s, -np.inf)], axis=1)
                    most[at] = np.sort(np.partition(two, two.shape[1] - 2, axis=1)[:, -2:], axis=1)[:, ::-1]
            yield pa.RecordBatch.from_pydict({"query_id": ids, "same": total[0], "n_same": n[0], "other": total[1], "n_other": n[1], "top": most[:, 0], "next": most[:, 1]})

        found = vectors.select("chunk_id", "vec", "label").mapInArrow(tidy(run), schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], schema)
    # the two highest of all batches' two highest
    tops = F.slice(F.sort_array(F.flatten(F.collect_list(F.array("top", "next"))), False), 1, 2)
    per = out.groupBy("query_id").agg(F.sum("same").alias("same"), F.sum("n_same").alias("n_same"), F.sum("other").alias("other"), F.sum("n_other").alias("n_other"), tops.alias("tops"))
    mean = lambda x, n: F.round(F.try_divide(x, n), 4)
    return per.select("query_id", mean(F.col("same"), F.col("n_same")).alias("mean_same"), mean(F.col("other"), F.col("n_other")).alias("mean_other"), F.col("tops")[0].alias("top"), F.round(F.col("tops")[0] - F.col("tops")[1], 6).alias("margin"))
