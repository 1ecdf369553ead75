"""Vectors of texts: hashed tf-idf, cut to its leading directions by a distributed randomised SVD.

A term goes to one of WIDTH signed slots by its hash, so no vocabulary is kept. With A the matrix of all texts (a row each, at
length 1), the rows of a random matrix are multiplied by A'A some times; each pass is one job over the texts, whose tasks add up
a table of WIDTH x (rank + EXTRA) numbers, whatever the corpus. The driver makes the columns orthogonal between passes and
takes the directions from the last pass (Rayleigh-Ritz). Questions and documents are embedded by their text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import tokens
from ..session import pieces, saved, small_batches, tidy

#: Slots of the hashed terms; directions kept and further ones that are carried along; passes over the texts.
WIDTH, RANK, EXTRA, PASSES = 1 << 14, 64, 16, 4
#: Slots that are added up together, and numbers that a task multiplies at once.
SLAB, ENTRIES = 256, 1 << 15
#: Terms of the texts that a task looks at together.
TERMS = 1 << 17


def slots(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """chunk_id, slots: each term's slot times two, and one more for a negative sign; of (chunk_id, text), null texts have none."""
    each = F.transform(tokens(F.col("text")), lambda t: F.pmod(F.xxhash64(t), F.lit(2 * width)).cast("int"))
    return texts.select("chunk_id", F.coalesce(each, F.array().cast("array<int>")).alias("slots"))


def weighted(column: pa.ListArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, slot and weight of the entries of a batch: (1 + ln tf) * idf with the term's sign, each row at length 1."""
    n, width = column.value_lengths().to_numpy().astype(np.int64), len(idf)
    key, tf = np.unique(np.repeat(np.arange(len(n)), n) * 2 * width + column.flatten().to_numpy(), return_counts=True)
    row, slot = key // (2 * width), key // 2 % width
    w = (1 + np.log(tf)) * idf[slot] * (1 - 2 * (key % 2))
    length = np.sqrt(np.bincount(row, w * w, len(n)))
    return row, slot, w / length[row]


def _product(row: np.ndarray, slot: np.ndarray, w: np.ndarray, q: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The rows that have entries, some at a time: their entries, which of these begins a row, and their products with q."""
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    end = np.append(begin[1:], len(row))
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + ENTRIES, "right")))
        part = slice(int(begin[a]), int(end[b - 1]))
        first = begin[a:b] - begin[a]
        yield part, first, np.add.reduceat(w[part, None] * q[slot[part]], first)
        a = b


def _added(rows: DataFrame, by: list[str]) -> DataFrame:
    """The packed tables (slab, part) of rows, added up."""

    def add(table: pa.Table) -> pa.Table:
        total = np.add.reduce([np.frombuffer(x, np.float64) for x in table.column("part").to_pylist()])
        return pa.table({"slab": table.column("slab")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    return rows.groupBy(*by).applyInArrow(add, "slab int, part binary")


class TextModel:
    """idf of every slot, the leading directions (a column each) and their singular values."""

    def __init__(self, idf: np.ndarray, directions: np.ndarray, values: np.ndarray):
        self.idf, self.directions, self.values = idf, directions, values

    @classmethod
    def fit(cls, texts: DataFrame, rank: int = RANK, width: int = WIDTH, passes: int = PASSES, seed: int = 42) -> TextModel:
        """The model of all texts (chunk_id, text). Texts without terms count for nothing; without any others all vectors are zero."""
        spark = texts.sparkSession
        small_batches(spark)
        own = saved(slots(texts, width).filter(F.size("slots") > 0), "text-slots")
        slot = F.explode(F.array_distinct(F.transform("slots", lambda x: F.floor(x / 2).cast("int"))))
        seen = own.select(slot.alias("slot")).groupBy("slot").agg(F.count("*").alias("df")).toArrow()  # width rows at most
        df = np.zeros(width)
        df[seen.column("slot").to_numpy()] = seen.column("df").to_numpy()
        idf = np.log((1 + own.count()) / (1 + df)) + 1
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, rank + EXTRA))))[0]
        for i in range(passes):
            b = cls._pass(own, idf, q)
            if i < passes - 1:
                q = np.linalg.qr(b)[0]
        values, turn = np.linalg.eigh(q.T @ b)
        best = np.argsort(-values)[:rank]
        return cls(idf, q @ turn[:, best], np.sqrt(np.maximum(values[best], 0)))

    @staticmethod
    def _pass(own: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
        """A'A q. Tasks are as many as run at once some times over, each gives a table, and these are added up in two steps."""
        spark = own.sparkSession
        held = spark.sparkContext.broadcast((idf, q))  # width x (rank + EXTRA) numbers
        tasks = 4 * spark.sparkContext.defaultParallelism
        groups = max(1, int(tasks**0.5))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, q = held.value
            total, touched = np.zeros_like(q), np.zeros(-(-len(q) // SLAB), bool)
            lot = 0
            for batch in (part for whole in batches for part in pieces(whole, "slots", TERMS)):
                row, slot, w = weighted(batch.column("slots"), idf)
                lot = (lot * 31 + batch.num_rows + int(slot.sum())) % (1 << 31)
                touched[slot // SLAB] = True
                for part, first, y in _product(row, slot, w, q):
                    at = np.argsort(slot[part], kind="stable")
                    which = np.repeat(np.arange(len(first)), np.diff(np.append(first, part.stop - part.start)))
                    terms = slot[part][at]
                    edge = np.flatnonzero(np.diff(terms, prepend=-1))
                    total[terms[edge]] += np.add.reduceat(w[part][at, None] * y[which[at]], edge)
            slabs = np.flatnonzero(touched)
            for i in slabs.tolist():
                yield pa.RecordBatch.from_pydict({"slab": pa.array([i], pa.int32()), "lot": pa.array([lot % groups], pa.int32()), "part": pa.array([total[i * SLAB : (i + 1) * SLAB].tobytes()], pa.binary())})

        parts = own.select("slots").coalesce(tasks).mapInArrow(tidy(run), "slab int, lot int, part binary")
        got = _added(_added(parts, ["slab", "lot"]), ["slab"]).toArrow()  # one row a slab
        out = np.zeros_like(q)
        for i, part in zip(got.column("slab").to_pylist(), got.column("part").to_pylist(), strict=True):
            out[i * SLAB : (i + 1) * SLAB] = np.frombuffer(part, np.float64).reshape(-1, q.shape[1])
        return out

    def embed(self, texts: DataFrame) -> DataFrame:
        """chunk_id, vec of every text (chunk_id, text); a text without terms has a zero vector."""
        spark = texts.sparkSession
        small_batches(spark)
        held = spark.sparkContext.broadcast((self.idf, self.directions))
        schema = StructType([texts.schema["chunk_id"], StructField("vec", ArrayType(DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, directions = held.value
            for batch in (part for whole in batches for part in pieces(whole, "slots", TERMS)):
                out = np.zeros((batch.num_rows, directions.shape[1]))
                row, slot, w = weighted(batch.column("slots"), idf)
                for part, first, y in _product(row, slot, w, directions):
                    out[row[part][first]] = y
                ends = np.arange(batch.num_rows + 1, dtype=np.int32) * directions.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], ["chunk_id", "vec"])

        return slots(texts, len(self.idf)).mapInArrow(tidy(run), schema)
