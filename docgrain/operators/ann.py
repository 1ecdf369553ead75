"""Approximate vector search: an inverted file of cells with product-quantised residuals and exact scores for the best.

Cells are the parts of a distributed k-means over all vectors, taken at length 1. A vector is kept in its cell with a code: what
its cell's centre leaves over, cut into PARTS pieces, each the number of the nearest of LEVELS codewords. A query scores the
codes of the cells nearest to it from a table of its products with all codewords; some times k of the best are scored exactly.
How many cells a query looks at, and how many times k, is measured against the exact search (dense.search), which stands
beside it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import fresh, saved, ship
from . import dense
from .bm25 import best

#: Pieces of a vector, codewords of a piece, and how many times k are scored exactly.
PARTS, LEVELS, REFINE = 16, 256, 10
#: Cells at most, whatever the number of vectors; vectors, drawn by hash, that codewords are fitted on.
CELLS, SAMPLE = 4096, 20_000
#: Recall at k that calibrate() asks of a search, and queries that it tries at most.
RECALL, TRIED = 0.95, 200


def _codewords(rows: np.ndarray, levels: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Centres of Lloyd's algorithm over a sample."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(levels, len(rows)), replace=False)]
    for _ in range(rounds):
        at = np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, rows)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


class IvfIndex:
    """An index below a folder: rows (cell, chunk_id, code, vec at length 1) sorted by cell, and its model."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        held = json.loads(spark.read.text(f"{self.folder}/model", wholetext=True).first()[0])
        self.centres, self.words, self.probes = np.array(held["centres"]), [np.array(w) for w in held["words"]], held["probes"]
        self.refine = held["refine"]

    def _keep(self) -> None:
        held = json.dumps({"centres": self.centres.tolist(), "words": [w.tolist() for w in self.words], "probes": self.probes, "refine": self.refine})
        self.spark.createDataFrame([(held,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/model")

    @classmethod
    def build(cls, vectors: DataFrame, folder: str | None = None, cells: int | None = None, parts: int = PARTS, levels: int = LEVELS, seed: int = 42) -> IvfIndex:
        """The index of vectors (chunk_id, vec); those that aren't sound, or of another length than most, are left out."""
        spark = vectors.sparkSession
        ship(spark)
        size = dense.width(vectors, "vec") or 0
        own = dense.sound(vectors.select("chunk_id", "vec"), "vec", size)
        length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
        own = saved(own.select("chunk_id", F.transform("vec", lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0))).alias("vec")), "ivf-vectors")
        n = own.count()
        self = cls.__new__(cls)
        self.spark, self.folder = spark, (folder or fresh(spark, "ivf")).rstrip("/")
        wanted = max(1, min(cells or int(n**0.5), CELLS, n))
        if n:
            model = KMeans(k=wanted, seed=seed, maxIter=10).fit(own.select(array_to_vector("vec").alias("features")))
            self.centres = np.array(model.clusterCenters())
            drawn = np.array([r.vec for r in own.orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).select("vec").collect()])
        else:
            self.centres, drawn = np.zeros((1, size)), np.zeros((1, size))
        rest = drawn - self.centres[self._cell(drawn)]
        self.words = [_codewords(piece, levels, seed + i) for i, piece in enumerate(np.array_split(rest, max(1, min(parts, size)), axis=1))]
        self.probes, self.refine = max(1, len(self.centres) // 4), REFINE
        held = spark.sparkContext.broadcast(self._state())  # CELLS centres and LEVELS codewords at most
        kind = vectors.schema["chunk_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _of(held.value)
            for batch in batches:
                if batch.num_rows:
                    v = np.array(batch.column("vec").to_pylist()).reshape(batch.num_rows, -1)
                    cell = index._cell(v)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("chunk_id"), pa.array([c.tobytes() for c in index._code(v - index.centres[cell])], pa.binary()), batch.column("vec")], ["cell", "chunk_id", "code", "vec"])

        schema = StructType([StructField("cell", StructType.fromDDL("c int")[0].dataType), kind, *StructType.fromDDL("code binary, vec array<double>")])
        own.mapInArrow(run, schema).repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{self.folder}/rows")
        self._keep()
        return self

    def _state(self) -> dict:
        return {"centres": self.centres, "words": self.words}

    def _cell(self, v: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres**2).sum(1) - 2 * v @ self.centres.T, axis=1)

    def _code(self, rest: np.ndarray) -> np.ndarray:
        cuts = np.cumsum([0, *(w.shape[1] for w in self.words)])
        return np.stack([np.argmin((w**2).sum(1) - 2 * rest[:, a:b] @ w.T, axis=1) for w, a, b in zip(self.words, cuts[:-1], cuts[1:], strict=True)], 1).astype(np.uint8)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = None, block: int = dense.BLOCK, others_only: bool = False) -> DataFrame:
        """query_id, rank, chunk_id, score as dense.search() gives them, from the `probes` cells nearest to each query (query_id,
        query_vec). A query whose vector isn't sound, or is of another length, gives nothing."""
        probes, most = min(probes or self.probes, len(self.centres)), self.refine * k
        queries = dense.sound(queries.select("query_id", "query_vec"), "query_vec", self.centres.shape[1])
        ids = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("chunk_id", self.rows().schema["chunk_id"].dataType)])
        cuts = np.cumsum([0, *(w.shape[1] for w in self.words)])
        rows, near = self.rows(), None
        for part, q in dense._blocks(queries, block):
            to_cells = q @ self.centres.T
            asked = np.argsort(-to_cells, axis=1, kind="stable")[:, :probes]
            probed = np.zeros((len(q), len(self.centres)), bool)
            np.put_along_axis(probed, asked, True, axis=1)
            tables = np.stack([np.pad(q[:, a:b] @ w.T, ((0, 0), (0, LEVELS - len(w)))) for w, a, b in zip(self.words, cuts[:-1], cuts[1:], strict=True)], 1)
            held = self.spark.sparkContext.broadcast((np.array(part["query_id"].to_pylist()), part["query_id"].type, probed, to_cells, tables))

            def run(batches: Iterator[pa.RecordBatch], held: object = held) -> Iterator[pa.RecordBatch]:
                names, kind, probed, to_cells, tables = held.value
                for batch in batches:
                    cells = batch.column("cell").to_numpy()
                    own = batch.column("chunk_id").to_pylist()
                    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(own), -1).astype(np.int64)
                    for cell in np.unique(cells).tolist():
                        mine, who = np.flatnonzero(cells == cell), np.flatnonzero(probed[:, cell])
                        if not len(who):
                            continue
                        s = np.repeat(to_cells[who, cell][:, None], len(mine), axis=1)
                        for m in range(code.shape[1]):
                            s += tables[who, m][:, code[mine, m]]
                        names_here = np.array([own[i] for i in mine.tolist()])
                        if others_only:
                            s[names[who][:, None] == names_here] = -np.inf
                        row, column = best(s, names_here, most)
                        yield pa.RecordBatch.from_arrays([pa.array(names[who[row]], kind), batch.column("chunk_id").take(pa.array(mine[column])), pa.array(s[row, column])], ["query_id", "chunk_id", "score"])

            needed = np.flatnonzero(probed.any(0)).tolist()
            some = rows if len(needed) == len(self.centres) else rows.filter(F.col("cell").isin(needed))
            found = some.select("cell", "chunk_id", "code").mapInArrow(run, StructType([*ids, StructField("score", DoubleType())]))
            near = found if near is None else near.unionAll(found)
        if near is None:
            return self.spark.createDataFrame([], StructType([*ids, StructField("score", DoubleType())])).selectExpr("query_id", "1 as rank", "chunk_id", "score")
        first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
        near = saved(near.withColumn("at", first).filter(F.col("at") <= most).select("query_id", "chunk_id"), "ivf-near")
        length = F.sqrt(F.aggregate("query_vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
        dot = F.aggregate(F.zip_with("vec", "query_vec", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        scored = near.join(queries, "query_id").join(rows.select("chunk_id", "vec"), "chunk_id")
        scored = scored.select("query_id", "chunk_id", F.round(F.coalesce(F.try_divide(dot, length), F.lit(0.0)), 6).alias("score"))
        return dense._ranked(scored, k)

    def recall(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: DataFrame | None = None) -> float:
        """The share of the exact search's rows that search() gives for the queries (query_id, query_vec), own ids left out."""
        want = exact if exact is not None else self._exact(queries, k)
        got = self.search(queries, k, probes, others_only=True).select("query_id", "chunk_id", F.lit(1).alias("hit"))
        return want.join(got, ["query_id", "chunk_id"], "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]

    def _exact(self, queries: DataFrame, k: int) -> DataFrame:
        return saved(dense.search(queries, self.rows().select("chunk_id", "vec"), k, others_only=True).select("query_id", "chunk_id"), "ivf-exact")

    def calibrate(self, queries: DataFrame, k: int = 10, recall: float = RECALL) -> float:
        """Sets and keeps how many times k are scored exactly, doubled from REFINE until all cells give the recall, and then the least
        number of cells, doubled from one, that does; as tried on TRIED of the queries. Gives the recall."""
        tried = saved(queries.select("query_id", "query_vec").orderBy(F.xxhash64("query_id")).limit(TRIED), "ivf-tried")
        exact, n, self.refine, self.probes = self._exact(tried, k), self.rows().count(), REFINE, 1
        while self.recall(tried, k, len(self.centres), exact) < recall and self.refine * k < n:
            self.refine *= 2
        while (got := self.recall(tried, k, exact=exact)) < recall and self.probes < len(self.centres):
            self.probes = min(2 * self.probes, len(self.centres))
        self._keep()
        return got


def _of(state: dict) -> IvfIndex:
    index = IvfIndex.__new__(IvfIndex)
    index.__dict__.update(state)
    return index
