"""Exact top-k inner-product search with a ball tree per shard.

Vectors are dealt to shards of SHARD rows; each shard holds a ball tree (centre, radius, smallest id of every node).
Queries come in blocks. A block goes through a shard's nodes in descending order of their upper bound q.c + |q| r; at a
node, only the queries go on whose bound can still reach their current k-th score. That k-th score is shared: shards are
searched in rounds (one, then GROWTH times as many as before), and what all shards before found is the floor of the next
round. Trees stay where they are: blocks of queries, up to WAVE bytes at a time, are broadcast to them, and a shard returns
only rows that reach the floor, k a query at most.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, small_batches, tidy

#: Vectors of a shard, of a leaf, and queries of a block at most.
SHARD, LEAF, BLOCK = 8192, 64, 512
#: Bytes of queries that are broadcast at once; how many times as many shards each round has as the one before.
WAVE, GROWTH = 32 << 20, 8
#: Exact integers of a float.
EXACT = 1 << 53


def quantise(x: np.ndarray, step: int = 256) -> np.ndarray:
    """floor(step * x), in int64 where it fits and Python integers elsewhere."""
    y = np.floor(step * x.astype(np.float64))
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    return np.array([[int(v) for v in row] for row in y], object)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products; scores beyond a long are held at its ends."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    top = max(1, int(abs(q).max())) * max(1, int(abs(v).max())) * q.shape[1]
    if top < EXACT:
        return np.rint(q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if top < 1 << 63:
        return q.astype(np.int64) @ v.astype(np.int64).T
    wide = q.astype(object) @ v.astype(object).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class BallTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        points = vectors.astype(np.float64)
        order = np.arange(len(ids))
        nodes: list[tuple[int, int, int, int]] = []  # start, stop, left child, right child (-1: leaf)
        centres, radii, least = [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            start, stop, parent, side = todo.pop()
            own = points[order[start:stop]]
            centre = own.mean(0)
            me = len(nodes)
            nodes.append((start, stop, -1, -1))
            if parent >= 0:
                a, b, l, r = nodes[parent]
                nodes[parent] = (a, b, me, r) if side == 0 else (a, b, l, me)
            centres.append(centre)
            # rounding must not cut a bound
            radii.append(float(np.sqrt(((own - centre) ** 2).sum(1)).max()) * (1 + 1e-9) + 1e-6)
            least.append(int(ids[order[start:stop]].min()))
            if stop - start > leaf:
                far = own[((own - own[((own - centre) ** 2).sum(1).argmax()]) ** 2).sum(1).argmax()]
                along = own @ (far - centre)
                half = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(along, half)]
                todo += [(start, start + half, me, 0), (start + half, stop, me, 1)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.nodes, self.centres, self.radii, self.least = nodes, np.array(centres), np.array(radii), np.array(least)

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best k of this shard for each query, other than itself, ties to smaller ids (id -1: none);
        and the number of products made. floor: scores of which k candidates are known, below which nothing counts."""
        n = len(qids)
        none = np.iinfo(np.int64)
        best, who = np.full((n, k), none.min), np.full((n, k), -1)
        floor = np.full(n, none.min) if floor is None else floor
        q = queries.astype(np.float64)
        slack = 1e-9 * np.abs(q).sum(1) * max(1.0, float(np.abs(self.centres).max(initial=0))) + 1e-6
        bound = q @ self.centres.T + np.sqrt((q * q).sum(1))[:, None] * self.radii + slack[:, None]
        made = 0

        def alive(node: int, among: np.ndarray) -> np.ndarray:
            b, kth = bound[among, node], best[among, -1]
            tie = (np.floor(b) > kth) | (self.least[node] < who[among, -1]) | (who[among, -1] < 0)
            return among[(b >= floor[among]) & (b >= kth) & tie]

        heap = [(-float(bound[:, 0].max(initial=-np.inf)), 0, np.arange(n))] if n else []
        while heap:
            _, node, among = heapq.heappop(heap)
            among = alive(node, among)
            if not len(among):
                continue
            start, stop, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    down = alive(child, among)
                    if len(down):
                        heapq.heappush(heap, (-float(bound[down, child].max()), child, down))
                continue
            scores = products(queries[among], self.vectors[start:stop])
            made += scores.size
            ids = np.broadcast_to(self.ids[start:stop], scores.shape)
            own = ids == qids[among][:, None]
            all_ids = np.concatenate([who[among], np.where(own, -1, ids)], 1)
            all_scores = np.concatenate([best[among], np.where(own, none.min, scores)], 1)
            # by score downwards, then id upwards, nothing last
            order = np.lexsort((np.where(all_ids < 0, none.max, all_ids), ~all_scores, all_ids < 0), axis=1)[:, :k]
            who[among], best[among] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_scores, order, 1)
        return who, best, made


def _packed(vectors: DataFrame, size: int, tree: bool) -> DataFrame:
    """dim and payload rows: pickled trees, or pickled (ids, vectors) of queries, of up to `size` rows each."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def pack(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            ids, own = np.array([r[0] for r in rows], np.int64), quantise(np.array([r[1] for r in rows]))
            payload = pickle.dumps(BallTree(ids, own) if tree else (ids, own), protocol=5)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for vec_id, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_numpy(zero_copy_only=False), strict=True):
                held.setdefault(len(x), []).append((vec_id, x))
                if len(held[len(x)]) >= size:
                    yield pack(len(x))
        for dim in list(held):
            yield pack(dim)

    return vectors.mapInArrow(tidy(run), "dim long, payload binary")


def _dealt(rows: DataFrame, size: int, tree: bool, name: str) -> DataFrame:
    """id, dim, payload, n_bytes: rows packed evenly, whatever their ids."""
    rows = saved(rows, f"{name}-rows")
    packed = _packed(rows.repartition(max(1, -(-rows.count() // size))), size, tree)
    return saved(packed.select(F.monotonically_increasing_id().alias("id"), "dim", "payload", F.length("payload").alias("n_bytes")), name)


def _rounds(n: int) -> list[tuple[float, float]]:
    """Ranges of shares of n shards: one shard, then GROWTH times as many as before."""
    out, a, step = [], 0, 1
    while a < n:
        out.append((a / n, min(1.0, (a + step) / n)))
        a, step = a + step, step * GROWTH
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK, made: list[int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query over all vectors but its own id.

    vectors and queries have vec_id and embedding. Components become floor(256 * x). Rows whose id or vector is null,
    or whose vector is empty or holds null or non-finite components, take no part; vectors of another length than the
    query's are no candidates. Ties go to the smaller vec_id; scores beyond a long count as its ends. Every row is a
    candidate of its own, repeated rows too; query rows that share an id are one query with the candidates of each. Extra
    columns are left out. made: gets the number of products made and that of all pairs appended.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sound(df: DataFrame) -> DataFrame:
        own = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return own.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine)

    trees, blocks = _dealt(sound(vectors), shard, True, "topk-trees"), _dealt(sound(queries), block, False, "topk-blocks")
    sizes = sorted((r["id"], r["n_bytes"]) for r in blocks.select("id", "n_bytes").collect())  # a few bytes for each block
    n_shards = trees.count()
    schema = "row long, query_id long, vec_id long, score long, made long, pairs long"
    out = spark.createDataFrame([], schema)

    def search(asked: object, floors: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, payload in zip(batch.column("dim").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                    tree = pickle.loads(payload)
                    for no, (own_dim, queries_) in asked.value.items():
                        if own_dim != dim:
                            continue
                        ids, own = pickle.loads(queries_)
                        row = no * block + np.arange(len(ids))
                        floor = np.array([floors.value.get(r, np.iinfo(np.int64).min) for r in row.tolist()], np.int64)
                        who, scores, n = tree.search(ids, own, k, floor)
                        there = (who >= 0) & (scores >= floor[:, None])
                        rows = int(there.sum())
                        # the counts of a pair of block and shard go with a row of no query
                        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.repeat(row, k).reshape(-1, k)[there], -1)), pa.array(np.append(np.repeat(ids, k).reshape(-1, k)[there], -1)), pa.array(np.append(who[there], -1)), pa.array(np.append(scores[there], 0)), pa.array(np.append(np.zeros(rows, np.int64), n)), pa.array(np.append(np.zeros(rows, np.int64), len(ids) * len(tree.ids)))], ["row", "query_id", "vec_id", "score", "made", "pairs"])

        return run

    at = 0
    while at < len(sizes):
        stop, size = at, 0
        while stop < len(sizes) and (stop == at or size + sizes[stop][1] <= WAVE):
            size += sizes[stop][1]
            stop += 1
        wave = blocks.filter(F.col("id").between(sizes[at][0], sizes[stop - 1][0])).collect()  # WAVE bytes at most, or one block
        asked = spark.sparkContext.broadcast({r["id"]: (r["dim"], bytes(r["payload"])) for r in wave})
        found, floors = None, {}
        for a, b in _rounds(n_shards):
            share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
            own = trees.filter((share >= a) & (share < b)).select("dim", "payload").repartition(max(1, min(round((b - a) * n_shards), max(4 * parts, 64))))
            hits = saved(own.mapInArrow(tidy(search(asked, spark.sparkContext.broadcast(floors))), schema), "topk-hits")
            found = hits if found is None else found.union(hits)
            if b < 1:
                best = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc()))
                kth = found.filter("row >= 0").withColumn("n", best).filter(F.col("n") == k)
                floors = {r["row"]: r["score"] for r in kth.select("row", "score").collect()}  # a number for each query of the wave
        out = out if found is None else out.union(found)
        at = stop
    if made is not None:
        made += list(out.agg(F.sum("made"), F.sum("pairs")).first())
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.filter("row >= 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
