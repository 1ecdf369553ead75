"""What a task holds and gives is bounded, however many rows it meets."""

import random

import numpy as np
import pyarrow as pa

from docgrain.operators import bm25, dense
from docgrain.session import pieces


class Held:
    def __init__(self, value):
        self.value = value


def block(queries=30):
    rng = random.Random(1)
    weighed = [{"query_id": q, "scope": "all", "term": f"w{t}", "qtf": 1, "idf": 1.5 + t / 7, "avgdl": 20.0} for q in range(queries) for t in rng.sample(range(60), 8)]
    return bm25._Block(pa.table({"query_id": list(range(queries)), "scope": ["all"] * queries}), pa.Table.from_pylist(weighed))


def batches(n, rows):
    rng = random.Random(2)
    for i in range(n):
        texts = [[f"w{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.randint(0, 40))] for _ in range(rows)]
        yield pa.RecordBatch.from_pydict({"scope": ["all"] * rows, "chunk_id": [f"c{(i * rows + j) * 7919 % 10007:05}" for j in range(rows)], "t": pa.array(texts, pa.list_(pa.string()))})


def run(keep_zero):
    got = [r for b in bm25._scorer(Held(block()), 5, keep_zero, 1.5, 0.75)(batches(40, 50)) for r in b.to_pylist()]
    return sorted((r["query_id"], -r["score"], r["chunk_id"]) for r in got)


def test_a_task_gives_k_rows_a_query_whatever_its_batches(monkeypatch):
    for keep_zero in (False, True):
        whole = run(keep_zero)
        assert len(whole) == 30 * 5  # not 5 of each of 40 batches
        with monkeypatch.context() as m:
            m.setattr(bm25, "TOKENS", 100)
            m.setattr(bm25, "CELLS", 64)
            assert run(keep_zero) == whole


def test_best_rows_are_those_of_a_sort():
    rng = np.random.default_rng(3)
    q, score, names = rng.integers(0, 4, 20_000), rng.integers(0, 500, 20_000) / 8, rng.permutation(20_000)
    best = bm25.Best(5, 7)
    for a in range(0, 20_000, 333):
        at = slice(a, a + 333)
        best.add(q[at], score[at], pa.array(names[at]))
    got = list(zip(*(x.tolist() for x in best.rows()[:2]), best.rows()[2].to_pylist(), strict=True))
    want = [x for i in range(4) for x in sorted(zip(q.tolist(), score.tolist(), names.tolist(), strict=True), key=lambda x: (x[0] != i, -x[1], x[2]))[:7]]
    assert got == want and best.size <= best.limit


def test_pieces_hold_the_limit_or_a_row():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (3, 4, 20, 1, 1, 0)] + [None], "t": [[1]] * 7})
    assert [p.num_rows for p in pieces(batch, "text", 8)] == [2, 1, 4] and [p.num_rows for p in pieces(batch, "t", 3)] == [3, 3, 1]


def test_queries_go_over_the_vectors_in_one_pass(spark):
    rows = spark.createDataFrame([(i, [float(i % 13), 1.0, float(i % 7)]) for i in range(300)], "chunk_id long, vec array<double>")
    asked = rows.selectExpr("chunk_id as query_id", "vec as query_vec")
    few = dense.search(asked, rows, 3, block=7)
    assert few._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # not one of each of 43 blocks
    assert few.collect() == dense.search(asked, rows, 3).collect() and few.count() == 900


def test_only_scopes_that_are_asked_are_indexed(spark, monkeypatch):
    chunks = spark.createDataFrame([(s, f"{s}-{i}", f"word{i} common") for s in ("a", "b", None, "c") for i in range(4)], "scope string, chunk_id string, text string")
    asked = spark.createDataFrame([(1, "a", "word1 common"), (2, None, "word2"), (3, "unknown", "common")], "query_id int, scope string, text string")
    want = sorted(tuple(r) for r in bm25.Index.build(chunks).search(asked, 3, keep_zero=True).collect())
    build, held = bm25.Index.build, []
    monkeypatch.setattr(bm25.Index, "build", lambda own: held.append(own.count()) or build(own))
    assert sorted(tuple(r) for r in bm25.search(asked, chunks, 3, keep_zero=True).collect()) == want and held == [8]
