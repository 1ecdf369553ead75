import random

import duckdb
import numpy as np
import pytest

from docgrain.llm import topk
from oracle import same


def brute(rows, queries, k):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    top = 1 << 63
    score = lambda v, w: max(-top, min(top - 1, sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(v, w))))
    out = []
    for q in sorted({i for i, _ in fine if i in queries}):
        best = [(-score(v, w), j) for i, v in fine if i == q for j, w in fine if j != q and len(w) == len(v)]
        out += [(q, n, j, -s) for n, (s, j) in enumerate(sorted(best)[:k], 1)]
    return out


def run(spark, rows, queries, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter(df.vec_id.isin(list(queries)))
    return sorted(map(tuple, topk.top_k(df, asked, **options).collect()))


def test_equals_brute_force_with_ties_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(3)]) for i in range(150)]
    rows += [(i, [1.0, 1.0, 1.0]) for i in range(200, 260)]  # a hot vector
    rows += rows[:12] * 2 + [(7, [0.5, 0.5, 0.5])]  # repeated rows, queries among them, an id with two vectors
    queries = set(range(0, 300, 10)) | {7}
    assert run(spark, rows, queries, shard=32, block=7) == brute(rows, queries, 5)


def test_odd_rows_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, []), (6, [3.0, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [2.0**40, 1.0])]
    assert run(spark, rows, {0, 1, 2, 7}) == brute(rows, {0, 1, 2, 7}, 5)


def test_repeated_rows_are_candidates_each(spark, tmp_path):
    rows = [(i, [float(i), 1.0]) for i in (0, 1, 1, 2, 2, 3)] + [(50, [1.0, 1.0])] * 2
    got = run(spark, rows, {0, 50})
    assert got == brute(rows, {0, 50}, 5)
    assert [r[2] for r in got if r[0] == 0] == [1, 1, 2, 2, 3]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert sorted(con.execute(topk.OP1_SQL).fetchall()) == got


def test_scores_beyond_a_long_count_as_its_ends(spark):
    rows = [(0, [2.0**30, 2.0**30]), (1, [2.0**30, 2.0**30]), (2, [2.0**30, 2.0**29]), (3, [-(2.0**30), -(2.0**30)]), (4, [1.0, 1.0])]
    got = run(spark, rows, {0})
    assert got == brute(rows, {0}, 5)
    assert got[0][3] == (1 << 63) - 1 and got[-1][3] == -(1 << 63)


def test_extra_columns_are_left_out(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 1, 2, "x") for i in range(9)], "vec_id long, embedding array<double>, score int, dim int, payload string")
    got = topk.top_k(df, df.filter("vec_id = 0"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 5


def test_rounds_share_the_kth_score(spark):
    """Clustered vectors in several shards: most products are never made."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 10, (20, 8))
    v = centres[rng.integers(0, 20, 3000)] + rng.normal(0, 0.1, (3000, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = []
    got = topk.top_k(df, df.filter("vec_id < 5"), shard=300, made=made).collect()
    assert sorted(map(tuple, got)) == brute(rows, set(range(5)), 5)
    assert made[1] == 5 * 3000 and made[0] < 0.5 * made[1]


def test_empty_tables(spark):
    assert run(spark, [], set()) == []
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(df, df.limit(0)).count() == 0


def test_tree_prunes_clustered_vectors():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 2000, (20, 8))
    v = np.rint(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 20, (4000, 8))).astype(np.int64)
    ids = np.arange(4000)
    _, _, made = topk.BallTree(ids, v).search(ids[:5], v[:5], 5)
    assert made < 0.3 * 5 * 4000


@pytest.mark.parametrize("name", ["op1_ball_tree"])
def test_query_equals_sql(spark, small, name):
    same(spark, small, topk.op1_ball_tree, topk.OP1_SQL)
