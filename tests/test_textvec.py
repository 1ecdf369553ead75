"""Text vectors against numpy's singular value decomposition."""

import numpy as np
import pytest

from docgrain.operators import dense
from docgrain.operators.textvec import TextModel, slots, weighted
from docgrain.plans import retrieval

WIDTH = 512


def texts(spark, n=120):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"topic{i % 4}word{w}" if w < 30 else f"any{w}" for w in rng.integers(0, 60, 40))) for i in range(n)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, "? !")], "chunk_id long, text string")


def matrix(df, idf):
    """A row a text, in the order of the ids."""
    table = slots(df, len(idf)).orderBy("chunk_id").toArrow().combine_chunks()
    out = np.zeros((table.num_rows, len(idf)))
    row, slot, w = weighted(table.column("slots").combine_chunks(), idf)
    np.add.at(out, (row, slot), w)
    return out


def test_subspace_is_as_good_as_the_best(spark):
    df = texts(spark).repartition(5)
    model = TextModel.fit(df, rank=8, width=WIDTH, passes=6)
    a = matrix(df, model.idf)
    _, best, rows = np.linalg.svd(a)
    assert np.allclose(model.values[:4], best[:4], rtol=1e-3)
    assert np.allclose(model.directions.T @ model.directions, np.eye(8), atol=1e-9)
    error = np.linalg.norm(a - a @ model.directions @ model.directions.T)
    assert error <= 1.01 * np.sqrt((best[8:] ** 2).sum())
    got = np.array([r.vec for r in model.embed(df).orderBy("chunk_id").collect()])
    assert np.allclose(got, a @ model.directions)
    assert not got[-3:].any()


def test_idf_counts_every_text_once(spark):
    df = spark.createDataFrame([(1, "same same other"), (2, "same"), (3, None)], "chunk_id long, text string")
    model = TextModel.fit(df, rank=2, width=WIDTH)
    both = {int(s) // 2 for s in slots(df.filter("chunk_id = 2"), WIDTH).first().slots}
    assert all(np.isclose(model.idf[s], 1.0) for s in both)
    assert np.isclose(np.sort(model.idf)[1], np.log(3 / 2) + 1)


def test_partitions_don_t_matter(spark):
    df = texts(spark)
    one, many = (TextModel.fit(df.repartition(n), rank=4, width=WIDTH, passes=6) for n in (1, 9))
    assert np.allclose(one.values, many.values, rtol=1e-6)


def test_neighbours_share_a_topic(spark):
    df = texts(spark)
    vectors = TextModel.fit(df, rank=8, width=WIDTH).embed(df)
    asked = vectors.filter("chunk_id < 20").selectExpr("chunk_id as query_id", "vec as query_vec")
    near = dense.search(asked, vectors, 5, others_only=True).collect()
    assert np.mean([r.query_id % 4 == r.chunk_id % 4 for r in near]) > 0.9


@pytest.mark.parametrize("condition", ["chunk_id < 0", "chunk_id >= 900"])
def test_nothing_to_learn_from(spark, condition):
    df = texts(spark).filter(condition)
    rows = TextModel.fit(df, rank=4, width=WIDTH).embed(df).collect()
    assert not any(x for r in rows for x in r.vec)


def test_questions_find_the_document_that_holds_them(spark, small):
    got = {(r.model, r.k): r for r in retrieval.text_vector_compare(spark, small).collect()}
    assert len(got) == 16
    assert got["svd_64", 10].recall >= got["svd_16", 10].recall
    assert got["svd_64", 10].hit > 0.9
