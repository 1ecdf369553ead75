"""Approximate vector search against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrain.operators import dense
from docgrain.operators.ann import IvfIndex


def table(spark, v, bad=()):
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + list(bad)
    return spark.createDataFrame(rows, "chunk_id long, vec array<double>")


def asked(df):
    return df.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec"))


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    v = centres[rng.integers(0, 20, 2000)] + 0.3 * rng.normal(size=(2000, 24))
    bad = [(9000, None), (9050, [1.0, None] + [0.0] * 22), (9001, [float("nan")] * 24), (9100, [1.0, 2.0]), (9150, [0.0] * 24)]
    return table(spark, v, bad)


def test_recall_and_probes(spark, clustered):
    index = IvfIndex.build(clustered)
    queries = asked(clustered)
    assert index.calibrate(queries) >= 0.95
    assert index.probes < len(index.centres) / 2
    again = IvfIndex(spark, index.folder)
    assert again.probes == index.probes and again.recall(queries) >= 0.9
    assert index.rows().count() == 2001


def test_all_cells_and_a_wide_refinement_give_the_exact_rows(spark, clustered):
    few = clustered.filter("chunk_id < 150 or chunk_id >= 9000")
    index = IvfIndex.build(few, cells=5)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(index.search(asked(few), 20, probes=5)) == rows(dense.search(asked(few), few, 20))


def test_unsound_vectors_take_no_part(spark, clustered):
    got = dense.search(asked(clustered), clustered, 2100)
    assert {r.query_id for r in got.select("query_id").distinct().collect()} == {*range(0, 2000, 50), 9150}
    assert got.filter("query_id = 0").count() == 2001


def test_nothing(spark, clustered):
    index = IvfIndex.build(clustered.limit(0))
    assert index.search(asked(clustered), 3).count() == 0
    assert IvfIndex.build(clustered).search(asked(clustered).limit(0), 3).count() == 0
