"""Search over blocks of postings against the scan of bm25.py."""

import random

import pytest
from pyspark.sql import functions as F

from docgrain.operators import bm25, postings
from docgrain.operators.postings import PostingIndex
from docgrain.plans.common import chunks


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 5)) for r in df.collect())


def made(spark, n=3000, scopes=3):
    rng = random.Random(n)
    vocabulary = [f"word{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    own = [(f"s{i % scopes}", f"c{i:05}", " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 30))) or None) for i in range(n)]
    asked = [(q, f"s{q % (scopes + 1)}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 6)) + ["word0", "word0", "unknown"])) for q in range(40)]
    return spark.createDataFrame(own, "scope string, chunk_id string, text string"), spark.createDataFrame(asked, "query_id int, scope string, text string")


@pytest.mark.parametrize("k", [1, 10])
def test_equals_the_scan_and_reads_less(spark, k):
    own, asked = made(spark)
    report = {}
    got = rows(PostingIndex.build(own).search(asked, k, made=report))
    assert got == rows(bm25.search(asked, own, k)) and got
    assert 0 < report["read"] < report["held"]


def test_small_scopes_with_weights_below_zero(spark):
    own = spark.createDataFrame([("a", i, "same words here" + " rare" * (i == 3)) for i in range(5)] + [("b", 9, None), (None, 10, "same")], "scope string, chunk_id int, text string")
    asked = spark.createDataFrame([(1, "a", "same words"), (2, "a", "rare same"), (3, "b", "same"), (4, None, "same"), (5, "a", ""), (6, "a", None)], "query_id int, scope string, text string")
    got = rows(PostingIndex.build(own).search(asked, 3))
    assert got == rows(bm25.search(asked, own.filter("scope is not null"), 3)) and {r[0] for r in got} == {1, 2}


def test_batches_are_appended_merged_and_replaced(spark):
    own, asked = made(spark, 1200, 2)
    want = rows(bm25.search(asked, own, 10))
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(3))
    index = PostingIndex.build(own.filter(part == 0))
    index.append(own.filter(part == 1).limit(5), 1)
    index.append(own.filter(part == 1), 1)
    index.append(own.filter(part == 2), 2)
    assert index.batches() == [0, 1, 2] and rows(index.search(asked, 10)) == want
    index.merge([1, 2], 3)
    assert index.batches() == [0, 3] and rows(PostingIndex(spark, index.folder).search(asked, 10)) == want
    with pytest.raises(ValueError):
        index.merge([1], 4)


def test_maxima_are_read_without_postings(spark, small):
    index = PostingIndex.build(chunks(spark, small))
    plan = index._table("blocks").select("term", "max_tf").filter("term = 'the'")._jdf.queryExecution().toString()
    assert "tfs" not in plan.split("ReadSchema")[1] and "EqualTo(term,the)" in plan


def test_a_segment_has_one_row_a_term_and_no_posting_is_shuffled(spark, monkeypatch):
    own, asked = made(spark, 2000, 2)
    index = PostingIndex.build(own.coalesce(1))
    assert index._table("blocks").count() == index._table("terms").count()  # not one of each of 16 windows
    writes = postings._segments(index._table("tokens"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in writes
    want = rows(bm25.search(asked, own, 7))
    monkeypatch.setattr(postings, "LOT", 700)
    monkeypatch.setattr(postings, "CELLS", 50)
    monkeypatch.setattr(postings, "BLOCK", 9)
    small = PostingIndex.build(own)
    assert small._table("blocks").select("seg").distinct().count() > 20 and rows(small.search(asked, 7)) == want
