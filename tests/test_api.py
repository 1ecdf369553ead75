import pytest
from pyspark.sql import functions as F

from docgrain.api import Caller, Engine, Options


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame(
        [
            (1, "alpha", "The penalty is 10% of the price.\nPayment is due in 30 days.\nThe term is two years.", "contract"),
            (2, "alpha", "The supplier accepts unlimited liability.\nPayment is due in 60 days.", "contract"),
            (3, "beta", "Payment of another tenant is due at once.", "contract"),
            (4, "alpha", "Nobody may read this payment clause.", "contract"),
        ],
        "doc_id int, tenant_id string, text string, section string",
    )
    acl = spark.createDataFrame([(1, "finance", True), (2, "*", True), (3, "finance", True), (4, "hr", True), (4, "finance", False)], "doc_id int, role string, allow_read boolean")
    return Engine.ingest(docs, acl, embed=lambda t: F.array(F.length(t).cast("double"), F.lit(1.0)))


FINANCE = Caller("alpha", "finance")


def test_search_stays_in_scope(spark, engine):
    asked = spark.createDataFrame([(1, "when is the payment due", [1.0, 1.0]), (2, "liability", [0.0, 1.0])], "query_id int, text string, query_vec array<double>")
    for options in (Options(keep_zero=True), Options(), Options(parent_cap=None, expand=True)):
        rows = engine.search(asked, FINANCE, options=options).collect()
        assert {r["doc_id"] for r in rows} <= {1, 2} and {r["query_id"] for r in rows} == {1, 2}
        assert all(r["score"] is not None for r in rows)
    top = engine.search(asked.drop("query_vec"), FINANCE).filter("query_id = 2 and rank = 1").first()
    assert top["doc_id"] == 2


def test_one_denied_document_refuses_the_request(spark, engine):
    asked = spark.createDataFrame([(1,), (4,)], "doc_id int")
    with pytest.raises(PermissionError):
        engine.scope(FINANCE, asked)
    assert engine.accessible(Caller("alpha", "x", admin=True)).count() == 3


def test_questions_keep_to_their_document(spark, engine):
    asked = spark.createDataFrame([(1, "payment due", [1.0, 1.0], 1), (2, "payment due", [1.0, 1.0], 2)], "query_id int, text string, query_vec array<double>, doc_id int")
    for queries in (asked, asked.drop("query_vec")):
        rows = engine.search(queries, FINANCE).collect()
        assert {(r["query_id"], r["doc_id"]) for r in rows} == {(1, 1), (2, 2)}
    with pytest.raises(PermissionError):
        engine.search(asked.withColumn("doc_id", F.lit(4)), FINANCE).count()
    plan = engine.search(asked, FINANCE)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_only_sure_and_scoped_answers_are_cached(spark, engine):
    asked = spark.createDataFrame([(1, "payment is due in 30 days contract", 1), (2, "zzz qqq", 1)], "query_id int, text string, doc_id int")
    rows = {r["query_id"]: r for r in engine.answer(asked, FINANCE, options=Options(least_confidence=0.3)).collect()}
    assert 0 <= rows[2]["confidence"] < rows[1]["confidence"] <= 1
    assert rows[1]["cacheable"] and not rows[2]["cacheable"]
    assert not any(r["cacheable"] for r in engine.answer(asked.drop("doc_id"), FINANCE, options=Options(least_confidence=0.0)).collect())


def test_answers_cite_what_was_found(spark, engine):
    q = spark.createDataFrame([(1, "payment due"), (2, "zzz")], "query_id int, text string")
    rows = {r["query_id"]: r for r in engine.answer(q, FINANCE, options=Options(keep_zero=False)).collect()}
    assert rows[1]["citations"] and "Payment" in rows[1]["answer"]
    assert rows[2]["answer"] == "INSUFFICIENT_EVIDENCE" and rows[2]["citations"] == []


def test_compare_and_review(spark, engine):
    facets = spark.createDataFrame([(1, "payment"), (2, "liability"), (3, "penalty"), (4, "zzz")], "facet_id int, text string")
    got = {r["facet_id"]: r["status"] for r in engine.compare(facets, 1, 2, FINANCE).collect()}
    assert got == {1: "both", 2: "only_b", 3: "only_a", 4: "missing"}
    _, overall = engine.risk_review(FINANCE)
    assert {r["doc_id"]: r["severity"] for r in overall.collect()} == {1: "critical", 2: "critical"}


def test_only_documents_without_chunks_are_refused(spark):
    docs = spark.createDataFrame([(1, "t", " \n ", "s"), (2, "t", "Payment is due.", "s")], "doc_id int, tenant_id string, text string, section string")
    engine = Engine.ingest(docs, spark.createDataFrame([], "doc_id int, role string, allow_read boolean"))
    assert [r.doc_id for r in engine.rejected.collect()] == [1] and [r.doc_id for r in engine.documents.collect()] == [2]
