"""Gates, caches, stage events, page rules, paragraphs and readings of answers, on small inputs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from docgrain.functions import scores, text
from docgrain.operators import access, answering, chunking, evaluation, risk
from docgrain.plans.evaluate import ANS
from docgrain.sources import files, sinks
from docgrain.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_users_roles_and_owners(spark):
    users = spark.createDataFrame([("ann", True), ("bob", False)], "username string, is_active boolean")
    assert access.active_user(users, "ann").count() == 1 and access.active_user(users, "bob").count() == 0
    allowed = lambda r: one(spark, access.role_allowed(F.lit(r).cast("string"), "legal", "hr"))
    assert [allowed(r) for r in ("admin", "legal", "finance", None)] == [True, True, False, False]
    talks = spark.createDataFrame([(1, "ann", "t"), (1, "ann", "other")], "conv_id int, username string, tenant_id string")
    assert access.owned(talks, 1, "ann", "t").count() == 1 and access.owned(talks, 1, "bob", "t").count() == 0


def test_scores_without_a_reranker(spark):
    assert [round(one(spark, scores.fallback_score(F.lit(i))), 6) for i in (0, 3, 20)] == [1.0, 0.7, 0.1]
    assert one(spark, scores.sigmoid(F.lit(0.0))) == 0.5
    assert one(spark, answering.may_cache(F.lit(True), F.lit(True), F.lit(0.7))) and not one(spark, answering.may_cache(F.lit(False), F.lit(True), F.lit(0.9)))


def test_caches_are_read_whole_or_not_at_all(spark, tmp_path):
    df = spark.range(3)
    sinks.write_cache({"a": df, "b": df}, str(tmp_path))
    assert sinks.complete(spark, str(tmp_path), "a", "b") and not sinks.complete(spark, str(tmp_path), "a", "c")
    assert sinks.read_cache(spark, str(tmp_path), "a", "c") is None
    assert sinks.read_cache(spark, str(tmp_path), "a", "b")["b"].count() == 3
    sinks.write_cache({"a": spark.range(9)}, str(tmp_path))  # whole already
    assert sinks.read_cache(spark, str(tmp_path), "a")["a"].count() == 3
    (tmp_path / "b" / "_SUCCESS").unlink()
    assert sinks.read_cache(spark, str(tmp_path), "a", "b") is None


def test_stage_events(spark):
    log = [(1, i, "stage", s) for i, s in enumerate(jobs.STAGES)] + [(1, 9, "final", None), (1, 10, "stage", "route")]
    log += [(2, 0, "stage", "rerank"), (2, 1, "stage", "route"), (3, 0, "error", None)]
    rows = {r["run_id"]: tuple(r)[1:] for r in jobs.stage_events(spark.createDataFrame(log, "run_id int, seq int, event string, stage string")).collect()}
    assert rows == {1: (5, "verify", True, True), 2: (2, "route", False, False), 3: (0, None, True, True)}


def test_pages_carry_their_section_and_scans_need_text():
    pages = [(1, [(0, 0, 1.234, 2, "Article 1 Scope"), (0, 0, 1, 1, "body\nof\nit"), (0, 0, 1, 1, "  ")]), (2, [(0, 0, 1, 1, "goes on"), (0, 0, 1, 1, "Section 2\nof\nthree lines")])]
    got = [(k, t, n, s, b[2]) for k, t, n, s, _, b in files.page_blocks(iter(pages))]
    assert [g[:4] for g in got] == [("heading", "Article 1 Scope", 1, ["Article 1 Scope"]), ("paragraph", "body\nof\nit", 1, ["Article 1 Scope"]), ("paragraph", "goes on", 2, ["Article 1 Scope"]), ("paragraph", "Section 2\nof\nthree lines", 2, ["Article 1 Scope"])]
    assert got[0][4] == 1.23
    block = lambda t: [(0, 0, 1, 1, t)]
    read = lambda n: f"read {n}"
    long = "word " * 40
    assert files.scanned([(1, 9.0, 1, block(long)), (2, 9.0, 0, [])], read) == [(1, block(long)), (2, [])]  # enough of its own
    assert [own[0][4] for _, own in files.scanned([(1, 9.0, 1, block("few")), (2, 9.0, 0, [])], read)] == ["read 1", "read 2"]
    with pytest.raises(ValueError, match="without text"):
        files.scanned([(1, 9.0, 1, [])], None)


def test_paragraphs_end_at_blank_lines_headings_and_fences(spark):
    lines = ["a", "b", "", "", "c", "# T", "d", "```", "", "x", "```", "```", "y", "```", "e"]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "doc string, pos int, line string")
    got = [tuple(r) for r in chunking.markdown_paragraphs(rows).orderBy("pos").select("pos", "kind", "text", "section_path").collect()]
    assert got == [(0, "paragraph", "a\nb", []), (4, "paragraph", "c", []), (5, "heading", "T", ["T"]), (6, "paragraph", "d", ["T"]), (7, "code", "```\n\nx\n```", ["T"]), (11, "code", "```\ny\n```", ["T"]), (14, "paragraph", "e", ["T"])]


def test_lenient_readings(spark):
    ids = F.array(F.lit("c1"), F.lit("c2"))
    read = lambda t, f=False: one(spark, answering.lenient_citations(F.lit(t), ids, f))
    assert one(spark, answering.lenient_decision(F.lit("  "))) == "INSUFFICIENT_EVIDENCE" == one(spark, answering.lenient_decision(F.lit("There is No Mention of it.")))
    assert read("see c2 and [Reference 1], [Source Block 7]") == ["c1", "c2"]
    assert read("nothing named") == [] and read("nothing named", True) == ["c1"] and read("no mention of it", True) == []


def test_f1_copies_and_facets(spark):
    f = lambda fn, a, b: round(one(spark, fn(F.lit(a), F.lit(b))), 6)
    assert f(evaluation.counted_f1, "the a a b", "a b b") == round(2 * 0.5 * (2 / 3) / (0.5 + 2 / 3), 6)
    assert f(evaluation.counted_f1, "", "") == 0 and f(evaluation.set_f1, "a a", "a") == round(2 * 0.5 * 1 / 1.5, 6)
    assert one(spark, evaluation.facet_coverage(F.lit("Payment is due"), F.array(F.lit("payment terms"), F.lit("of it")))) == 0.5


def test_articles_between_accented_letters_are_cut_as_in_the_sql(spark):
    said = "The çanç laèanêier, thean a_b the-a été"
    want = duckdb.execute(f"SELECT {ANS.format(x='$1')}", [said]).fetchone()[0].split(" ")
    assert one(spark, text.answer_tokens(F.lit(said))) == want == ["ç", "ç", "laè", "êier", "thean", "ab", "thea", "été"]


def test_first_hits_stop_at_the_limit(spark):
    hits = spark.createDataFrame([("d", i, f"r{i}") for i in range(20)] + [("e", 0, "r")], "doc string, no int, rule string")
    rows = risk.first_hits(hits, "doc", 8, "no").collect()
    assert sorted((r["doc"], r["no"]) for r in rows) == [("d", i) for i in range(8)] + [("e", 0)]
