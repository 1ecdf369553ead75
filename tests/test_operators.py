import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrain.functions import text as tx
from docgrain.plans.common import holding
from docgrain.operators import access, answering, bm25, chunking, dense, evaluation, fusion, risk


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_tokens_keep_accents_and_drop_single_letters(spark):
    assert one(spark, tx.tokens(F.col("t")), t="Mức phạt 12%: A b-c, ĐÔ_la!") == ["mức", "phạt", "12", "đô_la"]
    assert one(spark, tx.tokens(F.lit(""))) == []


def test_sentences_and_estimate(spark):
    assert one(spark, tx.sentences(F.lit("One. Two; three: Four. (five) x. y"))) == ["One.", "Two; three:", "Four.", "(five) x. y"]
    assert one(spark, tx.token_estimate(F.lit("a b c"))) == 3
    assert one(spark, tx.token_estimate(F.lit(""))) == 1


def test_strict_normal_applies_nfkc(spark):
    assert one(spark, tx.strict_normal(F.lit("  ﬁne  ＡＢ \n x "))) == "fine ab x"


def test_json_body(spark):
    assert one(spark, tx.json_body(F.lit('say ```json\n{"a": 1}\n``` ok'))) == '{"a": 1}'
    assert one(spark, tx.json_body(F.lit('well {"a": {"b": 2}} then'))) == '{"a": {"b": 2}}'


def bm25_loop(query, docs, k1=1.5, b=0.75, eps=0.25):
    cut = {i: [w for w in d.lower().split() if len(w) > 1] for i, d in docs.items()}
    df = Counter(w for d in cut.values() for w in set(d))
    n, avg = len(docs), sum(map(len, cut.values())) / len(docs)
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else eps * mean for w, v in raw.items()}
    out = {}
    for i, d in cut.items():
        tf = Counter(d)
        s = sum(idf[w] * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(d) / avg)) for w in query.lower().split() if w in tf)
        if any(w in tf for w in query.lower().split()):
            out[i] = s
    return out


def test_bm25_equals_loop(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    docs = {f"c{i}": " ".join(rng.choices(words, k=rng.randint(1, 20))) for i in range(40)}
    query = " ".join(rng.choices(words, k=6))
    chunks = spark.createDataFrame([(0, i, t) for i, t in docs.items()], "scope int, chunk_id string, text string")
    asked = spark.createDataFrame([(1, 0, query)], "query_id int, scope int, text string")
    got = {r["chunk_id"]: r["score"] for r in bm25.search(asked, chunks, 40).collect()}
    # a negative idf can make a score that isn't positive, which falls back to its shared terms
    shared = {i: len(set(query.split()) & set(t.split())) for i, t in docs.items()}
    want = {i: x if round(x, 6) > 0 else 0.1 * shared[i] for i, x in bm25_loop(query, docs).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_vocabulary_equals_term_stats_of_postings(spark):
    chunks = spark.createDataFrame([(i % 2, f"c{i}", "aa bb bb " + "cc " * (i % 3)) for i in range(9)], "scope int, chunk_id string, text string")
    key = lambda df: sorted(map(tuple, df.withColumn("idf", F.round("idf", 9)).collect()))
    assert key(bm25.vocabulary(chunks)) == key(bm25.term_stats(bm25.postings(chunks), bm25.corpus_stats(chunks)))


def test_bm25_keeps_zero_scores_on_request_and_falls_back(spark):
    chunks = spark.createDataFrame([(0, f"c{i}", t) for i, t in enumerate(["alpha beta", "alpha beta", "alpha beta", "gamma"])], "scope int, chunk_id string, text string")
    asked = spark.createDataFrame([(1, 0, "alpha beta")], "query_id int, scope int, text string")
    assert bm25.search(asked, chunks, keep_zero=True).count() == 4
    top = bm25.search(asked, chunks).collect()
    assert len(top) == 3 and all(r["score"] > 0 for r in top)


def ranked(spark, ids, name="a"):
    return spark.createDataFrame([(1, c, i) for i, c in enumerate(ids, 1)], "query_id int, chunk_id string, rank int")


def test_rrf_worked_values(spark):
    rows = fusion.reciprocal_rank(ranked(spark, ["c1", "c2", "c3"]), ranked(spark, ["c2", "c4"])).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows][0] == "c2"
    assert abs(rows[0]["rrf"] - (1 / 62 + 1 / 61)) < 1e-9


def test_interleaved_equals_loop(spark):
    rng = random.Random(1)
    for _ in range(4):
        a, b = rng.sample("abcdefgh", 5), rng.sample("abcdefgh", 4)
        want = []
        for i in range(5):
            for x in (a[i : i + 1] + b[i : i + 1]):
                if x not in want:
                    want.append(x)
        got = [r["chunk_id"] for r in fusion.interleaved(ranked(spark, a), ranked(spark, b), 6).orderBy("rank").collect()]
        assert got == want[:6]


def test_cap_and_expand(spark):
    df = spark.createDataFrame([(1, f"c{i}", p, i, f"t{i}", t) for i, (p, t) in enumerate([("p", "P"), ("p", "P"), (None, None), ("p", "P"), (None, None), ("q", "")], 1)], "query_id int, chunk_id string, parent_id string, rank int, text string, parent_text string")
    assert [(r["chunk_id"], r["rank"]) for r in fusion.cap_parents(df, 2).orderBy("rank").collect()] == [("c1", 1), ("c2", 2), ("c3", 3), ("c5", 4), ("c6", 5)]
    assert [(r["chunk_id"], r["text"]) for r in fusion.expand_parents(df).orderBy("rank").collect()] == [("c1", "P"), ("c3", "t3"), ("c5", "t5"), ("c6", "t6")]


def test_index_grows_by_batches(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    rows = [(i % 2, f"c{i}", " ".join(rng.choices(words, k=rng.randint(0, 15)))) for i in range(60)]
    asked = spark.createDataFrame([(q, q % 2, " ".join(rng.choices(words, k=4))) for q in range(9)], "query_id int, scope int, text string")
    df = lambda part: spark.createDataFrame(part, "scope int, chunk_id string, text string")
    index = bm25.Index.build(df(rows[:25]), str(tmp_path / "index"))
    index.append(df(rows[25:40]), 1)
    index.append(df(rows[40:]), 2)
    index.append(df(rows[40:]), 2)  # written again after a failure: replaced, not added
    key = lambda x: sorted(map(tuple, x.collect()))
    for keep_zero in (False, True):
        whole = key(bm25.search(asked, df(rows), 7, keep_zero))
        assert key(index.search(asked, 7, keep_zero)) == whole == key(index.search(asked, 7, keep_zero, block=2))
    terms = lambda x: sorted((*map(tuple, x.withColumn("idf", F.round("idf", 9)).collect()),))
    assert terms(index.terms()) == terms(bm25.vocabulary(df(rows)))


def cosine_loop(asked, rows, k, others_only=False):
    def cosine(a, b):
        n = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
        return round(sum(x * y for x, y in zip(a, b)) / (n(a) * n(b)), 6)

    out = []
    for q, v in asked:
        best = sorted((-cosine(v, w), c) for c, w in rows if not (others_only and c == q))[:k]
        out += [(q, i, c) for i, (_, c) in enumerate(best, 1)]
    return sorted(out)


def test_dense_search_equals_loop_for_any_number_of_queries(spark):
    rng = random.Random(6)
    rows = [(f"v{i}", [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(2001)]  # many ties, zero vectors
    vectors = spark.createDataFrame(rows[:60], "chunk_id string, vec array<float>")
    asked = spark.createDataFrame(rows, "query_id string, query_vec array<float>")
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "chunk_id").collect()))
    for others_only in (False, True):
        assert key(dense.search(asked, vectors, 3, block=700, others_only=others_only)) == cosine_loop(rows, rows[:60], 3, others_only)
    assert dense.search(asked.limit(0), vectors).count() == 0 and dense.search(asked, vectors.limit(0)).count() == 0


def test_dense_search_keeps_to_scopes(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.9, 0.1], 2), ("c", [0.0, 1.0], 2)], "chunk_id string, vec array<double>, scope int")
    asked = spark.createDataFrame([(1, [1.0, 0.0], 2)], "query_id int, query_vec array<double>, scope int")
    assert [r["chunk_id"] for r in dense.search(asked, vectors).orderBy("rank").collect()] == ["b", "c"]


def test_holding_finds_passages_of_any_length(spark):
    texts = ["one two three four five six seven eight nine ten", "xone two three four five six sevenx", "a  b\nc", "", None, "ab", "prefix tail here and on"]
    passages = ["two three four five six seven eight nine", "one two three four five six seven", "ne two three", "wo thr", "ten", "e", "b\nc", "", "tail he", "not there at all", "x", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "query_id long, text string")
    want = sorted((q, d) for q, p in enumerate(passages) for d, t in enumerate(texts) if p is not None and t is not None and p in t)
    assert sorted(map(tuple, holding(asked, docs).collect())) == want
    assert holding(asked.limit(0), docs).count() == 0


def test_percentiles_equal_numpy(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.random(), 0.5, 1.0])) for g in "abc" for _ in range({"a": 1, "b": 50, "c": 333}[g])] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = (0.0, 0.5, 0.95, 1.0)
    for linear in (True, False):
        for r in evaluation.percentiles(df, "g", "x", shares, linear).collect():
            own = sorted(x for g, x in rows if g == r["g"] and x is not None)
            assert r["n"] == len(own)
            for i, p in enumerate(shares):
                want = np.quantile(own, p) if linear else own[min(int(len(own) * p), len(own) - 1)]
                assert abs(r[f"p{i}"] - want) < 1e-12


def test_metrics_worked_values(spark):
    r = ranked(spark, ["c1", "c2", "c3", "c4", "c5"])
    gold = spark.createDataFrame([(1, "c3"), (1, "c7")], "query_id int, chunk_id string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    rows = {(x["query_id"], x["k"]): x for x in evaluation.per_query(r, gold, asked, (1, 5)).collect()}
    assert rows[1, 5]["recall"] == 0.5 and rows[1, 5]["hit"] == 1.0 and abs(rows[1, 5]["rr"] - 1 / 3) < 1e-12
    assert rows[1, 1]["hit"] == 0.0
    assert (rows[2, 5]["hit"], rows[2, 5]["recall"], rows[2, 5]["ndcg"], rows[2, 5]["rr"]) == (1.0, 1.0, 1.0, 0.0)


def stack(lines):
    path, out = [], []
    for no, (level, title) in enumerate(lines):
        if level:
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, title))
        out.append((no, [t for _, t in path]))
    return out


def test_heading_windows_equal_a_stack(spark):
    rng = random.Random(7)
    for k in range(3):
        lines = [(rng.choice([0, 1, 2, 3, 4, 5, 6]), f"t{i}") for i in range(60)]
        df = spark.createDataFrame([("d", i, ("#" * lv + " " + t) if lv else t) for i, (lv, t) in enumerate(lines)], "doc string, pos int, line string")
        got = [(r["pos"], r["section_path"]) for r in chunking.markdown_sections(df).orderBy("pos").collect()]
        assert got == stack(lines)


def pack(tokens, target, overlap):
    out, cur, total = [], [], 0
    for i, t in enumerate(tokens):
        if cur and total + t > target:
            out.append((cur[0], cur[-1]))
            keep, s = [], 0
            for j in reversed(cur):
                if s + tokens[j] > overlap:
                    break
                keep.insert(0, j)
                s += tokens[j]
            cur, total = keep, s
        cur.append(i)
        total += t
    return out + [(cur[0], cur[-1])] if cur else out


def test_child_ranges_equal_the_loop(spark):
    rng = random.Random(9)
    docs = {i: [rng.choice([1, 2, 3, 5, 8, 40]) for _ in range(rng.randint(1, 40))] for i in range(60)}
    df = spark.createDataFrame([(i, j, t) for i, ts in docs.items() for j, t in enumerate(ts)], "parent_id int, pos int, tokens int")
    got = {}
    for r in chunking.child_ranges(df, 12, 5).orderBy("parent_id", "child_no").collect():
        got.setdefault(r["parent_id"], []).append((r["first"], r["last"]))
    assert got == {i: pack(ts, 12, 5) for i, ts in docs.items()}


def test_parent_groups_equal_the_loop(spark):
    rng = random.Random(11)
    docs = {i: [(rng.randint(1, 9), rng.choice(["", "a", "b"])) for _ in range(rng.randint(1, 30))] for i in range(40)}
    df = spark.createDataFrame([(i, j, t, s) for i, b in docs.items() for j, (t, s) in enumerate(b)], "doc_id int, pos int, tokens int, top string")
    got = {(r["doc_id"], r["pos"]): r["parent_no"] for r in chunking.parent_groups(df, 15).collect()}
    for i, blocks in docs.items():
        no, total, top, filled = 0, 0, None, False
        for j, (t, s) in enumerate(blocks):
            if filled and (total + t > 15 or (top and s and top != s)):
                no, total = no + 1, 0
            total, top, filled = total + t, s, True
            assert got[i, j] == no


@pytest.mark.parametrize(
    ("text", "hit"),
    [("Penalty of 10%", True), ("Penalty of 8%", False), ("Penalty must not exceed 8%, else 20%", False), ("Mức phạt 20%", True), ("A fee of 20%", False), ("90 days notice", True), ("30 days notice", False), ("Notice of 60 days", False)],
)
def test_risk_boundaries(spark, text, hit):
    clauses = spark.createDataFrame([(1, text)], "clause_id int, text string")
    assert (risk.scan(clauses, risk.rules_table(spark), only=["EXCESSIVE_PENALTY", "LONG_NOTICE"]).count() > 0) == hit


def test_access_is_closed(spark):
    docs = spark.createDataFrame([(1, "t"), (2, None), (3, "")], "doc_id int, tenant string")
    assert [r["doc_id"] for r in docs.filter(access.in_tenant(F.col("tenant"), F.lit("t"))).collect()] == [1]
    assert docs.filter(access.in_scope(F.col("doc_id"), F.array().cast("array<int>"))).count() == 0
    assert docs.filter(access.in_scope(F.col("doc_id"), F.lit(None).cast("array<int>"))).count() == 3
    with pytest.raises(PermissionError):
        access.resolve_scope(spark.createDataFrame([(1,), (9,)], "doc_id int"), docs)
    assert one(spark, access.under(F.lit("/data/x/../../etc"), "/data")) is False


def test_confidence_stays_between_0_and_1(spark):
    top = one(spark, answering.confidence(F.lit(1.0), F.lit(0.0328), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    low = one(spark, answering.confidence(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0)))
    assert abs(top - 1) < 1e-9 and low == 0


def test_scope_key_ignores_order(spark):
    key = lambda *d: one(spark, answering.scope_key(F.lit("t"), F.lit("u"), F.array(*map(F.lit, d))))
    assert key("b", "a", "a") == key("a", "b") != key("a", "c")


def test_routes(spark):
    task = lambda q, n: one(spark, answering.route(F.lit(q), F.lit(n))["task"])
    assert task("hello there", 1) == "conversational"
    assert task("Which one", 1) == "conversational"  # "hi" is looked for as a substring
    assert task("please compare the two contracts and their payment terms", 2) == "comparison"
    assert task("please compare the two contracts and their payment terms", 1) == "single_document_qa"


def test_error_rates(spark):
    assert one(spark, evaluation.error_rate_chars(F.lit("Điều"), F.lit("Dieu"))) == 0.5
    assert one(spark, evaluation.error_rate_words(F.lit("a b c d"), F.lit("a x d"))) == 0.5
    assert one(spark, evaluation.error_rate_words(F.lit(""), F.lit("x"))) == 1.0
    long = " ".join(f"w{i}" for i in range(100))
    assert one(spark, evaluation.error_rate_words(F.lit(long), F.lit(long + " y"))) == 0.01
