"""Queries: gold mapping, retrieval metrics, answers and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Fixture
from ..functions.scores import overlap
from ..functions.text import strict_normal, tokens
from ..operators import answering, bm25, evaluation, fusion, matching
from ..operators.chunking import line_chunks
from ..session import saved, table
from .common import CHUNK_SQL, FUSED_SQL, GOLD_SQL, SCORE_SQL, Lists, doc_chunks, fused_sql, gold, questions, tok_sql
from .retrieval import CAP_SQL, RERANK_SQL, UNION_SQL

KS = (1, 5, 10, 20)


def _matches(spark: SparkSession, d: str, gold_pairs: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, chunk_id, how: lines of gold documents that hold the passage, or its first or last 30 characters."""
    pairs = (gold(spark, d) if gold_pairs is None else gold_pairs).withColumnRenamed("chunk_id", "doc_id")
    passages = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("g"))
    lines = line_chunks(table(spark, d, "documents")).select("doc_id", "chunk_id", F.col("text").alias("c"))
    # only lines of gold documents are brought to one form
    rows = pairs.join(passages, "query_id").join(lines, "doc_id").withColumns({x: strict_normal(F.col(x)) for x in ("g", "c")})
    exact = F.contains("c", "g")
    edge = F.contains(F.col("c"), F.substring("g", 1, 30)) | F.contains(F.col("c"), F.right("g", F.lit(30)))
    inside = (F.length("c") >= 30) & F.contains("g", "c")
    how = F.when(exact, "exact").when((F.length("g") >= 30) & (edge | inside), "span")
    return rows.select("query_id", "doc_id", "chunk_id", how.alias("how")).filter("how is not null")


def gold_mapping_strict(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


NORM = r"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"
MATCH_SQL = rf"""{CHUNK_SQL}, {GOLD_SQL},
mt AS (SELECT query_id, doc_id, chunk_id, CASE WHEN contains(c, g) THEN 'exact' WHEN length(g) >= 30 AND (contains(c, substr(g, 1, 30)) OR contains(c, right(g, 30)) OR (length(c) >= 30 AND contains(g, c))) THEN 'span' END AS how
  FROM (SELECT p.query_id, k.doc_id, k.chunk_id, {NORM.format(x="k.text")} AS c, {NORM.format(x="b.text")} AS g FROM gold p JOIN benchmark b ON b.item_id = p.query_id JOIN chunk k ON k.doc_id = p.chunk_id))"""
GOLD_MAPPING_STRICT = f"WITH {MATCH_SQL} SELECT query_id, doc_id, chunk_id, how FROM mt WHERE how IS NOT NULL"

CLASSES = ("exact", "span", "boundary", "empty")


def gold_mapping_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How many benchmark texts are found as a whole line, as part of lines, only across lines, or nowhere."""
    pairs = Lists(spark, d).gold
    best = _matches(spark, d, pairs).groupBy("query_id").agg(F.min("how").alias("how"))
    some = pairs.select("query_id").distinct().withColumn("some", F.lit(True))
    each = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(best, "query_id", "left").join(some, "query_id", "left")
    label = F.coalesce("how", F.when(F.col("some"), "boundary").otherwise("empty"))
    counts = each.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(c,) for c in CLASSES], "label string")
    return every.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


GOLD_MAPPING_HISTOGRAM = f"""WITH {MATCH_SQL}, best AS (SELECT query_id, min(how) AS how FROM mt WHERE how IS NOT NULL GROUP BY ALL),
lab AS (SELECT coalesce(how, CASE WHEN EXISTS (SELECT 1 FROM gold g WHERE g.query_id = item_id) THEN 'boundary' ELSE 'empty' END) AS label FROM benchmark LEFT JOIN best ON query_id = item_id)
SELECT c.label, count(lab.label) AS n FROM (SELECT unnest(['exact', 'span', 'boundary', 'empty']) AS label) c LEFT JOIN lab USING (label) GROUP BY ALL"""


#: What a bad reading of a page makes of common letter pairs, in every second document.
MISREAD = (("th", "tb"), ("rn", "m"), ("ll", "11"))


def _misread(spark: SparkSession, d: str) -> DataFrame:
    """All documents, every second one damaged."""
    bad = F.col("text")
    for good, wrong in MISREAD:
        bad = F.replace(bad, F.lit(good), F.lit(wrong))
    return table(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 2 == 1, bad).otherwise(F.col("text")))


def approximate_gold(spark: SparkSession, d: str) -> DataFrame:
    """Where documents hold benchmark texts with a tenth of the characters wrong at most, every second document being damaged."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return matching.closest(_misread(spark, d), asked, 0.1)


def gold_mapping_damaged(spark: SparkSession, d: str) -> DataFrame:
    """How many benchmark texts are found as they stand, only as a parser has damaged them, or nowhere."""
    found = approximate_gold(spark, d).groupBy("query_id").agg(F.min("distance").alias("distance"))
    each = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(found, "query_id", "left")
    label = F.when(F.col("distance") == 0, "exact").when(F.col("distance") > 0, "parser").otherwise("empty")
    counts = each.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(c,) for c in ("exact", "parser", "empty")], "label string")
    return every.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def metric_sql(ranked: str, ks: tuple[int, ...] = KS, by: str = "") -> str:
    """SQL of per_query() over a ranked CTE (by, query_id, chunk_id, rank) and gold; gives by, query_id, k and the metrics."""
    b = f"{by}, " if by else ""
    base = f"(SELECT DISTINCT {by} FROM {ranked}), " if by else ""
    return f"""(SELECT {b}query_id, k, CASE WHEN ng IS NULL THEN 1.0::DOUBLE ELSE (found > 0)::INT::DOUBLE END AS hit, CASE WHEN ng IS NULL THEN 1.0::DOUBLE ELSE found / ng::DOUBLE END AS recall,
  CASE WHEN ng IS NULL THEN 1.0::DOUBLE ELSE coalesce(dcg, 0) / list_sum(list_transform(range(1, least(k, ng) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg, coalesce(1 / first::DOUBLE, 0) AS rr
  FROM (SELECT {b}q.query_id, k, ng, count(rank) FILTER (WHERE rank <= k) AS found, sum(1 / log2(rank + 1)) FILTER (WHERE rank <= k) AS dcg, min(rank) AS first
    FROM {base}(SELECT item_id AS query_id FROM benchmark) q CROSS JOIN (SELECT unnest({list(ks)}) AS k) LEFT JOIN (SELECT query_id, count(*) AS ng FROM gold GROUP BY ALL) n ON n.query_id = q.query_id
    LEFT JOIN (SELECT r.query_id AS rq, rank{", " + by + " AS rb" if by else ""} FROM {ranked} r JOIN gold USING (query_id, chunk_id)) h ON rq = q.query_id{" AND rb = " + by if by else ""} GROUP BY ALL))"""


SUMMARY = "k, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr, count(*) AS n_queries"


def retrieval_metrics_at_k(spark: SparkSession, d: str) -> DataFrame:
    lists = Lists(spark, d)
    return evaluation.summary(evaluation.per_query(lists.sparse, lists.gold, lists.questions, KS))


RETRIEVAL_METRICS_AT_K = f"WITH {FUSED_SQL}, {GOLD_SQL} SELECT {SUMMARY} FROM {metric_sql('sp')} GROUP BY k"


def retrieval_metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    lists = Lists(spark, d)
    per = evaluation.per_query(lists.fused, lists.gold, lists.questions, KS)
    return per.select("query_id", "k", "hit", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"), F.round("rr", 6).alias("rr"))


RETRIEVAL_METRICS_PER_QUERY = f"WITH {FUSED_SQL}, {GOLD_SQL} SELECT query_id, k, hit, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(rr, 6) AS rr FROM {metric_sql('fu')}"

#: Rerank budgets, pools, and the lists that feed them.
BUDGETS, POOLS, POOL_K = (5, 10, 15, 20, 30, 50, 75), (5, 10, 20, 50, 100), 100


def _budgets(lists: Lists) -> DataFrame:
    """budget and the reranked list within it, for every budget."""
    cuts = lists.spark.createDataFrame([(b,) for b in BUDGETS], "budget int")
    cut = lists.scored.join(F.broadcast(cuts), F.col("rank") <= F.col("budget"))
    ranked = fusion.rerank(cut.withColumnRenamed("query_id", "qid").withColumn("query_id", F.concat_ws(":", "budget", "qid")), F.col("overlap"), 10)
    return ranked.select("budget", F.col("qid").alias("query_id"), "chunk_id", "rank")


def _by(lists: Lists, ranked: DataFrame, by: str, ks: tuple[int, ...]) -> DataFrame:
    """summary() for each value of a column of ranked."""
    ranked = saved(ranked, f"by-{by}")
    values = ranked.select(by).distinct()
    key = lambda df: df.withColumn("query_id", F.concat_ws(":", by, F.col("query_id")))
    g, q = lists.gold.join(F.broadcast(values)), lists.questions.select("query_id").join(F.broadcast(values))
    per = evaluation.per_query(key(ranked), key(g), key(q), ks)
    return evaluation.summary(per.withColumn(by, F.split("query_id", ":")[0]), by)


def candidate_budget_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Metrics at 5 for each rerank budget, what they gain over a budget of 20, and whether less work does as well."""
    lists = Lists(spark, d, POOL_K)
    s = saved(_by(lists, _budgets(lists), "budget", (5,)).withColumn("budget", F.col("budget").cast("int")), "budgets")
    base = s.filter("budget = 20").select(F.col("hit").alias("hit0"), F.col("mrr").alias("mrr0"))
    label = F.when(F.col("budget") == 20, "baseline").when((F.col("hit") >= F.col("hit0")) & (F.col("mrr") >= F.col("mrr0")), "dominates").when((F.col("hit") < F.col("hit0")) & (F.col("mrr") < F.col("mrr0")), "dominated").otherwise("trade_off")
    return s.join(F.broadcast(base)).select("budget", "hit", "recall", "mrr", F.round(F.col("hit") - F.col("hit0"), 6).alias("hit_delta"), F.round(F.col("mrr") - F.col("mrr0"), 6).alias("mrr_delta"), label.alias("label"))


WIDE_RERANK = RERANK_SQL.replace("WHERE pc.rank <= 20", f"WHERE pc.rank <= {POOL_K}")
BUDGET_SQL = f"""bs0 AS (SELECT budget, query_id, chunk_id, row_number() OVER (PARTITION BY budget, query_id ORDER BY score DESC, old)::INT AS rank FROM rr0 JOIN (SELECT unnest({list(BUDGETS)}) AS budget) ON old <= budget),
bs AS (SELECT * FROM bs0 WHERE rank <= 10)"""
CANDIDATE_BUDGET_SWEEP = f"""WITH {fused_sql(POOL_K)}, {GOLD_SQL}, {CAP_SQL}, {WIDE_RERANK}, {BUDGET_SQL}, s AS (SELECT budget, {SUMMARY} FROM {metric_sql('bs', (5,), 'budget')} GROUP BY budget, k),
t AS (SELECT hit AS hit0, mrr AS mrr0 FROM s WHERE budget = 20)
SELECT budget, hit, recall, mrr, round(hit - hit0, 6) AS hit_delta, round(mrr - mrr0, 6) AS mrr_delta, CASE WHEN budget = 20 THEN 'baseline' WHEN hit >= hit0 AND mrr >= mrr0 THEN 'dominates' WHEN hit < hit0 AND mrr < mrr0 THEN 'dominated' ELSE 'trade_off' END AS label FROM s, t"""


def _variants(lists: Lists, names: tuple[str, ...] = ("bm25", "dense", "rrf", "rrf_cap", "union", "reranked", "expanded")) -> DataFrame:
    """variant, query_id, chunk_id, rank of the lists that the ablation compares."""
    made = {
        "bm25": lambda: lists.sparse,
        "dense": lambda: lists.dense,
        "rrf": lambda: lists.fused,
        "rrf_cap": lambda: lists.capped,
        "union": lambda: fusion.interleaved(lists.dense, lists.sparse, 40),
        "reranked": lambda: lists.hybrid(),
        # the first chunk of each parent only
        "expanded": lambda: fusion.expand_parents(lists.parented.withColumn("text", F.lit("")).withColumn("parent_text", F.lit(""))),
    }
    out = None
    for name in names:
        own = made[name]().select(F.lit(name).alias("variant"), "query_id", "chunk_id", "rank")
        out = own if out is None else out.unionByName(own)
    return out


VARIANT_SQL = f"""{FUSED_SQL}, {GOLD_SQL}, {CAP_SQL}, {RERANK_SQL}, {UNION_SQL},
va AS (SELECT 'bm25' AS variant, query_id, chunk_id, rank FROM sp UNION ALL SELECT 'dense', query_id, chunk_id, rank FROM dn UNION ALL SELECT 'rrf', query_id, chunk_id, rank FROM fu
  UNION ALL SELECT 'rrf_cap', query_id, chunk_id, rank FROM pc UNION ALL SELECT 'union', query_id, chunk_id, rank FROM iu UNION ALL SELECT 'reranked', query_id, chunk_id, rank FROM rr WHERE rank <= 10
  UNION ALL SELECT 'expanded', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT FROM (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(parent_id::VARCHAR, '#' || chunk_id) ORDER BY rank) AS first FROM pc0) WHERE first = 1)"""


def variant_ablation(spark: SparkSession, d: str) -> DataFrame:
    lists = Lists(spark, d)
    return _by(lists, _variants(lists), "variant", (5, 10))


VARIANT_ABLATION = f"WITH {VARIANT_SQL} SELECT variant, {SUMMARY} FROM {metric_sql('va', (5, 10), 'variant')} GROUP BY variant, k"


def union_vs_rrf(spark: SparkSession, d: str) -> DataFrame:
    lists = Lists(spark, d)
    return _by(lists, _variants(lists, ("bm25", "dense", "rrf", "union")), "variant", (20,)).select("variant", "hit", "recall")


UNION_VS_RRF = f"WITH {VARIANT_SQL}, v4 AS (SELECT * FROM va WHERE variant IN ('bm25', 'dense', 'rrf', 'union')) SELECT variant, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall FROM {metric_sql('v4', (20,), 'variant')} GROUP BY variant"


def pool_sweep(spark: SparkSession, d: str) -> DataFrame:
    lists = Lists(spark, d, POOL_K)
    return _by(lists, _variants(lists, ("bm25", "dense", "rrf")), "variant", POOLS).select("variant", "k", "recall", "hit")


POOL_SWEEP = f"""WITH {fused_sql(POOL_K)}, {GOLD_SQL}, v3 AS (SELECT 'bm25' AS variant, query_id, chunk_id, rank FROM sp UNION ALL SELECT 'dense', query_id, chunk_id, rank FROM dn UNION ALL SELECT 'rrf', query_id, chunk_id, rank FROM fu)
SELECT variant, k, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit FROM {metric_sql('v3', POOLS, 'variant')} GROUP BY variant, k"""


def waterfall(spark: SparkSession, d: str) -> DataFrame:
    """Hit and recall that are left after each stage of the pipeline."""
    lists = Lists(spark, d)
    ranked, capped = lists.hybrid(), lists.capped
    stages = {"1_pool": lists.fused, "2_capped": capped, "3_budget": capped.filter("rank <= 20"), "4_rerank10": ranked, "5_rerank5": ranked.filter("rank <= 5")}
    out = None
    for name, df in stages.items():
        own = df.select(F.lit(name).alias("stage"), "query_id", "chunk_id", "rank")
        out = own if out is None else out.unionByName(own)
    return _by(lists, out, "stage", (40,)).select("stage", "hit", "recall")


WATERFALL = f"""WITH {FUSED_SQL}, {GOLD_SQL}, {CAP_SQL}, {RERANK_SQL}, wf AS (SELECT '1_pool' AS stage, query_id, chunk_id, rank FROM fu UNION ALL SELECT '2_capped', query_id, chunk_id, rank FROM pc
  UNION ALL SELECT '3_budget', query_id, chunk_id, rank FROM pc WHERE rank <= 20 UNION ALL SELECT '4_rerank10', query_id, chunk_id, rank FROM rr WHERE rank <= 10 UNION ALL SELECT '5_rerank5', query_id, chunk_id, rank FROM rr WHERE rank <= 5)
SELECT stage, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall FROM {metric_sql('wf', (40,), 'stage')} GROUP BY stage"""


def failure_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Why a question fails: no gold, gold never retrieved, lost by the cap, the budget or the reranker; with shares."""
    lists = Lists(spark, d)
    first = lambda df, name: df.join(lists.gold, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias(name))
    rows = lists.questions.select("query_id").join(lists.gold.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    rows = rows.join(first(lists.fused, "pool"), "query_id", "left").join(first(lists.capped, "cap"), "query_id", "left").join(first(lists.hybrid(), "final"), "query_id", "left")
    label = (
        F.when(F.col("n").isNull(), "NO_GOLD").when(F.col("pool").isNull(), "NOT_RETRIEVED").when(F.col("cap").isNull(), "LOST_BY_CAP")
        .when(F.col("cap") > 20, "LOST_BY_BUDGET").when(F.col("final").isNull(), "LOST_BY_RERANK").when(F.col("final") > 5, "LATE").otherwise("SUCCESS")
    )
    counts = rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("label", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("percent"))


FAILURE_TAXONOMY = f"""WITH {FUSED_SQL}, {GOLD_SQL}, {CAP_SQL}, {RERANK_SQL},
f AS (SELECT item_id AS query_id, (SELECT count(*) FROM gold g WHERE g.query_id = item_id) AS n, (SELECT min(rank) FROM fu JOIN gold USING (query_id, chunk_id) WHERE query_id = item_id) AS pool,
  (SELECT min(rank) FROM pc JOIN gold USING (query_id, chunk_id) WHERE query_id = item_id) AS cap, (SELECT min(rank) FROM rr JOIN gold USING (query_id, chunk_id) WHERE query_id = item_id AND rank <= 10) AS final FROM benchmark),
l AS (SELECT CASE WHEN n = 0 THEN 'NO_GOLD' WHEN pool IS NULL THEN 'NOT_RETRIEVED' WHEN cap IS NULL THEN 'LOST_BY_CAP' WHEN cap > 20 THEN 'LOST_BY_BUDGET' WHEN final IS NULL THEN 'LOST_BY_RERANK' WHEN final > 5 THEN 'LATE' ELSE 'SUCCESS' END AS label FROM f)
SELECT label, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM l)::DOUBLE, 4) AS percent FROM l GROUP BY label"""


def _scoped_sparse(lists: Lists) -> DataFrame:
    """BM25 inside the source of a question's first gold document, with that source's own statistics; questions without gold
    aren't asked."""
    docs = table(lists.spark, lists.d, "documents")
    first = lists.gold.groupBy("query_id").agg(F.min("chunk_id").alias("doc_id")).join(docs.select("doc_id", F.col("source").alias("scope")), "doc_id")
    asked = lists.questions.drop("scope").join(first.select("query_id", "scope"), "query_id")
    return bm25.search(asked, doc_chunks(lists.spark, lists.d, F.col("source")), 20)


def global_vs_scoped(spark: SparkSession, d: str) -> DataFrame:
    lists = Lists(spark, d)
    both = lists.sparse.select(F.lit("global").alias("mode"), "query_id", "chunk_id", "rank").unionByName(_scoped_sparse(lists).select(F.lit("scoped").alias("mode"), "query_id", "chunk_id", "rank"))
    return _by(lists, both, "mode", (10,))


GLOBAL_VS_SCOPED = f"""WITH {FUSED_SQL}, {GOLD_SQL}, scoped AS (SELECT * FROM (WITH chunk AS (SELECT source AS scope, doc_id AS chunk_id, text FROM documents),
  ask AS (SELECT item_id AS query_id, d.source AS scope, b.text FROM benchmark b JOIN (SELECT query_id, min(chunk_id) AS doc_id FROM gold GROUP BY query_id) g ON g.query_id = item_id JOIN documents d USING (doc_id)), {SCORE_SQL},
  pos AS (SELECT query_id, chunk_id, CASE WHEN score <= 0 THEN round(0.1 * hits, 6) ELSE score END AS score FROM sc)
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM pos WHERE score > 0) WHERE rank <= 20),
gs AS (SELECT 'global' AS mode, query_id, chunk_id, rank FROM sp UNION ALL SELECT 'scoped', query_id, chunk_id, rank FROM scoped)
SELECT mode, {SUMMARY} FROM {metric_sql('gs', (10,), 'mode')} GROUP BY mode, k"""


def document_scoped_search(spark: SparkSession, d: str) -> DataFrame:
    """Each question against the lines of each of its gold documents alone, with that document's own statistics."""
    lists = Lists(spark, d)
    asked = lists.gold.join(lists.questions.drop("scope"), "query_id").select(F.concat_ws(":", "query_id", "chunk_id").alias("query_id"), F.col("chunk_id").alias("scope"), "text")
    lines = line_chunks(table(spark, d, "documents")).select(F.col("doc_id").alias("scope"), "chunk_id", "text")
    return bm25.search(asked, lines.join(asked.select("scope").distinct(), "scope", "left_semi"), 5)


DOCUMENT_SCOPED_SEARCH = f"""WITH {GOLD_SQL}, lines AS (SELECT * FROM (WITH {CHUNK_SQL} SELECT doc_id AS scope, chunk_id, text FROM chunk)),
chunk AS (SELECT * FROM lines WHERE scope IN (SELECT chunk_id FROM gold)), ask AS (SELECT g.query_id || ':' || g.chunk_id AS query_id, g.chunk_id AS scope, b.text FROM gold g JOIN benchmark b ON b.item_id = g.query_id), {SCORE_SQL},
pos AS (SELECT query_id, chunk_id, CASE WHEN score <= 0 THEN round(0.1 * hits, 6) ELSE score END AS score FROM sc)
SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM pos WHERE score > 0) WHERE rank <= 5"""


def query_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    n = gold(spark, d).groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n_docs"))
    bucket = F.when(F.col("n_docs") == 1, "1").when(F.col("n_docs") <= 3, "2-3").otherwise("4+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_queries"), F.sum("n_docs").alias("n_docs"))


QUERY_AMBIGUITY = f"""WITH {GOLD_SQL}, n AS (SELECT query_id, count(DISTINCT chunk_id) AS n_docs FROM gold GROUP BY ALL)
SELECT CASE WHEN n_docs = 1 THEN '1' WHEN n_docs <= 3 THEN '2-3' ELSE '4+' END AS bucket, count(*) AS n_queries, sum(n_docs)::BIGINT AS n_docs FROM n GROUP BY bucket"""


def wrong_doc_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of the first ten that aren't gold, over questions with gold, by list."""
    lists = Lists(spark, d)
    asked = lists.gold.select("query_id").distinct()
    right = lists.gold.withColumn("right", F.lit(1))
    rows = _variants(lists, ("bm25", "dense", "rrf")).filter("rank <= 10").join(asked, "query_id", "left_semi").join(right, ["query_id", "chunk_id"], "left")
    return rows.groupBy("variant").agg(F.round(F.avg(F.when(F.col("right").isNull(), 1.0).otherwise(0.0)), 6).alias("wrong_rate"), F.count("*").alias("n"))


WRONG_DOC_RATE = f"WITH {VARIANT_SQL} SELECT variant, round(avg(CASE WHEN g.chunk_id IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS wrong_rate, count(*) AS n FROM va LEFT JOIN gold g USING (query_id, chunk_id) WHERE variant IN ('bm25', 'dense', 'rrf') AND rank <= 10 AND query_id IN (SELECT query_id FROM gold) GROUP BY variant"

ANSWERS = Fixture(
    "query_id int, variant string, answer string, truth string, context string, retrieved array<string>, gold array<string>, is_unanswerable boolean, latency double, tokens int",
    (
        (1, "a", "The term is two years [d1_v1_p0_c1].", "two years", "The term of this agreement is two years from the date.", ("d1_v1_p0_c1", "d1_v1_p0_c2"), ("d1_v1_p0_c1",), False, 120.0, 50),
        (2, "a", "INSUFFICIENT_EVIDENCE", "", "Nothing here.", ("d1_v1_p0_c1",), (), True, 80.5, 20),
        (3, "a", "The answer was not found in the documents.", "30 days", "Notice is 30 days.", ("d2_v1_p0_c0",), ("d2_v1_p0_c0",), False, 310.25, 35),
        (4, "a", "Payment is due in 30 days, see Reference 2 and Ref 9.", "30 days", "Payment is due within 30 days of the invoice.", ("d2_v1_p0_c0", "d2_v1_p0_c1"), ("d2_v1_p0_c1", "d2_v1_p0_c4"), False, 95.0, 44),
        (5, "b", "It says 10 percent [d9_v1_p0_c3] [d2_v1_p0_c1].", "ten percent", "The fee is 5 percent.", ("d2_v1_p0_c1",), ("d2_v1_p0_c1",), False, 101.75, 61),
        (6, "b", "The fee is five percent of the price.", "", "The fee is five percent of the whole price.", ("d2_v1_p0_c1",), (), True, 77.0, 12),
        (7, "b", "", "", "", (), (), False, 12.0, 0),
        (8, "b", "The the a an.", "an", "the", ("d3_v1_p0_c0",), ("d3_v1_p0_c0",), False, 15.5, 4),
        (9, "b", "Liability is unlimited! Is it? Yes, unlimited liability applies to seller.", "unlimited liability", "The seller has unlimited liability", ("d3_v1_p0_c0",), ("d3_v1_p0_c0",), False, 400.0, 88),
    ),
)
DOCS = Fixture("chunk_id string, doc_id string", (("d1_v1_p0_c1", "d1"), ("d1_v1_p0_c2", "d1"), ("d2_v1_p0_c0", "d2"), ("d2_v1_p0_c1", "d2"), ("d2_v1_p0_c4", "d2"), ("d3_v1_p0_c0", "d3"), ("d9_v1_p0_c3", "d9")))


def _cited(spark: SparkSession) -> DataFrame:
    return ANSWERS.df(spark).withColumn("cited", evaluation.citations(F.col("answer"), F.col("retrieved")))


CITED_SQL = rf"""an AS (SELECT * FROM {ANSWERS.sql()}), ci0 AS (SELECT *, regexp_extract_all(answer, '\[([A-Za-z0-9_\-]+)\]', 1) AS br, list_transform(regexp_extract_all(answer, '(?i)\bRef(?:erence)? (\d+)', 1), lambda n: coalesce(retrieved[greatest(n::INT, 1)], 'INVALID_REF_INDEX_' || n)) AS pl FROM an),
ci1 AS (SELECT *, list_concat(br, pl) AS raw FROM ci0), ci AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS cited FROM ci1)"""


def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    """Every cited id and what it is: valid, of another document than the first retrieved, or unknown."""
    docs = DOCS.df(spark)
    rows = _cited(spark).select("query_id", F.explode("cited").alias("chunk_id"), F.try_element_at("retrieved", F.lit(1)).alias("first"))
    of_first = docs.select(F.col("chunk_id").alias("first"), F.col("doc_id").alias("want"))
    rows = rows.join(docs, "chunk_id", "left").join(of_first, "first", "left")
    kind = F.when(F.col("doc_id").isNull(), "invalid").when(F.col("doc_id") != F.col("want"), "wrong_document").otherwise("valid")
    return rows.select("query_id", "chunk_id", kind.alias("kind"))


CITATION_EXTRACT = f"""WITH {CITED_SQL}, dc AS (SELECT * FROM {DOCS.sql()}), c AS (SELECT query_id, unnest(cited) AS chunk_id, retrieved[1] AS first FROM ci)
SELECT query_id, c.chunk_id, CASE WHEN a.doc_id IS NULL THEN 'invalid' WHEN a.doc_id <> b.doc_id THEN 'wrong_document' ELSE 'valid' END AS kind FROM c LEFT JOIN dc a ON a.chunk_id = c.chunk_id LEFT JOIN dc b ON b.chunk_id = c.first"""


def citation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Macro and micro precision and macro recall of citations over accepted, answerable questions, by variant."""
    rows = _cited(spark).filter(~F.col("is_unanswerable") & (answering.answer_class(F.col("answer")) == "answer") & (F.trim("answer") != ""))
    right = F.size(F.array_intersect("cited", "gold"))
    p = F.when(F.size("cited") == 0, 0.0).otherwise(right / F.greatest(F.size("cited"), F.lit(1)))
    return rows.groupBy("variant").agg(
        F.round(F.avg(p), 6).alias("macro_precision"),
        F.round(F.try_divide(F.sum(right), F.sum(F.size("cited"))), 6).alias("micro_precision"),
        F.round(F.avg(evaluation.citation_recall(F.col("cited"), F.col("gold"))), 6).alias("macro_recall"),
        F.count("*").alias("n"),
    )


REFUSAL_SQL = "(len(list_filter([" + ", ".join("'" + r + "'" for r in answering.REFUSALS) + "], lambda w: contains(lower(answer), w))) > 0)"
CLASS_SQL = f"CASE WHEN starts_with(trim(answer), 'INSUFFICIENT_EVIDENCE') THEN 'sentinel' WHEN {REFUSAL_SQL} THEN 'prose' ELSE 'answer' END"
CITATION_METRICS = f"""WITH {CITED_SQL}, r AS (SELECT *, len(list_intersect(cited, gold)) AS ok, len(cited) AS nc, len(list_distinct(gold)) AS ng FROM ci WHERE NOT is_unanswerable AND {CLASS_SQL} = 'answer' AND trim(answer) <> '')
SELECT variant, round(avg(CASE WHEN nc = 0 THEN 0 ELSE ok / nc::DOUBLE END), 6) AS macro_precision, round(sum(ok) / sum(nc)::DOUBLE, 6) AS micro_precision, round(avg(CASE WHEN ng = 0 THEN 1 ELSE ok / ng::DOUBLE END), 6) AS macro_recall, count(*) AS n FROM r GROUP BY variant"""


def answerability(spark: SparkSession, d: str) -> DataFrame:
    """Acceptance, strict and inclusive refusal rates and balanced accuracies, by variant."""
    rows = ANSWERS.df(spark).withColumn("c", answering.answer_class(F.col("answer")))
    can, cannot = ~F.col("is_unanswerable"), F.col("is_unanswerable")
    rate = lambda cond, base: F.try_divide(F.count_if(cond & base), F.count_if(base))
    accept, strict, loose = rate(F.col("c") == "answer", can), rate(F.col("c") == "sentinel", cannot), rate(F.col("c") != "answer", cannot)
    agg = rows.groupBy("variant").agg(accept.alias("a"), strict.alias("s"), loose.alias("l"), F.avg("latency").alias("lat"), F.avg("tokens").alias("tok"), F.count("*").alias("n"))
    r = lambda x: F.round(x, 6)
    return agg.select("variant", "n", r(F.col("a")).alias("acceptance"), r(F.col("s")).alias("refusal_strict"), r(F.col("l")).alias("refusal_inclusive"), r((F.col("a") + F.col("s")) / 2).alias("balanced_strict"), r((F.col("a") + F.col("l")) / 2).alias("balanced_inclusive"), r(F.col("lat")).alias("mean_latency"), r(F.col("tok")).alias("mean_tokens"))


ANSWERABILITY = f"""WITH a AS (SELECT *, {CLASS_SQL} AS c FROM {ANSWERS.sql()}),
g AS (SELECT variant, count(*) AS n, count(*) FILTER (WHERE c = 'answer' AND NOT is_unanswerable) / count(*) FILTER (WHERE NOT is_unanswerable)::DOUBLE AS a, count(*) FILTER (WHERE c = 'sentinel' AND is_unanswerable) / count(*) FILTER (WHERE is_unanswerable)::DOUBLE AS s,
  count(*) FILTER (WHERE c <> 'answer' AND is_unanswerable) / count(*) FILTER (WHERE is_unanswerable)::DOUBLE AS l, avg(latency) AS lat, avg(tokens) AS tok FROM a GROUP BY variant)
SELECT variant, n, round(a, 6) AS acceptance, round(s, 6) AS refusal_strict, round(l, 6) AS refusal_inclusive, round((a + s) / 2, 6) AS balanced_strict, round((a + l) / 2, 6) AS balanced_inclusive, round(lat, 6) AS mean_latency, round(tok, 6) AS mean_tokens FROM g"""


def outcome_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = _cited(spark)
    refused = answering.answer_class(F.col("answer")) != "answer"
    grounded = F.size(F.array_intersect("cited", "gold")) > 0
    return rows.select("query_id", answering.outcome(F.col("is_unanswerable"), refused, grounded).alias("outcome"))


OUTCOME_CLASSES = f"WITH {CITED_SQL} SELECT query_id, CASE WHEN is_unanswerable AND {CLASS_SQL} <> 'answer' THEN 'CORRECT_REFUSAL' WHEN is_unanswerable THEN 'FALSE_ANSWER' WHEN {CLASS_SQL} <> 'answer' THEN 'FALSE_REFUSAL' WHEN len(list_intersect(cited, gold)) > 0 THEN 'GROUNDED' ELSE 'UNSUPPORTED' END AS outcome FROM ci"


def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return ANSWERS.df(spark).select("query_id", F.round(evaluation.token_f1(F.col("answer"), F.col("truth")), 6).alias("f1"), evaluation.exact_match(F.col("answer"), F.col("truth")).alias("exact"))


ANS = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"
TOKEN_F1 = f"""WITH n AS (SELECT query_id, {ANS.format(x='answer')} AS an, {ANS.format(x='truth')} AS tn FROM {ANSWERS.sql()}),
t AS (SELECT query_id, an, tn, list_filter(string_split(an, ' '), lambda w: w <> '') AS a, list_filter(string_split(tn, ' '), lambda w: w <> '') AS t FROM n),
s AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda y: y = w)), len(list_filter(t, lambda y: y = w))))), 0)::DOUBLE AS sh FROM t)
SELECT query_id, round(CASE WHEN len(a) = 0 AND len(t) = 0 THEN 1 WHEN len(a) = 0 OR len(t) = 0 OR sh = 0 THEN 0 ELSE 2 * (sh / len(a)) * (sh / len(t)) / (sh / len(a) + sh / len(t)) END, 6) AS f1, an = tn AS exact FROM s"""


def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    return ANSWERS.df(spark).select("query_id", F.round(evaluation.faithfulness(F.col("answer"), F.col("context")), 6).alias("faithfulness"))


FAITHFULNESS = rf"""WITH s AS (SELECT query_id, answer, lower(context) AS c, list_filter(list_transform(string_split_regex(answer, '[.!?]'), lambda x: trim(x)), lambda x: length(x) > 10) AS said FROM {ANSWERS.sql()}),
u AS (SELECT query_id, c, unnest(said) AS x FROM s), v AS (SELECT query_id, c, list_filter(string_split_regex(lower(x), '\s+'), lambda w: length(w) > 3) AS w FROM u),
k AS (SELECT query_id, count(*) FILTER (WHERE len(w) = 0 OR 2 * len(list_filter(w, lambda y: contains(c, y))) >= len(w)) AS ok, count(*) AS n FROM v GROUP BY ALL)
SELECT query_id, round(CASE WHEN trim(answer) = '' THEN 0 WHEN len(said) = 0 THEN 1 ELSE ok / n::DOUBLE END, 6) AS faithfulness FROM s LEFT JOIN k USING (query_id)"""


def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = _cited(spark)
    return rows.select("query_id", F.round(evaluation.citation_precision(F.col("cited"), F.col("gold")), 6).alias("precision"), F.round(evaluation.citation_recall(F.col("cited"), F.col("gold")), 6).alias("recall"))


EVIDENCE_COVERAGE = f"""WITH {CITED_SQL} SELECT query_id, round(CASE WHEN len(cited) = 0 THEN CASE WHEN len(gold) = 0 THEN 1 ELSE 0 END ELSE len(list_intersect(cited, gold)) / len(cited)::DOUBLE END, 6) AS precision,
round(CASE WHEN len(gold) = 0 THEN 1 ELSE len(list_intersect(cited, gold)) / len(list_distinct(gold))::DOUBLE END, 6) AS recall FROM ci"""

SCANS = Fixture("page int, truth string, scan string", ((1, "The quick brown fox", "The qu1ck brown fox"), (2, "", ""), (3, "", "noise"), (4, "abc def ghi", "abc ghi"), (5, "Section 1. Scope", "Secti0n 1 Scope."), (6, "same text", "same text")))


def cer(spark: SparkSession, d: str) -> DataFrame:
    return SCANS.df(spark).select("page", evaluation.error_rate_chars(F.col("truth"), F.col("scan")).alias("cer"))


CER = f"SELECT page, CASE WHEN length(truth) = 0 THEN CASE WHEN length(scan) = 0 THEN 0 ELSE 1 END ELSE round(levenshtein(truth, scan) / length(truth)::DOUBLE, 4) END AS cer FROM {SCANS.sql()}"


def wer(spark: SparkSession, d: str) -> DataFrame:
    """Word error rate of scans against their truth."""
    return SCANS.df(spark).select("page", evaluation.error_rate_words(F.col("truth"), F.col("scan")).alias("wer"))


#: A fixed value: texts that are shorter than this are answers given away.
ANSWER_CHARS = 30


def lexical_overlap_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Whether a benchmark text gives its answer away: share of its words in the name and in the text of a gold document."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("q"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), tokens(F.concat_ws(" ", "lang", "source")).alias("title"), tokens(F.col("text")).alias("head"), F.length("text").alias("n"))
    rows = gold(spark, d).join(q, "query_id").join(docs, "chunk_id")
    t, a = overlap(F.col("q"), F.col("title")), overlap(F.col("q"), F.col("head"))
    flag = F.when(t > 0.6, "TITLE").when((a > 0.7) & (F.col("n") < ANSWER_CHARS), "ANSWER_SPAN").otherwise("NONE")
    return rows.select("query_id", F.col("chunk_id").alias("doc_id"), F.round(t, 6).alias("title_overlap"), F.round(a, 6).alias("head_overlap"), flag.alias("flag"))


LEXICAL_OVERLAP_LEAKAGE = f"""WITH {GOLD_SQL}, r AS (SELECT query_id, g.chunk_id AS doc_id, length(d.text) AS n, list_distinct({tok_sql("b.text")}) AS q, {tok_sql("d.lang || ' ' || d.source")} AS t, {tok_sql("d.text")} AS h FROM gold g JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = g.chunk_id),
o AS (SELECT query_id, doc_id, n, len(list_intersect(q, t)) / greatest(len(q), 1)::DOUBLE AS a, len(list_intersect(q, h)) / greatest(len(q), 1)::DOUBLE AS b FROM r)
SELECT query_id, doc_id, round(a, 6) AS title_overlap, round(b, 6) AS head_overlap, CASE WHEN a > 0.6 THEN 'TITLE' WHEN b > 0.7 AND n < 30 THEN 'ANSWER_SPAN' ELSE 'NONE' END AS flag FROM o"""

NAMES = (
    "gold_mapping_strict gold_mapping_histogram retrieval_metrics_at_k retrieval_metrics_per_query candidate_budget_sweep variant_ablation union_vs_rrf pool_sweep waterfall failure_taxonomy "
    "global_vs_scoped document_scoped_search query_ambiguity wrong_doc_rate citation_extract citation_metrics answerability outcome_classes token_f1 faithfulness evidence_coverage cer lexical_overlap_leakage"
).split()
QUERIES = {n: (globals()[n], globals()[n.upper()]) for n in NAMES} | {"wer": (wer, None), "approximate_gold": (approximate_gold, None), "gold_mapping_damaged": (gold_mapping_damaged, None)}
