"""Queries: lexical and dense search, fusion, the hybrid pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Fixture
from ..functions.scores import jaccard
from ..functions.text import tokens
from ..operators import access, answering, bm25, dense, fusion
from ..operators.ann import IvfIndex
from ..operators.evaluation import per_query, summary
from ..operators.postings import PostingIndex
from ..operators.textvec import TextModel
from ..session import saved, table
from .common import ASK_SQL, CHUNK_SQL, FUSED_SQL, GOLD_SQL, POSITIVE_SQL, SCORE_SQL, Lists, chunks, tok_sql


def bm25_tokenize(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return cut.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


BM25_TOKENIZE = f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tok_sql('text')} AS t FROM documents)"


def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.vocabulary(chunks(spark, d)).select("term", "df", "cf", F.round("idf", 6).alias("idf"))


BM25_TERM_STATS = f"WITH {CHUNK_SQL}, {ASK_SQL}, {SCORE_SQL} SELECT term, df, cf, round(idf, 6) AS idf FROM ts"


def bm25_topk_corpus(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("scope"), "text")
    return bm25.search(asked, chunks(spark, d), 10)


BM25_TOPK_CORPUS = f"""WITH {CHUNK_SQL}, ask AS (SELECT item_id AS query_id, 0 AS scope, text FROM benchmark), {SCORE_SQL}, {POSITIVE_SQL}
SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM sp0 WHERE score > 0) WHERE rank <= 10"""


def bm25_postings_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same from an inverted index: only blocks of postings that can matter are read."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("scope"), "text")
    return PostingIndex.build(chunks(spark, d)).search(asked, 10)


def bm25_topk_scoped(spark: SparkSession, d: str) -> DataFrame:
    own = chunks(spark, d).withColumn("scope", F.col("doc_id"))
    items = table(spark, d, "benchmark")
    asked = items.select("item_id", "text", F.explode(F.array(F.col("item_id"), F.col("item_id") + 100)).alias("scope"))
    asked = asked.select((F.col("item_id") * 100_000 + F.col("scope")).alias("query_id"), "scope", "text")
    return bm25.search(asked, own, 20, keep_zero=True)


BM25_TOPK_SCOPED = f"""WITH chunk0 AS (SELECT * FROM (WITH {CHUNK_SQL} SELECT doc_id AS scope, chunk_id, text FROM chunk)), chunk AS (SELECT * FROM chunk0),
ask AS (SELECT item_id * 100000 + scope AS query_id, scope, text FROM (SELECT item_id, text, unnest([item_id, item_id + 100]) AS scope FROM benchmark)), {SCORE_SQL},
every AS (SELECT a.query_id, c.chunk_id, coalesce(sc.score, 0) AS score FROM ask a JOIN chunk c USING (scope) LEFT JOIN sc ON sc.query_id = a.query_id AND sc.chunk_id = c.chunk_id)
SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM every) WHERE rank <= 20"""

REQUESTS = Fixture(
    "req int, tenant string, scope array<long>",
    ((1, "src1", None), (2, "src1", (1, 21, 2)), (3, "src2", ()), (4, None, (5, 6)), (5, "", None), (6, "nobody", None), (7, None, None)),
)


def fail_closed_scope(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source").withColumn("source", F.when(F.col("doc_id") % 11 != 0, F.col("source")))
    met = access.in_tenant(F.col("source"), F.col("tenant")) & access.in_scope(F.col("doc_id"), F.col("scope"))
    asked = F.broadcast(REQUESTS.df(spark))
    return asked.join(docs, met, "left").groupBy("req").agg(F.count("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


FAIL_CLOSED_SCOPE = f"""WITH docs AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN source END AS source FROM documents)
SELECT req, count(doc_id) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM {REQUESTS.sql()} r
LEFT JOIN docs ON (tenant IS NULL OR coalesce(source = tenant AND source <> '', false)) AND (scope IS NULL OR coalesce(list_contains(scope, doc_id), false)) GROUP BY req"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")


def _vector_questions(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec"), "label")


def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(_vector_questions(spark, d), _vectors(spark, d), 10, others_only=True)


PAIRS_SQL = "pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS ql, c.label AS cl, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)"
DENSE_COSINE_TOPK = f"""WITH {PAIRS_SQL} SELECT query_id, rank, chunk_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM pairs) WHERE rank <= 10"""


def dense_blocks_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(_vector_questions(spark, d), _vectors(spark, d), 10, block=7)


DENSE_BLOCKS_TOPK = """WITH pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM pairs) WHERE rank <= 10"""


def dense_ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same from an inverted file, which looks at as many cells as give a recall of 0.95 on some queries."""
    index = IvfIndex.build(_vectors(spark, d).select("chunk_id", "vec"))
    index.calibrate(_vector_questions(spark, d))
    return index.search(_vector_questions(spark, d), 10, others_only=True)


def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """cells, probes, recall at 10 of the inverted file over all queries, against the exact search."""
    index = IvfIndex.build(_vectors(spark, d).select("chunk_id", "vec"))
    index.calibrate(_vector_questions(spark, d))
    recall = index.recall(_vector_questions(spark, d))
    return spark.createDataFrame([(len(index.centres), index.probes, round(recall, 4))], "cells int, probes int, recall double")


def dense_margin_stats(spark: SparkSession, d: str) -> DataFrame:
    return dense.margins(_vector_questions(spark, d), _vectors(spark, d))


DENSE_MARGIN_STATS = f"""WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs)
SELECT query_id, round(avg(score) FILTER (WHERE ql = cl), 4) AS mean_same, round(avg(score) FILTER (WHERE ql <> cl), 4) AS mean_other, max(score) AS top,
  round(max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2), 6) AS margin FROM r GROUP BY query_id"""


def _text_model(lists: Lists) -> tuple[TextModel, DataFrame]:
    """The model of all documents, and their vectors."""
    docs = table(lists.spark, lists.d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    model = TextModel.fit(docs)
    return model, saved(model.embed(docs), "text-vectors")


def _asked(lists: Lists, model: TextModel) -> DataFrame:
    return model.embed(lists.questions.select(F.col("query_id").alias("chunk_id"), "text")).select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec"))


def text_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose text vector is closest to that of each question."""
    lists = Lists(spark, d)
    model, vectors = _text_model(lists)
    return dense.search(_asked(lists, model), vectors, 10)


def text_vector_compare(spark: SparkSession, d: str) -> DataFrame:
    """Metrics against the gold of all questions for vectors of all directions of the model, for its first 16, and for both lists
    fused with BM25."""
    lists = Lists(spark, d)
    model, vectors = _text_model(lists)
    asked, out = saved(_asked(lists, model), "text-questions"), None
    for size in (len(model.values), 16):
        cut = lambda c, n=size: F.slice(c, 1, n).alias(c)
        found = saved(dense.search(asked.select("query_id", cut("query_vec")), vectors.select("chunk_id", cut("vec")), 20), "text-list")
        fused = fusion.reciprocal_rank(found, lists.sparse)
        for name, ranked in ((f"svd_{size}", found), (f"svd_{size}_bm25", fused)):
            own = summary(per_query(ranked, lists.gold, lists.questions, (1, 5, 10, 20))).withColumn("model", F.lit(name))
            out = own if out is None else out.unionAll(own)
    return out


def semantic_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The closest unexpired entry (label 3 counts as expired) of each look-up, if it is close enough."""
    vectors = _vectors(spark, d)
    asked = vectors.filter("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec"))
    entries = vectors.filter("label <> 3 and chunk_id % 10 <> 0")
    return dense.search(asked, entries.select("chunk_id", "vec"), 1).filter("score >= 0.3").select("query_id", F.col("chunk_id").alias("entry_id"), "score")


SEMANTIC_CACHE_LOOKUP = """WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS entry_id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings c WHERE q.vec_id % 10 = 0 AND c.vec_id % 10 <> 0 AND c.label <> 3)
SELECT query_id, entry_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM p) WHERE rank = 1 AND score >= 0.3"""


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return Lists(spark, d).fused.select("query_id", "rank", "chunk_id", "rrf")


RRF_FUSION = f"WITH {FUSED_SQL} SELECT query_id, rank, chunk_id, rrf FROM fu"


def interleaved_union(spark: SparkSession, d: str) -> DataFrame:
    lists = Lists(spark, d)
    return fusion.interleaved(lists.dense, lists.sparse, 15)


UNION_SQL = """iu0 AS (SELECT query_id, chunk_id, min(spot) AS spot FROM (SELECT query_id, chunk_id, 2 * (rank - 1) AS spot FROM dn UNION ALL SELECT query_id, chunk_id, 2 * (rank - 1) + 1 FROM sp) GROUP BY ALL),
iu AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY spot)::INT AS rank FROM iu0)"""
INTERLEAVED_UNION = f"WITH {FUSED_SQL}, {UNION_SQL} SELECT query_id, chunk_id, rank FROM iu WHERE rank <= 15"


def parent_cap2(spark: SparkSession, d: str) -> DataFrame:
    return Lists(spark, d).capped.filter("rank <= 20").select("query_id", "rank", "chunk_id", "parent_id")


CAP_SQL = """pc0 AS (SELECT *, CASE WHEN chunk_id % 7 <> 0 THEN chunk_id // 5 END AS parent_id FROM fu),
pc1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS nth FROM pc0),
pc AS (SELECT query_id, chunk_id, parent_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM pc1 WHERE nth <= 2 OR parent_id IS NULL)"""
PARENT_CAP2 = f"WITH {FUSED_SQL}, {CAP_SQL} SELECT query_id, rank, chunk_id, parent_id FROM pc WHERE rank <= 20"


def parent_expand(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    parent = F.when(F.col("parent_id") % 3 == 0, "").otherwise(F.concat(F.lit("parent "), F.col("parent_id").cast("string")))
    rows = Lists(spark, d).parented.join(texts, "chunk_id").withColumn("parent_text", parent)
    return fusion.expand_parents(rows).select("query_id", "rank", "chunk_id", "parent_id", "text")


PARENT_EXPAND = f"""WITH {FUSED_SQL}, pe0 AS (SELECT fu.*, CASE WHEN chunk_id % 7 <> 0 THEN chunk_id // 5 END AS parent_id, d.text FROM fu JOIN documents d ON d.doc_id = chunk_id),
pe AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(parent_id::VARCHAR, '#' || chunk_id) ORDER BY rank) AS nth FROM pe0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank, chunk_id, parent_id, CASE WHEN parent_id % 3 <> 0 THEN 'parent ' || parent_id ELSE text END AS text FROM pe WHERE nth = 1"""


def candidate_merge_max(spark: SparkSession, d: str) -> DataFrame:
    lists = Lists(spark, d)
    return fusion.merge_best(lists.dense, lists.sparse).select("query_id", "rank", "chunk_id", "score")


CANDIDATE_MERGE_MAX = f"""WITH {FUSED_SQL}, m AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT query_id, chunk_id, score FROM dn UNION ALL SELECT query_id, chunk_id, score FROM sp) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, score FROM m"""


def hybrid_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return Lists(spark, d).hybrid().select("query_id", "rank", "chunk_id", "score")


RERANK_SQL = f"""qw AS (SELECT item_id AS query_id, list_distinct({tok_sql("text")}) AS q FROM benchmark),
dw AS (SELECT doc_id AS chunk_id, list_distinct({tok_sql("text")}) AS t FROM documents),
rr0 AS (SELECT pc.query_id, pc.chunk_id, pc.rank AS old, pc.rrf, round(coalesce(len(list_intersect(q, t)) / greatest(len(q), 1)::DOUBLE, 0), 6) AS score FROM pc JOIN qw USING (query_id) LEFT JOIN dw USING (chunk_id) WHERE pc.rank <= 20),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old)::INT AS rank FROM rr0)"""
HYBRID_PIPELINE = f"WITH {FUSED_SQL}, {CAP_SQL}, {RERANK_SQL} SELECT query_id, rank, chunk_id, score FROM rr WHERE rank <= 10"


def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    lists = Lists(spark, d)
    five = lambda df, name: df.filter("rank <= 5").groupBy("query_id").agg(F.collect_set("chunk_id").alias(name))
    shared = five(lists.dense, "a").join(five(lists.sparse, "b"), "query_id", "full")
    none = F.array().cast("array<bigint>")
    shared = shared.select("query_id", jaccard(F.coalesce("a", none), F.coalesce("b", none)).alias("overlap5"))
    two = lists.fused.filter("rank <= 2").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("rrf"))).alias("r1"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("rrf"))), F.lit(0.0)).alias("r2"))
    ranked = saved(lists.hybrid(), "list-hybrid")
    best = ranked.filter("rank = 1").select("query_id", "score")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.filter(F.array_distinct(tokens(F.col("text"))), lambda w: F.length(w) > 3).alias("w"))
    about = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.lower(F.substring("text", 1, 200)).alias("about"))
    heads = ranked.filter("rank <= 3").join(about, "chunk_id").groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("about")), " ").alias("about"))
    meta = asked.join(heads, "query_id").select("query_id", (F.size(F.filter("w", lambda x: F.instr(F.col("about"), x) > 0)) / F.greatest(F.size("w"), F.lit(1))).alias("meta"))
    rows = shared.join(two, "query_id").join(best, "query_id").join(meta, "query_id")
    total = answering.confidence(F.col("overlap5"), F.col("r1"), F.col("r2"), F.col("score"), F.col("meta"))
    return rows.select("query_id", F.round("overlap5", 6).alias("overlap5"), F.round("meta", 6).alias("meta"), F.round(total, 6).alias("confidence"))


CONFIDENCE_SCORE = f"""WITH {FUSED_SQL}, {CAP_SQL}, {RERANK_SQL},
a AS (SELECT query_id, list(chunk_id) AS a FROM dn WHERE rank <= 5 GROUP BY ALL), b AS (SELECT query_id, list(chunk_id) AS b FROM sp WHERE rank <= 5 GROUP BY ALL),
j AS (SELECT query_id, coalesce(len(list_intersect(a, b)), 0) / (len(coalesce(a, [])) + len(coalesce(b, [])) - coalesce(len(list_intersect(a, b)), 0))::DOUBLE AS overlap5 FROM a FULL JOIN b USING (query_id)),
t AS (SELECT query_id, max(rrf) FILTER (WHERE rank = 1) AS r1, coalesce(max(rrf) FILTER (WHERE rank = 2), 0) AS r2 FROM fu GROUP BY ALL),
h AS (SELECT query_id, array_to_string(list_sort(list(lower(substr(d.text, 1, 200)))), ' ') AS about FROM rr JOIN documents d ON d.doc_id = rr.chunk_id WHERE rank <= 3 GROUP BY ALL),
m AS (SELECT query_id, len(list_filter(w, lambda x: contains(about, x))) / greatest(len(w), 1)::DOUBLE AS meta FROM (SELECT query_id, list_filter(q, lambda x: length(x) > 3) AS w FROM qw) JOIN h USING (query_id)),
s AS (SELECT query_id, overlap5, meta, least(greatest(r1 / 0.0328::DOUBLE, 0), 1) AS fused, least(greatest((r1 - r2) / greatest(r1, 0.001::DOUBLE), 0), 1) AS margin, least(greatest(score, 0), 1) AS rerank
  FROM j JOIN t USING (query_id) JOIN (SELECT query_id, score FROM rr WHERE rank = 1) USING (query_id) JOIN m USING (query_id))
SELECT query_id, round(overlap5, 6) AS overlap5, round(meta, 6) AS meta, round(0.25::DOUBLE * overlap5 + 0.2::DOUBLE * fused + 0.2::DOUBLE * margin + 0.2::DOUBLE * rerank + 0.15::DOUBLE * meta, 6) AS confidence FROM s"""

QUERIES = {
    "bm25_tokenize": (bm25_tokenize, BM25_TOKENIZE),
    "bm25_term_stats": (bm25_term_stats, BM25_TERM_STATS),
    "bm25_topk_corpus": (bm25_topk_corpus, BM25_TOPK_CORPUS),
    "bm25_postings_topk": (bm25_postings_topk, BM25_TOPK_CORPUS),
    "bm25_topk_scoped": (bm25_topk_scoped, BM25_TOPK_SCOPED),
    "fail_closed_scope": (fail_closed_scope, FAIL_CLOSED_SCOPE),
    "dense_cosine_topk": (dense_cosine_topk, DENSE_COSINE_TOPK),
    "dense_ann_topk": (dense_ann_topk, None),
    "ann_recall": (ann_recall, None),
    "text_vector_topk": (text_vector_topk, None),
    "text_vector_compare": (text_vector_compare, None),
    "dense_blocks_topk": (dense_blocks_topk, DENSE_BLOCKS_TOPK),
    "dense_margin_stats": (dense_margin_stats, DENSE_MARGIN_STATS),
    "semantic_cache_lookup": (semantic_cache_lookup, SEMANTIC_CACHE_LOOKUP),
    "rrf_fusion": (rrf_fusion, RRF_FUSION),
    "interleaved_union": (interleaved_union, INTERLEAVED_UNION),
    "parent_cap2": (parent_cap2, PARENT_CAP2),
    "parent_expand": (parent_expand, PARENT_EXPAND),
    "candidate_merge_max": (candidate_merge_max, CANDIDATE_MERGE_MAX),
    "hybrid_pipeline": (hybrid_pipeline, HYBRID_PIPELINE),
    "confidence_score": (confidence_score, CONFIDENCE_SCORE),
}
