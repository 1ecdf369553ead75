"""What the query modules share: the test tables seen as retrieval data, and the same as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import bm25, dense, fusion, matching
from ..operators.chunking import line_chunks
from ..session import saved, table

LIST_K = 20


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every line of documents that isn't blank, all in one scope."""
    return line_chunks(table(spark, d, "documents"), "source").withColumn("scope", F.lit(0))


def doc_chunks(spark: SparkSession, d: str, scope: object = None) -> DataFrame:
    """Whole documents as chunks."""
    own = F.lit("all") if scope is None else scope
    return table(spark, d, "documents").select(own.alias("scope"), F.col("doc_id").alias("chunk_id"), "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("all").alias("scope"), "text")


class Lists:
    """The ranked lists and the gold of the test tables, each made once and kept in the work folder, so that a query that
    compares many of them reads the files once."""

    def __init__(self, spark: SparkSession, d: str, k: int = LIST_K):
        self.spark, self.d, self.k = spark, d, k

    @cached_property
    def questions(self) -> DataFrame:
        return questions(self.spark, self.d)

    @cached_property
    def index(self) -> bm25.Index:
        """Of whole documents."""
        return bm25.Index.build(doc_chunks(self.spark, self.d))

    @cached_property
    def sparse(self) -> DataFrame:
        """The first documents of each benchmark text by BM25."""
        return saved(self.index.search(self.questions, self.k), "list-sparse")

    @cached_property
    def dense(self) -> DataFrame:
        """The first vectors of each benchmark text, whose own vector is the one with its id."""
        vectors = table(self.spark, self.d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
        asked = vectors.join(table(self.spark, self.d, "benchmark").select(F.col("item_id").alias("chunk_id")), "chunk_id", "left_semi")
        return saved(dense.search(asked.select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec")), vectors, self.k), "list-dense")

    @cached_property
    def fused(self) -> DataFrame:
        return saved(fusion.reciprocal_rank(self.dense, self.sparse), "list-fused")

    @cached_property
    def parented(self) -> DataFrame:
        return self.fused.withColumn("parent_id", parent_of(F.col("chunk_id")))

    @cached_property
    def capped(self) -> DataFrame:
        """Two of each parent."""
        return saved(fusion.cap_parents(self.parented, 2), "list-capped")

    @cached_property
    def scored(self) -> DataFrame:
        """The first capped ones, as many as a list has, with the stand-in reranker's score."""
        return saved(lexical(self.spark, self.d, self.capped.filter(F.col("rank") <= self.k).select("query_id", "chunk_id", "rank", "rrf")), "list-scored")

    def hybrid(self, top_n: int = 10) -> DataFrame:
        """The canonical pipeline: two lists, rank fusion, two per parent, budget, rerank."""
        return fusion.rerank(self.scored, F.col("overlap"), top_n)

    @cached_property
    def gold(self) -> DataFrame:
        return saved(gold(self.spark, self.d), "gold")


def parent_of(chunk_id: object) -> object:
    """A made-up parent: five documents each; every seventh document has none."""
    return F.when(chunk_id % 7 != 0, F.floor(chunk_id / 5))


def lexical(spark: SparkSession, d: str, ranked: DataFrame) -> DataFrame:
    """ranked with `overlap`: the share of the question's distinct words that the document has (a stand-in reranker)."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(tokens(F.col("text"))).alias("q"))
    # only documents that are ranked are cut to words
    needed = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text").join(ranked.select("chunk_id").distinct(), "chunk_id", "left_semi")
    texts = needed.select("chunk_id", F.array_distinct(tokens(F.col("text"))).alias("t"))
    joined = ranked.join(asked, "query_id").join(texts, "chunk_id", "left")
    share = F.coalesce(F.size(F.array_intersect("q", "t")) / F.greatest(F.size("q"), F.lit(1)), F.lit(0.0))
    return joined.withColumn("overlap", share).drop("q", "t")


def holding(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, chunk_id: the documents (doc_id, text) that hold a passage (query_id, text) verbatim; an empty one is in all."""
    return matching.containing(docs, passages).withColumnRenamed("doc_id", "chunk_id")


def gold(spark: SparkSession, d: str) -> DataFrame:
    """query_id, chunk_id (doc_id): the documents that hold a benchmark text verbatim."""
    return holding(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, d, "documents"))


def tok_sql(x: str) -> str:
    return rf"list_filter(string_split_regex(trim(regexp_replace(lower({x}), '[^\pL\pM\pN_\s]', ' ', 'g')), '\s+'), lambda t: length(t) > 1)"


CHUNK_SQL = """chunk AS (SELECT 0 AS scope, doc_id, source, pos, doc_id || '_b' || pos AS chunk_id, text
  FROM (SELECT doc_id, source, unnest(range(len(l))) AS pos, unnest(l) AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))
  WHERE trim(text) <> '')"""
DOC_SQL = "chunk AS (SELECT 'all' AS scope, doc_id AS chunk_id, text FROM documents)"
ASK_SQL = "ask AS (SELECT item_id AS query_id, 'all' AS scope, text FROM benchmark)"
#: Needs chunk (scope, chunk_id, text) and ask (query_id, scope, text).
SCORE_SQL = f"""ct AS (SELECT scope, chunk_id, {tok_sql("text")} AS t FROM chunk),
po AS (SELECT scope, chunk_id, dl, term, count(*) AS tf FROM (SELECT scope, chunk_id, len(t) AS dl, unnest(t) AS term FROM ct) GROUP BY ALL),
st AS (SELECT scope, count(*) AS n, avg(len(t)) AS avgdl FROM ct GROUP BY scope),
td AS (SELECT scope, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM po GROUP BY ALL),
tr AS (SELECT td.*, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM td JOIN st USING (scope)),
tm AS (SELECT scope, avg(raw) AS mean FROM tr GROUP BY scope),
ts AS (SELECT scope, term, df, cf, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END AS idf FROM tr JOIN tm USING (scope)),
qt AS (SELECT query_id, scope, term, count(*) AS qtf FROM (SELECT query_id, scope, unnest({tok_sql("text")}) AS term FROM ask) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, po.scope, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * qtf), 6) AS score, count(*) AS hits
  FROM qt JOIN po USING (scope, term) JOIN ts USING (scope, term) JOIN st USING (scope) GROUP BY ALL)"""
POSITIVE_SQL = "sp0 AS (SELECT query_id, chunk_id, CASE WHEN score <= 0 THEN round(0.1 * hits, 6) ELSE score END AS score FROM sc)"


def fused_sql(k: int) -> str:
    """dn, sp and fu: the two lists of k and their fusion."""
    return f"""{DOC_SQL}, {ASK_SQL}, {SCORE_SQL}, {POSITIVE_SQL},
sp AS (SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM sp0 WHERE score > 0) WHERE rank <= {k}),
dn0 AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id, embeddings c),
dn AS (SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM dn0) WHERE rank <= {k}),
fu0 AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)::DOUBLE), 9) AS rrf FROM (SELECT query_id, chunk_id, rank FROM dn UNION ALL SELECT query_id, chunk_id, rank FROM sp) GROUP BY ALL),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id)::INT AS rank FROM fu0)"""


FUSED_SQL = fused_sql(LIST_K)
GOLD_SQL = "gold AS (SELECT item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b, documents d WHERE contains(d.text, b.text))"
