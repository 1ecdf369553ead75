"""Queries: looser gold, degraded text, judged claims, routes over metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Fixture
from ..functions.text import safe_id, space_normal, tokens
from ..operators import evaluation, risk
from ..operators.chunking import carry_heading, line_chunks
from ..session import table
from .common import CHUNK_SQL, DOC_SQL, GOLD_SQL, POSITIVE_SQL, SCORE_SQL, Lists, gold, tok_sql
from .evaluate import KS, NORM, SUMMARY, metric_sql
from .review import SCAN_SQL

#: Share of a passage's longer words that a line must have to count as loosely relevant.
LOOSE, LEAST_WORDS = 0.6, 3


def gold_mapping_loose(spark: SparkSession, d: str) -> DataFrame:
    """query_id, chunk_id, how: lines of gold documents that hold the passage or most of its words of over 3 letters."""
    pairs = gold(spark, d).withColumnRenamed("chunk_id", "doc_id")
    long = lambda t: F.filter(F.array_distinct(tokens(t)), lambda w: F.length(w) > 3)
    passages = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), space_normal(F.col("text")).alias("g"), long(F.col("text")).alias("gw"))
    lines = line_chunks(table(spark, d, "documents")).select("doc_id", "chunk_id", space_normal(F.col("text")).alias("c"), long(F.col("text")).alias("cw"))
    rows = pairs.join(passages, "query_id").join(lines, "doc_id")
    share = F.size(F.array_intersect("gw", "cw")) / F.greatest(F.size("gw"), F.lit(1))
    how = F.when(F.contains("c", "g"), "contains").when((F.size("gw") >= LEAST_WORDS) & (share >= LOOSE), "words")
    return rows.select("query_id", "chunk_id", how.alias("how")).filter("how is not null")


_LONG = "list_filter(list_distinct({x}), lambda w: length(w) > 3)"
GOLD_MAPPING_LOOSE = f"""WITH {CHUNK_SQL}, {GOLD_SQL},
r AS (SELECT p.query_id, k.chunk_id, {NORM.format(x="k.text")} AS c, {NORM.format(x="b.text")} AS g, {_LONG.format(x=tok_sql("b.text"))} AS gw, {_LONG.format(x=tok_sql("k.text"))} AS cw
  FROM gold p JOIN benchmark b ON b.item_id = p.query_id JOIN chunk k ON k.doc_id = p.chunk_id),
h AS (SELECT query_id, chunk_id, CASE WHEN contains(c, g) THEN 'contains' WHEN len(gw) >= 3 AND len(list_intersect(gw, cw)) / len(gw)::DOUBLE >= 0.6 THEN 'words' END AS how FROM r)
SELECT query_id, chunk_id, how FROM h WHERE how IS NOT NULL"""


def degraded(text: Column, key: Column, every: int) -> Column:
    """text with about one character in `every` replaced, at places that the key decides: the same on every run.

    A stand-in for recognition errors; the places are multiples of `every` from a start between 1 and `every`.
    """
    start = (key % every + 1).cast("int")
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when((i + 1 >= start) & ((i + 1 - start) % every == 0), "#").otherwise(c)), "")


def ocr_degradation(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval metrics for questions as they are and with one character in 40 or in 12 replaced."""
    lists = Lists(spark, d)
    asked = lists.questions
    levels = {"0_clean": asked, "1_in_40": asked.withColumn("text", degraded(F.col("text"), F.col("query_id"), 40)), "2_in_12": asked.withColumn("text", degraded(F.col("text"), F.col("query_id"), 12))}
    out = None
    for name, df in levels.items():
        found = evaluation.summary(evaluation.per_query(lists.index.search(df, 20), lists.gold, asked, KS))
        found = found.select(F.lit(name).alias("level"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def _ocr_sql(name: str, every: int | None) -> str:
    text = "text" if every is None else (
        f"array_to_string(list_transform(string_split(text, ''), lambda c, i: CASE WHEN i >= item_id % {every} + 1 AND (i - item_id % {every} - 1) % {every} = 0 THEN '#' ELSE c END), '')"
    )
    return f"""SELECT '{name}' AS level, * FROM (WITH {DOC_SQL}, ask AS (SELECT item_id AS query_id, 'all' AS scope, {text} AS text FROM benchmark), {SCORE_SQL}, {POSITIVE_SQL}, {GOLD_SQL},
sp AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM sp0 WHERE score > 0) WHERE rank <= 20)
SELECT {SUMMARY} FROM {metric_sql("sp")} GROUP BY k)"""


OCR_DEGRADATION = " UNION ALL ".join(_ocr_sql(n, e) for n, e in (("0_clean", None), ("1_in_40", 40), ("2_in_12", 12)))

JUDGED = Fixture("query_id int, variant string, supported int, total int, score double", ((1, "a", 3, 3, 2.0), (2, "a", 1, 2, 1.0), (3, "a", 0, 0, 0.0), (4, "b", 5, 6, 2.0), (5, "b", 2, 2, 1.0)))


def judge_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Supported claims over all claims, and mean scores as a share of the best, by variant."""
    rows = JUDGED.df(spark)
    return rows.groupBy("variant").agg(F.round(F.try_divide(F.sum("supported"), F.sum("total")), 6).alias("groundedness"), F.round(F.avg("score") / 2, 6).alias("correctness"), F.sum("total").alias("claims"))


JUDGE_RATIOS = f"SELECT variant, round(sum(supported) / sum(total)::DOUBLE, 6) AS groundedness, round(avg(score) / 2, 6) AS correctness, sum(total)::BIGINT AS claims FROM {JUDGED.sql()} GROUP BY variant"


def safe_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers made of page addresses, and how many pages share one."""
    own = table(spark, d, "pages").select(safe_id(F.col("url")).alias("safe"))
    return own.groupBy("safe").agg(F.count("*").alias("n"))


SAFE_IDS = "SELECT substr(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), 1, 50) AS safe, count(*) AS n FROM pages GROUP BY safe"


def split_disjointness(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and shared documents, of each pair of three splits by id."""
    ids = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 < 6, "train").when(F.col("doc_id") % 10 < 8, "dev").otherwise("test").alias("split"))
    pairs = ids.alias("a").join(ids.alias("b"), "doc_id").groupBy(F.col("a.split").alias("one"), F.col("b.split").alias("other")).agg(F.count("*").alias("shared"))
    names = spark.createDataFrame([("train",), ("dev",), ("test",)], "s string")
    every = names.select(F.col("s").alias("one")).join(F.broadcast(names.select(F.col("s").alias("other"))))
    return every.join(pairs, ["one", "other"], "left").select("one", "other", F.coalesce("shared", F.lit(0)).alias("shared"))


SPLIT_DISJOINTNESS = """WITH i AS (SELECT doc_id, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'dev' ELSE 'test' END AS split FROM documents), n AS (SELECT unnest(['train', 'dev', 'test']) AS s)
SELECT a.s AS one, b.s AS other, (SELECT count(*) FROM i x JOIN i y USING (doc_id) WHERE x.split = a.s AND y.split = b.s) AS shared FROM n a, n b"""



def error_rates_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Character and word error rates of every benchmark text with one character in 12 replaced."""
    rows = table(spark, d, "benchmark").select("item_id", "text", degraded(F.col("text"), F.col("item_id"), 12).alias("scan"))
    return rows.select("item_id", evaluation.error_rate_chars(F.col("text"), F.col("scan")).alias("cer"), evaluation.error_rate_words(F.col("text"), F.col("scan")).alias("wer"))


_SCAN = "array_to_string(list_transform(string_split(text, ''), lambda c, i: CASE WHEN i >= item_id % 12 + 1 AND (i - item_id % 12 - 1) % 12 = 0 THEN '#' ELSE c END), '')"
_CUT = r"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"
# words as single ASCII characters, as DuckDB's distance counts bytes: those of both sides numbered, the others of a side alike
ERROR_RATES_BENCHMARK = f"""WITH s AS (SELECT item_id, text, {_SCAN} AS scan FROM benchmark), w AS (SELECT *, {_CUT.format(x='text')} AS a, {_CUT.format(x='scan')} AS b FROM s),
e AS (SELECT *, list_distinct(list_filter(a, lambda x: list_contains(b, x))) AS every FROM w),
c AS (SELECT *, array_to_string(list_transform(a, lambda x: chr((47 + coalesce(list_position(every, x), -1))::INT)), '') AS ca, array_to_string(list_transform(b, lambda x: chr((47 + coalesce(list_position(every, x), -2))::INT)), '') AS cb FROM e)
SELECT item_id, round(len(list_filter(string_split(text, ''), lambda x, i: x <> scan[i])) / length(text)::DOUBLE, 4) AS cer, round(levenshtein(ca, cb) / len(a)::DOUBLE, 4) AS wer FROM c"""


def risk_rollup_documents(spark: SparkSession, d: str) -> DataFrame:
    """Findings and the gravest severity of every document, low where nothing is found."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = risk.scan(docs, risk.rules_table(spark), "doc_id")
    rows = docs.select("doc_id").join(found, "doc_id", "left")
    return rows.groupBy("doc_id").agg(F.count("rule_id").alias("n_findings"), risk.overall(F.col("severity")).alias("severity"))


RISK_ROLLUP_DOCUMENTS = f"""WITH {SCAN_SQL} SELECT d.doc_id, count(rule_id) AS n_findings, coalesce(list_extract(['low', 'medium', 'high', 'critical'], max(list_position(['low', 'medium', 'high', 'critical'], severity))), 'low') AS severity
FROM documents d LEFT JOIN ru ON ru.clause_id = -1 - d.doc_id GROUP BY d.doc_id"""


def faithfulness_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """How far every benchmark text is borne out by the first half of each document that holds it."""
    lists = Lists(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("context"))
    rows = lists.gold.join(lists.questions.select("query_id", "text"), "query_id").join(docs, "chunk_id")
    return rows.select("query_id", F.col("chunk_id").alias("doc_id"), F.round(evaluation.faithfulness(F.col("text"), F.col("context")), 6).alias("faithfulness"))


FAITHFULNESS_BENCHMARK = rf"""WITH {GOLD_SQL}, s AS (SELECT g.query_id, g.chunk_id AS doc_id, b.text AS answer, lower(substr(d.text, 1, length(d.text) // 2)) AS c, list_filter(list_transform(string_split_regex(b.text, '[.!?]'), lambda x: trim(x)), lambda x: length(x) > 10) AS said
  FROM gold g JOIN benchmark b ON b.item_id = g.query_id JOIN documents d ON d.doc_id = g.chunk_id),
u AS (SELECT query_id, doc_id, c, unnest(said) AS x FROM s), v AS (SELECT query_id, doc_id, c, list_filter(string_split_regex(lower(x), '\s+'), lambda w: length(w) > 3) AS w FROM u),
k AS (SELECT query_id, doc_id, count(*) FILTER (WHERE len(w) = 0 OR 2 * len(list_filter(w, lambda y: contains(c, y))) >= len(w)) AS ok, count(*) AS n FROM v GROUP BY ALL)
SELECT query_id, doc_id, round(CASE WHEN trim(answer) = '' THEN 0 WHEN len(said) = 0 THEN 1 ELSE ok / n::DOUBLE END, 6) AS faithfulness FROM s LEFT JOIN k USING (query_id, doc_id)"""


def headings_carried(spark: SparkSession, d: str) -> DataFrame:
    """The section of every line of the documents, every fifth line being made to read like a heading."""
    lines = line_chunks(table(spark, d, "documents"))
    text = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("Section "), F.col("text"))).otherwise(F.col("text"))
    return carry_heading(lines.select("doc_id", "pos", text.alias("text"))).select("doc_id", "pos", "is_heading", F.md5("section").alias("section_md5"))


HEADINGS_CARRIED = rf"""WITH {CHUNK_SQL}, b AS (SELECT doc_id, pos::INT AS pos, CASE WHEN pos % 5 = 0 THEN 'Section ' || text ELSE text END AS text FROM chunk),
h AS (SELECT *, len(string_split(text, chr(10))) <= 2 AND length(text) < 120 AND regexp_matches(text, '(?i)^(Article|Section|Clause|Chapter|Part|\d+\.|\d+\.\d+)') AS is_heading FROM b)
SELECT doc_id, pos, is_heading, md5(last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos)) AS section_md5 FROM h"""

NAMES = "gold_mapping_loose ocr_degradation judge_ratios safe_ids split_disjointness error_rates_benchmark risk_rollup_documents faithfulness_benchmark headings_carried".split()
QUERIES = {n: (globals()[n], globals()[n.upper()]) for n in NAMES}
