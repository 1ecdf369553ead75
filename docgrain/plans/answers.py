"""Queries: predictions joined to their manifest, other gold and failure rules, text variants, bounded findings, all on the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import summary_context
from ..operators import answering, bm25, evaluation, risk
from ..operators.chunking import line_chunks, markdown_paragraphs
from ..session import table
from .common import ASK_SQL, CHUNK_SQL, FUSED_SQL, GOLD_SQL, POSITIVE_SQL, SCORE_SQL, Lists
from .evaluate import ANS, NORM, SUMMARY, metric_sql
from .ingest import SAC_CONTEXT
from .retrieval import CAP_SQL, RERANK_SQL
from .review import FACETS, SCAN_SQL


def _name(doc_id: Column) -> Column:
    return F.concat(F.lit("doc_"), doc_id.cast("string"), F.lit("_x"))


def predictions(lists: Lists) -> DataFrame:
    """query_id, variant, answer, retrieved: made-up answers to the benchmark's questions over the documents retrieved for them; every
    eleventh question has none."""
    found = lists.sparse.filter("rank <= 5").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: _name(x["chunk_id"])).alias("retrieved"))
    rows = lists.questions.drop("scope").join(found, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    top = F.coalesce(F.try_element_at("retrieved", F.lit(1)), F.lit("none"))
    kind = F.col("query_id") % 5
    said = (
        F.when(kind == 0, F.concat("text", F.lit(" ["), top, F.lit("]"))).when(kind == 1, F.concat(F.lit("It is in [Reference 2] and [Source Block 9]: "), F.col("text")))
        .when(kind == 2, F.lit("INSUFFICIENT_EVIDENCE")).when(kind == 3, F.lit("That information is not present here.")).otherwise(F.col("text"))
    )
    return rows.filter("query_id % 11 <> 10").select("query_id", F.when(F.col("query_id") % 2 == 0, "a").otherwise("b").alias("variant"), said.alias("answer"), "retrieved")


def manifest(lists: Lists) -> DataFrame:
    """query_id, gold, is_unanswerable of the benchmark's questions: documents that hold the text; none makes it unanswerable."""
    own = lists.gold.groupBy("query_id").agg(F.sort_array(F.collect_set(_name(F.col("chunk_id")))).alias("gold"))
    rows = lists.questions.select("query_id").join(own, "query_id", "left")
    return rows.select("query_id", F.coalesce("gold", F.array().cast("array<string>")).alias("gold"), F.col("gold").isNull().alias("is_unanswerable"))


PRED_SQL = f"""{FUSED_SQL}, {GOLD_SQL}, fo AS (SELECT query_id, list('doc_' || chunk_id || '_x' ORDER BY rank) AS retrieved FROM sp WHERE rank <= 5 GROUP BY query_id),
pr0 AS (SELECT item_id AS query_id, text, coalesce(retrieved, []) AS retrieved FROM benchmark LEFT JOIN fo ON query_id = item_id),
pr AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant, retrieved, CASE query_id % 5 WHEN 0 THEN text || ' [' || coalesce(retrieved[1], 'none') || ']' WHEN 1 THEN 'It is in [Reference 2] and [Source Block 9]: ' || text
  WHEN 2 THEN 'INSUFFICIENT_EVIDENCE' WHEN 3 THEN 'That information is not present here.' ELSE text END AS answer FROM pr0 WHERE query_id % 11 <> 10),
ma AS (SELECT item_id AS query_id, coalesce(list_sort(list(DISTINCT 'doc_' || chunk_id || '_x') FILTER (WHERE chunk_id IS NOT NULL)), []) AS gold, count(chunk_id) = 0 AS is_unanswerable FROM benchmark LEFT JOIN gold g ON g.query_id = item_id GROUP BY item_id)"""
_SIGNALS = "(len(list_filter([" + ", ".join(f"'{x}'" for x in answering.SIGNALS) + "], lambda w: contains(lower(answer), w))) > 0)"
DECIDED_SQL = rf"""de AS (SELECT *, CASE WHEN trim(answer) = '' OR {_SIGNALS} THEN 'INSUFFICIENT_EVIDENCE' ELSE 'ANSWER' END AS decision,
  list_sort(list_distinct(list_concat(list_filter(retrieved, lambda c: contains(answer, c)), list_filter(list_transform(regexp_extract_all(answer, '(?i)\[(?:Reference|Document Reference|Source Block)\s*(\d+)\]', 1), lambda n: retrieved[greatest(n::INT, 1)]), lambda c: c IS NOT NULL)))) AS cited FROM pr)"""


def lenient_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The decision and cited documents read from every prediction, with and without falling back to the first retrieved one."""
    rows = predictions(Lists(spark, d))
    a, r = F.col("answer"), F.col("retrieved")
    cited = lambda fallback: F.array_join(answering.lenient_citations(a, r, fallback), ",")
    return rows.select("query_id", answering.lenient_decision(a).alias("decision"), cited(False).alias("cited"), cited(True).alias("cited_or_first"))


LENIENT_DECISIONS = f"""WITH {PRED_SQL}, {DECIDED_SQL}
SELECT query_id, decision, array_to_string(cited, ',') AS cited, CASE WHEN decision = 'ANSWER' AND len(cited) = 0 AND len(retrieved) > 0 THEN retrieved[1] ELSE array_to_string(cited, ',') END AS cited_or_first FROM de"""


def strict_rescoring(spark: SparkSession, d: str) -> DataFrame:
    """By variant: acceptance, refusal, balanced accuracy, and macro and micro citation scores over accepted, answerable questions.
    Every question of the manifest counts; one without a prediction is a refusal without citations."""
    lists = Lists(spark, d)
    rows = manifest(lists).join(predictions(lists), "query_id", "left")
    answer = F.coalesce("answer", F.lit(""))
    rows = rows.select("gold", "is_unanswerable", F.coalesce("variant", F.lit("missing")).alias("variant"), answering.lenient_decision(answer).alias("decision"), answering.lenient_citations(answer, F.coalesce("retrieved", F.array().cast("array<string>")), False).alias("cited"))
    can, said = ~F.col("is_unanswerable"), F.col("decision") == "ANSWER"
    both = can & said
    right = F.size(F.array_intersect("cited", "gold"))
    rate = lambda cond, base: F.try_divide(F.count_if(cond & base), F.count_if(base))
    r = lambda x, n: F.round(x, 6).alias(n)
    accept, refuse = rate(said, can), rate(~said, ~can)
    return rows.groupBy("variant").agg(
        F.count("*").alias("n"), r(accept, "acceptance"), r(refuse, "refusal"), r((accept + refuse) / 2, "balanced"),
        r(F.avg(F.when(both, evaluation.citation_precision(F.col("cited"), F.col("gold")))), "macro_precision"),
        r(F.try_divide(F.sum(F.when(both, right)), F.sum(F.when(both, F.size("cited")))), "micro_precision"),
        r(F.avg(F.when(both, evaluation.citation_recall(F.col("cited"), F.col("gold")))), "macro_recall"),
    )


STRICT_RESCORING = f"""WITH {PRED_SQL}, {DECIDED_SQL}, j AS (SELECT gold, is_unanswerable, coalesce(variant, 'missing') AS variant, coalesce(decision, 'INSUFFICIENT_EVIDENCE') = 'ANSWER' AS said, coalesce(cited, []) AS cited FROM ma LEFT JOIN de USING (query_id)),
k AS (SELECT *, NOT is_unanswerable AND said AS taken, len(list_intersect(cited, gold)) AS ok, len(cited) AS nc, len(gold) AS ng FROM j),
g AS (SELECT variant, count(*) AS n, count(*) FILTER (WHERE taken) / nullif(count(*) FILTER (WHERE NOT is_unanswerable), 0)::DOUBLE AS a, count(*) FILTER (WHERE is_unanswerable AND NOT said) / nullif(count(*) FILTER (WHERE is_unanswerable), 0)::DOUBLE AS s,
  avg(CASE WHEN nc = 0 THEN 0 ELSE ok / nc::DOUBLE END) FILTER (WHERE taken) AS mp, sum(ok) FILTER (WHERE taken) / nullif(sum(nc) FILTER (WHERE taken), 0)::DOUBLE AS ip, avg(ok / ng::DOUBLE) FILTER (WHERE taken) AS mr FROM k GROUP BY variant)
SELECT variant, n, round(a, 6) AS acceptance, round(s, 6) AS refusal, round((a + s) / 2, 6) AS balanced, round(mp, 6) AS macro_precision, round(ip, 6) AS micro_precision, round(mr, 6) AS macro_recall FROM g"""


def f1_copies(spark: SparkSession, d: str) -> DataFrame:
    """Three word F1s of each benchmark text against the first line of each of its gold documents."""
    lists = Lists(spark, d)
    first = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.split("text", "\n")[0].alias("line"))
    rows = lists.gold.join(lists.questions.select("query_id", "text"), "query_id").join(first, "chunk_id")
    r = lambda x, n: F.round(x, 6).alias(n)
    a, b = F.col("text"), F.col("line")
    return rows.select("query_id", F.col("chunk_id").alias("doc_id"), r(evaluation.token_f1(a, b), "f1_answers"), r(evaluation.counted_f1(a, b), "f1_counted"), r(evaluation.set_f1(a, b), "f1_sets"))


_SHARE = "coalesce(list_sum(list_transform(list_distinct({x}), lambda w: least(len(list_filter({x}, lambda y: y = w)), len(list_filter({y}, lambda y: y = w))))), 0)::DOUBLE"
_F1 = "CASE WHEN {s} = 0 THEN 0 ELSE 2 * ({s} / len({x})) * ({s} / len({y})) / ({s} / len({x}) + {s} / len({y})) END"
F1_COPIES = f"""WITH {GOLD_SQL}, r AS (SELECT g.query_id, g.chunk_id AS doc_id, b.text AS a, string_split(d.text, chr(10))[1] AS l FROM gold g JOIN benchmark b ON b.item_id = g.query_id JOIN documents d ON d.doc_id = g.chunk_id),
t AS (SELECT query_id, doc_id, list_filter(string_split({ANS.format(x='a')}, ' '), lambda w: w <> '') AS x, list_filter(string_split({ANS.format(x='l')}, ' '), lambda w: w <> '') AS y, list_filter(string_split({NORM.format(x='a')}, ' '), lambda w: w <> '') AS u, list_filter(string_split({NORM.format(x='l')}, ' '), lambda w: w <> '') AS v FROM r),
s AS (SELECT *, {_SHARE.format(x='x', y='y')} AS sx, {_SHARE.format(x='u', y='v')} AS su, len(list_intersect(list_distinct(u), v))::DOUBLE AS sc FROM t)
SELECT query_id, doc_id, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE {_F1.format(s='sx', x='x', y='y')} END, 6) AS f1_answers,
  round(CASE WHEN len(u) = 0 OR len(v) = 0 THEN 0 ELSE {_F1.format(s='su', x='u', y='v')} END, 6) AS f1_counted, round(CASE WHEN len(u) = 0 OR len(v) = 0 THEN 0 ELSE {_F1.format(s='sc', x='u', y='v')} END, 6) AS f1_sets FROM s"""


def gold_mapping_variants(spark: SparkSession, d: str) -> DataFrame:
    """query_id, chunk_id and which looser rules map a line of a gold document to the passage: contained in it or in its parent
    (five lines), the passage's half at either end, or three shared words; fallback marks a document's first line where no
    line shares three."""
    lists = Lists(spark, d)
    lines = line_chunks(table(spark, d, "documents")).select("doc_id", "pos", "chunk_id", "text")
    passages = lists.questions.select("query_id", "text").withColumnRenamed("text", "passage")
    rows = lists.gold.withColumnRenamed("chunk_id", "doc_id").join(passages, "query_id").join(lines, "doc_id")
    parent = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    parents = lines.join(lists.gold.select(F.col("chunk_id").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id", F.floor(F.col("pos") / 5).alias("group")).agg(parent.alias("parent"))
    rows = rows.withColumn("group", F.floor(F.col("pos") / 5)).join(parents, ["doc_id", "group"])
    g, c = F.lower(F.trim("passage")), F.lower("text")
    contained = F.contains(c, g) | F.contains(F.lower("parent"), g)
    half = F.least(F.lit(100), F.floor(F.length(g) / 2)).cast("int")
    ends = (F.length(g) >= 40) & (half >= 30) & (F.contains(c, F.substr(g, F.lit(1), half)) | F.contains(c, F.right(g, half)))
    distinct = lambda t: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(t), r"(?U)[^\w]+", " "), " "), lambda w: w != ""))
    asked = distinct(F.substring("passage", 1, 80))
    shared = F.size(F.array_intersect(asked, distinct(F.col("text")))) >= F.least(F.size(asked), F.lit(3))
    found = rows.select("query_id", "doc_id", "pos", "chunk_id", contained.alias("contained"), (F.contains(c, g) | F.contains(g, c) | ends).alias("ends"), shared.alias("shared"))
    best = found.groupBy("query_id", "doc_id").agg(F.max("shared").alias("any"), F.min("pos").alias("first"))
    flagged = found.join(best, ["query_id", "doc_id"]).withColumn("fallback", ~F.col("any") & (F.col("pos") == F.col("first")))
    return flagged.filter("contained or ends or shared or fallback").select("query_id", "chunk_id", "contained", "ends", "shared", "fallback")


_WORDS = r"list_distinct(list_filter(string_split(regexp_replace(lower({x}), '[^\pL\pM\pN_]+', ' ', 'g'), ' '), lambda w: w <> ''))"
GOLD_MAPPING_VARIANTS = f"""WITH {CHUNK_SQL}, {GOLD_SQL}, r AS (SELECT p.query_id, k.doc_id, k.pos, k.chunk_id, k.text, lower(trim(b.text)) AS g, lower(k.text) AS c, b.text AS passage,
  (SELECT string_agg(z.text, chr(10) ORDER BY z.pos) FROM chunk z WHERE z.doc_id = k.doc_id AND z.pos // 5 = k.pos // 5) AS parent FROM gold p JOIN benchmark b ON b.item_id = p.query_id JOIN chunk k ON k.doc_id = p.chunk_id),
h AS (SELECT *, least(100, length(g) // 2) AS half, {_WORDS.format(x="substr(passage, 1, 80)")} AS asked, {_WORDS.format(x="text")} AS own FROM r),
f AS (SELECT query_id, doc_id, pos, chunk_id, contains(c, g) OR contains(lower(parent), g) AS contained, contains(c, g) OR contains(g, c) OR (length(g) >= 40 AND half >= 30 AND (contains(c, substr(g, 1, half)) OR contains(c, right(g, half)))) AS ends,
  len(list_intersect(asked, own)) >= least(len(asked), 3) AS shared FROM h),
m AS (SELECT *, NOT max(shared) OVER w AND pos = min(pos) OVER w AS fallback FROM f WINDOW w AS (PARTITION BY query_id, doc_id))
SELECT query_id, chunk_id, contained, ends, shared, fallback FROM m WHERE contained OR ends OR shared OR fallback"""


def failure_taxonomy_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The second taxonomy, of a question's first gold hit in the fused pool, the budget and the reranked list."""
    lists = Lists(spark, d)
    first = lambda df, name: df.join(lists.gold, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias(name))
    rows = lists.questions.select("query_id").join(lists.gold.select("query_id").distinct(), "query_id", "left_semi")
    rows = rows.join(first(lists.fused, "pool"), "query_id", "left").join(first(lists.capped.filter("rank <= 20"), "budget"), "query_id", "left").join(first(lists.hybrid(), "final"), "query_id", "left")
    late = F.col("final").isNull() | (F.col("final") > 5)
    label = (
        F.when(F.col("final") <= 5, "NONE_HIT_TOP5").when(F.col("pool").isNull(), "NOT_FOUND_SCOPED_FIRST_STAGE").when(F.col("budget").isNull(), "LOST_BY_BUDGET")
        .when(F.col("final") <= 10, "TOP10_NOT_TOP5").when((F.col("budget") <= 5) & late, "RERANKER_DEMOTED").otherwise("OTHER")
    )
    return rows.select("query_id", label.alias("label"))


FAILURE_TAXONOMY_SCOPED = f"""WITH {FUSED_SQL}, {GOLD_SQL}, {CAP_SQL}, {RERANK_SQL}, f AS (SELECT item_id AS query_id, (SELECT min(rank) FROM fu JOIN gold USING (query_id, chunk_id) WHERE query_id = item_id) AS pool,
  (SELECT min(rank) FROM pc JOIN gold USING (query_id, chunk_id) WHERE query_id = item_id AND rank <= 20) AS budget, (SELECT min(rank) FROM rr JOIN gold USING (query_id, chunk_id) WHERE query_id = item_id AND rank <= 10) AS final FROM benchmark WHERE item_id IN (SELECT query_id FROM gold))
SELECT query_id, CASE WHEN final <= 5 THEN 'NONE_HIT_TOP5' WHEN pool IS NULL THEN 'NOT_FOUND_SCOPED_FIRST_STAGE' WHEN budget IS NULL THEN 'LOST_BY_BUDGET' WHEN final <= 10 THEN 'TOP10_NOT_TOP5' WHEN budget <= 5 THEN 'RERANKER_DEMOTED' ELSE 'OTHER' END AS label FROM f"""


def first_risk_hits(spark: SparkSession, d: str) -> DataFrame:
    """The first eight rule hits of every source's documents, in order of document and rule: what a review goes on with."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("clause_id"), "text", "source")
    hits = risk.scan(docs, risk.rules_table(spark)).join(docs.select("clause_id", "source"), "clause_id")
    return risk.first_hits(hits, "source", 8, "clause_id", "rule_no").select("source", F.col("nth").cast("int").alias("nth"), F.col("clause_id").alias("doc_id"), "rule_id")


_NUMBERS = "[" + ", ".join(f"'{r.rule_id}'" for r in risk.RULES) + "]"
FIRST_RISK_HITS = f"""WITH {SCAN_SQL}, h AS (SELECT source, doc_id, rule_id, row_number() OVER (PARTITION BY source ORDER BY doc_id, list_position({_NUMBERS}, rule_id))::INT AS nth FROM ru JOIN documents ON doc_id = -1 - clause_id WHERE clause_id < 0)
SELECT source, nth, doc_id, rule_id FROM h WHERE nth <= 8"""


def facet_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of the facets that each document addresses with one of their longer words."""
    facets = F.array(*[F.lit(f) for _, f in FACETS.rows])
    return table(spark, d, "documents").select("doc_id", F.round(evaluation.facet_coverage(F.col("text"), facets), 6).alias("coverage"))


FACET_COVERAGE = f"""SELECT doc_id, round(len(list_filter([{", ".join("'" + f + "'" for _, f in FACETS.rows)}], lambda f: len(list_filter(string_split(f, ' '), lambda w: length(w) > 3 AND contains(lower(text), w))) > 0)) / {len(FACETS.rows)}::DOUBLE, 6) AS coverage FROM documents"""

CATEGORIES = (("the", "Common"), ("licen", "Licence"), ("of", "Part"), ("who", "Person"), ("what", "Thing"))


def question_categories(spark: SparkSession, d: str) -> DataFrame:
    """The first category whose word a user's turn holds, in the order of the list; General without one."""
    turns = table(spark, d, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", answering.category(F.col("text"), CATEGORIES).alias("category"))


QUESTION_CATEGORIES = "SELECT conv_id, turn, CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{c}'" for w, c in CATEGORIES) + " ELSE 'General' END AS category FROM conversations WHERE role = 'user'"


def _variant_metrics(spark: SparkSession, d: str, texts: dict[str, Column]) -> DataFrame:
    """Retrieval metrics of the same questions over the documents in different forms."""
    lists = Lists(spark, d)
    docs = table(spark, d, "documents")
    out = None
    for name, text in texts.items():
        found = bm25.search(lists.questions, docs.select(F.lit("all").alias("scope"), F.col("doc_id").alias("chunk_id"), text.alias("text")), 20)
        own = evaluation.summary(evaluation.per_query(found, lists.gold, lists.questions, (5, 20))).select(F.lit(name).alias("form"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def _form_sql(name: str, chunk: str) -> str:
    return f"""SELECT '{name}' AS form, * FROM (WITH chunk AS ({chunk}), {ASK_SQL}, {SCORE_SQL}, {POSITIVE_SQL}, {GOLD_SQL},
sp AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM sp0 WHERE score > 0) WHERE rank <= 20)
SELECT {SUMMARY} FROM {metric_sql("sp", (5, 20))} GROUP BY k)"""


_PLAIN = "SELECT 'all' AS scope, doc_id AS chunk_id, {x} AS text FROM documents"


def sac_compare(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval with and without the summary context before each document."""
    text = F.col("text")
    return _variant_metrics(spark, d, {"plain": text, "with_context": F.concat_ws("\n", summary_context(F.col("source"), text), text)})


SAC_COMPARE = _form_sql("plain", _PLAIN.format(x="text")) + " UNION ALL " + _form_sql("with_context", f"SELECT 'all' AS scope, doc_id AS chunk_id, context || chr(10) || text AS text FROM documents JOIN ({SAC_CONTEXT}) USING (doc_id)")


def format_invariance(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval over the same documents as plain lines, under a Markdown heading, and as the leaves of a JSON list."""
    text = F.col("text")
    leaves = F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.lit("**root.["), i.cast("string"), F.lit("]**: "), x)), "\n")
    return _variant_metrics(spark, d, {"txt": text, "md": F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), text), "json": leaves})


FORMAT_INVARIANCE = " UNION ALL ".join((
    _form_sql("txt", _PLAIN.format(x="text")),
    _form_sql("md", _PLAIN.format(x="'# ' || source || chr(10) || chr(10) || text")),
    _form_sql("json", _PLAIN.format(x="array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: '**root.[' || (i - 1) || ']**: ' || x), chr(10))")),
))


def paragraph_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown: a blank line after every third line ends a paragraph, and every seventh line is a heading."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.when(F.col("at") % 7 == 0, F.concat(F.lit("## "), F.col("line"))).otherwise(F.col("line"))
    wide = rows.select("doc", (2 * F.col("at")).alias("pos"), line.alias("line")).unionAll(rows.filter("at % 3 = 2").select("doc", (2 * F.col("at") + 1).alias("pos"), F.lit("").alias("line")))
    return markdown_paragraphs(wide).select("doc", "pos", "kind", F.md5("text").alias("text_md5"), F.md5(F.array_join("section_path", " > ")).alias("section_md5"))


PARAGRAPH_BLOCKS = r"""WITH l AS (SELECT doc_id::VARCHAR AS doc, unnest(range(len(s))) AS n, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
w AS (SELECT doc, 2 * n AS pos, CASE WHEN n % 7 = 0 THEN '## ' || line ELSE line END AS line FROM l UNION ALL SELECT doc, 2 * n + 1, '' FROM l WHERE n % 3 = 2),
h AS (SELECT *, regexp_matches(line, '^(#{1,6})\s+(.*)') AS heading, length(regexp_extract(line, '^(#{1,6})\s+(.*)', 1)) AS level, trim(regexp_extract(line, '^(#{1,6})\s+(.*)', 2)) AS title, trim(line) = '' AS blank FROM w),
p AS (SELECT *, lag(heading OR blank, 1, true) OVER o AS after, last_value(CASE WHEN level = 1 THEN pos END IGNORE NULLS) OVER o AS p1, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER o AS t1,
  last_value(CASE WHEN level = 2 THEN pos END IGNORE NULLS) OVER o AS p2, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER o AS t2 FROM h WINDOW o AS (PARTITION BY doc ORDER BY pos)),
g AS (SELECT *, sum(CASE WHEN heading OR (NOT blank AND after) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS no FROM p WHERE NOT blank),
b AS (SELECT doc, no, min(pos)::INT AS pos, CASE WHEN max(heading) THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN max(heading) THEN max(title) ELSE string_agg(line, chr(10) ORDER BY pos) END AS text,
  arg_min(array_to_string(list_filter([t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END], lambda x: x IS NOT NULL), ' > '), pos) AS section FROM g GROUP BY doc, no)
SELECT doc, pos, kind, md5(text) AS text_md5, md5(section) AS section_md5 FROM b"""

NAMES = (
    "lenient_decisions strict_rescoring f1_copies gold_mapping_variants failure_taxonomy_scoped first_risk_hits facet_coverage question_categories sac_compare format_invariance paragraph_blocks"
).split()
QUERIES = {n: (globals()[n], globals()[n.upper()]) for n in NAMES}
