"""Queries: parsing and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Fixture
from ..functions import text as tx
from ..operators import chunking
from ..session import table
from ..sources import sinks
from ..sources.semi import json_leaves, strip_html
from .common import CHUNK_SQL


def blocks_from_lines(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_chunks(table(spark, d, "documents"), "source").select("doc_id", "pos", "chunk_id", F.length("text").cast("long").alias("n_chars"), F.array("source").alias("section_path"))


BLOCKS_FROM_LINES = f"WITH {CHUNK_SQL} SELECT doc_id, pos::INT AS pos, chunk_id, length(text) AS n_chars, [source] AS section_path FROM chunk"

MD = Fixture(
    "doc string, pos int, line string",
    (
        ("a", 0, "intro before any heading"), ("a", 1, "# One"), ("a", 2, "text one"), ("a", 3, ""), ("a", 4, "### One deep"), ("a", 5, "skips a level"), ("a", 6, "## One two"), ("a", 7, "```"), ("a", 8, "# not a heading"),
        ("a", 9, "```"), ("a", 10, "after code"), ("a", 11, "# Two"), ("a", 12, "#### Two deep"), ("a", 13, "tail"), ("b", 0, "## Starts at two"), ("b", 1, "x"), ("b", 2, "# Top"), ("b", 3, "```py"), ("b", 4, "never closed"),
        ("c", 0, "#nospace"), ("c", 1, "####### seven"), ("c", 2, "# A"), ("c", 3, "## B"), ("c", 4, "## C"), ("c", 5, "end"),
    ),
)


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.markdown_sections(MD.df(spark)).select("doc", "pos", "kind", F.array_join("section_path", " > ").alias("section"))


_LAST = ", ".join(f"last_value(CASE WHEN level = {k} THEN pos END IGNORE NULLS) OVER w AS p{k}, last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 7))
_OPEN = ", ".join(f"CASE WHEN p{k} IS NOT NULL" + "".join(f" AND p{k} > coalesce(p{j}, -1)" for j in range(1, k)) + f" THEN t{k} END" for k in range(1, 7))
MARKDOWN_SECTIONS = rf"""WITH l AS (SELECT *, starts_with(line, '```')::INT AS fence FROM {MD.sql()}),
f AS (SELECT *, sum(fence) OVER (PARTITION BY doc ORDER BY pos) AS n, sum(fence) OVER (PARTITION BY doc) AS total FROM l),
g AS (SELECT *, n % 2 = 1 OR fence = 1 AS code FROM f WHERE NOT (total % 2 = 1 AND n = total)),
h AS (SELECT *, CASE WHEN NOT code THEN length(regexp_extract(line, '^(#{{1,6}})\s+(.*)', 1)) ELSE 0 END AS level, trim(regexp_extract(line, '^(#{{1,6}})\s+(.*)', 2)) AS title FROM g),
s AS (SELECT *, {_LAST} FROM h WINDOW w AS (PARTITION BY doc ORDER BY pos))
SELECT doc, pos, CASE WHEN code THEN 'code' WHEN level > 0 THEN 'heading' ELSE 'paragraph' END AS kind, array_to_string(list_filter([{_OPEN}], lambda x: x IS NOT NULL), ' > ') AS section FROM s WHERE code OR trim(line) <> ''"""


def json_leaf_blocks(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("json"))
    return json_leaves(events).select("id", "path", "value", F.concat(F.lit("**"), "path", F.lit("**: "), "value").alias("text"))


JSON_LEAF_BLOCKS = """SELECT event_id AS id, 'root.' || k AS path, v AS value, '**root.' || k || '**: ' || v AS text
FROM (SELECT event_id, k, json_extract_string(props, '$.' || k) AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events))"""

BLOCKS = Fixture(
    "doc_id int, pos int, text string",
    ((1, 0, "preface"), (1, 1, "Article 1"), (1, 2, "body one"), (1, 3, "2. Payment terms"), (1, 4, "2. Payment terms\nof three\nlines"), (1, 5, "body two"), (2, 0, "body of two"), (2, 1, "section nine"), (2, 2, "Part of a sentence that goes on and on, well past the length that a heading may have, so that it is not one at all, no way."), (2, 3, "x")),
)


def carry_forward_heading(spark: SparkSession, d: str) -> DataFrame:
    return chunking.carry_heading(BLOCKS.df(spark)).select("doc_id", "pos", "is_heading", "section")


CARRY_FORWARD_HEADING = rf"""WITH h AS (SELECT *, len(string_split(text, chr(10))) <= 2 AND length(text) < 120 AND regexp_matches(text, '(?i)^(Article|Section|Clause|Chapter|Part|\d+\.|\d+\.\d+)') AS is_heading FROM {BLOCKS.sql()})
SELECT doc_id, pos, is_heading, last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h"""


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return cut.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


SENT = r"list_filter(list_transform(string_split(regexp_replace({x}, '([.;:])\s+([A-Z0-9(\[])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
SENTENCE_SPLIT = f"SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, {SENT.format(x='text')} AS s FROM documents)"
TOKENS = r"greatest(1, floor(len(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')) * 1.33::DOUBLE)::INT)"


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


TOKEN_ESTIMATE = f"SELECT doc_id, {TOKENS.format(x='text')} AS tokens FROM documents"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    own = chunking.line_chunks(table(spark, d, "documents"))
    return own.select("doc_id", "pos", tx.token_estimate(F.col("text")).alias("tokens"), F.concat(F.lit("s"), F.floor(F.col("pos") / 5).cast("string")).alias("top"))


def parent_chunks(spark: SparkSession, d: str) -> DataFrame:
    groups = chunking.parent_groups(_blocks(spark, d), 200).join(_blocks(spark, d), ["doc_id", "pos"])
    return groups.groupBy("doc_id", "parent_no").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n_blocks"), F.sum("tokens").alias("tokens"))


PARENT_CHUNKS = f"""WITH RECURSIVE {CHUNK_SQL}, b AS (SELECT doc_id, pos, {TOKENS.format(x='text')} AS tokens, 's' || (pos // 5) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM chunk),
g AS (SELECT doc_id, n, pos, tokens, top, 0 AS parent_no, tokens::BIGINT AS total FROM b WHERE n = 1 UNION ALL
  SELECT b.doc_id, b.n, b.pos, b.tokens, b.top, CASE WHEN g.total + b.tokens > 200 OR g.top <> b.top THEN parent_no + 1 ELSE parent_no END, CASE WHEN g.total + b.tokens > 200 OR g.top <> b.top THEN b.tokens ELSE g.total + b.tokens END
  FROM g JOIN b ON b.doc_id = g.doc_id AND b.n = g.n + 1)
SELECT doc_id, parent_no, min(pos)::INT AS first, max(pos)::INT AS last, count(*) AS n_blocks, sum(tokens)::BIGINT AS tokens FROM g GROUP BY ALL"""


def child_chunks(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "documents").select(F.col("doc_id").alias("parent_id"), F.posexplode(tx.sentences(F.col("text"))).alias("pos", "s"))
    return chunking.child_ranges(said.select("parent_id", "pos", tx.token_estimate(F.col("s")).alias("tokens")), 60, 12)


CHILD_CHUNKS = f"""WITH RECURSIVE s AS (SELECT doc_id AS p, list_transform({SENT.format(x='text')}, lambda x: {TOKENS.format(x='x')}) AS t FROM documents),
c AS (SELECT p, t, list_concat([0], list_transform(range(1, len(t) + 1), lambda i: list_sum(t[1:i]))) AS cum FROM s WHERE len(t) > 0),
w AS (SELECT p, 0 AS i, 0 AS s, NULL::INT AS a, NULL::INT AS z FROM c UNION ALL
  SELECT w.p, w.i + 1, CASE WHEN w.i > w.s AND cum[w.i + 1] - cum[w.s + 1] + t[w.i + 1] > 60 THEN greatest(w.s, len(list_filter(cum, lambda x: x < cum[w.i + 1] - 12))) ELSE w.s END,
    CASE WHEN w.i > w.s AND cum[w.i + 1] - cum[w.s + 1] + t[w.i + 1] > 60 THEN w.s END, CASE WHEN w.i > w.s AND cum[w.i + 1] - cum[w.s + 1] + t[w.i + 1] > 60 THEN w.i - 1 END
  FROM w JOIN c USING (p) WHERE w.i < len(t)),
e AS (SELECT p, a, z FROM w WHERE a IS NOT NULL UNION ALL SELECT w.p, w.s, w.i - 1 FROM w JOIN c USING (p) WHERE w.i = len(t))
SELECT p AS parent_id, (row_number() OVER (PARTITION BY p ORDER BY z) - 1)::INT AS child_no, a::INT AS first, z::INT AS last FROM e"""

PAGES = Fixture("page int, area double, chars int, odd double, images int", ((1, 0.0, 500, 0.0, 0), (2, 10.0, 39, 0.0, 0), (3, 10.0, 40, 0.16, 0), (4, 10.0, 149, 0.15, 1), (5, 10.0, 150, 0.0, 1), (6, 10.0, 149, 0.0, 0)))


def ocr_gate(spark: SparkSession, d: str) -> DataFrame:
    return PAGES.df(spark).select("page", chunking.ocr_gate(*map(F.col, ("area", "chars", "odd", "images"))).alias("gate"))


OCR_GATE = f"SELECT page, CASE WHEN area <= 0 THEN 'no_area' WHEN chars < 40 THEN 'few_chars' WHEN odd > 0.15 THEN 'unprintable' WHEN images >= 1 AND chars < 150 THEN 'image_with_little_text' ELSE 'native' END AS gate FROM {PAGES.sql()}"


def enriched_text(spark: SparkSession, d: str) -> DataFrame:
    own = chunking.line_chunks(table(spark, d, "documents"), "source", "lang")
    path = F.when(F.col("pos") % 3 == 0, F.array()).otherwise(F.array("source", "lang"))
    return own.select("chunk_id", F.md5(tx.enriched(F.concat_ws("_", "source", "lang"), path, F.col("text"))).alias("text_md5"))


ENRICHED_TEXT = f"""WITH {CHUNK_SQL} SELECT chunk_id, md5('[Document: ' || c.source || ' ' || lang || '] [Section: ' || CASE WHEN pos % 3 = 0 THEN 'General' ELSE c.source || ' > ' || lang END || ']' || chr(10) || c.text) AS text_md5
FROM chunk c JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)"""


def sac_context(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.summary_context(F.col("source"), F.col("text")).alias("context"))


SAC_CONTEXT = r"""SELECT doc_id, substr(CASE WHEN ag = '' THEN 'Agreement' ELSE ag END || ' | ' || source || ' | ' || array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:50], ' '), 1, 120) AS context
FROM (SELECT *, regexp_extract(text, '([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+){0,3} (?:Agreement|Contract))', 1) AS ag FROM documents)"""


def section_json(spark: SparkSession, d: str) -> DataFrame:
    """Every document as one JSON object: its title and its lines in order by section, a made-up one for every five lines."""
    lines = chunking.line_chunks(table(spark, d, "documents"), F.col("source").alias("title"))
    return sinks.section_json(lines.withColumn("section", F.when(F.col("pos") % 10 < 5, F.concat(F.lit("s"), F.floor(F.col("pos") / 5).cast("string")))))


SECTION_JSON = f"""WITH {CHUNK_SQL}, b AS (SELECT doc_id, source, pos, CASE WHEN pos % 10 < 5 THEN 's' || (pos // 5) ELSE 'general' END AS section, text FROM chunk),
s AS (SELECT doc_id, source, section, to_json(section) || ':' || to_json(list(text ORDER BY pos)) AS part FROM b GROUP BY doc_id, source, section)
SELECT doc_id, '{{"title":' || to_json(source) || ',"sections":{{' || string_agg(part, ',' ORDER BY section) || '}}}}' AS json FROM s GROUP BY doc_id, source"""


def html_text(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    text = strip_html(F.col("html"))
    return pages.select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


HTML_TEXT = r"""SELECT page_id, title, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS t FROM pages)"""


def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    """Parents and children that whole documents are cut to, by source."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("section"))
    parents, children = chunking.chunk_documents(docs)
    count = lambda df, name: df.select(F.element_at("section_path", 1).alias("source"), "token_count").groupBy("source").agg(F.count("*").alias(name), F.sum("token_count").alias(f"{name}_tokens"))
    return count(parents, "parents").join(count(children, "children"), "source")


NAMES = "blocks_from_lines markdown_sections json_leaf_blocks carry_forward_heading sentence_split token_estimate parent_chunks child_chunks ocr_gate enriched_text sac_context section_json html_text".split()
QUERIES = {n: (globals()[n], globals()[n.upper()]) for n in NAMES} | {"chunk_summary": (chunk_summary, None)}
