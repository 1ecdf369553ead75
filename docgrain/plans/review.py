"""Queries: risk review, comparison, access, routing, jobs and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Fixture
from ..functions.text import tokens
from ..operators import access, answering, evaluation, risk
from ..session import table
from ..streaming import jobs
from .common import tok_sql

CLAUSES = Fixture(
    "clause_id int, text string",
    (
        (1, "The penalty is 10% of the value."), (2, "Penalty of 8% applies."), (3, "The penalty shall not exceed 8% though 20% was asked."), (4, "Mức phạt 12% giá trị hợp đồng."), (5, "Phạt tối đa 8% giá trị."), (6, "A fee of 20% applies."),
        (7, "Either party gives 90 days prior written notice."), (8, "A 30 days notice is enough."), (9, "Thông báo trước 61 ngày."), (10, "Notice of 60 days."), (11, "The supplier accepts UNLIMITED LIABILITY."), (12, "Bên A chịu trách nhiệm vô hạn."),
        (13, "This agreement renews; automatic renewal applies."), (14, "Governed by the laws of England."), (15, "Nothing to see."), (16, ""), (17, "The seller may modify the price list at any time, and shall indemnify and hold harmless the buyer."), (18, "Payment in USD. The parties shall not compete."),
    ),
)


def risk_rules_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rules met by the clauses and by all documents (their ids below zero)."""
    docs = table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("clause_id"), "text")
    every = CLAUSES.df(spark).select(F.col("clause_id").cast("long").alias("clause_id"), "text").unionByName(docs)
    return risk.scan(every, risk.rules_table(spark)).select("clause_id", "rule_id", "severity")


def _rule_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    out = []
    for r in risk.RULES:
        if r.kind == "penalty":
            cond = r"regexp_matches(text, '(?i)(phạt|penalty|penalties)') AND NOT regexp_matches(text, '(?i)(không vượt quá|tối đa|not exceed(ing)?|maximum of)\s*8\s*%') AND len(list_filter(regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*%', 1), lambda x: x::DOUBLE > 8)) > 0"
        elif r.kind == "notice":
            cond = "len(list_filter(list_concat(" + ", ".join(f"regexp_extract_all(text, {q(p.replace('(?iu)', '(?i)'))}, 1)" for p in risk.NOTICE) + "), lambda x: x::INT > 60)) > 0"
        else:
            cond = " OR ".join([f"regexp_matches(lower(text), {q(p)})" for p in r.patterns] + [f"contains(lower(text), {q(k.lower())})" for k in r.keywords])
        out.append(f"SELECT clause_id, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity FROM cl WHERE {cond}")
    return " UNION ALL ".join(out)


SCAN_SQL = f"cl AS (SELECT clause_id::BIGINT AS clause_id, text FROM {CLAUSES.sql()} UNION ALL SELECT -1 - doc_id, text FROM documents), ru AS ({_rule_sql()})"
RISK_RULES_SCAN = f"WITH {SCAN_SQL} SELECT clause_id, rule_id, severity FROM ru"


def risk_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Findings and the gravest severity of each clause, low where nothing is found."""
    clauses = CLAUSES.df(spark)
    found = risk.scan(clauses, risk.rules_table(spark))
    rows = clauses.select("clause_id").join(found, "clause_id", "left")
    return rows.groupBy("clause_id").agg(F.count("rule_id").alias("n_findings"), risk.overall(F.col("severity")).alias("severity"))


RISK_ROLLUP = f"""WITH {SCAN_SQL} SELECT c.clause_id, count(rule_id) AS n_findings, coalesce(list_extract(['low', 'medium', 'high', 'critical'], max(list_position(['low', 'medium', 'high', 'critical'], severity))), 'low') AS severity
FROM {CLAUSES.sql()} c LEFT JOIN ru ON ru.clause_id = c.clause_id GROUP BY c.clause_id"""

FACETS = Fixture("facet_no int, facet string", ((0, "the of and to"), (1, "que les des"), (2, "licensed under"), (3, "und der die"), (4, "thing that")))


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """pair, a, b: every two documents whose ids follow one another, and every seventh document with itself."""
    ids = table(spark, d, "documents").select("doc_id")
    two = ids.filter("doc_id % 2 = 0").select(F.floor(F.col("doc_id") / 2).alias("pair"), F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return two.unionByName(ids.filter("doc_id % 7 = 0").select((-1 - F.col("doc_id")).alias("pair"), F.col("doc_id").alias("a"), F.col("doc_id").alias("b")))


def facet_compare(spark: SparkSession, d: str) -> DataFrame:
    """Each facet's best line in both documents of a pair, by shared words, side by side."""
    facets = FACETS.df(spark).select("facet_no", tokens(F.col("facet")).alias("f"))
    pairs = _sides(spark, d)
    sides = pairs.select("pair", F.explode(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))).alias("side", "doc_id"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", tokens(F.col("line")).alias("t"))
    # a document's best lines are found once, however many pairs it is in; the facets are a handful of literals
    hits = lines.join(F.broadcast(facets)).select("doc_id", "facet_no", "pos", F.size(F.array_intersect("f", "t")).alias("score")).filter("score > 0")
    best = hits.groupBy("doc_id", "facet_no").agg(F.max(F.struct("score", (-F.col("pos")).alias("neg"))).alias("m"))
    wide = sides.join(best, "doc_id").groupBy("pair", "facet_no").pivot("side", ["a", "b"]).agg(F.first("m"))
    base = pairs.select("pair").join(F.broadcast(FACETS.df(spark).select("facet_no")))
    rows = base.join(wide, ["pair", "facet_no"], "left")
    status = F.when(F.col("a").isNull() & F.col("b").isNull(), "missing").when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both")
    return rows.select("pair", "facet_no", (-F.col("a.neg")).alias("pos_a"), F.col("a.score").alias("score_a"), (-F.col("b.neg")).alias("pos_b"), F.col("b.score").alias("score_b"), status.alias("status"))


FACET_COMPARE = f"""WITH f AS (SELECT facet_no, {tok_sql('facet')} AS f FROM {FACETS.sql()}),
s0 AS (SELECT doc_id // 2 AS pair, doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT -1 - doc_id, doc_id, doc_id FROM documents WHERE doc_id % 7 = 0),
l AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
t AS (SELECT doc_id, pos, {tok_sql('line')} AS t FROM l), h AS (SELECT doc_id, facet_no, pos, len(list_intersect(f, t)) AS score FROM t, f),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, facet_no ORDER BY score DESC, pos) AS n FROM h WHERE score > 0), o AS (SELECT * FROM b WHERE n = 1)
SELECT p.pair, g.facet_no, x.pos::INT AS pos_a, x.score::INT AS score_a, y.pos::INT AS pos_b, y.score::INT AS score_b, CASE WHEN x.pos IS NULL AND y.pos IS NULL THEN 'missing' WHEN x.pos IS NULL THEN 'only_b' WHEN y.pos IS NULL THEN 'only_a' ELSE 'both' END AS status
FROM s0 p CROSS JOIN f g LEFT JOIN o x ON x.doc_id = p.a AND x.facet_no = g.facet_no LEFT JOIN o y ON y.doc_id = p.b AND y.facet_no = g.facet_no"""


def planner_route(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", answering.route(F.col("text"), F.col("conv_id") % 3).alias("p")).select("conv_id", "turn", "p.*")


def _any(words: tuple[str, ...]) -> str:
    return "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(lower(text), w))) > 0"


PLANNER_ROUTE = rf"""SELECT conv_id, turn, p.task AS task, p.candidate_k AS candidate_k, p.final_k AS final_k FROM (SELECT conv_id, turn, CASE
 WHEN len(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) <= 6 AND {_any(answering.GREETINGS)} THEN {{'task': 'conversational', 'candidate_k': 15, 'final_k': 5}}
 WHEN {_any(answering.COMPARE)} AND conv_id % 3 > 1 THEN {{'task': 'comparison', 'candidate_k': 25, 'final_k': 8}} ELSE {{'task': 'single_document_qa', 'candidate_k': 20, 'final_k': 5}} END AS p FROM conversations WHERE role = 'user')"""

ROLES = ("finance", "hr", "*", "legal")


def _grants(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, role, allow_read: made-up grants for every third document."""
    own = table(spark, d, "documents").filter("doc_id % 3 = 0").select("doc_id")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("doc_id") % 4 + 1).cast("int"))
    one = own.select("doc_id", role.alias("role"), (F.col("doc_id") % 5 != 0).alias("allow_read"))
    return one.unionByName(own.select("doc_id", F.lit("finance").alias("role"), (F.col("doc_id") % 7 == 0).alias("allow_read")))


GRANTS_SQL = f"(SELECT doc_id, {list(ROLES)}[(doc_id % 4 + 1)::INT] AS role, doc_id % 5 <> 0 AS allow_read FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'finance', doc_id % 7 = 0 FROM documents WHERE doc_id % 3 = 0)"


def acl_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return access.accessible(docs, _grants(spark, d), "finance")


ACL_DOCUMENTS = f"SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM {GRANTS_SQL} WHERE role IN ('finance', '*') AND allow_read)"


def acl_denied(spark: SparkSession, d: str) -> DataFrame:
    """Ids that a request for all documents and some that don't exist isn't granted."""
    docs = table(spark, d, "documents")
    asked = docs.select("doc_id").union(spark.range(10**9, 10**9 + 3).toDF("doc_id"))
    return access.denied(asked, access.accessible(docs, _grants(spark, d), "finance"))


ACL_DENIED = f"""SELECT doc_id FROM (SELECT doc_id FROM documents UNION ALL SELECT unnest([1000000000, 1000000001, 1000000002])) WHERE doc_id NOT IN (SELECT doc_id FROM {GRANTS_SQL} WHERE role IN ('finance', '*') AND allow_read)"""


def conversation_last_message(spark: SparkSession, d: str) -> DataFrame:
    """The last message of each conversation, its made-up user, and its title from its first message."""
    own = table(spark, d, "conversations").withColumn("username", F.concat(F.lit("u"), (F.col("conv_id") % 4).cast("string")))
    first = own.groupBy("conv_id", "username").agg(answering.short_title(F.min_by("text", "turn")).alias("title"), F.count("*").alias("n_turns"))
    last = access.last_rows(own, "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))
    return last.join(first, "conv_id")


CONVERSATION_LAST_MESSAGE = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations),
f AS (SELECT conv_id, arg_min(text, turn) AS t, count(*) AS n_turns FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, role, length(text) AS n_chars, 'u' || (conv_id % 4) AS username, CASE WHEN length(t) > 45 THEN substr(t, 1, 45) || '...' ELSE t END AS title, n_turns FROM l JOIN f USING (conv_id) WHERE n = 1"""


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = F.array(F.col("item_id") % 5, F.col("item_id") % 3, F.lit(7)).cast("array<string>")
    rows = table(spark, d, "benchmark").select("item_id", "text", docs.alias("docs"))
    return rows.select("item_id", answering.scope_key(F.lit("t1"), F.lit("u1"), F.col("docs")).alias("scope_key"), answering.query_key(F.col("text")).alias("query_key"))


CACHE_KEYS = """SELECT item_id, substr(sha256('t1|u1|' || array_to_string(list_sort(list_distinct([(item_id % 5)::VARCHAR, (item_id % 3)::VARCHAR, '7'])), ',')), 1, 24) AS scope_key, md5(lower(trim(text))) AS query_key FROM benchmark"""


def percentiles_linear(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.percentiles(table(spark, d, "events"), "event_type", "value", (0.5, 0.95, 0.99))
    return rows.select("event_type", F.round("p0", 6).alias("p50"), F.round("p1", 6).alias("p95"), F.round("p2", 6).alias("p99"), "n")


PERCENTILES_LINEAR = "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM events GROUP BY event_type"


def percentiles_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Latency percentiles by place in the sorted values."""
    rows = evaluation.percentiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", (0.5, 0.95), linear=False)
    return rows.select("l_returnflag", F.col("p0").alias("p50"), F.col("p1").alias("p95"))


PERCENTILES_NEAREST = """WITH r AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(l_extendedprice) FILTER (WHERE i = least(floor(n * 0.5::DOUBLE), n - 1)) AS p50, max(l_extendedprice) FILTER (WHERE i = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95 FROM r GROUP BY l_returnflag"""


def job_state_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest state of each job, users standing for jobs and event types for states."""
    return jobs.latest_state(table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("state"), "ts", F.col("event_id").alias("seq")))


JOB_STATE_LATEST = "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS ts, count(*) AS n_events FROM events GROUP BY user_id"


def rpm_windows(spark: SparkSession, d: str) -> DataFrame:
    """Requests in fixed windows of 60 seconds, and whether they stay within a limit of two."""
    return jobs.rate_windows(table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts")), "60 seconds", 2).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "within")


RPM_WINDOWS = "SELECT date_trunc('minute', ts) AS start, count(*) AS n, count(*) <= 2 AS within FROM events GROUP BY ALL"


def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of failed calls (values in the lower part) of each user that would open a circuit of length three."""
    calls = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") < 20).alias("failed"))
    return jobs.failure_streaks(calls, "user_id", ["ts", "event_id"], 3)


FAILURE_STREAKS = """WITH c AS (SELECT user_id, ts, event_id, value < 20 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, failed ORDER BY ts, event_id) AS grp FROM c)
SELECT user_id, min(n)::INT AS first, count(*) AS length FROM g WHERE failed GROUP BY user_id, grp HAVING count(*) >= 3"""

NAMES = (
    "risk_rules_scan risk_rollup facet_compare planner_route acl_documents acl_denied conversation_last_message cache_keys percentiles_linear percentiles_nearest job_state_latest rpm_windows failure_streaks"
).split()
QUERIES = {n: (globals()[n], globals()[n.upper()]) for n in NAMES}
