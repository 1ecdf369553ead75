"""Rule-based clause review."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEVERITIES = ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    severity: str
    patterns: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    threshold: int | None = None
    default_enabled: bool = True
    kind: str = field(default="words")  # words, penalty or notice


#: Own seed rules, in English and Vietnamese; a caller may pass any others.
RULES = (
    Rule("UNLIMITED_LIABILITY", "Unlimited liability", "critical", (r"unlimited liability", r"liability (?:shall|will) (?:be unlimited|not be limited)"), ("trách nhiệm vô hạn", "without any limit of liability")),
    Rule("EXCESSIVE_PENALTY", "Penalty over 8 %", "critical", kind="penalty", threshold=8),
    Rule("FOREIGN_CURRENCY", "Payment in foreign currency", "critical", (r"pay(?:able|ment|ments)? (?:in|by) (?:usd|eur|us dollars?)",), ("thanh toán bằng ngoại tệ",)),
    Rule("DATA_PRIVACY", "Personal data without consent", "high", (r"(?:share|transfer|sell)s? (?:the )?personal data",), ("dữ liệu cá nhân",)),
    Rule("BROAD_IP_TRANSFER", "Broad transfer of intellectual property", "critical", (r"assigns? all (?:right|intellectual property)",), ("chuyển giao toàn bộ quyền sở hữu trí tuệ",)),
    Rule("ONE_SIDED_INDEMNITY", "One-sided indemnity", "high", (r"shall indemnify and hold harmless",), ("bồi thường toàn bộ",)),
    Rule("AUTO_RENEWAL", "Automatic renewal", "medium", (r"automatic(?:ally)? renew(?:s|ed|al)?",), ("tự động gia hạn",)),
    Rule("LONG_NOTICE", "Notice over 60 days", "high", kind="notice", threshold=60),
    Rule("NO_CONVENIENCE", "No termination for convenience", "medium", (r"(?:may|shall) not terminate (?:this agreement )?for convenience",), ("không được đơn phương chấm dứt",)),
    Rule("NON_COMPETE", "Non-compete", "high", (r"non-?compete", r"shall not compete"), ("không cạnh tranh",)),
    Rule("GOVERNING_LAW", "Foreign governing law", "high", (r"governed by the laws of (?:england|singapore|new york)",), ("luật áp dụng là luật nước ngoài",)),
    Rule("UNILATERAL_CHANGE", "Unilateral modification", "high", (r"(?:may|reserves the right to) (?:modify|amend|change) .{0,40}at any time",), ("đơn phương sửa đổi",)),
    Rule("LICENCE_NOTICE", "Licence notice", "low", (r"licen[sc]ed under",), ("mit license", "general public license")),
)

# Wordings that say the cap of 8 % is kept, which clear a clause as a whole.
KEPT = r"(?iu)(?:không vượt quá|tối đa|not exceed(?:ing)?|maximum of)\s*8\s*%"
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
PENALTY = r"(?iu)(?:phạt|penalty|penalties)"
#: Days of notice, the patterns in order; the first number over the threshold is reported.
NOTICE = (r"(?iu)(\d+)\s*(?:days|ngày)[^.]{0,40}(?:notice|thông báo)", r"(?iu)(?:notice|thông báo)[^.]{0,40}?(\d+)\s*(?:days|ngày)")


def over_penalty(text: Column, percent: float = 8.0) -> Column:
    """A penalty of more than `percent` % that no wording of the clause caps."""
    amounts = F.transform(F.regexp_extract_all(text, F.lit(PERCENT), F.lit(1)), lambda x: x.cast("double"))
    return text.rlike(PENALTY) & ~text.rlike(KEPT) & F.exists(amounts, lambda v: v > percent)


def notice_days(text: Column, days: int = 60) -> Column:
    """The first number of days of notice over the threshold, in pattern order; null if there is none."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in NOTICE])
    return F.try_element_at(F.filter(F.transform(found, lambda x: x.cast("int")), lambda v: v > days), F.lit(1))


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    rows = [(i, r.rule_id, r.severity, r.kind, list(r.patterns), [k.lower() for k in r.keywords], r.threshold) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, rule_id string, severity string, kind string, patterns array<string>, keywords array<string>, threshold int")


def scan(clauses: DataFrame, rules: DataFrame, key: str = "clause_id", only: list[str] | None = None) -> DataFrame:
    """key, rule_no, rule_id, severity of every rule that a clause (key, text) meets.

    The rules are a small fixed table and are broadcast; a words rule is met by any pattern or any keyword.
    """
    if only is not None:
        rules = rules.filter(F.col("rule_id").isin(only))
    pairs = clauses.select(key, "text", F.lower("text").alias("low")).join(F.broadcast(rules))
    words = F.exists("patterns", lambda p: F.regexp_like(F.col("low"), p)) | F.exists("keywords", lambda k: F.instr(F.col("low"), k) > 0)
    hit = F.when(F.col("kind") == "penalty", over_penalty(F.col("text"))).when(F.col("kind") == "notice", notice_days(F.col("text")).isNotNull()).otherwise(words)
    return pairs.filter(hit).select(key, "rule_no", "rule_id", "severity")


def first_hits(hits: DataFrame, by: str, limit: int, *order: str) -> DataFrame:
    """The first hits of each group in the given order, and their number: what a costly review of hits is limited to."""
    ranked = hits.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("nth") <= limit)


def overall(severity: Column) -> Column:
    """The gravest of a group's severities, low if there is none."""
    grade = F.max(sum((F.when(severity == s, i).otherwise(0) for i, s in enumerate(SEVERITIES)), F.lit(0)))
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.coalesce(grade, F.lit(0)) + 1).cast("int"))
