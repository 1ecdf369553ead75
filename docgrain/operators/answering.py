"""Routing, confidence, answer classes, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scores import clamp

# Words that the routing, refusal and sentinel rules look for.
GREETINGS = ("hello", "hi", "hey", "xin chào", "chào", "thanks", "cảm ơn")
COMPARE = ("compare", "difference", "versus", "so sánh", "khác nhau")
REFUSALS = ("not found in", "cannot find", "no information", "not mentioned", "insufficient evidence", "không tìm thấy", "unable to answer")
SENTINEL = "INSUFFICIENT_EVIDENCE"


def route(question: Column, n_docs: Column) -> Column:
    """Struct of task, candidate_k, final_k: small talk (6 words at most, a greeting inside), comparison (a comparing
    word and several documents), else the fallback. Greetings are looked for as substrings."""
    low = F.lower(question)
    n_words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.instr(low, w) > 0)
    plan = lambda task, c, k: F.struct(F.lit(task).alias("task"), F.lit(c).alias("candidate_k"), F.lit(k).alias("final_k"))
    return F.when((n_words <= 6) & any_of(GREETINGS), plan("conversational", 15, 5)).when(any_of(COMPARE) & (n_docs > 1), plan("comparison", 25, 8)).otherwise(plan("single_document_qa", 20, 5))


def answer_class(answer: Column) -> Column:
    """sentinel, prose or answer: how strictly an answer is a refusal."""
    low = F.lower(answer)
    prose = F.exists(F.array(*map(F.lit, REFUSALS)), lambda w: F.instr(low, w) > 0)
    return F.when(F.trim(answer).startswith(SENTINEL), "sentinel").when(prose, "prose").otherwise("answer")


# Wordings that a lenient reading takes for a refusal, wherever they stand in an answer.
SIGNALS = (
    "insufficient_evidence", "insufficient evidence", "not contain information", "does not contain information", "do not specify or mention", "does not specify or mention", "cannot be determined from the provided",
    "no mention of", "not mentioned in the provided", "not found in the provided", "neither contract mentions", "the provided contract does not", "the provided excerpts do not", "information is not present",
)
# Fixed value: how an answer names a numbered place.
REFERENCE = r"(?i)\[(?:Reference|Document Reference|Source Block)\s*(\d+)\]"


def lenient_decision(answer: Column) -> Column:
    """ANSWER, or INSUFFICIENT_EVIDENCE for a blank answer and one that holds any refusal wording."""
    refused = F.exists(F.array(*map(F.lit, SIGNALS)), lambda w: F.instr(F.lower(answer), w) > 0)
    return F.when((F.trim(answer) == "") | refused, SENTINEL).otherwise("ANSWER")


def lenient_citations(answer: Column, retrieved: Column, fallback: bool) -> Column:
    """Retrieved ids that stand in an answer or whose place a bracketed reference names, sorted; fallback: an answer without
    any cites the first retrieved one."""
    named = F.filter(retrieved, lambda c: F.instr(answer, c) > 0)
    places = F.transform(F.regexp_extract_all(answer, F.lit(REFERENCE), F.lit(1)), lambda n: F.try_element_at(retrieved, F.greatest(n.cast("int"), F.lit(1))))
    cited = F.array_sort(F.array_distinct(F.array_compact(F.concat(named, places))))
    if not fallback:
        return cited
    first = (lenient_decision(answer) == "ANSWER") & (F.size(cited) == 0) & (F.size(retrieved) > 0)
    return F.when(first, F.slice(retrieved, 1, 1)).otherwise(cited)


def category(question: Column, categories: tuple[tuple[str, str], ...], other: str = "General") -> Column:
    """The category of the first word of the list that a question holds."""
    low = F.lower(question)
    out = F.lit(other)
    for word, name in reversed(categories):
        out = F.when(F.instr(low, word) > 0, name).otherwise(out)
    return out


def outcome(unanswerable: Column, refused: Column, grounded: Column) -> Column:
    return F.when(unanswerable & refused, "CORRECT_REFUSAL").when(unanswerable, "FALSE_ANSWER").when(refused, "FALSE_REFUSAL").when(grounded, "GROUNDED").otherwise("UNSUPPORTED")


#: Weights of rank overlap, fused score, margin, rerank and metadata.
WEIGHTS = (0.25, 0.20, 0.20, 0.20, 0.15)
#: The fused score of a chunk that leads both lists.
TOP_RRF, LEAST_MARGIN = 0.0328, 0.001


def confidence(rank_overlap: Column, top_rrf: Column, second_rrf: Column, rerank: Column, metadata: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    """Weighted sum of five signals between 0 and 1."""
    fused = clamp(top_rrf / TOP_RRF)
    margin = clamp((top_rrf - second_rrf) / F.greatest(top_rrf, F.lit(LEAST_MARGIN)))
    parts = (clamp(rank_overlap), fused, margin, clamp(rerank), clamp(metadata))
    return sum((w * p for w, p in zip(weights[1:], parts[1:], strict=True)), weights[0] * parts[0])


def may_cache(scoped: Column, grounded: Column, score: Column, least: float = 0.70) -> Column:
    return scoped & grounded & (score >= least)


def scope_key(tenant: Column, user: Column, docs: Column) -> Column:
    """24 hex digits that name a tenant, a user and a set of documents, however the set is ordered or repeated."""
    ids = F.array_join(F.array_sort(F.array_distinct(docs)), ",")
    return F.substring(F.sha2(F.concat_ws("|", tenant, user, ids), 256), 1, 24)


def query_key(query: Column) -> Column:
    return F.md5(F.lower(F.trim(query)))


def short_title(text: Column, limit: int = 45) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
