"""The engine's entry points: ingest, search, answer, compare and review, each for a batch and for one caller's rights."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.scores import jaccard, overlap
from .functions.text import tokens
from .operators import access, answering, bm25, chunking, dense, fusion, risk
from .operators.textvec import TextModel
from .session import saved


@dataclass(frozen=True)
class Options:
    """How a search runs. keep_zero ranks every chunk that a question may meet, shared words or not. least_confidence: what an
    answer must reach to be kept in a cache."""

    sparse_k: int = 20
    dense_k: int = 20
    parent_cap: int | None = 2
    expand: bool = False
    budget: int = 20
    top_n: int = 10
    keep_zero: bool = False
    least_confidence: float = 0.70


@dataclass(frozen=True)
class Caller:
    tenant: str
    role: str
    admin: bool = False


class Engine:
    """documents: doc_id, tenant_id, ..; acl: doc_id, role, allow_read; parents and children as chunk_documents gives them;
    vectors: chunk_id, vec. reranker: a Column of (question, text), a share of shared words by default. rejected: documents that
    ingest() didn't take."""

    rejected: DataFrame | None = None

    def __init__(self, documents: DataFrame, acl: DataFrame, parents: DataFrame, children: DataFrame, vectors: DataFrame | None = None, reranker: Callable[[Column, Column], Column] | None = None):
        self.documents, self.acl, self.parents, self.children, self.vectors = documents, acl, parents, children, vectors
        self.reranker = reranker or (lambda q, t: overlap(tokens(q), tokens(t)))

    @classmethod
    def ingest(cls, documents: DataFrame, acl: DataFrame, embed: Callable[[Column], Column] | TextModel | None = None, **options: object) -> Engine:
        """Chunks documents (doc_id, tenant_id, text, section) and, with an embedding function or a fitted TextModel, makes their vectors.
        Documents without a chunk aren't taken, as nothing of them could be found; they are in `rejected`."""
        parents, children = chunking.chunk_documents(documents)
        with_chunks = children.select("doc_id").distinct()
        if isinstance(embed, TextModel):
            vectors = embed.embed(children.select("chunk_id", "text"))
        else:
            vectors = children.select("chunk_id", embed(F.col("text")).alias("vec")) if embed else None
        engine = cls(documents.join(with_chunks, "doc_id", "left_semi"), acl, parents, children, vectors, **options)
        engine.rejected = documents.join(with_chunks, "doc_id", "left_anti")
        return engine

    def accessible(self, caller: Caller) -> DataFrame:
        own = self.documents.filter(access.in_tenant(F.col("tenant_id"), F.lit(caller.tenant)))
        return access.accessible(own, self.acl, caller.role, caller.admin)

    def scope(self, caller: Caller, asked: DataFrame | None = None) -> DataFrame:
        """doc_id of what a caller may search; an id among `asked` that isn't granted refuses the whole request."""
        return access.resolve_scope(asked, self.accessible(caller))

    def _lists(self, queries: DataFrame, caller: Caller, asked: DataFrame | None, options: Options) -> dict[str, DataFrame]:
        """The sparse and, with vectors, dense list of each question, and the reranked chunks of both."""
        own = "doc_id" in queries.columns
        if own:  # each question meets one document, and one that isn't granted refuses the whole request
            named = queries.select("doc_id").distinct()
            asked = named if asked is None else asked.select("doc_id").unionByName(named)
        chunks = self.children.join(self.scope(caller, asked), "doc_id", "left_semi")
        place = lambda df: df.withColumn("scope", F.col("doc_id").cast("string") if own else F.lit("all"))
        questions = place(queries)
        lists = {"sparse": saved(bm25.search(questions.select("query_id", "scope", "text"), place(chunks).select("scope", "chunk_id", "text"), options.sparse_k, keep_zero=options.keep_zero), "sparse")}
        if self.vectors is not None and "query_vec" in queries.columns:
            vectors = self.vectors.join(place(chunks).select("chunk_id", "scope"), "chunk_id")
            lists["dense"] = saved(dense.search(questions.select("query_id", "scope", "query_vec"), vectors, options.dense_k), "dense")
        pool = fusion.reciprocal_rank(*reversed(lists.values()))
        lists["fused"] = saved(pool, "fused")
        fused = lists["fused"].join(self.children.select("chunk_id", "doc_id", "parent_id", "text"), "chunk_id")
        if options.parent_cap is not None:
            fused = fusion.cap_parents(fused, options.parent_cap, options.budget)
        if options.expand:
            text = self.parents.select("parent_id", F.col("text").alias("parent_text"))
            fused = fusion.expand_parents(fused.join(text, "parent_id", "left")).join(self.children.select("chunk_id", "doc_id"), "chunk_id")
        asked_text = queries.select("query_id", F.col("text").alias("question"))
        ranked = fusion.rerank(fused.filter(F.col("rank") <= options.budget).join(asked_text, "query_id"), self.reranker(F.col("question"), F.col("text")), options.top_n)
        lists["ranked"] = ranked.select("query_id", "rank", "chunk_id", "doc_id", "parent_id", "text", "score")
        return lists

    def search(self, queries: DataFrame, caller: Caller, asked: DataFrame | None = None, options: Options = Options()) -> DataFrame:
        """query_id, rank, chunk_id, doc_id, parent_id, text, score for queries (query_id, text[, query_vec][, doc_id]).

        With a doc_id each question is searched in that document alone, with that document's own statistics; without one in
        all documents that the caller may search, with statistics over them all.
        """
        return self._lists(queries, caller, asked, options)["ranked"]

    def answer(self, queries: DataFrame, caller: Caller, generate: Callable[[Column, Column], Column] | None = None, asked: DataFrame | None = None, options: Options = Options()) -> DataFrame:
        """query_id, answer, citations, confidence, cacheable. Without a generator the best chunk is the answer; without a chunk it
        says so. The confidence weighs how far both lists agree, the fused scores and their margin, the reranker's best score and
        how many of the question's longer words the first sections name; an answer is fit for a cache if it is asked of named
        documents, cites any and is confident enough."""
        lists = self._lists(queries, caller, asked, options)
        found = saved(lists["ranked"], "ranked")
        best = found.groupBy("query_id").agg(F.min_by("text", "rank").alias("context"), F.max("score").alias("top"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("citations"))
        none = F.array().cast("array<string>")
        five = lambda df, name: df.filter("rank <= 5").groupBy("query_id").agg(F.collect_set(F.col("chunk_id").cast("string")).alias(name))
        two = lists["fused"].filter("rank <= 2").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("rrf"))).alias("r1"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("rrf"))), F.lit(0.0)).alias("r2"))
        heads = found.filter("rank <= 3").join(self.children.select("chunk_id", "section_path"), "chunk_id").groupBy("query_id").agg(F.lower(F.array_join(F.flatten(F.collect_list("section_path")), " ")).alias("heads"))
        rows = queries.select("query_id", "text").join(best, "query_id", "left").join(five(lists["sparse"], "a"), "query_id", "left")
        rows = rows.join(five(lists["dense"], "b"), "query_id", "left") if "dense" in lists else rows.withColumn("b", none)
        rows = rows.join(two, "query_id", "left").join(heads, "query_id", "left")
        longer = F.filter(F.array_distinct(tokens(F.col("text"))), lambda w: F.length(w) > 3)
        named = F.size(F.filter(longer, lambda w: F.instr(F.coalesce("heads", F.lit("")), w) > 0)) / F.greatest(F.size(longer), F.lit(1))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        sure = answering.confidence(jaccard(F.coalesce("a", none), F.coalesce("b", none)), zero("r1"), zero("r2"), zero("top"), named)
        said = generate(F.col("text"), F.col("context")) if generate else F.col("context")
        cited = F.coalesce("citations", F.array().cast("array<string>"))
        scoped = F.lit(asked is not None or "doc_id" in queries.columns)
        rows = rows.select("query_id", F.coalesce(said, F.lit(answering.SENTINEL)).alias("answer"), cited.alias("citations"), sure.alias("confidence"))
        return rows.withColumn("cacheable", answering.may_cache(scoped, F.size("citations") > 0, F.col("confidence"), options.least_confidence))

    def compare(self, facets: DataFrame, first: object, second: object, caller: Caller, top_k: int = 4) -> DataFrame:
        """facet_id, the chunks found for each facet (facet_id, text) in two documents, and which of them has any."""
        kind = self.documents.schema["doc_id"].dataType
        both = F.explode(F.create_map(F.lit("a"), F.lit(first).cast(kind), F.lit("b"), F.lit(second).cast(kind)))
        questions = facets.select("facet_id", "text", both.alias("side", "doc_id")).withColumn("query_id", F.concat_ws(":", "side", F.col("facet_id").cast("string")))
        found = saved(self.search(questions.select("query_id", "text", "doc_id"), caller, options=Options(top_n=top_k)), "compared")
        per = questions.select("query_id", "side", F.col("facet_id").alias("asked")).join(found, "query_id").groupBy("asked", "side").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunks"))
        sides = [per.filter(F.col("side") == name).select(F.col("asked").alias("query_id"), F.col("chunks").alias(f"chunks_{name}")) for name in ("a", "b")]
        rows = facets.select(F.col("facet_id").alias("query_id")).join(sides[0], "query_id", "left").join(sides[1], "query_id", "left")
        a, b = F.col("chunks_a").isNotNull(), F.col("chunks_b").isNotNull()
        status = F.when(a & b, "both").when(a, "only_a").when(b, "only_b").otherwise("missing")
        return rows.select(F.col("query_id").alias("facet_id"), "chunks_a", "chunks_b", status.alias("status"))

    def risk_review(self, caller: Caller, asked: DataFrame | None = None, rules: tuple[risk.Rule, ...] = risk.RULES, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(findings, overall): rules met by each chunk in scope, and each document's gravest severity."""
        scope = self.scope(caller, asked)
        chunks = self.children.join(scope, "doc_id", "left_semi")
        found = risk.scan(chunks, risk.rules_table(chunks.sparkSession, rules), "chunk_id", only).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
        overall = scope.join(found, "doc_id", "left").groupBy("doc_id").agg(F.count("rule_id").alias("n_findings"), risk.overall(F.col("severity")).alias("severity"))
        return found, overall
