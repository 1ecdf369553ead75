"""Documents to blocks, sections, parents and children."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, token_estimate

CHILD_TOKENS, OVERLAP_TOKENS, PARENT_TOKENS = 250, 30, 1200
LEVELS = 6


def lines(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """The kept columns, pos (from 0) and text of every line of docs (text)."""
    return docs.select(*keep, F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def line_chunks(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """Lines that aren't blank as chunks: chunk_id is <doc_id>_b<pos>."""
    own = lines(docs, "doc_id", *keep).filter(F.trim("text") != "")
    return own.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("_b"), F.col("pos").cast("string")))


def markdown_sections(rows: DataFrame) -> DataFrame:
    """doc, pos, kind (heading, code, paragraph), line, section_path of Markdown lines (doc, pos, line).

    The heading stack is a window: level L is open where its last heading is later than those of all shallower levels.
    Lines inside a fence are code; a fence that isn't closed hides the rest, which is left out. Blank lines are left out.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").startswith("```")
    df = rows.withColumn("fence", fence.cast("int")).withColumn("n", F.sum("fence").over(upto))
    total = F.sum("fence").over(Window.partitionBy("doc"))
    df = df.withColumn("total", total)
    inside = (F.col("n") % 2 == 1) | (F.col("fence") == 1)
    # the last fence of an odd number opens what never closes
    df = df.filter(~((F.col("total") % 2 == 1) & (F.col("n") == F.col("total")))).withColumn("code", inside)
    marks = F.length(F.regexp_extract("line", r"^(#{1,6})\s+(.*)", 1))
    df = df.withColumn("level", F.when(~F.col("code"), marks).otherwise(0)).withColumn("title", F.trim(F.regexp_extract("line", r"^(#{1,6})\s+(.*)", 2)))
    for k in range(1, LEVELS + 1):
        own = F.col("level") == k
        df = df.withColumn(f"p{k}", F.last(F.when(own, F.col("pos")), True).over(upto)).withColumn(f"t{k}", F.last(F.when(own, F.col("title")), True).over(upto))
    parts = []
    for k in range(1, LEVELS + 1):
        later = F.lit(True)
        for j in range(1, k):
            later = later & (F.col(f"p{k}") > F.coalesce(f"p{j}", F.lit(-1)))
        parts.append(F.when(F.col(f"p{k}").isNotNull() & later, F.col(f"t{k}")))
    path = F.array_compact(F.array(*parts))
    kind = F.when(F.col("code"), "code").when(F.col("level") > 0, "heading").otherwise("paragraph")
    return df.filter(F.col("code") | (F.trim("line") != "")).select("doc", "pos", kind.alias("kind"), "line", path.alias("section_path"))


def markdown_paragraphs(rows: DataFrame) -> DataFrame:
    """doc, pos (of the first line), kind, text, section_path: blocks of Markdown lines (doc, pos, line).

    Lines that follow one another are a paragraph until a blank line, a heading or a fence ends it; a fenced block is one
    block with its fences; a heading is a block of its own, its text the title.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    # blank lines only cut; they are told from the gaps that they leave among the numbered lines
    numbered = rows.withColumn("at", F.row_number().over(order))
    lines = markdown_sections(numbered.select("doc", "pos", "line")).join(numbered.select("doc", "pos", "at"), ["doc", "pos"])
    kind, before, last = F.col("kind"), F.lag("kind").over(order), F.lag("at").over(order)
    fence = F.col("line").startswith("```") & (kind == "code")
    opens = fence & (F.sum(fence.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2 == 1)
    begins = before.isNull() | (kind != before) | (kind == "heading") | opens | ((kind == "paragraph") & (F.col("at") - last > 1))
    grouped = lines.withColumn("no", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    blocks = grouped.groupBy("doc", "no").agg(F.min("pos").alias("pos"), F.first("kind").alias("kind"), text.alias("text"), F.min_by("section_path", "pos").alias("section_path"))
    title = F.trim(F.regexp_extract("text", r"^(#{1,6})\s+(.*)", 2))
    return blocks.select("doc", "pos", "kind", F.when(F.col("kind") == "heading", title).otherwise(F.col("text")).alias("text"), "section_path")


#: Fixed value: how a heading of a page begins.
HEADING = r"(?iu)^(Article|Section|Clause|Chapter|Part|\d+\.|\d+\.\d+)"


def carry_heading(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, pos, text) with is_heading and section: the last short block that reads like a heading, carried on."""
    n_lines = F.size(F.split("text", "\n"))
    heading = (n_lines <= 2) & (F.length("text") < 120) & F.col("text").rlike(HEADING)
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("is_heading", heading).withColumn("section", F.last(F.when(heading, F.col("text")), True).over(order))


def parent_groups(blocks: DataFrame, target: int = PARENT_TOKENS) -> DataFrame:
    """doc_id, pos, parent_no of blocks (doc_id, pos, tokens, top): a group ends before a block that would take its
    tokens over the target, or whose first path element differs where both paths have one.

    One pass over each document's blocks, in time proportional to them; only numbers are gathered, never texts.
    """

    @F.pandas_udf("array<int>")
    def numbers(tokens: pd.Series, tops: pd.Series) -> pd.Series:
        def one(tokens: np.ndarray, tops: np.ndarray) -> list[int]:
            out, no, total, last = [], 0, 0, None
            for n, top in zip(tokens, tops, strict=True):
                if out and (total + n > target or (last and top and last != top)):
                    no, total = no + 1, 0
                total, last = total + n, top
                out.append(no)
            return out

        return pd.Series([one(t, p) for t, p in zip(tokens, tops, strict=True)])

    items = F.sort_array(F.collect_list(F.struct("pos", "tokens", "top")))
    folded = blocks.groupBy("doc_id").agg(items.alias("items")).withColumn("no", numbers(F.col("items.tokens"), F.col("items.top")))
    zipped = folded.select("doc_id", F.explode(F.arrays_zip("items", "no")).alias("z"))
    return zipped.select("doc_id", F.col("z.items.pos").alias("pos"), F.col("z.no").alias("parent_no"))


def child_ranges(items: DataFrame, target: int = CHILD_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """parent_id, child_no, first, last (sentence numbers from 0) of sentences (parent_id, pos, tokens).

    Sentences are packed greedily; a new chunk begins with the longest end of the last one that fits the overlap. Chunks
    are ranges, so one pass over the token counts gives their bounds; a start is found in the running sums.
    """

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def ranges(tokens: pd.Series) -> pd.Series:
        def one(tokens: np.ndarray) -> list[dict]:
            upto = np.concatenate([[0], np.cumsum(tokens)])
            out, s = [], 0
            for i, t in enumerate(tokens):
                if i > s and upto[i] - upto[s] + t > target:
                    out.append({"first": s, "last": i - 1})
                    # the first sentence from which the tokens up to here fit the overlap, not before the chunk's own start
                    s = max(s, int(np.searchsorted(upto, upto[i] - overlap)))
            return [*out, {"first": s, "last": len(tokens) - 1}]

        return pd.Series([one(t) for t in tokens])

    toks = F.transform(F.sort_array(F.collect_list(F.struct("pos", "tokens"))), lambda x: x["tokens"])
    per = items.groupBy("parent_id").agg(toks.alias("toks")).filter(F.size("toks") > 0)
    done = per.select("parent_id", F.posexplode(ranges("toks")).alias("child_no", "c"))
    return done.select("parent_id", "child_no", F.col("c.first").alias("first"), F.col("c.last").alias("last"))


def chunk_documents(docs: DataFrame, version: int = 1, child: int = CHILD_TOKENS, overlap: int = OVERLAP_TOKENS, parent: int = PARENT_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of docs (doc_id, text, section): line blocks, parents by tokens and section, children by sentences.

    parents: doc_id, parent_id, page_number, section_path, text, token_count; children: chunk_id, doc_id, parent_id,
    section_path, text, token_count, refs (block ids in order, once each).
    """
    blocks = line_chunks(docs, "section").withColumn("tokens", token_estimate(F.col("text"))).withColumn("top", F.coalesce("section", F.lit("")))
    numbered = blocks.join(parent_groups(blocks, parent), ["doc_id", "pos"])
    pid = F.concat(F.col("doc_id").cast("string"), F.lit(f"_v{version}_p"), F.col("parent_no").cast("string"))
    numbered = numbered.withColumn("parent_id", pid)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "text")))
    parents = numbered.groupBy("doc_id", "parent_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"), F.min_by("section", "pos").alias("section"))
    parents = parents.select("doc_id", "parent_id", F.lit(1).alias("page_number"), F.array("section").alias("section_path"), "text", token_estimate(F.col("text")).alias("token_count"))
    said = numbered.select("doc_id", "parent_id", "pos", "section", "chunk_id", F.posexplode(sentences(F.col("text"))).alias("at", "sentence"))
    order = Window.partitionBy("parent_id").orderBy("pos", "at")
    said = said.withColumn("n", F.row_number().over(order) - 1).withColumn("tokens", token_estimate(F.col("sentence")))
    ranges = child_ranges(said.select("parent_id", F.col("n").alias("pos"), "tokens"), child, overlap)
    inside = said.join(ranges, "parent_id").filter("n between first and last")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "sentence"))), lambda x: x["sentence"]), " ")
    refs = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"]))
    children = inside.groupBy("doc_id", "parent_id", "child_no").agg(text.alias("text"), F.min_by("section", "n").alias("section"), refs.alias("refs"))
    cid = F.concat("parent_id", F.lit("_c"), F.col("child_no").cast("string"))
    return parents, children.select(cid.alias("chunk_id"), "doc_id", "parent_id", F.array("section").alias("section_path"), "text", token_estimate(F.col("text")).alias("token_count"), "refs")


# Characters below which a page has too few, the share of unprintable ones that is too much, and characters
# below which a page with pictures has too few.
FEW_CHARS, ODD_SHARE, PICTURE_CHARS = 40, 0.15, 150


def ocr_gate(area: Column, chars: Column, odd_ratio: Column, images: Column) -> Column:
    """Why a page needs OCR, or native: no area, few characters, many unprintable ones, or pictures with little text."""
    return F.when(area <= 0, "no_area").when(chars < FEW_CHARS, "few_chars").when(odd_ratio > ODD_SHARE, "unprintable").when((images >= 1) & (chars < PICTURE_CHARS), "image_with_little_text").otherwise("native")
