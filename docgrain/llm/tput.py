"""Ranked lexical search by the three-phase uniform threshold algorithm (TPUT) over lists of postings kept by term.

A list holds a term's documents by falling impact, 10**9 * tf div (1000 * tf + 8 * m), where m measures the document's
length against the mean; an item gives each of its terms a gain (weight times occurrences), and a document scores the sum
of gain times impact. Lists are cut into ranges of (term, impact), so a term that every document holds fills many
partitions, and a file's statistics tell which impacts it holds.

1. The k heads of every list give partial scores; the HEADS * k documents of highest partial score of an item are looked up
   in all of its lists, and the k-th highest score is a lower bound.
2. An item fetches from each of its lists the postings worth a uniform threshold or more: such that less than the threshold
   in every list, and no more than the head of a list whose head is below it, comes to less than a part (1 / PART) of the
   bound. Lists of low gain aren't read at all. The fetched postings are dealt out by document and added up for a block of
   items at a time; with what each unseen list can still add they give an upper bound of every document seen, and only those
   that reach the bound come out of the task. Items of many terms have documents with one posting of any worth in great
   number; that is why the threshold is set below what would do for correctness (PART = 1).
3. What is left is looked up, by term and document, in the lists that its partial sum lacks.

All bounds are whole numbers, and ties are kept to the end, so the result is exact. A bit table of fixed size, whatever the
number of items, keeps postings of terms that no item asks for from being made; what it lets through beside is dropped by
the joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, documents, id_text, saved, small_batches, tidy

#: Bits of the table of asked terms; 1 MB, which every worker holds.
BITS = 1 << 23
#: Documents of an item that are looked up for its first bound, in times k.
HEADS = 3
#: The part of the bound that unseen postings may come to; items of a block, and rows of their terms.
PART, ITEMS, ASKED = 4, 2048, 1 << 18
#: Postings that are added up together.
SLICE = 1 << 16
#: Bytes of terms, with A-Z lowered; all others end a term.
_CUT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many terms each text (bytes, null: none) has, the number of every term in order, and the distinct terms."""
    texts = pc.fill_null(texts, b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    lowered = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(bytes(raw).translate(_CUT))])
    cut = pc.ascii_split_whitespace(lowered)
    words = cut.flatten()
    there = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    coded = words.filter(there).dictionary_encode()
    return np.diff(upto[cut.offsets.to_numpy()]), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _slots(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) & (BITS - 1) for w in words.view(pa.binary()).to_pylist()), np.int64, len(words))


def _counted(rows: DataFrame, table: np.ndarray | None) -> DataFrame:
    """term, id, row, tf, n (the document's terms) of every row (id, row, text) and term, if table has the term's bit.

    One more row for each batch has no term, the number of documents with a term as tf and all their terms as n.
    """
    held = rows.sparkSession.sparkContext.broadcast(table) if table is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                count, flat, words = terms(batch.column("text"))
                text = np.repeat(np.arange(len(count)), count)
                if held is not None:
                    slot = _slots(words)
                    on = (held.value[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)[flat]
                    text, flat = text[on], flat[on]
                key, tf = np.unique(text * len(words) + flat, return_counts=True)
                at, word = np.divmod(key, max(1, len(words)))
                at = pa.array(at)
                ids, own = batch.column("id").take(at), batch.column("row").take(at)
                found = [words.take(pa.array(word)), ids, own, pa.array(tf.astype(np.int64)), pa.array(count[at.to_numpy()].astype(np.int64))]
                sums = [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([int((count > 0).sum())]), pa.array([int(count.sum())])]
                for columns in (found, sums):
                    yield pa.RecordBatch.from_arrays(columns, ["term", "id", "row", "tf", "n"])

    return rows.select("id", "row", "text").mapInArrow(tidy(run), "term string, id long, row long, tf long, n long")


def _rows(table: DataFrame, key: str) -> DataFrame:
    """id, row (a number of its own for each row) and text of a table with a key and a text."""
    own = id_text(table.select(F.col(key).alias("doc_id"), F.col("text")))
    return own.select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"), "text")


def item_terms(items: DataFrame, key: str = "item_id") -> DataFrame:
    """item (a number of its own for each row), item_id, term and c (its occurrences) of the items; kept in the work folder."""
    small_batches(items.sparkSession)
    found = _counted(_rows(items, key), None).filter("term is not null")
    return saved(found.select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term", F.col("tf").alias("c")), "tput-items")


def asked_bits(asked: DataFrame) -> np.ndarray:
    """The bit table of the terms of asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"slot": _slots(batch.column("term"))})

    slots = asked.select("term").distinct().mapInArrow(run, "slot long")
    cell = slots.groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits"))
    out = np.zeros(BITS >> 6, np.uint64)
    got = cell.toArrow()  # BITS / 64 rows at most
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


class TermLists:
    """Postings of documents by term and falling impact, kept in the work folder.

    asked: a table of terms; only their lists are made. Without it every term has one. lists: term, doc_id, row, impact;
    documents, terms: how many documents have a term, and how many terms these have.
    """

    def __init__(self, docs: DataFrame, asked: DataFrame | None = None):
        spark = docs.sparkSession
        small_batches(spark)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        counts = saved(_counted(_rows(docs, "doc_id"), asked_bits(asked) if asked is not None else None), "tput-counts")
        total = counts.filter("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        self.documents, self.terms = total.documents, total.terms
        length = F.expr(f"25L + (75L * n * {self.documents}L) div {max(1, self.terms)}L")
        impact = F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
        rows = counts.filter("term is not null").select("term", F.col("id").alias("doc_id"), "row", "tf", length.alias("m")).select("term", "doc_id", "row", impact.alias("impact"))
        order = ["term", F.desc("impact"), "doc_id", "row"]
        self.lists = saved(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), "tput-lists")

    def gains(self, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """item, item_id, term, gain, top (the list's head) of the lists that add to an item, and term, doc_id, row, impact of the
        k heads of each of these lists."""
        best = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "doc_id", "row"))
        heads = saved(self.lists.withColumn("at", best).filter(F.col("at") <= k), "tput-heads")
        df = self.lists.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("top"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * self.documents + 2) / (2 * F.col("df") + 1)))
        own = asked.join(df, "term").select("item", "item_id", "term", (F.col("c") * weight).cast("long").alias("gain"), "top")
        return saved(own.filter("gain > 0"), "tput-gains"), heads


def _kth(scores: DataFrame, k: int, score: str) -> DataFrame:
    """item, bound: the k-th highest score of the items that have k."""
    at = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(score)))
    return scores.select("item", score).withColumn("at", at).filter(F.col("at") <= k).groupBy("item").agg(F.min(score).alias("bound"), F.count("*").alias("n")).filter(F.col("n") == k).drop("n")


def _worth(impact: str = "impact") -> Column:
    return F.sum(F.col("gain") * F.col(impact))


class _Asked:
    """A block of items: for each term, by number, the items that ask for it with gain, least impact and slack; by item its bound and slack."""

    def __init__(self, rows: pa.Table, numbers: dict[str, int]):
        term = np.array([numbers[t] for t in rows["term"].to_pylist()], np.int64)
        self.items, item = np.unique(rows["item"].to_numpy(), return_inverse=True)
        by = np.argsort(term, kind="stable")
        self.at = np.searchsorted(term[by], np.arange(len(numbers) + 1))
        self.item, self.gain, self.least, self.slack = item[by], *(rows[c].to_numpy()[by] for c in ("gain", "least", "slack"))
        self.total = np.bincount(item, rows["slack"].to_numpy(), len(self.items)).astype(np.int64)
        self.bound = np.zeros(len(self.items), np.int64)
        self.bound[item] = rows["bound"].to_numpy()

    def candidates(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> pa.RecordBatch:
        """item, row, part, known of the documents that can reach their item's bound, from all fetched postings of some documents."""
        rows, own = np.unique(row, return_inverse=True)
        n = self.at[term + 1] - self.at[term]
        which = np.arange(int(n.sum())) + np.repeat(self.at[term] - (np.cumsum(n) - n), n)
        impact, own = np.repeat(impact, n), np.repeat(own, n)
        there = np.flatnonzero(impact >= self.least[which])
        which, cell = which[there], own[there] * len(self.items) + self.item[which[there]]
        size = len(rows) * len(self.items)
        part = np.bincount(cell, self.gain[which] * impact[there], size).astype(np.int64)  # below 2 ** 53, so exact
        known = np.bincount(cell, self.slack[which], size).astype(np.int64)
        reach = (part + np.tile(self.total, len(rows)) - known >= np.tile(self.bound, len(rows))) & (part > 0)
        at = np.flatnonzero(reach)
        own, item = np.divmod(at, len(self.items))
        return pa.RecordBatch.from_pydict({"item": self.items[item], "row": rows[own], "part": part[at], "known": known[at]})


def _seen(lists: TermLists, plan: DataFrame) -> DataFrame:
    """item, row, part (the sum of what was fetched), known (the slack of those lists) of the documents that can reach the bound.

    The items' terms are broadcast in blocks of ITEMS items at most, dealt out by hash, and of about ASKED rows.
    """
    spark = plan.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = plan.agg(F.count("*").alias("rows"), F.count_distinct("item").alias("items")).first()
    blocks = max(1, -(-n.rows // ASKED), -(-n.items // ITEMS))
    out = None
    for number in range(blocks):
        own = plan.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number)
        rows = own.select("item", "term", "gain", "least", "slack", "bound").toArrow()
        if not rows.num_rows:
            continue
        numbers = {t: i for i, t in enumerate(dict.fromkeys(rows["term"].to_pylist()))}
        held = spark.sparkContext.broadcast(_Asked(rows, numbers))
        reach = own.filter("least <= top").groupBy("term").agg(F.min("least").alias("reach"))
        number_of = spark.createDataFrame(list(numbers.items()), "term string, number int")
        fetched = lists.lists.join(reach.join(number_of, "term"), "term").filter("impact >= reach").select("row", "number", "impact")
        found = fetched.repartition(parts, "row").sortWithinPartitions("row").mapInArrow(tidy(_adder(held)), "item long, row long, part long, known long")
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], "item long, row long, part long, known long")


def _adder(held: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0

        def out(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, size
            row, term, impact = (np.concatenate([b.column(c).to_numpy() for b in kept]) for c in ("row", "number", "impact"))
            end = len(row) if final else int(np.searchsorted(row, row[-1]))  # the last document may go on
            if end:
                yield held.value.candidates(row[:end], term[:end], impact[:end])
            kept = [pa.RecordBatch.from_pydict({"row": row[end:], "number": term[end:], "impact": impact[end:]})]
            size = len(row) - end

        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size >= SLICE:
                yield from out(False)
        if size:
            yield from out(True)

    return run


def search(lists: TermLists, asked: DataFrame, k: int = 10, made: dict[str, int] | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item of asked (see item_terms).

    Equal scores go to the smaller doc_id, a null one last. Every row of the items and of the documents is one of its own,
    repeated or not. Items and documents without terms give nothing. made, if given, takes the numbers of postings that the
    items' lists hold, that were fetched and that were looked up.
    """
    gains, heads = lists.gains(asked, k)
    # 1: heads, and the scores of the best of them
    first = heads.join(gains, "term").groupBy("item", "row").agg(_worth().alias("part"))
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("part"), "row"))
    first = saved(first.withColumn("at", best).filter(F.col("at") <= HEADS * k).select("item", "row"), "tput-first")
    theirs = lists.lists.join(first.select("row").distinct(), "row").select("row", "term", "impact")
    score = theirs.join(first, "row").join(gains.select("item", "term", "gain"), ["item", "term"]).groupBy("item", "row").agg(_worth().alias("score"))
    bounds = _kth(score, k, "score")
    # a document with less than the threshold in every list: what lists with lower heads give, and less than the threshold of each other
    worth, per_item = F.col("gain") * F.col("top"), Window.partitionBy("item").orderBy("worth", "term")
    plan = gains.withColumn("worth", worth).join(bounds, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0))).withColumn("share", F.expr(f"bound div {PART}"))
    plan = plan.withColumn("others", F.count("*").over(Window.partitionBy("item")) - F.row_number().over(per_item) + 1)
    plan = plan.withColumn("below", F.sum("worth").over(per_item.rowsBetween(Window.unboundedPreceding, 0)) - F.col("worth"))
    reached = F.when(F.col("below") + F.col("worth") * F.col("others") >= F.col("share"), F.expr("(share - below + others - 1) div others"))
    # the threshold comes from the first list, by rising worth, that reaches it
    start = F.max(F.when(reached.isNotNull(), F.col("others"))).over(Window.partitionBy("item"))
    plan = plan.withColumn("start", start).withColumn("t", F.max(F.when(F.col("others") == F.col("start"), reached)).over(Window.partitionBy("item")))
    least = F.when(F.col("others") > F.col("start"), F.col("top") + 1).otherwise(F.expr("greatest(1L, (t + gain - 1) div gain)"))
    plan = plan.withColumn("least", least).withColumn("slack", F.col("gain") * F.least(F.col("least") - 1, F.col("top")))
    plan = saved(plan.select("item", "item_id", "term", "gain", "top", "least", "slack", "bound"), "tput-plan")
    # 2: all that reaches the threshold, added up by document
    seen = saved(_seen(lists, plan), "tput-seen")
    totals = plan.groupBy("item").agg(F.first("item_id").alias("item_id"), F.sum("slack").alias("slack"), F.max("bound").alias("low"))
    raised = totals.join(_kth(seen, k, "part"), "item", "left").withColumn("bound", F.greatest("low", F.coalesce("bound", F.lit(0))))
    left = seen.join(raised, "item").filter(F.col("part") + F.col("slack") - F.col("known") >= F.col("bound"))
    left = saved(left.select("item", "item_id", "row", "part"), "tput-left")
    # 3: the lists that a candidate's sum lacks
    open_ = left.select("item", "row").join(plan.filter("least > 1").select("item", "term", "gain", "least"), "item")
    more = open_.join(lists.lists.select("term", "row", "impact"), ["term", "row"]).filter("impact < least").groupBy("item", "row").agg(_worth().alias("more"))
    ids = lists.lists.join(left.select("row").distinct(), "row", "left_semi").groupBy("row").agg(F.first("doc_id").alias("doc_id"))
    exact = left.join(more, ["item", "row"], "left").join(ids, "row").withColumn("score", F.col("part") + F.coalesce("more", F.lit(0))).filter("score > 0")
    if made is not None:
        made["held"] = lists.lists.join(plan.select("term"), "term").count()
        made["fetched"] = lists.lists.join(plan.filter("least <= top").select("term", "least"), "term").filter("impact >= least").count()
        made["seen"] = seen.count()
        made["looked up"] = open_.count()
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, made: dict[str, int] | None = None) -> DataFrame:
    """search() for the rows of items (item_id, text) over the rows of docs (doc_id, text); extra columns are left out."""
    asked = item_terms(items)
    return search(TermLists(docs, asked), asked, k, made)


def op11_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
lens AS (SELECT r, doc_id, len(ws)::BIGINT AS n FROM docs WHERE len(ws) > 0),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lens),
tfs AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM docs) GROUP BY r, term),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
items AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ws FROM benchmark),
asked AS (SELECT i, item_id, term, count(*)::BIGINT AS c FROM (SELECT i, item_id, unnest(ws) AS term FROM items) GROUP BY i, item_id, term),
gains AS (SELECT i, item_id, term, c * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS gain FROM asked JOIN dfs USING (term), total),
scores AS (
  SELECT i, item_id, r, sum(gain * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM gains JOIN tfs USING (term) JOIN lens USING (r), total GROUP BY i, item_id, r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scores JOIN lens USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
