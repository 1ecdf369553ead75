"""Mix sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

The mix is a sequence of slots of `block` words each. Slot i is mapped to the golden-ratio point i * A mod 2**31 and
through the cumulative target weights to a source, so every stretch of the mix holds each source close to its share.
A slot's rank among its source's slots is the number of the block that it takes from that source's shuffled stream
of documents, which runs twice; the words of a document that fall into taken blocks are what the mix takes of it. Points
come near the shares but not onto them, so each source is settled: its last block is cut at its target, slots beyond it
stay empty, and what its slots leave short comes in slots after all others. Small sources are met as large ones are.

Running sums and ranks over a hot source are made in two steps (inside hash buckets, then over bucket totals), so no
task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, saved

#: The golden ratio's fraction of 2**31, an odd number.
STEP, PERIOD = 1_327_217_885, 1 << 31
#: Cells of the unit interval that a point's source is looked up by.
CELLS = 4096
#: Slots ranked together.
RUN = 1024


def _order_key(doc_id: Column, size: Column) -> Column:
    """The shuffled order of documents: 32 bits of an MD5 over the id and the size."""
    text = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, repeat: int = 2, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source, idx (its order by code point, null last), source_size, target of every source of sizes (source, size).

    Sources weigh `weights`, repeating, and share `share` times all sizes; a target stops at `repeat` times the size
    and the excess goes to the others by weight. The result is min(repeat * size, level * weight) with one level:
    sources are passed in ascending order of size to weight until the rest can take its share.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    idx = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("idx")
    per = per.select("*", idx)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (repeat * F.col("source_size")).cast("double"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    whole = Window.partitionBy()
    below = F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(whole).cast("double")
    per = per.withColumn("level", (F.lit(share) * total - below) / rest)
    # the first source that the level does not fill fixes the level for all after it
    found = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("cap_rank", "level"))).over(whole)["level"]
    per = per.withColumn("cap_rank", F.row_number().over(ratio)).withColumn("final", found)
    return per.select("source", "idx", "source_size", "n_docs", F.coalesce(F.least("cap", F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def schedule(per: DataFrame, n_slots: int, block: int) -> DataFrame:
    """idx, rank and slot of the blocks that the mix takes: which source each is from, its number among that source's blocks,
    and its place in the mix."""
    spark = per.sparkSession
    everything = F.sum("target").over(Window.partitionBy())
    upto = F.sum("target").over(Window.orderBy("idx"))
    edge = lambda x: F.floor(F.try_divide(x, everything) * PERIOD).cast("long")
    ranges = per.select("idx", edge(upto - F.col("target")).alias("lo"), edge(upto).alias("hi")).select("idx", F.coalesce(F.lag("hi").over(Window.orderBy("idx")), F.lit(0)).alias("lo"), "hi").filter("lo < hi")
    width = PERIOD // CELLS
    cells = ranges.select("*", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    slots = spark.range(n_slots).select("id", (F.pmod("id", F.lit(PERIOD)) * STEP % PERIOD).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / width))
    hit = slots.join(cells, "cell").filter("point >= lo and point < hi").select("idx", "id", F.floor(F.col("id") / RUN).alias("run"))
    hit = saved(hit, "mix-slots")
    runs = hit.groupBy("idx", "run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("idx").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.select("idx", "run", before.alias("before"))
    inside = hit.select("idx", "id", "run", (F.row_number().over(Window.partitionBy("idx", "run").orderBy("id")) - 1).alias("at"))
    ranked = inside.join(placed, ["idx", "run"]).select("idx", (F.col("before") + F.col("at")).alias("rank"), F.col("id").alias("slot"))
    # settling: a row for each source
    wanted = F.ceil(_words(F.col("target")) / block).cast("long")
    short = per.select("idx", wanted.alias("wanted")).join(runs.groupBy("idx").agg(F.sum("n").alias("had")), "idx", "left").select("idx", "wanted", F.coalesce("had", F.lit(0)).alias("had"))
    more = F.greatest(F.col("wanted") - F.col("had"), F.lit(0))
    first = F.coalesce(F.sum(more).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    short = saved(short.select("idx", "wanted", "had", more.alias("more"), first.alias("first")), "mix-short")
    extra = short.filter("more > 0").select("idx", "first", "had", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more") - 1)).alias("k"))
    extra = extra.select("idx", (F.col("had") + F.col("k")).alias("rank"), (n_slots + F.col("first") + F.col("k")).alias("slot"))
    return ranked.join(short.select("idx", "wanted"), "idx").filter("rank < wanted").drop("wanted").unionAll(extra)


def _words(target: Column) -> Column:
    """A target in whole words."""
    return F.round(target).cast("long")


def _placed(sizes: DataFrame, per: DataFrame, n_docs: int, repeat: int) -> DataFrame:
    """Every row of sizes at each place (from) that its source's shuffled stream, which runs `repeat` times, has it; bucket and row tell rows apart."""
    # buckets of about 256 documents if there were one source, up to 65536
    bits = max(4, min(16, (max(n_docs, 1) // 256).bit_length()))
    key = _order_key(F.col("doc_id"), F.col("size"))
    rows = sizes.join(per.select(F.col("source").alias("s"), "idx", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.select("doc_id", "size", "idx", "source_size", "target", key.alias("key")).withColumn("bucket", F.shiftright("key", 32 - bits))
    totals = rows.groupBy("idx", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("idx", "bucket", before.alias("before"))
    order = Window.partitionBy("idx", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    placed = rows.withColumn("row", F.row_number().over(order)).withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = placed.join(totals, ["idx", "bucket"]).withColumn("start", F.col("before") + F.col("at"))
    passes = F.explode_outer(F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0), F.lit(repeat - 1)), lambda p: F.col("start") + p * F.col("source_size"))))
    return placed.select("doc_id", "size", "idx", "source_size", "target", "bucket", "row", passes.alias("from"))


def _sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "mix-sizes")


def _mixed(docs: DataFrame, share: float, repeat: int, weights: tuple[int, ...], block: int | None) -> DataFrame:
    """mix() with the rows' sources."""
    sizes = _sizes(docs)
    per = saved(targets(sizes, share, repeat, weights), "mix-targets")
    whole = per.agg(F.sum("source_size").alias("words"), F.sum("target").alias("target"), F.sum("n_docs").alias("docs")).first()
    words, n_docs = whole["words"] or 0, whole["docs"] or 0
    block = block or max(1, min(2048, words >> 16))
    n_slots = -int(-(whole["target"] or 0) // block)
    blocks = _placed(sizes, per, n_docs, repeat)
    blocks = blocks.select("*", F.explode_outer(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("from") + F.col("size") - 1) / block))).alias("rank"))
    joined = blocks.join(schedule(per, n_slots, block), ["idx", "rank"], "left")
    end = F.least(F.col("from") + F.col("size"), (F.col("rank") + 1) * block, _words(F.col("target")))
    inside = F.when(F.col("slot").isNotNull(), F.greatest(end - F.greatest("from", F.col("rank") * block), F.lit(0)))
    taken = joined.groupBy("idx", "bucket", "row", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum(inside), F.lit(0)).cast("long").alias("taken"), F.min(F.when(inside > 0, F.col("slot"))).alias("first_slot"))
    return taken.join(per.select("idx", "source"), "idx").select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


def mix(docs: DataFrame, share: float = 1.5, repeat: int = 2, weights: tuple[int, ...] = (5, 2, 1), block: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot of every row of docs.

    size: words of the text (null: 0). taken: words the mix takes of the row, repeats counted, at most repeat * size; those of
    a source add up to its target, to the word. first_slot: where the row first comes in the mix, null if nothing is taken.
    A null source is a source of its own, the last. Repeated rows are separate documents. Without words all targets
    are 0. Extra columns are left out; an empty table gives an empty one. block: words in a slot, 1/65536 of all
    words but at most 2048 by default. The same rows give the same mix, however they are partitioned.
    """
    return _mixed(docs, share, repeat, weights, block).drop("source")


def repeat_taken(docs: DataFrame, share: float = 1.5, repeat: int = 2, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The rows of docs, all columns as they are, each as often as the mix takes its words, to the nearest whole number.

    Rows that share doc_id, source and size are taken alike: each as often as the mix takes them on average.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    taken = _mixed(docs, share, repeat, weights, None)
    by = [F.col("doc_id").alias("id"), F.col("source").alias("from"), F.col("size").alias("words")]
    times = taken.groupBy(*by).agg(F.round(F.try_divide(F.avg("taken"), F.max("size"))).cast("int").alias("times")).filter("times > 0")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("from"), size.alias("words"))
    same = F.col("o.id").eqNullSafe(F.col("t.id")) & F.col("o.from").eqNullSafe(F.col("t.from")) & (F.col("o.words") == F.col("t.words"))
    joined = own.alias("o").join(times.alias("t"), same)
    repeated = joined.select(F.col("o.row").alias("row"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


OP6_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM sizes GROUP BY source),
w AS (SELECT *, [5, 2, 1][(idx % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM per),
lv AS (SELECT *, row_number() OVER (ORDER BY cap / weight, idx) AS cap_rank,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
fin AS (SELECT (SELECT arg_min(level, cap_rank) FROM lv WHERE level * weight <= cap) AS final),
tg AS (SELECT source, idx, source_size, coalesce(least(cap, final * weight), cap) AS target FROM lv, fin),
al AS (SELECT sum(source_size)::BIGINT AS words, sum(target) AS target FROM tg),
bl AS (SELECT greatest(1, least(2048, words >> 16))::BIGINT AS block, target FROM al),
rg AS (SELECT idx, floor(sum(target) OVER (ORDER BY idx) / sum(target) OVER () * 2147483648.0)::BIGINT AS hi FROM tg),
r2 AS (SELECT idx, coalesce(lag(hi) OVER (ORDER BY idx), 0) AS lo, hi FROM rg),
sl AS (SELECT i, (i % 2147483648) * 1327217885 % 2147483648 AS point FROM (SELECT unnest(range(ceil(target / block)::BIGINT)) AS i FROM bl)),
rk0 AS (SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY i) - 1 AS rank, i AS slot FROM sl JOIN r2 ON point >= lo AND point < hi),
wt AS (SELECT idx, ceil(round(tg.target)::BIGINT / block)::BIGINT AS wanted, (SELECT count(*) FROM rk0 WHERE rk0.idx = tg.idx) AS had FROM tg, bl),
ex AS (SELECT idx, had, greatest(wanted - had, 0) AS more, coalesce(sum(greatest(wanted - had, 0)) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM wt),
rk AS (SELECT rk0.* FROM rk0 JOIN wt USING (idx) WHERE rank < wanted
  UNION ALL SELECT idx, had + k, (SELECT ceil(target / block)::BIGINT FROM bl) + first + k FROM (SELECT *, unnest(range(more)) AS k FROM ex)),
ky AS (SELECT doc_id, size, idx, source_size, target, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR), 1, 8))::BIGINT AS k
  FROM sizes JOIN tg ON sizes.source IS NOT DISTINCT FROM tg.source),
pl AS (SELECT *, row_number() OVER () AS row, sum(size) OVER (PARTITION BY idx ORDER BY k, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS start FROM ky),
ps AS (SELECT pl.*, p, start + p * source_size AS a FROM pl, (SELECT unnest([0, 1]) AS p) WHERE size > 0),
bk AS (SELECT ps.*, unnest(range((a // block)::BIGINT, ((a + size - 1) // block)::BIGINT + 1)) AS rank, block FROM ps, bl),
ins AS (SELECT row, slot, greatest(least(a + size, (bk.rank + 1) * block, round(target)::BIGINT) - greatest(a, bk.rank * block), 0) AS part FROM bk JOIN rk USING (idx, rank)),
tk AS (SELECT row, sum(part)::BIGINT AS taken, (min(slot) FILTER (WHERE part > 0))::BIGINT AS first_slot FROM ins GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot FROM pl LEFT JOIN tk USING (row)
"""
