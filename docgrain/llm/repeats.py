"""Removal of long repeats by run-length compressed Burrows-Wheeler transforms of the repetitive part of a corpus.

1. Anchors (see anchors.py): every string of `length` bytes holds one, at a place that its bytes alone decide. Anchors
   whose GRAM bytes occur once can't be in a repeat; the rest, with the bytes around them (their context: all windows
   that hold the anchor), are the repetitive part of the corpus.
2. Equal contexts are counted before anything is compared; all windows of a context that occurs twice are repeats.
3. The different contexts of an anchor are aligned on it and indexed in shards: the transform is made column by column
   from the right (a stable sort by one byte gives the suffix order of the column before), and kept as runs with the
   contexts at the runs' ends. Where the byte before a suffix equals that of its neighbour in suffix order, the pair
   stays adjacent one column further left and its match is longer by one; so only pairs at run ends are compared, and
   the matching statistics of all other windows follow by streaming from column to column. A window whose longest match
   with another context is `length` bytes or more is a repeat.
4. An anchor with over HOT different contexts is dealt to narrower ranges of windows, each keyed by the bytes that all
   of its windows hold, down to single windows, which need only be counted. Nothing is capped or left out.

Marked windows are gathered by document and cut from the text in one join.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import GRAM, anchors
from .common import chunks, documents, release, saved, small_batches, tidy

LENGTH = 200
#: Different contexts of one anchor that are indexed together; contexts of a shard.
HOT, SHARD = 1024, 4096
#: Window ranges of the narrower levels.
NARROW = (13, 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class RunIndex:
    """Run-compressed transform of aligned contexts.

    group: a number per context, ascending; only contexts of one group are compared. skip: columns that a context lacks
    on the left. Columns are window starts 0 .. wide - 1 and the bytes up to the last window's end.
    """

    def __init__(self, group: np.ndarray, skip: np.ndarray, bodies: list[bytes], wide: int, length: int = LENGTH):
        n, columns = len(bodies), wide - 1 + length
        self.wide, self.length, self.skip = wide, length, skip
        self.stop = skip + np.fromiter(map(len, bodies), np.int64, n)
        # bytes plus one, 0 where a context has none
        self.symbols = np.zeros((n, columns), np.uint16)
        flat = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint16) + np.uint16(1)
        row = np.repeat(np.arange(n), self.stop - skip)
        begin = np.cumsum(self.stop - skip) - (self.stop - skip)
        self.symbols[row, np.arange(len(flat)) + np.repeat(skip - begin, self.stop - skip)] = flat
        order = np.arange(n)
        base = group.astype(np.int64) * 257
        first = np.diff(group, prepend=-1) != 0  # of a group, in any order that keeps groups together
        heads, before, at = [], [], []
        for column in range(columns - 1, -1, -1):
            order = order[np.argsort((base + self.symbols[:, column])[order], kind="stable")]
            if column < wide:
                if column:
                    prior = self.symbols[order, column - 1]
                    end = np.flatnonzero((prior[1:] != prior[:-1]) & ~first[1:]) + 1
                else:
                    end = np.flatnonzero(~first[1:]) + 1
                heads.append(order[end])
                before.append(order[end - 1])
                at.append(np.full(len(end), column))
        #: At each end of a run: the context that heads the next run, the one before it in suffix order, the column.
        self.head, self.before, self.at = np.concatenate(heads), np.concatenate(before), np.concatenate(at)

    def matches(self) -> np.ndarray:
        """Longest match of each context's suffix from each window start with another context; short ones may read lower."""
        n, wide, length = len(self.symbols), self.wide, self.length
        x, y, c = self.head, self.before, self.at
        some = np.minimum(c + min(7, length - 1), self.symbols.shape[1] - 1)
        near = np.flatnonzero((self.symbols[x, c] == self.symbols[y, c]) & (self.symbols[x, some] == self.symbols[y, some]) & (self.stop[x] - c >= length) & (self.stop[y] - c >= length))
        up, down = np.zeros((n, wide), np.int64), np.zeros((n, wide), np.int64)
        column = np.arange(self.symbols.shape[1])
        for a in range(0, len(near), 16_384):
            k = near[a : a + 16_384]
            other = self.symbols[x[k]] != self.symbols[y[k]]
            other &= column >= c[k][:, None]
            there = np.where(other.any(1), other.argmax(1), len(column)) - c[k]
            there = np.minimum(there, np.minimum(self.stop[x[k]], self.stop[y[k]]) - c[k])
            up[x[k], c[k]] = there + c[k]
            down[y[k], c[k]] = there + c[k]
        # streaming: one column on, a match is shorter by one unless a run end says more
        return np.maximum(np.maximum.accumulate(up, axis=1), np.maximum.accumulate(down, axis=1)) - np.arange(wide)

    def repeats(self) -> np.ndarray:
        """Which windows of each context also occur in another context of its group."""
        start = np.arange(self.wide)
        whole = (start >= self.skip[:, None]) & (start + self.length <= self.stop[:, None])
        return whole & (self.matches() >= self.length)


def _raw() -> Column:
    return F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))


def _hash(*salt: int) -> Column:
    return F.xxhash64(*map(F.lit, salt), F.col("doc_id").cast("long"), _raw())


def clashes(docs: DataFrame) -> list[int]:
    """Hashes of id and text that different rows share: a second hash tells. Some 3 are to be expected in 10**10 rows, 300 in 10**11."""
    twice = docs.select(_hash().alias("k"), _hash(1).alias("other")).groupBy("k").agg(F.min("other").alias("a"), F.max("other").alias("b"))
    return [r.k for r in twice.filter("a <> b").select("k").collect()]


def _keyed(docs: DataFrame, clashing: list[int]) -> DataFrame:
    """docs and its own key (a hash of id and text, with another salt where that clashes), n (bytes) and raw (the text as bytes),
    under names that can't clash."""
    k = F.when(_hash().isin(clashing), _hash(2)).otherwise(_hash()) if clashing else _hash()
    return docs.select(F.struct("*").alias("row"), k.alias("k"), F.length(_raw()).alias("n"), _raw().alias("raw"))


def _occurrences(keyed: DataFrame, length: int) -> DataFrame:
    """k, pos, h, c: the anchors of all texts, with the hashes of their bytes and of their contexts."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for whole in batches:
            for batch in chunks(whole, "raw"):
                texts = batch.column("raw").to_pylist()
                who, at, h = anchors(texts, length)
                c = np.fromiter((digest(texts[i][max(0, a - reach) : a + length], min(a, reach)) for i, a in zip(who.tolist(), at.tolist(), strict=True)), np.uint64, len(who))
                yield pa.RecordBatch.from_pydict({"k": pa.array(batch.column("k").to_numpy()[who]), "pos": pa.array(at.astype(np.int32)), "h": pa.array(h.view(np.int64)), "c": pa.array(c.view(np.int64))})

    return keyed.filter(F.col("n") >= length).select("k", "raw").mapInArrow(tidy(run), "k long, pos int, h long, c long")


def _index(rows: DataFrame, wide: int, length: int, parts: int) -> DataFrame:
    """k, a, b: spans of the repeats that the run index finds in rows (key, c, m, k, base, skip, body) of small groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                key = np.array([r[0] for r in held])
                group = np.cumsum(np.diff(key, prepend=key[0]) != 0)
                found = RunIndex(group, np.array([r[5] for r in held]), [r[6] for r in held], wide, length).repeats()
                found[[i for i, r in enumerate(held) if r[2] > 1]] = False  # all of theirs are marked already
                edge = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
                (i, a), (_, b) = np.nonzero(edge > 0), np.nonzero(edge < 0)
                k, base = np.array([r[3] for r in held], np.int64), np.array([r[4] for r in held], np.int64)
                yield pa.RecordBatch.from_pydict({"k": pa.array(k[i]), "a": pa.array((base[i] + a).astype(np.int32)), "b": pa.array((base[i] + b - 1 + length).astype(np.int32))})
            held.clear()

        for batch in batches:
            for r in zip(*(batch.column(n).to_pylist() for n in ("key", "c", "m", "k", "base", "skip", "body")), strict=True):
                if held and held[-1][:2] == r[:2]:
                    continue  # rows repeated whole have one context between them
                if len(held) >= SHARD and held[-1][0] != r[0]:
                    yield from flush()
                held.append(r)
        yield from flush()

    return rows.select("key", "c", "m", "k", "base", "skip", "body").repartition(parts, "key").sortWithinPartitions("key", "c").mapInArrow(tidy(run), "k long, a int, b int")


def _narrower(rows: DataFrame, wide: int, narrow: int, length: int) -> DataFrame:
    """Deal contexts with `wide` windows to ranges of `narrow`, keyed by the bytes that all windows of a range hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[tuple] = []
            for key, m, k, base, skip, body in zip(*(batch.column(n).to_pylist() for n in ("key", "m", "k", "base", "skip", "body")), strict=True):
                stop = skip + len(body)
                for lo in range(0, wide, narrow):
                    last = min(lo + narrow, wide) - 1
                    if stop < lo + length or skip > last:
                        continue
                    core = body[last - skip : lo + length - skip]
                    a = max(skip, lo)
                    own = body[a - skip : last + length - skip]
                    out.append((_signed(digest(core + struct.pack("<qi", key, lo))), _signed(digest(own, a - lo)), m, k, base + lo, a - lo, own))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "c", "m", "k", "base", "skip", "body"])

    return rows.mapInArrow(tidy(run), "key long, c long, m long, k long, base int, skip int, body binary")


def _hot(rows: DataFrame, wide: int, narrow: tuple[int, ...], length: int, hot: int, parts: int) -> list[DataFrame]:
    """Spans from anchors with many contexts."""
    rows = saved(_narrower(rows, wide, narrow[0], length), "repeats-narrow")
    classes = saved(rows.groupBy("key", "c").agg(F.sum("m").alias("m"), F.min(F.struct("k", "base", "skip", "body")).alias("one")), "repeats-narrow-classes")
    twice = classes.filter("m > 1").select("key", "c")
    begin = F.col("base") + F.col("skip")
    out = [rows.filter("m = 1").join(twice, ["key", "c"]).filter(F.length("body") >= length).select("k", begin.alias("a"), (begin + F.length("body")).alias("b"))]
    groups = classes.groupBy("key").agg(F.count("*").alias("g")).filter("g > 1")
    mixed = saved(classes.join(groups, "key").select("key", "c", "m", "one.*", "g"), "repeats-narrow-mixed")
    out.append(_index(mixed.filter(F.col("g") <= hot), narrow[0], length, parts))
    large = mixed.filter(F.col("g") > hot)
    if len(narrow) > 1 and not large.isEmpty():
        out += _hot(large, narrow[0], narrow[1:], length, hot, parts)
    return out


def spans(keyed: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """k and spans (array of a, b: byte offsets, half open, unordered, maybe overlapping) of the texts (k, n, raw) that hold repeats.

    Rows repeated whole are documents of their own, so all their windows repeat; they share k, and each span is given once.
    """
    spark = keyed.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reach, wide = length - GRAM, length - GRAM + 1
    found = saved(_occurrences(keyed, length), "repeats-anchors")
    # saved, so that the join below deals both sides anew and can split an anchor that holds many of the rows
    again = saved(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeats-again")
    rows = saved(found.join(again, "h"), "repeats-candidates")
    release(spark)
    classes = saved(rows.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("k", "pos")).alias("one")), "repeats-classes")
    twice = classes.filter("m > 1").select("h", "c")
    full = saved(rows.join(twice, ["h", "c"]).select("k", F.greatest(F.col("pos") - reach, F.lit(0)).alias("a"), (F.col("pos") + length).alias("b")), "repeats-full")
    groups = saved(classes.groupBy("h").agg(F.count("*").alias("g")).filter("g > 1"), "repeats-groups")
    mixed = classes.join(groups, "h").select(F.col("h").alias("key"), "c", "m", "one.k", "one.pos", "g")
    begin = F.greatest(F.col("pos") - reach, F.lit(0))
    body = F.substring("raw", begin + 1, F.col("pos") + length - begin)
    texts = keyed.filter(F.col("n") >= length).select("k", "raw")
    context = mixed.join(texts, "k").select("key", "c", "m", "k", (F.col("pos") - reach).alias("base"), (begin - F.col("pos") + reach).alias("skip"), body.alias("body"), "g")
    context = saved(context, "repeats-contexts")
    release(spark)
    out = [full, _index(context.filter(F.col("g") <= hot), wide, length, parts)]
    large = context.filter(F.col("g") > hot)
    if not large.isEmpty():
        out += _hot(large, wide, NARROW, length, hot, parts)
    every = out[0]
    for df in out[1:]:
        every = every.union(df)
    every = saved(every, "repeats-spans")
    release(spark)
    return every.groupBy("k").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def covered(n: int, own: list[dict] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of n bytes, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], min(s["b"], n)) for s in own or ()):
        if b - a < length:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """raw without the runs."""
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the characters that they cut through."""
    out = []
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def _apply(docs: DataFrame, each: Callable[[bytes, list[tuple[int, int]]], tuple], names: list[str], kinds: list[pa.DataType], schema: str, length: int, hot: int) -> DataFrame:
    """row (docs' columns as a struct) with the values that each(raw, runs) gives for every row of docs."""
    keyed = _keyed(docs, clashes(docs))
    joined = keyed.join(spans(keyed.drop("row"), length, hot), "k", "left").select("row", "raw", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "raw"):
                values = [each(raw, covered(len(raw), own, length)) for raw, own in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
                columns = list(zip(*values, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["row", *names])

    return joined.mapInArrow(tidy(run), f"row {joined.schema['row'].dataType.simpleString()}, {schema}")


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """docs with every character cut from `text` whose bytes all lie in a repeat of `length` bytes; n_chars, if there, follows.

    A repeat is a string of `length` bytes that also starts elsewhere, in the same text or another one; texts are judged
    as they come in. A null text stays null and takes no part. Other columns, whatever their names, stay as they are;
    rows repeated whole are repeats of one another; an empty table gives an empty one.
    """

    def each(raw: bytes, runs: list[tuple[int, int]]) -> tuple:
        return (cut(raw, whole_characters(raw, runs)).decode("utf-8", "replace"),)

    done = _apply(docs.withColumn("text", F.col("text").cast("string")), each, ["kept"], [pa.string()], "kept string", length, hot)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    count = F.when(F.col("row.text").isNotNull(), F.length("kept"))
    columns = {"text": text} | ({"n_chars": count.cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*[columns.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def digests(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row: what removal byte by byte leaves. Null: empty."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def each(raw: bytes, runs: list[tuple[int, int]]) -> tuple:
        return len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(cut(raw, runs)).hexdigest()

    keyed = _keyed(own, clashes(own)).select(F.col("row.doc_id").alias("doc_id"), "k", "n", "raw")
    joined = keyed.join(spans(keyed.drop("doc_id"), length, hot), "k", "left").select("doc_id", "raw", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "raw"):
                values = [each(raw, covered(len(raw), s, length)) for raw, s in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
                n, removed, count, sha = list(zip(*values, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
