"""SimHash near-duplicates found with covering locality-sensitive hashing.

Every bit position gets a vector of r + 1 bits; table v, one for each nonzero v of r + 1 bits, keeps the positions
whose vector has an odd product with v. Any r positions leave some v even for all of them, so two fingerprints that
differ in at most r bits agree in some table: no pair is missed, whatever the data.

Fingerprints are made distinct first, so copies of a text cost nothing further. Buckets are compared in blocks; a
bucket over BUCKET fingerprints is split again by quarters of the bits that its mask leaves free (r <= 3 differing
bits miss at least one of four quarters), until it is small; nothing is capped. Each bucket gives a star per connected
part, never all its pairs; label propagation with shortcuts joins the stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, id_text, saved, small_batches, tidy

RADIUS = 3
#: Distinct fingerprints that are compared with one another in one bucket.
BUCKET = 512
#: Rows that a task gathers before it compares them.
FLUSH = 16_384


def fingerprint(raw: bytes | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles: bit set if it is in over half the shingle hashes; 0 without words."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=False)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                fps = np.array([fingerprint(x, width, seed) for x in batch.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The masks of all tables, as signed longs; 2 ** (radius + 1) - 1 of them."""
    top = (1 << (radius + 1)) - 1
    vector = [1 + i % top for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, top + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        left = label[a] != label[b]
        if not left.any():
            break
        a, b = a[left], b[left]
    while (label != label[label]).any():
        label = label[label]
    return label


def _stars(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between each fingerprint and the first one of its part within its bucket; rows are sorted by key."""
    n = len(key)
    last = np.searchsorted(key, key, side="right") - 1
    here, a, b = np.flatnonzero(last > np.arange(n)), [], []
    shift = 1
    while len(here):
        near = here[np.bitwise_count(fp[here] ^ fp[here + shift]) <= radius]
        a.append(near)
        b.append(near + shift)
        shift += 1
        here = here[here + shift <= last[here]]
    if not a:
        return fp[:0], fp[:0]
    label = components(np.concatenate(a), np.concatenate(b), n)
    other = np.flatnonzero(label != np.arange(n))
    return fp[other], fp[label[other]]


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, held = [], [], 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal keys, fps, held
            if not held:
                return
            key, fp = np.concatenate(keys), np.concatenate(fps)
            end = len(key) if final else int(np.searchsorted(key, key[-1], side="left"))
            a, b = _stars(key[:end], fp[:end].view(np.uint64), radius)
            keys, fps, held = [key[end:]], [fp[end:]], len(key) - end
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys.append(batch.column("key").to_numpy())
            fps.append(batch.column("fp").to_numpy())
            held += batch.num_rows
            if held > FLUSH:
                yield from flush(False)
        yield from flush(True)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("key", "fp").repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(tidy(run), "a long, b long")


def _split(rows: DataFrame) -> DataFrame:
    """Deal the rows of large buckets to four smaller ones each, by the quarters of their free bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quarters: dict[int, list[int]] = {}
        for batch in batches:
            free = batch.column("free").to_numpy().view(np.uint64)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            key = batch.column("key").to_numpy()
            for q in range(4):
                for m in np.unique(free).tolist():
                    if m not in quarters:
                        on = [i for i in range(64) if m >> i & 1]
                        quarters[m] = [sum(1 << i for i in on[k::4]) for k in range(4)]
                part = np.array([quarters[m][q] for m in free.tolist()], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), q)), pa.array((fp & part).view(np.int64)), pa.array((free & ~part).view(np.int64)), pa.array(fp.view(np.int64))], ["old", "q", "bits", "free", "fp"])

    split = rows.select("key", "free", "fp").mapInArrow(tidy(run), "old long, q long, bits long, free long, fp long")
    return split.select(F.xxhash64("old", "q", "bits").alias("key"), "free", "fp")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect all pairs within the radius."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be from 0 to 3")
    tables = [F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in enumerate(covering_masks(radius))]
    at = F.explode(F.array(*tables)).alias("at")
    rows = fps.select("fp", at).select(F.xxhash64("at.t", F.col("fp").bitwiseAND(F.col("at.m"))).alias("key"), F.bitwise_not(F.col("at.m")).alias("free"), "fp")
    out = None
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        rows = saved(rows.join(counts, "key"), "simhash-buckets")
        found = _bucket_links(rows.filter(F.col("n") <= bucket), radius)
        out = found if out is None else out.unionByName(found)
        large = rows.filter((F.col("n") > bucket) & (F.col("free") != 0))
        if large.isEmpty():
            return out.distinct()
        rows = _split(large)


def connected(edges: DataFrame) -> DataFrame:
    """node, label (its part's smallest node) of every node in edges a, b: label propagation with shortcuts."""
    edges = saved(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = saved(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("label")), "cc-labels")
    while True:
        near = edges.join(labels, edges.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("further"))
        lower = lower.join(up, lower.label == up.up, "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        lower = saved(lower, "cc-labels")
        labels = lower.select("node", "label")
        if lower.filter("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links) of every row.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows come out as often. A part whose
    doc_ids are all null has a null component_id. Extra columns are left out; an empty table gives an empty one.
    """
    fps = saved(fingerprints(docs, width, seed), "simhash")
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    label = connected(links(classes.select("fp"), radius, bucket))
    parts = classes.join(label, classes.fp == label.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = parts.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = saved(parts.join(least, "label").select("fp", "component_id"), "simhash-parts")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
