"""Token ids in binary shard files with Elias-Fano document boundaries.

Documents are dealt by ranges of doc_id; each task encodes its range in order and writes shard files of bounded size:

    ids        n_tokens little-endian unsigned integers of 2 or 4 bytes (2 where the vocabulary allows)
    doc ids    n_docs signed 64-bit integers, then one bit each for null
    low        the low `l` bits of the n_docs + 1 boundaries, packed
    high       their high parts in unary, one bit per boundary plus one per step
    directory  set bits of `high` before each block of 512 bits, unsigned 32-bit: select() needs no 64-bit table
    footer     the sizes above (struct FOOTER), a CRC-32 of everything before it and the magic number

An attempt writes files of its own and returns their names only when it ends, so a retried task leaves no half shard
in the manifest. The manifest has a row per shard, never per document.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, folder, fresh, gathered, id_text, small_batches, tidy
from .units import UnitEncoder

MAGIC = b"DGTOKEN1"
FOOTER = struct.Struct("<QQBBQQQI8s")  # n_tokens, n_docs, id bytes, low bits, low, high, directory bytes, crc, magic
BLOCK = 512
#: A shard is closed at this many ids.
SHARD_IDS = 16 << 20
#: Bytes of texts that ranges of rows with one doc_id are told apart by.
PREFIX = 64


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(last / n) bits each."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.bits, self.low, self.high, self.directory = n, bits, low, high, directory

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (last // max(n, 1)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if bits:
            split = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(split.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-(int(ones[-1]) + 1 if n else 1) // BLOCK) * BLOCK, np.uint8)
        flags[ones] = 1
        before = np.concatenate([[0], np.cumsum(flags.reshape(-1, BLOCK).sum(1, dtype=np.int64))[:-1]])
        return cls(n, bits, low, np.packbits(flags, bitorder="little"), before.astype("<u4"))

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at the given positions."""
        index = np.asarray(index, np.int64)
        block = np.searchsorted(self.directory, index, side="right") - 1
        inside = np.unpackbits(self.high.reshape(-1, BLOCK // 8)[block], axis=1, bitorder="little")
        seen = np.cumsum(inside, axis=1, dtype=np.int32)
        at = (seen > (index - self.directory[block])[:, None]).argmax(1)
        value = (block * BLOCK + at - index).astype(np.uint64) << np.uint64(self.bits)
        for b in range(self.bits):
            pos = index * self.bits + b
            value |= ((self.low[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return value.astype(np.int64)


class ShardWriter:
    """Collects documents in memory up to a bound and writes them as one shard."""

    def __init__(self, folder: str, width: int, limit: int = SHARD_IDS):
        self.folder, self.width, self.limit = folder, width, limit
        self.ids, self.docs, self.nulls, self.ends = bytearray(), array("q"), bytearray(), [0]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids += ids
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ends.append(len(self.ids) // self.width)

    def full(self) -> bool:
        return self.ends[-1] >= self.limit

    def close(self) -> tuple[str, int, int]:
        """Write the shard; its name, documents and ids."""
        ef = EliasFano.build(np.array(self.ends))
        n_tokens, n_docs = self.ends[-1], len(self.docs)
        parts = [bytes(self.ids), self.docs.tobytes(), np.packbits(np.frombuffer(bytes(self.nulls), np.uint8), bitorder="little").tobytes(), ef.low.tobytes(), ef.high.tobytes(), ef.directory.tobytes()]
        crc = 0
        for x in parts:
            crc = zlib.crc32(x, crc)
        parts.append(FOOTER.pack(n_tokens, n_docs, self.width, ef.bits, len(ef.low), len(ef.high), 4 * len(ef.directory), crc, MAGIC))
        name = f"{uuid.uuid4().hex}.dgtok"
        store, root = folder(self.folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}", compression=None) as f:
            for x in parts:
                f.write(x)
        self.ids, self.docs, self.nulls, self.ends = bytearray(), array("q"), bytearray(), [0]
        return name, n_docs, n_tokens


class Shard:
    """Random access to the documents of one shard file."""

    def __init__(self, uri: str):
        store, path = folder(uri)
        with store.open_input_file(path) as f:
            data = f.read()
        self.n_tokens, self.n_docs, self.width, bits, low, high, directory, crc, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC or zlib.crc32(memoryview(data)[: -FOOTER.size]) != crc:
            raise ValueError(f"{PurePosixPath(path).name}: not a whole token shard")
        at = self.n_tokens * self.width
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_tokens)
        self.docs = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        nulls = np.frombuffer(data, np.uint8, -(-self.n_docs // 8), at)
        self.nulls = np.unpackbits(nulls, bitorder="little", count=self.n_docs).astype(bool)
        at += len(nulls)
        lows, highs = np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low)
        self.ends = EliasFano(self.n_docs + 1, bits, lows, highs, np.frombuffer(data, "<u4", directory // 4, at + low + high))

    def tokens(self, i: int) -> np.ndarray:
        a, b = self.ends.select(np.array([i, i + 1]))
        return self.ids[a:b]


#: Characters of joined units that the library encodes in one call.
JOINED = 1 << 16
_ENCODERS: dict[tuple[str, int], UnitEncoder | Whole] = {}


class Whole:
    """Encodes every text as a whole."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode = encode


def encoder(path: str, width: int) -> UnitEncoder | Whole:
    """The tokenizers library behind a cache of units.

    New units are joined and encoded in one call, as no match of the split pattern goes over a unit's end; the bytes
    that each id stands for tell which unit it belongs to. Without a byte-level vocabulary they go one by one.
    """
    if (path, width) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        many = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        kind = np.dtype(f"<u{width}")
        vocab = tokenizer.get_vocab()
        lengths = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        lengths[list(vocab.values())] = [len(t) for t in vocab]  # a byte-level token has a character per byte

        def each(texts: list[str]) -> list[bytes]:
            return [np.array(e.ids, kind).tobytes() for e in many(texts, add_special_tokens=False)]

        def joined(texts: list[str]) -> list[bytes]:
            if not texts or any(t[:1] != " " for t in texts):
                return each(texts)
            out, start = [], 0
            while start < len(texts):
                size, stop = 0, start
                while stop < len(texts) and (size < JOINED or stop == start):
                    size += len(texts[stop])
                    stop += 1
                ids = np.array(many(["".join(texts[start:stop])], add_special_tokens=False)[0].ids, kind)
                ends = np.cumsum([len(t.encode()) for t in texts[start:stop]])
                cuts = np.searchsorted(np.cumsum(lengths[ids]), ends)
                upto = ((cuts + 1) * width).tolist()
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]
                start = stop
            return out

        parts = json.loads(tokenizer.to_str())
        before = parts.get("pre_tokenizer") or {}
        # units are cut where this split pattern cuts; a tokenizer that changes or splits texts otherwise gets them whole
        if parts.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"):
            own = UnitEncoder(each, width)
            own.encode_units = joined
        else:
            own = Whole(each)
        _ENCODERS[path, width] = own
    return _ENCODERS[path, width]


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS) -> list[dict]:
    """Encode docs in ascending doc_id order into shard files below folder; the manifest, in that order.

    Ties of doc_id go by text, null doc_ids come first, null texts count as empty and still get end_id. Extra columns
    are left out; an empty table gives an empty manifest. A manifest row: shard, n_docs, n_tokens, start (ids before it).
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    small_batches(spark)
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    end = end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = encoder(path, width), ShardWriter(folder, width, shard_ids)
        shards: list[tuple[str, int, int]] = []
        for batch in gathered(batches):
            packed = own.encode([(x or b"").decode("utf-8", "replace") for x in batch.column("text").to_pylist()])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), packed, strict=True):
                out.add(doc_id, ids + end)
                if out.full():
                    shards.append(out.close())
        if len(out.docs):
            shards.append(out.close())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(shards), pa.int64()), "seq": pa.array(range(len(shards)), pa.int64()), "shard": pa.array([x[0] for x in shards], pa.string()), "n_docs": pa.array([x[1] for x in shards], pa.int64()), "n_tokens": pa.array([x[2] for x in shards], pa.int64())})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the texts' first bytes deal an id's rows, or those without one, to many tasks
    dealt = id_text(docs).repartitionByRange(parts, F.col("doc_id"), F.substring("text", 1, PREFIX)).sortWithinPartitions("doc_id", "text")
    rows = sorted(dealt.mapInArrow(tidy(run), "part long, seq long, shard string, n_docs long, n_tokens long").collect())
    start, manifest = 0, []
    for r in rows:
        manifest.append({"shard": f"{folder}/{r['shard']}", "n_docs": r["n_docs"], "n_tokens": r["n_tokens"], "start": start})
        start += r["n_tokens"]
    return manifest


def read_tokens(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shard files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    step = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(name)
                for a in range(0, shard.n_docs, step):
                    b = min(a + step, shard.n_docs)
                    ends = shard.ends.select(np.arange(a, b + 1))
                    crcs = [zlib.crc32(shard.ids[x:y].astype("<u4").tobytes()) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.docs[a:b], pa.int64(), mask=shard.nulls[a:b]), "start": pa.array(ends[:-1] + before), "n_tokens": pa.array(np.diff(ends)), "ids_crc32": pa.array(crcs, pa.int64())})

    shards = spark.createDataFrame([(m["shard"], m["start"]) for m in manifest], "shard string, start long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(min(len(manifest), 4 * parts)).mapInArrow(tidy(run), schema)


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(spark, write_tokens(documents(spark, sf_dir), fresh(spark, "tokens")))
