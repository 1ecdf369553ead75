"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words (matches of the split pattern) of a shard of documents form one symbol sequence. An inverted index
maps each mergeable token pair, by its rank, to its positions in that sequence. Ranks are taken in ascending order;
each merge is applied at all its positions at once and only the touched neighbours enter the index anew. Every
document is then the concatenation of its words' ids. No shuffle, no driver state: a shard is one Arrow batch, and
the words met before stay in a bounded cache of the Python worker.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, gathered, id_text, small_batches, tidy
from .units import UnitEncoder

#: Pairs remembered by a worker; beyond it the memo starts afresh.
MEMO_PAIRS = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def unicode_pattern(pattern: str) -> regex.Pattern:
    """The split pattern with white space as Unicode's White_Space property, as in Rust's regular expressions."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        # merges of two bytes, known from the start
        self.pair = np.full((256, 256), -1, np.int64)
        self.bytes_memo = {}
        for a in range(256):
            for b in range(256):
                r = ranks.get(bytes([a, b]), -1)
                self.pair[a, b] = r
                self.bytes_memo[self.single[a], self.single[b]] = r
        self.memo: dict[tuple[int, int], int] = dict(self.bytes_memo)

    def _rank(self, a: int, b: int) -> int:
        """Rank of the token that a and b merge to, -1 if there is none."""
        r = self.memo.get((a, b))
        if r is None:
            r = self.memo[a, b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return r

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. A word that is itself a token keeps that token."""
        if len(self.memo) > MEMO_PAIRS:
            self.memo = dict(self.bytes_memo)
        out: list[list[int]] = [[]] * len(words)
        todo: list[int] = []
        whole = self.ranks.get
        for i, w in enumerate(words):
            if (t := whole(w)) is not None:
                out[i] = [t]
            elif w:
                todo.append(i)
        # all words in a row, an end mark after each; the index of their pairs of bytes
        joined = np.frombuffer(b"".join([words[i] + b"\0" for i in todo]), np.uint8)
        sizes = np.fromiter((len(words[i]) + 1 for i in todo), np.int64, len(todo))
        stops = np.cumsum(sizes) - 1
        starts = list(zip(todo, (stops - sizes + 1).tolist(), strict=True))
        symbols = np.array(self.single)[joined]
        symbols[stops] = -1
        sym: list[int] = symbols.tolist()
        n = len(sym)
        index: dict[int, list[int]] = {}
        if n:
            first = self.pair[joined[:-1], joined[1:]]
            first[symbols[:-1] < 0] = -1
            first[symbols[1:] < 0] = -1
            at = np.flatnonzero(first >= 0)
            at = at[np.argsort(first[at], kind="stable")]
            own, begin = np.unique(first[at], return_index=True)
            for r, part in zip(own.tolist(), np.split(at, begin[1:]), strict=True) if len(at) else ():
                index[r] = part.tolist()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        memo, rank = self.memo, self._rank
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            for p in sorted(index.pop(r)):
                a = sym[p]
                if a < 0:
                    continue
                q = after[p]
                b = sym[q]
                if b < 0 or memo.get((a, b)) != r:
                    continue
                sym[p], sym[q] = r, -2
                after[p] = s = after[q]
                before[s] = p
                low = False
                o = before[p]
                if o >= 0 and (x := sym[o]) >= 0:
                    t = memo.get((x, r))
                    if t is None:
                        t = rank(x, r)
                    if t >= 0:
                        low |= t < r
                        if t in index:
                            index[t].append(o)
                        elif t != r:
                            index[t] = [o]
                            heapq.heappush(heap, t)
                if (y := sym[s]) >= 0:
                    t = memo.get((r, y))
                    if t is None:
                        t = rank(r, y)
                    if t >= 0:
                        low |= t < r
                        if t in index:
                            index[t].append(p)
                        elif t != r:
                            index[t] = [p]
                            heapq.heappush(heap, t)
                if low:
                    self._finish(sym, before, after, p)
        for i, p in starts:
            ids = []
            while (x := sym[p]) != -1:
                ids.append(x)
                p = after[p]
            out[i] = ids
        return out

    def _finish(self, sym: list[int], before: list[int], after: list[int], p: int) -> None:
        """A merge made a pair of lower rank, which comes first in its own word: end that word by itself."""
        while before[p] >= 0 and sym[before[p]] != -1:
            p = before[p]
        while True:
            best, at, q = -1, -1, p
            while sym[after[q]] != -1:
                t = self._rank(sym[q], sym[after[q]])
                if t >= 0 and (best < 0 or t < best):
                    best, at = t, q
                q = after[q]
            if best < 0:
                return
            q = after[at]
            sym[at], sym[q] = best, -2
            after[at] = after[q]
            before[after[q]] = at


class BpeCodec:
    """Encoder and decoder of one rank file; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.replay = MergeReplay(load_ranks(path))
        self.find = unicode_pattern(pattern).findall
        self.words: dict[str, bytes] = {}
        self.units = UnitEncoder(self._encode_many, 4)
        top = max(self.replay.token) + 1
        self.token = [self.replay.token.get(i, b"") for i in range(top)]

    def _encode_many(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > self.units.cache_units:
            self.words.clear()
        cut = [self.find(t) for t in texts]
        new = list({w for ws in cut for w in ws} - self.words.keys())
        for w, ids in zip(new, self.replay.encode_words([w.encode() for w in new]), strict=True):
            self.words[w] = array("I", ids).tobytes()
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.units.encode(texts)

    def decode(self, packed: bytes) -> bytes:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.token.__getitem__, ids))


_CODECS: dict[tuple[str, str], BpeCodec] = {}


def codec(path: str, pattern: str) -> BpeCodec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BpeCodec(path, pattern)
    return _CODECS[path, pattern]


def _text(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian uint32) and decoded (bytes of the ids) of every row of docs.

    A null text counts as empty: no ids. Repeated rows give repeated rows; extra columns are left out; an empty table
    gives an empty one. Invalid UTF-8 is read with replacement characters. path: a rank file that every executor has.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in gathered(batches):
            packed = own.encode([_text(x) for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array([own.decode(x) for x in packed], pa.binary())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode() with its packed columns hashed in the same pass."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    small_batches(docs.sparkSession)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in gathered(batches):
            packed = own.encode([_text(x) for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([sha(x) for x in packed]), pa.array([sha(own.decode(x)) for x in packed])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
