"""Quality rules: plain counts and an n-gram perplexity with bands for each language.

Each language has a modified Kneser-Ney model over byte classes of its own, counted with Spark over all its documents:
letters folded to lower case, digits, white space, three kinds of marks, and 32 classes of the bytes that other scripts'
characters begin with and go on with. A model is sorted arrays of n-gram hashes with a probability and a back-off weight
each, built by language in a task of its own and kept in the shared folder, from which workers read those they need. A
document is rejected if its perplexity lies outside its language's band, a few interquartile ranges around the quartiles
of that language's documents.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, folder, fresh, saved, small_batches, tidy

BITS, ORDER = 6, 5
CLASSES, SPACE = 1 << BITS, 27
#: Symbols that the plain rule counts.
SYMBOLS = b"#*$%&|<>"
#: Slabs that a language's counts are added up in, by the first class of an n-gram; models that a worker holds.
SLABS, HELD = 16, 8
#: Groups in which the tasks' rows of a slab are added up before their sums are.
MERGED = 64
#: How far a band reaches below the first quartile and above the third, in interquartile ranges: text that says the same again
#: and again is to lie further off than text that no model knows.
REACH = (4.0, 2.0)


def _classes() -> np.ndarray:
    table = np.full(256, 30, np.uint8)  # other marks and symbols
    for b in b" \t\n\x0b\x0c\r":
        table[b] = SPACE
    for b in b".,;:!?":
        table[b] = 28
    for b in b"'\"-()":
        table[b] = 29
    table[ord("0") : ord("9") + 1] = 26
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = k
    high = np.arange(128, 256)
    table[128:] = np.where(high < 192, 32, 48) + (high & 15)  # goes on with a character, begins one
    return table


CLASS = _classes()


def gram_codes(raw: bytes) -> np.ndarray:
    """The code of the n-gram that ends at each byte; the text is preceded by white space."""
    c = np.empty(len(raw) + ORDER - 1, np.int32)
    c[: ORDER - 1] = SPACE
    c[ORDER - 1 :] = CLASS[np.frombuffer(raw, np.uint8)]
    code = c[: len(raw)].copy()
    for k in range(1, ORDER):
        code <<= BITS
        code += c[k : k + len(raw)]
    return code


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and their counts added up."""
    key, where = np.unique(np.concatenate(codes), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _opened(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


_COUNTS = "lang string, slab int, codes binary, n binary"


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, slab, codes, n (packed): how often each n-gram ends at a byte of a language's texts. Summed in each task before
    the shuffle, then by slab, so that no task meets the counts of all others."""
    small_batches(docs.sparkSession)
    per = CLASSES**ORDER // SLABS

    def rows(lang: str | None, codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.searchsorted(codes, np.arange(SLABS + 1, dtype=np.int64) * per)
        for slab, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b > a:
                body = [_squeezed(np.diff(codes[a:b], prepend=np.int32(0)).astype(np.int32)), _squeezed(n[a:b])]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "slab": pa.array([slab], pa.int32()), "codes": pa.array(body[:1], pa.binary()), "n": pa.array(body[1:], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for batch in chunks(whole):
                by: dict[str | None, list[np.ndarray]] = {}
                for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if raw:
                        by.setdefault(lang, []).append(gram_codes(raw))
                for lang, parts in by.items():
                    key, n = np.unique(np.concatenate(parts), return_counts=True)
                    total[lang] = _summed([total[lang][0], key], [total[lang][1], n]) if lang in total else (key, n)
        for lang, (key, n) in total.items():
            yield from rows(lang, key, n.astype(np.int64))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def out() -> Iterator[pa.RecordBatch]:
            if at is not None:
                yield from rows(at[0], *_summed(*held))

        for batch in batches:
            for lang, slab, codes, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "slab", "codes", "n")), strict=True):
                if at != (lang, slab):
                    yield from out()
                    at, held = (lang, slab), ([], [])
                elif len(held[0]) >= 16:
                    held = tuple([x] for x in _summed(*held))
                held[0].append(np.cumsum(_opened(codes, np.int32), dtype=np.int32))
                held[1].append(_opened(n, np.int64))
        yield from out()

    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    counted = own.mapInArrow(tidy(count), _COUNTS)
    # added in MERGED groups first, so that no task reads a row of every other
    group = F.pmod(F.monotonically_increasing_id(), F.lit(MERGED)).alias("group")
    some = counted.select("*", group).repartition("lang", "slab", "group").sortWithinPartitions("lang", "slab", "group").drop("group").mapInArrow(tidy(add), _COUNTS)
    return some.repartition("lang", "slab").sortWithinPartitions("lang", "slab").mapInArrow(tidy(add), _COUNTS)


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more; fixed ones where counts of counts are missing."""
    n1, n2, n3, n4 = (int((n == k).sum()) for k in (1, 2, 3, 4))
    if not min(n1, n2, n3, n4):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.clip(np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]), [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


class KneserNey:
    """Interpolated modified Kneser-Ney in sorted arrays: keys[k], prob[k] for (k + 1)-grams, context[k], weight[k] for their histories."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        key, n = np.asarray(grams, np.int64)[order], np.asarray(counts, np.int64)[order]
        tables = [(key, n)]
        for k in range(ORDER - 1, 0, -1):  # how many different classes precede each shorter n-gram
            key, n = np.unique(key % CLASSES**k, return_counts=True)
            tables.append((key, n))
        self.keys, self.prob, self.context, self.weight = [], [], [], []
        for key, n in tables[::-1]:
            d = _discounts(n)
            context, where = np.unique(key // CLASSES, return_inverse=True)
            total = np.bincount(where, n, len(context))
            cut = d[np.minimum(n, 3)]
            weight = np.bincount(where, cut, len(context)) / np.maximum(total, 1)
            p = (n - cut) / total[where]
            lower = self.probability(key, len(self.keys)) if self.keys else np.full(len(key), 1 / CLASSES)
            self.keys.append(key)
            self.prob.append(p + weight[where] * lower)
            self.context.append(context)
            self.weight.append(weight)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def probability(self, codes: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Probability of the last class of each n-gram code given up to k - 1 classes before it."""
        p = np.full(len(codes), 1 / CLASSES)
        for j in range(k):
            own = codes % CLASSES ** (j + 1)
            at, there = self._find(self.keys[j], own)
            ctx, known = self._find(self.context[j], own // CLASSES)
            p = np.where(there, self.prob[j][at], np.where(known, self.weight[j][ctx], 1.0) * p)
        return p

    def arrays(self) -> list[np.ndarray]:
        """What a look-up needs: bits of the longest n-grams by their hash (the code), and the tables to back off to."""
        top = [self.keys[-1].astype(np.int32), (-np.log2(self.prob[-1])).astype(np.float32)]
        lower = [x.astype(np.int64 if k % 2 == 0 else np.float64) for j in range(ORDER) for k, x in enumerate((self.keys[j], self.prob[j], self.context[j], self.weight[j]))]
        return top + lower

    @classmethod
    def restored(cls, arrays: list[np.ndarray]) -> KneserNey:
        self = cls.__new__(cls)
        self.top, self.cost = arrays[:2]
        self.keys, self.prob, self.context, self.weight = (arrays[2 + k :: 4] for k in range(4))
        return self

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """-log2 of every n-gram's probability (of a restored model)."""
        at, there = self._find(self.top, codes)
        out = self.cost[at]
        if not there.all():
            out[~there] = -np.log2(self.probability(codes[~there].astype(np.int64)))
        return out


_KINDS = [np.int32, np.float32] + [np.int64, np.float64, np.int64, np.float64] * ORDER


def models(docs: DataFrame) -> str:
    """The folder of a table with a model for each language of docs: lang and its arrays, packed. Each language's is made in a
    task of its own from its summed counts, of which there are CLASSES ** ORDER at most whatever the corpus."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[list, list]] = {}
        for batch in batches:
            for lang, codes, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "codes", "n")), strict=True):
                own = held.setdefault(lang, ([], []))
                own[0].append(np.cumsum(_opened(codes, np.int32), dtype=np.int32))
                own[1].append(_opened(n, np.int64))
        for lang, (codes, n) in held.items():
            made = KneserNey(np.concatenate(codes), np.concatenate(n))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "arrays": pa.array([[_squeezed(x) for x in made.arrays()]], pa.list_(pa.binary()))})

    path = fresh(docs.sparkSession, "quality-models")
    gram_counts(docs).repartition("lang").mapInArrow(tidy(build), "lang string, arrays array<binary>").write.parquet(path)
    return path


_MODELS: OrderedDict[tuple[str, str | None], KneserNey] = OrderedDict()


def model(path: str, lang: str | None) -> KneserNey:
    """A language's model from a folder of models(); a worker holds HELD of them."""
    if (path, lang) not in _MODELS:
        store, root = folder(path)
        own = ds.field("lang").is_null() if lang is None else ds.field("lang") == lang
        rows = ds.dataset(root, filesystem=store, format="parquet").to_table(filter=own)
        _MODELS[path, lang] = KneserNey.restored([_opened(x, kind) for x, kind in zip(rows["arrays"][0].as_py(), _KINDS, strict=True)])
        while len(_MODELS) > HELD:
            _MODELS.popitem(last=False)
    _MODELS.move_to_end((path, lang))
    return _MODELS[path, lang]


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of `width` words that occur twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    roll = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
            roll ^= roll >> np.uint64(29)
    order = np.argsort(roll)
    same = roll[order][1:] == roll[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    edge[:n] += twice
    edge[width:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def plain_counts(raw: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = raw or b""
    words = raw.split()
    if not words:
        return 0, 0, sum(map(raw.count, (bytes([b]) for b in SYMBOLS))), 0, 0
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(seen.sum() - seen[128:192].sum() - sum(seen[b] for b in b" \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, int(sum(seen[b] for b in SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, lang, the plain counts and bits: the bits a byte of the language's model below path, null for an empty text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                raws, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
                counts = list(zip(*map(plain_counts, raws), strict=True))
                bits: list[float | None] = [None] * len(raws)
                by: dict[str | None, list[int]] = {}
                for i, (lang, raw) in enumerate(zip(langs, raws, strict=True)):
                    if raw:
                        by.setdefault(lang, []).append(i)
                for lang, own in by.items():
                    cost = model(path, lang).bits(np.concatenate([gram_codes(raws[i]) for i in own])).astype(np.float64)
                    sizes = np.array([len(raws[i]) for i in own])
                    for i, x in zip(own, (np.add.reduceat(cost, np.cumsum(sizes) - sizes) / sizes).tolist(), strict=True):
                        bits[i] = x
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": batch.column("lang")} | {k: pa.array(v, pa.int64()) for k, v in zip(COLUMNS, counts, strict=True)} | {"bits": pa.array(bits, pa.float64())})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(tidy(run), "doc_id long, lang string, " + ", ".join(f"{k} long" for k in COLUMNS) + ", bits double")


def bands(scored: DataFrame, reach: tuple[float, float] = REACH) -> DataFrame:
    """lang, low, high: perplexity bands in bits a byte, from the quartiles of each language's documents, however many.

    Quartiles come from counts of hundredths of a bit, so the result doesn't depend on the order of rows.
    """
    bins = scored.filter("bits is not null").groupBy("lang", F.round("bits", 2).alias("bin")).agg(F.count("*").alias("n"))
    cuts = bins.groupBy("lang").agg(F.percentile("bin", F.lit(0.25), F.col("n")).alias("q1"), F.percentile("bin", F.lit(0.75), F.col("n")).alias("q3"))
    width = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.02))
    return cuts.select("lang", (F.col("q1") - reach[0] * width).alias("low"), (F.col("q3") + reach[1] * width).alias("high"))


def judge(docs: DataFrame, reach: tuple[float, float] = REACH) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and bits of every row.

    base_failed: under 20 words, or over 30 % of the words repeated; kept: not base_failed, and bits within the band of
    the row's language (a null lang is a language of its own). Null texts have no words. Repeated rows come out as
    often; extra columns are left out; an empty table gives an empty one.
    """
    scored = saved(score(docs, models(docs)), "quality")
    # a row for each language, of 24 bytes and its name
    rows = scored.alias("s").join(bands(scored, reach).alias("b"), F.col("s.lang").eqNullSafe(F.col("b.lang")), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    inside = F.coalesce((F.col("bits") >= F.col("low")) & (F.col("bits") <= F.col("high")), F.lit(False))
    return rows.select("doc_id", *COLUMNS, failed.alias("base_failed"), (~failed & inside).alias("kept"), "bits")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
