"""Many passages or keywords in many texts at once: exactly by an Aho-Corasick automaton, approximately by bit-parallel search.

Passages are dealt into blocks of bounded size; the automaton of a block is built once in every worker and run over the texts
as they stand, so there is no row for a window of a text and texts aren't shuffled. A text is read once for each block.

Approximate search: a passage of m characters that a text holds with up to e errors, cut into e + 1 pieces, has one of them in
the text unchanged. The automaton finds the pieces; around each, bit vectors of the passage's length go over the text, one
step a character, and give the edit distance at every place where a copy may end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pieces as parts
from ..session import saved, small_batches, tidy

#: Characters of the passages that make an automaton.
BLOCK = 4 << 20
#: Bytes of the texts that a task holds as strings at once.
TEXTS = 4 << 20
_AUTOMATA: dict[str, tuple] = {}


def _built(name: str, make: Callable[[], tuple]) -> tuple:
    """What make() gives, built once in a worker and kept until another is asked for."""
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name] = make()
    return _AUTOMATA[name]


def _automaton(words: dict[str, list]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, what in words.items():
        out.add_word(word, what)
    out.make_automaton()
    return out


def _numbered(patterns: DataFrame) -> DataFrame:
    """number and text of the distinct passages that aren't empty, and the block of each; kept in the work folder."""
    once = patterns.select("text").filter("length(text) > 0").distinct().withColumn("number", F.monotonically_increasing_id())
    kept = saved(once, "matching-passages")
    blocks = max(1, -(-(kept.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK))
    return kept.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))


def _searched(texts: DataFrame, key: str, patterns: DataFrame, find: Callable[[str, dict[int, str], str], Iterator[tuple]], columns: list[str]) -> DataFrame:
    """key, number and what find(text, passages by number, name of the block) gives besides a passage's number, for every text."""
    spark = texts.sparkSession
    small_batches(spark)
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("number", T.LongType())] + [T.StructField(n, T.LongType()) for n in columns])
    rows = texts.filter("text is not null").select(key, "text")
    out = None
    for r in patterns.select("block").distinct().collect():
        own = patterns.filter(F.col("block") == r.block).select("number", "text").toArrow()  # BLOCK characters, or a passage
        held = spark.sparkContext.broadcast(dict(zip(own["number"].to_pylist(), own["text"].to_pylist(), strict=True)))
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held: object = held, name: str = name) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in parts(whole, "text", TEXTS)):
                at, found = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    for row in find(text, held.value, name):
                        at.append(i)
                        found.append(row)
                values = list(zip(*found, strict=True)) or [()] * (1 + len(columns))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *(pa.array(v, pa.int64()) for v in values)], [key, "number", *columns])

        part = rows.mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _held(text: str, passages: dict[int, str], name: str) -> Iterator[tuple[int]]:
    def make() -> tuple:
        return (_automaton({passage: number for number, passage in passages.items()}),)

    return ((n,) for n in {n for _, n in _built(name, make)[0].iter(text)})


def containing(texts: DataFrame, patterns: DataFrame, key: str = "doc_id", name: str = "query_id") -> DataFrame:
    """name, key: the texts (key, text) that hold a passage (name, text) as it stands, each pair once. An empty passage is in
    every text; null ones, and null texts, give nothing. Repeated rows count once."""
    numbered = _numbered(patterns)
    found = _searched(texts, key, numbered, _held, []).join(numbered.select("number", "text"), "number")
    named = patterns.select(name, "text").distinct()
    pairs = found.join(named, "text").select(name, key)
    empty = texts.filter("text is not null").select(key).join(F.broadcast(patterns.filter("text = ''").select(name).distinct()))
    return pairs.unionAll(empty.select(name, key)).distinct()


def distances(pattern: str, text: str, anchored: bool = False) -> Iterator[int]:
    """The edit distance of pattern to the closest stretch that ends at each character of text (anchored: to all up to it)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    same: dict[str, int] = {}
    for i, c in enumerate(pattern):
        same[c] = same.get(c, 0) | 1 << i
    up, down, score, edge = full, 0, m, int(anchored)
    for c in text:
        eq = same.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = (down | ~(x | up)) & full, up & x
        # bits of a row, low first: where the distance to the row above rises and falls
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1 | edge) & full, minus << 1 & full
        v = eq | down
        up, down = (minus | ~(v | plus)) & full, plus & v
        yield score


def errors(length: int, share: float) -> int:
    """Errors that a passage may have: a share of its characters, never all of them."""
    return min(int(length * share), max(0, length - 1))


def pieces(passage: str, e: int) -> list[tuple[int, str]]:
    """Where each of e + 1 pieces of a passage begins, and the piece."""
    cuts = [i * len(passage) // (e + 1) for i in range(e + 2)]
    return [(a, passage[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def nearest(pattern: str, text: str, e: int, places: list[int]) -> tuple[int, int, int] | None:
    """start, end, distance of the closest stretch with e errors at most (ties: the earliest end, then the shortest), where the
    pattern may begin near one of places."""
    best: tuple[int, int] | None = None
    spans: list[list[int]] = []
    for p in sorted(places):  # windows that overlap are gone over together
        a, b = max(0, p - e), min(len(text), p + len(pattern) + e)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    for a, b in spans:
        for j, d in enumerate(distances(pattern, text[a:b])):
            if d <= e and (best is None or d < best[0]):
                best = d, a + j + 1
    if best is None:
        return None
    d, end = best
    back = text[max(0, end - len(pattern) - e) : end][::-1]
    n = next((j + 1 for j, x in enumerate(distances(pattern[::-1], back, anchored=True)) if x == d), 0)
    return end - n, end, d


def closest(texts: DataFrame, patterns: DataFrame, share: float = 0.1, key: str = "doc_id", name: str = "query_id") -> DataFrame:
    """name, key, start, end, distance: where each text (key, text) holds a passage (name, text) best, with up to share of the
    passage's characters wrong, missing or too many. Of equal places the first. Empty and null passages give nothing."""
    numbered = _numbered(patterns)

    def find(text: str, passages: dict[int, str], block: str) -> Iterator[tuple[int, int, int, int]]:
        def make() -> tuple:
            by: dict[str, list[tuple[int, int]]] = {}
            for number, passage in passages.items():
                for at, piece in pieces(passage, errors(len(passage), share)):
                    by.setdefault(piece, []).append((number, at))
            return (_automaton({w: (len(w), x) for w, x in by.items()}),)

        near: dict[int, set[int]] = {}
        for end, (n, whose) in _built(f"{block}-{share}", make)[0].iter(text):
            for number, at in whose:
                near.setdefault(number, set()).add(end + 1 - n - at)
        for number, places in near.items():
            got = nearest(passages[number], text, errors(len(passages[number]), share), list(places))
            if got:
                yield number, *got

    found = _searched(texts, key, numbered, find, ["start", "end", "distance"]).join(numbered.select("number", "text"), "number")
    return found.join(patterns.select(name, "text").distinct(), "text").select(name, key, "start", "end", "distance").distinct()
