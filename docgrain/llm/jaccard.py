"""Exact Jaccard join of word shingles by signature trees.

Texts of one shingle set are one class, so copies cost nothing further. Two sets of similarity LEAST have one of the first
n - ceil(LEAST * n) + 1 shingles (their keys) of each in common, in any order of all shingles; so all links lie within
buckets of classes that share a key. Buckets are searched in two rounds:

1. By the LEADS first keys alone, which most similar classes share: large buckets are dealt into cells that have one class in
   common. This finds nearly all parts of near-copies, at a cost that grows with their size only.
2. By all keys: a bucket within one part is done. Others are cut by bands of size, those of equal members are taken once, and
   one too large for a task is dealt into blocks: the members of its largest part into some, all others into further ones,
   and every two blocks that can hold a new link meet in a cell. Keys that would make large buckets of many parts (a passage
   of countless documents) are put last in the order of all shingles instead, which a bit table of fixed size marks. A pair is
   looked for at the first key that it shares: of the smaller set no more than (1 - LEAST) / (1 + LEAST) * n shingles come
   before that, so a bucket without such a member is left out. Nor are more than so many of its keys below CUT, which all sets
   give whole, missing in the other set: members that share fewer with sets of about their size are left out, as those are
   that share a passage only. Small buckets of one least member share cells.

A cell is a forest of signature trees: its members' token bitmaps are OR-combined node by node, with the range of their
sizes, the most shingles that share a bit, and their part. Two nodes are taken down together, and go unless their largest
possible overlap admits a link and they aren't wholly of one part. The first descent needs bitmaps only; the sets of members
with a partner left then decide, and a link that joins two parts of a cell is kept, so no cell gives all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, documents, id_text, saved, small_batches, tidy
from .lm import distinct_words
from .simhash import connected

WIDTH = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
#: Keys of the first round.
LEADS = 1
#: Shingles and members of a cell.
TOKENS, MEMBERS = 1 << 20, 4096
#: A bucket of so many cells is crowded: its keys are put last instead of comparing its blocks two by two.
CROWDED = 16
#: Pairs for each member of a cell from which on they aren't told apart.
MANY = 4
#: Children of a node of a signature tree, and pairs of nodes that are looked at together.
FAN, PAIRS = 4, 4096
#: Bits of the table of shingles that come last, 1 MB; how often it may be added to.
BITS, MOVES = 1 << 23, 3
#: All unmarked shingles below it are keys: a little less than the fifth of all hashes that the first keys reach to.
CUT = int(0.18 * 2**64)
#: What no number of keys reaches.
NEVER = 1 << 62
#: Bands of size: members of one band or of two that follow each other can be similar enough, others can't.
BAND = math.log(1.26)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Of each text (bytes, none null): a hash of all its words, 0 without any, and the hashes of its shingles in order.

    A text of fewer than WIDTH words is one shingle, one without words has none.
    """
    count, flat, distinct = distinct_words(texts)
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))[flat]
    ends = np.cumsum(count)
    rolled = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            rolled += words[k : k + len(rolled)]
            rolled *= _MULT
            rolled ^= rolled >> np.uint64(29)
    whole, out = [], []
    for n, end in zip(count.tolist(), ends.tolist(), strict=True):
        own = xxhash.xxh3_64_intdigest(words[end - n : end].tobytes()) if n else 0
        whole.append(own)
        out.append(rolled[end - n : end - WIDTH + 1] if n >= WIDTH else np.array([own] if n else [], np.uint64))
    return whole, out


def bitmap(grams: np.ndarray) -> bytes:
    """The low bits of a set's shingles, in a power of two of bits that is twice its size or more."""
    wide = max(64, 1 << (2 * len(grams) - 1).bit_length())
    bits = np.zeros(wide, np.uint8)
    bits[(grams & np.uint64(wide - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def in_table(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which shingles a bit table marks."""
    slot = (grams & np.uint64(BITS - 1)).astype(np.int64)
    return (table[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def first_keys(grams: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """A sorted set's keys; shingles that the bit table marks come last in the order. All others below CUT are among them."""
    n = len(grams)
    low = int(np.searchsorted(grams, np.uint64(CUT)))
    if last is not None:
        marked = in_table(grams, last)
        low -= int(marked[:low].sum())
        grams = np.concatenate([grams[~marked], grams[marked]])
    return grams[: max(low, n - -(-LEAST[0] * n // LEAST[1]) + 1)]


class Forest:
    """Signature trees over the members of cells: cell, comp (its part), n (size) and bits (its bitmap) of each member."""

    def __init__(self, cell: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: list[bytes]):
        sizes = np.fromiter(map(len, bits), np.int64, len(bits))
        wide = int(sizes.min()) // 8
        own = np.zeros((len(bits), wide), np.uint64)
        for size in np.unique(sizes).tolist():  # wider bitmaps are folded
            at = np.flatnonzero(sizes == size)
            own[at] = np.bitwise_or.reduce(np.frombuffer(b"".join([bits[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1, wide), 1)
        word = (own != 0).argmax(1)
        low = own[np.arange(len(own)), word]
        with np.errstate(over="ignore"):
            first = word * 64 + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1))
        #: Members as they stand in the trees: near-copies often share their first bit.
        self.order = np.lexsort((n, first, comp, cell))
        cell, comp, n, own = cell[self.order], comp[self.order], n[self.order], own[self.order]
        excess = n - np.bitwise_count(own).sum(1, dtype=np.int64)
        #: Of each level: OR of the bitmaps, least and greatest size, most shingles beyond the bits, least and greatest part, first child, children.
        self.levels = [(own, n, n, excess, comp, comp, None, None)]
        while True:
            begin = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
            size = np.diff(np.append(begin, len(cell)))
            if len(begin) == len(cell):
                break
            at = np.flatnonzero((np.arange(len(cell)) - np.repeat(begin, size)) % FAN == 0)
            own, lo, hi, excess, least, most, _, _ = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(own, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(excess, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), at, np.diff(np.append(at, len(cell)))))
            cell = cell[at]

    def _may(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether nodes x and y can hold a link between two parts."""
        own, lo, hi, excess, least, most, _, _ = self.levels[level]
        out = ~((least[x] == most[x]) & (least[y] == most[y]) & (least[x] == least[y]))
        some = np.flatnonzero(out)
        x, y = x[some], y[some]
        over = np.bitwise_count(own[x] & own[y]).sum(1, dtype=np.int64) + np.minimum(excess[x], excess[y])
        over = np.minimum(over, np.minimum(hi[x], hi[y]))
        out[some] = (LEAST[0] + LEAST[1]) * over >= LEAST[0] * (lo[x] + lo[y])
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members (numbers as given) that no node rules out, some at a time."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][1]))
        todo = [(top, roots, roots)] if top else []
        grid = np.arange(FAN)
        while todo:
            level, x, y = todo.pop()
            keep = self._may(level, x, y)
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            if not level:
                yield self.order[x], self.order[y]
                continue
            first, count = self.levels[level][6:]
            for a in range(0, len(x), PAIRS):
                u, v = x[a : a + PAIRS, None, None], y[a : a + PAIRS, None, None]
                i, j = grid[None, :, None], grid[None, None, :]
                real = (i < count[u]) & (j < count[v]) & ((u != v) | (i < j) | ((i == j) & (level > 1)))
                todo.append((level - 1, (first[u] + i + 0 * j)[real], (first[v] + j + 0 * i)[real]))


def joined(forest: Forest, comp: np.ndarray, sets: list[np.ndarray], cell: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of different parts that join all parts of each cell which are linked."""
    _, label = np.unique(np.stack([cell, comp]), axis=1, return_inverse=True)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    begin = np.cumsum(size) - size
    mark, out = np.zeros(int(ids.max()) + 1, bool), []
    for x, y in forest.pairs():
        by = np.argsort(x, kind="stable")
        x, y = x[by], y[by]
        cuts = [*np.flatnonzero(np.diff(x, prepend=-1)).tolist(), len(x)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            one, others = int(x[a]), y[a:b]
            others = others[label[others] != label[one]]
            for c in range(0, len(others), 512):  # one against many
                some = others[c : c + 512]
                n = size[some]
                stop = np.cumsum(n)
                mark[ids[begin[one] : begin[one] + size[one]]] = True
                there = mark[ids[np.arange(stop[-1]) + np.repeat(begin[some] - stop + n, n)]]
                mark[ids[begin[one] : begin[one] + size[one]]] = False
                shared = np.add.reduceat(there, stop - n, dtype=np.int64)
                for other in some[(LEAST[0] + LEAST[1]) * shared >= LEAST[0] * (size[one] + n)].tolist():
                    if label[other] != label[one]:
                        out.append((one, other))
                        label[label == label[other]] = label[one]
    return out


def _cells(batches: Iterator[pa.RecordBatch], weight: Callable[[pa.RecordBatch], int], limit: int) -> Iterator[pa.Table]:
    """Rows sorted by size and cell, put together to whole cells of one size, limit of weight or a cell at a time."""
    held: list[pa.RecordBatch] = []
    total = 0

    def out(table: pa.Table, final: bool) -> tuple[list[pa.Table], pa.Table]:
        edge = np.diff(table.column("size").to_numpy(), prepend=-1) != 0
        end = table.num_rows
        if not final:
            cell = table.column("cell").to_numpy()
            end = int(np.flatnonzero((np.diff(cell, prepend=0) != 0) | edge)[-1])
        cuts = [*np.flatnonzero(edge[:end]).tolist(), end]
        return [table.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a], table.slice(end)

    for batch in batches:
        held.append(batch)
        total += weight(batch)
        if total >= limit:
            parts, rest = out(pa.Table.from_batches(held).combine_chunks(), False)
            yield from parts
            held = rest.to_batches()
            total = sum(map(weight, held))
    if held:
        yield from out(pa.Table.from_batches(held).combine_chunks(), True)[0]


def _forests(table: pa.Table, bits: list[bytes]) -> Iterator[tuple[np.ndarray, Forest]]:
    """For each band of sizes the rows of that band and of the next, in cells as they are, and their trees."""
    cell, comp, n = (table.column(c).to_numpy() for c in ("cell", "comp", "n"))
    band = np.floor(np.log(n) / BAND).astype(np.int64)
    for own in np.unique(band).tolist():
        at = np.flatnonzero((band == own) | (band == own + 1))
        if len(at) > 1:
            yield at, Forest(cell[at], comp[at], n[at], [bits[i] for i in at.tolist()])


def connected_rows(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the first row that pairs (x, y) connect it with."""
    label = np.arange(n)
    while (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        for z in (label[x], label[y], x, y):
            np.minimum.at(label, z, low)
        label = label[label]
    return label


def _with_partner(rows: DataFrame) -> DataFrame:
    """cell, c, comp, n: what is left to compare of the members (cell, size, c, comp, n, bits), in cells by their sets.

    Members of a cell with many pairs left stay together. Of others those that pairs connect are put into a cell of their
    smallest class, so that a member of many pairs, or of one that meets in many buckets, brings its set once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches, lambda b: b.nbytes, 8 << 20):
            cell, c = table.column("cell").to_numpy(), table.column("c").to_numpy()
            _, number, size = np.unique(cell, return_inverse=True, return_counts=True)
            into, member = [], []
            for at, forest in _forests(table, table.column("bits").to_pylist()):
                count, found, kept = np.zeros(len(size), np.int64), np.zeros(len(cell), bool), []
                for x, y in forest.pairs():
                    x, y = at[x], at[y]
                    count += np.bincount(number[x], minlength=len(size))
                    found[x] = found[y] = True
                    few = count[number[x]] <= MANY * size[number[x]]
                    kept.append((x[few], y[few]))
                many = count > MANY * size
                dense = np.flatnonzero(found & many[number])
                into.append(cell[dense])
                member.append(dense)
                x, y = (np.concatenate([k[i] for k in kept] or [dense[:0]]) for i in (0, 1))
                few = ~many[number[x]]
                own = connected_rows(x[few], y[few], len(cell))
                least = c.copy()
                np.minimum.at(least, own, c)
                few = np.union1d(x[few], y[few])
                into.append(-1 - least[own[few]])
                member.append(few)
            if member:
                pair = np.unique(np.stack([np.concatenate(into), np.concatenate(member)]), axis=1)
                part = table.select(["c", "comp", "n"]).take(pa.array(pair[1]))
                yield from part.add_column(0, "cell", pa.array(pair[0])).combine_chunks().to_batches()

    found = _dealt(rows.select("cell", "size", "c", "comp", "n", "bits")).mapInArrow(tidy(run), "cell long, c long, comp long, n long")
    return found.dropDuplicates(["cell", "c"]).withColumn("size", F.lit(0).cast("long"))


def _decided(rows: DataFrame) -> DataFrame:
    """a, b: links between the members (cell, size, c, comp, n, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches, lambda b: b.nbytes, 16 << 20):
            # rows repeated whole bring their set more than once
            _, once = np.unique(np.stack([table.column("cell").to_numpy(), table.column("c").to_numpy()]), axis=1, return_index=True)
            table = table.take(pa.array(np.sort(once)))
            sets = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
            c, comp, cell = (table.column(x).to_numpy() for x in ("c", "comp", "cell"))
            for at, forest in _forests(table, list(map(bitmap, sets))):
                a, b = np.array(joined(forest, comp[at], [sets[i] for i in at.tolist()], cell[at]), np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_pydict({"a": c[at[a]], "b": c[at[b]]})

    return _dealt(rows.select("cell", "size", "c", "comp", "n", "grams")).mapInArrow(tidy(run), "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "cell").sortWithinPartitions("size", "cell")


def hashed(docs: DataFrame) -> DataFrame:
    """uid (a number of its own), doc_id, row, n (shingles in its set), digest (128 bits, null without words), keys and bits of every
    row (doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                sets = [np.unique(x) for x in shingles(batch.column("text").fill_null(b""))[1]]
                key = [first_keys(x) for x in sets]
                ends = np.cumsum([0, *map(len, key)])
                columns = [
                    batch.column("uid"), batch.column("doc_id"), batch.column("row"), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*key, np.zeros(0, np.uint64)]).view(np.int64))),
                    pa.array([bitmap(x) if len(x) else None for x in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["uid", "doc_id", "row", "n", "digest", "keys", "bits"]
    schema = "uid long, doc_id long, row long, n long, digest binary, keys array<long>, bits binary"
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "row", "text").mapInArrow(tidy(run), schema)


def _by_key(rows: DataFrame, judged: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What judged(table, group, edge) gives for rows with a key, sorted by it within partitions: whole keys, the number of each
    row's key, and which keys are a partition's first or last one, so that others may have rows of them too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, first = 0, True

        def out(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, first
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("key").to_numpy()
            at = np.flatnonzero(np.diff(key, prepend=~key[0]) != 0)
            end = len(key) if final else int(at[-1])
            if end:
                at = at[at < end]
                edge = np.zeros(len(at), bool)
                edge[-1] = final
                edge[0] |= first
                first = False
                yield from judged(table.slice(0, end), np.repeat(np.arange(len(at)), np.diff(np.append(at, end))), edge).to_batches()
            held = table.slice(end).to_batches()
            size = len(key) - end

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= max(1 << 16, 2 * held[0].num_rows):
                yield from out(False)
        if size:
            yield from out(True)

    return rows.mapInArrow(tidy(run), schema)


def near_sizes(group: np.ndarray, comp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each member of a group, whether another part has a member there of its size or so much above that they can be similar,
    and whether of its size or so much below."""
    order = np.lexsort((n, group))
    base, size, part = group[order].astype(np.int64) << 40, n[order], comp[order]
    place = base + size
    begin, end = np.searchsorted(place, place), np.searchsorted(place, place, "right")
    high, low = np.searchsorted(place, base + size * LEAST[1] // LEAST[0], "right"), np.searchsorted(place, base - -size * LEAST[0] // LEAST[1])
    edge = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
    other = edge[np.searchsorted(edge, np.arange(len(part)), "right")]  # the next one of another part
    up, down = np.zeros(len(part), bool), np.zeros(len(part), bool)
    up[order] = (part[begin] != part) | (other[begin] < high)
    down[order] = (part[low] != part) | (other[low] < end)
    return up, down


def met(rows: DataFrame) -> DataFrame:
    """Of rows (key, comp, c, n, early in the lowest bit of n), sorted within partitions, those whose key another part has too, in
    a set of about the same size; up: in one of the same size or a larger one."""

    def judged(table: pa.Table, group: np.ndarray, edge: np.ndarray) -> pa.Table:
        comp, n = table.column("comp").to_numpy(), table.column("n").to_numpy()
        up, down = (x | edge[group] for x in near_sizes(group, comp, n >> 1))
        out = table.set_column(table.schema.get_field_index("n"), "n", pa.array(n >> 1))
        return out.append_column("early", pa.array(n % 2 == 1)).append_column("up", pa.array(up)).filter(pa.array(up | down))

    return _by_key(rows, judged, "key long, comp long, c long, n long, early boolean, up boolean")


def live(rows: DataFrame, tokens: int, most: int) -> DataFrame:
    """Of rows (key, comp, c, n, need, have), sorted within partitions, those that may be in a link which is looked for at their
    key, where it has two parts or more, and whether so many that they make a large bucket. have: keys below CUT that a set
    shares. need: how many of them its links share, where it is the smaller set and the key comes early enough, NEVER elsewhere.
    A partition's first and last key, which others may have too, are taken whole and as large."""

    def judged(table: pa.Table, group: np.ndarray, edge: np.ndarray) -> pa.Table:
        comp, n, need, have = (table.column(c).to_numpy() for c in ("comp", "n", "need", "have"))
        band = np.floor(np.log(n) / BAND).astype(np.int64) + 1
        code = group * (int(band.max()) + 1) + band
        small = np.flatnonzero(need < NEVER)
        codes, number = np.unique(code[small], return_inverse=True)
        least = np.full(len(codes) + 1, NEVER)
        np.minimum.at(least, number, need[small])
        codes = np.append(codes, -1)

        def lowest(x: np.ndarray) -> np.ndarray:
            i = np.searchsorted(codes[:-1], x)
            return np.where(codes[i] == x, least[i], NEVER)

        keep = edge[group] | (need < NEVER) | (have >= np.minimum(lowest(code), lowest(code - 1)))
        first = np.flatnonzero(np.diff(group, prepend=-1))
        low, high = (f.reduceat(np.where(keep, comp, x), first) for f, x in ((np.minimum, 1 << 62), (np.maximum, -1)))
        k, total = np.bincount(group, keep), np.bincount(group, n * keep)
        large = (k > most) | (total > tokens) | edge
        out = table.select(["key", "comp", "c", "n"]).append_column("large", pa.array(large[group]))
        return out.filter(pa.array(keep & ((high > low) | edge)[group]))

    return _by_key(rows, judged, "key long, comp long, c long, n long, large boolean")


def bit_table(rows: DataFrame, column: str) -> DataFrame:
    """cell, bits: the low bits of a column of hashes as a bit table of BITS bits, in BITS / 64 rows at most."""
    slot = rows.select(F.col(column).bitwiseAND(F.lit(BITS - 1)).alias("slot"))
    return slot.groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits"))


def marked(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose hash may be among those wanted: all that are, and some others. The table that is broadcast has a fixed size."""
    table = F.broadcast(bit_table(wanted, column))
    own = F.col(column)
    held = rows.withColumn("cell", F.shiftright(own.bitwiseAND(F.lit(BITS - 1)), 6)).join(table, "cell")
    return held.filter(F.getbit("bits", own.bitwiseAND(F.lit(63)).cast("int")) == 1).select(*rows.columns)


class Join:
    """The classes of docs (doc_id, text as bytes, row: a hash of both) and the links between them.

    rows: doc_id, row, n, uid, c of every row; c, a class, is the uid of its first row, null without words. made: uid, row, n,
    digest, keys, bits of every row; those of a class stand where uid is c.
    """

    def __init__(self, docs: DataFrame):
        small_batches(docs.sparkSession)
        self.docs = docs
        self.made = saved(hashed(docs), "jaccard-rows")
        first = self.made.filter("n > 0").groupBy("digest").agg(F.min("uid").alias("c"))
        self.rows = saved(self.made.select("doc_id", "row", "n", "uid", "digest").join(first, "digest", "left").drop("digest"), "jaccard-classes")

    def classes(self, *columns: str) -> DataFrame:
        """c and columns of made of every class."""
        return self.made.select(F.col("uid").alias("c"), *columns).join(self.rows.filter("uid = c").select("c"), "c", "left_semi")

    def _texts(self, c: DataFrame, each: Callable[[np.ndarray], bytes | np.ndarray], kind: str) -> DataFrame:
        """c and what each() gives for the sorted set of the classes c; more than once for rows repeated whole."""
        # saved, as it is read twice: which texts can be wanted is told by a bit table before any text is shuffled
        own = saved(self.made.select(F.col("uid").alias("c"), "digest", "row").join(c, "c"), "jaccard-wanted")
        arrow = pa.binary() if kind == "binary" else pa.list_(pa.int64())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given: set[int] = set()
            for whole in batches:
                for batch in chunks(whole):
                    c = batch.column("c").to_pylist()
                    batch = batch.take(pa.array([i for i, x in enumerate(c) if x not in given], pa.int64()))
                    sets = [np.unique(x) for x in shingles(batch.column("text").fill_null(b""))[1]]
                    # rows whose hashes are equal may have other texts
                    same = [i for i, d in enumerate(batch.column("digest").to_pylist()) if xxhash.xxh3_128_digest(sets[i].tobytes()) == d]
                    own = batch.column("c").take(pa.array(same, pa.int64()))
                    given.update(own.to_pylist())
                    yield pa.RecordBatch.from_arrays([own, pa.array([each(sets[i]) for i in same], arrow)], ["c", "x"])

        return marked(self.docs.select("row", "text"), own, "row").join(own, "row").select("c", "digest", "text").mapInArrow(tidy(run), f"c long, x {kind}")

    def decide(self, cells: DataFrame) -> DataFrame:
        """a, b: links between members (cell, size, c, comp, n) of different parts of a cell; enough of them to join all parts that are linked."""
        left = saved(_with_partner(cells.join(self.made.select(F.col("uid").alias("c"), "bits"), "c")), "jaccard-left")
        sets = self._texts(left.select("c").distinct(), lambda x: x.tobytes(), "binary").withColumnRenamed("x", "grams")
        return saved(_decided(left.join(sets, "c")), "jaccard-links")

    def leads(self) -> DataFrame:
        """key, c, n by the first keys of each class."""
        return self.classes("n", F.slice("keys", 1, LEADS).alias("lead")).select(F.explode("lead").alias("key"), "c", "n")

    def near_keys(self, members: DataFrame, tokens: int = TOKENS, most: int = MEMBERS) -> DataFrame:
        """Links within buckets of members (key, c, n), each member its own part. Large buckets are dealt into cells that share
        their least member; not all links of a large bucket need be found."""
        per = members.groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("sum"), F.min("n").alias("least"), F.min("c").alias("pivot")).filter("k > 1")
        cells = F.greatest(F.ceil(F.col("sum") / tokens), F.ceil(F.col("k") / most)).alias("cells")
        per = per.select("key", F.floor(F.log2("least")).alias("size"), "pivot", cells)
        at = F.when(F.col("c") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).otherwise(F.array(F.pmod(F.xxhash64("c"), "cells")))
        dealt = members.join(per, "key").select("key", "size", "c", "n", F.explode(at).alias("at"))
        return self.decide(dealt.select(F.xxhash64("key", "at").alias("cell"), "size", "c", F.col("c").alias("comp"), "n"))

    def parts(self, links: DataFrame) -> DataFrame:
        """c, comp: the part of each class that has a link."""
        return connected(links).select(F.col("node").alias("c"), F.col("label").alias("comp"))

    def _needed(self, keyed: DataFrame, table: np.ndarray | None) -> DataFrame:
        """c and need, the keys below CUT that a set of keyed (c, keys) shares at least with a larger one that it is linked with."""
        held = keyed.sparkSession.sparkContext.broadcast(np.zeros(BITS >> 6, np.uint64) if table is None else table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("keys")
                grams = keys.flatten().to_numpy().view(np.uint64)
                upto = np.concatenate([[0], np.cumsum((grams < np.uint64(CUT)) & ~in_table(grams, held.value))])[np.cumsum([0, *keys.value_lengths().to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(np.diff(upto))], ["c", "low"])

        low = keyed.select("c", "keys").mapInArrow(tidy(run), "c long, low long").join(self.rows.filter("uid = c").select("c", "n"), "c")
        return low.select("c", (F.col("low") - F.floor((LEAST[1] - LEAST[0]) * F.col("n") / (LEAST[0] + LEAST[1]))).alias("need"))

    def _buckets(self, keyed: DataFrame, parts: DataFrame, tokens: int, most: int, table: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
        """Members key, band, c, comp, n of the buckets of two parts or more of keyed (c, keys, by the marks of table), and a row for
        each of these. Large buckets are cut by bands of size, into which members of the next band are taken too; others have no
        band."""
        spark = keyed.sparkSession
        own = saved(self.rows.filter("uid = c").select("c", "n").join(parts, "c", "left").select("c", "n", F.coalesce("comp", "c").alias("comp")), "jaccard-comps")
        each = keyed.join(own, "c").select(F.posexplode("keys").alias("at", "key"), "comp", "c", "n")
        early = (LEAST[0] + LEAST[1]) * F.col("at") <= (LEAST[1] - LEAST[0]) * F.col("n")
        each = each.select("key", "comp", "c", (2 * F.col("n") + early.cast("long")).alias("n"))
        # by range, so that a key that very many share fills several partitions
        order = ["key", "comp", "c"]
        by_key = lambda rows: rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        found = saved(met(by_key(each)), "jaccard-met")
        low, per = F.col("key").between(0, CUT - 1), Window.partitionBy("c")
        have = lambda x: F.sum(x.cast("long")).over(per)
        counted = found.join(self._needed(keyed, table), "c").select(*order, "n", "early", "up", "need", have(low).alias("have"), have(low & F.col("up")).alias("above"))
        small = F.col("early") & F.col("up") & (F.col("above") >= F.col("need"))
        judged = counted.select(*order, "n", F.when(small, F.col("need")).otherwise(F.lit(NEVER)).alias("need"), "have")
        shared = saved(live(by_key(judged), tokens, most), "jaccard-shared")
        band = F.floor(F.log("n") / BAND)
        member = lambda x, home: F.struct(x.alias("band"), F.lit(home).alias("home"))
        split = F.when(F.col("large"), F.array(member(band, True), member(band - 1, False))).otherwise(F.array(member(F.lit(-9).cast("long"), True)))
        members = shared.select("key", "c", "comp", "n", F.explode(split).alias("s")).select("key", "s.*", "c", "comp", "n")
        sums = members.groupBy("key", "band", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("sum"), F.bit_xor(F.xxhash64("c")).alias("f"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("g"), F.max("home").alias("home"), F.min("c").alias("pivot"))
        whole = sums.groupBy("key", "band").agg(
            F.count("*").alias("comps"), F.max("home").alias("home"), F.sum("k").alias("k"), F.sum("sum").alias("sum"), F.bit_xor("f").alias("f"), F.bit_xor("g").alias("g"),
            F.max(F.struct("k", "sum", "comp")).alias("top"), F.min("pivot").alias("pivot"),
        )
        return members, saved(whole.filter("comps > 1 and home"), "jaccard-buckets")

    def _last(self, members: DataFrame, buckets: DataFrame, table: np.ndarray, tokens: int, most: int) -> bool:
        """Mark the shingles that would make buckets too large; whether there is a new one. All shingles of the classes that meet
        in such buckets count, whose largest part is left out."""
        large = buckets.filter((F.col("k") - F.col("top.k") > most) | (F.col("sum") - F.col("top.sum") > tokens)).select("key", "band", F.col("top.comp").alias("main"))
        if large.isEmpty():
            return False
        there = saved(members.join(large, ["key", "band"]).filter("comp <> main").select("c", "n").distinct(), "jaccard-crowded")
        every = self._texts(there.select("c"), lambda x: x.view(np.int64), "array<long>").join(there, "c").select(F.explode("x").alias("x"), "n")
        often = every.groupBy("x").agg(F.count("*").alias("k"), F.sum("n").alias("sum")).filter((F.col("k") > most) | (F.col("sum") > tokens))
        got = bit_table(often, "x").toArrow()
        at, bits = got.column("cell").to_numpy(), got.column("bits").to_numpy().view(np.uint64)
        new = bool((bits & ~table[at]).any())
        table[at] |= bits
        return new

    def _moved(self, keyed: DataFrame, table: np.ndarray) -> DataFrame:
        """c, n, keys with the marked shingles last: only classes that have one among their keys get others."""
        held = keyed.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("keys")
                marked = in_table(keys.flatten().to_numpy().view(np.uint64), held.value)
                upto = np.concatenate([[0], np.cumsum(marked)])[np.cumsum([0, *keys.value_lengths().to_pylist()])]
                yield batch.select(["c"]).filter(pa.array(np.diff(upto) > 0))

        some = saved(keyed.select("c", "keys").mapInArrow(run, "c long").join(self.rows.filter("uid = c").select("c"), "c", "left_semi"), "jaccard-moved")
        new = self._texts(some, lambda x: first_keys(x, held.value).view(np.int64), "array<long>").groupBy("c").agg(F.first("x").alias("x"))
        return saved(keyed.join(new, "c", "left").select("c", F.coalesce("x", "keys").alias("keys")), "jaccard-keys")

    def rest(self, parts: DataFrame, tokens: int = TOKENS, most: int = MEMBERS, crowded: int = CROWDED) -> DataFrame:
        """Links that join all parts (c, comp) which some link joins."""
        keyed, table = self.made.select(F.col("uid").alias("c"), "keys"), np.zeros(BITS >> 6, np.uint64)
        members, buckets = self._buckets(keyed, parts, tokens, most)
        for _ in range(MOVES):
            if not self._last(members, buckets, table, crowded * tokens, crowded * most):
                break
            keyed = self._moved(keyed, table)
            members, buckets = self._buckets(keyed, parts, tokens, most, table)
        # buckets of one band and the same members are searched once
        once = buckets.groupBy("band", "k", "f", "g").agg(F.min(F.struct("key", "sum", "top", "pivot")).alias("one")).select("band", "one.key", "k", "one.sum", "one.top", "one.pivot")
        blocks = [F.greatest(F.ceil(s / tokens), F.ceil(k / most)) for s, k in ((F.col("top.sum"), F.col("top.k")), (F.col("sum") - F.col("top.sum"), F.col("k") - F.col("top.k")))]
        # buckets of one block each that have the same least member, no more than its keys, fill cells of about the usual size together
        upto = Window.partitionBy("pivot", "band").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        lot = F.coalesce(F.greatest(F.floor(F.sum("sum").over(upto) / tokens), F.floor(F.sum("k").over(upto) / most)), F.lit(0).cast("long"))
        once = once.select("key", "band", F.col("top.comp").alias("main"), blocks[0].alias("p"), blocks[1].alias("q"), "pivot", lot.alias("lot"))
        rows = members.join(once, ["key", "band"])
        # cells: a block i of the largest part with a block j of the others (i, j), two blocks of the others (-1 - i, j)
        main, zero = F.col("comp") == F.col("main"), F.lit(0).cast("long")
        i, j = F.pmod(F.xxhash64("c"), "p"), F.pmod(F.xxhash64("c"), "q")
        with_others = F.transform(F.sequence(zero, F.col("q") - 1), lambda x: F.struct(i.alias("i"), x.alias("j")))
        with_main = F.transform(F.sequence(zero, F.col("p") - 1), lambda x: F.struct(x.alias("i"), j.alias("j")))
        among = F.transform(F.filter(F.sequence(zero, F.col("q") - 1), lambda x: x != j), lambda x: F.struct((-1 - F.least(x, j)).alias("i"), F.greatest(x, j).alias("j")))
        rows = rows.withColumn("at", F.explode(F.when(main, with_others).otherwise(F.concat(with_main, among))))
        cell = F.when((F.col("p") == 1) & (F.col("q") == 1), F.xxhash64("pivot", "band", "lot")).otherwise(F.xxhash64("key", "band", "at.i", "at.j"))
        return self.decide(rows.select(cell.alias("cell"), F.col("band").alias("size"), "c", "comp", "n").dropDuplicates(["cell", "c"]))


def linked(join: Join, first: DataFrame, tokens: int = TOKENS, most: int = MEMBERS, crowded: int = CROWDED) -> DataFrame:
    """c, comp: the part of each class that is linked with another one. first: buckets (key, c, n) that are searched before all."""
    links = join.near_keys(first, tokens, most)
    return join.parts(links.unionAll(join.rest(join.parts(links), tokens, most, crowded)))


def components(docs: DataFrame, tokens: int = TOKENS, most: int = MEMBERS, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id (smallest doc_id reachable over links) of every row.

    Texts without words, and null ones, have an empty set and are linked with nothing, not with one another either. Repeated
    rows come out as often. A part whose doc_ids are all null has a null component_id. Extra columns are left out; an empty
    table gives an empty one.
    """
    own = id_text(docs)
    join = Join(own.withColumn("row", F.xxhash64("doc_id", "text")))
    parts = linked(join, join.leads(), tokens, most, crowded)
    known = join.rows.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("least")).join(parts, "c", "left")
    known = known.select("c", "least", F.coalesce("comp", "c").alias("comp"))
    firsts = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = saved(known.join(firsts, "comp").select("c", "component_id"), "jaccard-parts")
    every = join.rows.join(ids, "c", "left")
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir))


OP12_SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT r, doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS s FROM docs),
classes AS (SELECT list_sort(s) AS s, min(r) AS c, min(doc_id) AS least, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL),
grams AS (SELECT c, n, unnest(s) AS g FROM classes),
shared AS (SELECT a.c AS a, b.c AS b, a.n AS an, b.n AS bn, count(*) AS both_n FROM grams a JOIN grams b ON a.g = b.g AND a.c < b.c GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * both_n >= 80 * (an + bn - both_n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT c, c AS node FROM classes UNION SELECT reach.c, edges.b FROM reach JOIN edges ON reach.node = edges.a),
parts AS (SELECT reach.c, min(classes.least) AS component_id FROM reach JOIN classes ON reach.node = classes.c GROUP BY reach.c)
SELECT doc_id, coalesce(len(sets.s), 0)::BIGINT AS n_shingles, CASE WHEN len(sets.s) > 0 THEN component_id ELSE doc_id END AS component_id
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN parts USING (c)
"""
