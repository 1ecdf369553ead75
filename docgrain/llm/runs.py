"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q, at least LEAST words and at least TIMES * q words long, that neither
neighbour extends. Any run lies in a stretch of words all of whose GRAM-word strings come again within the stretch, so a
text is first cut down to such stretches, which most texts don't have. The stretches of a batch are put into one sequence,
each followed by a number of its own, and their squares (a string that follows itself) are found together:

1. Prefix doubling gives the suffix order and, from its levels, the longest common extension of any two places.
2. Lempel-Ziv blocks, from the longest previous factors, give squares that cover the leftmost occurrence of every square:
   for each block those that cross its end, and those that cross its begin and have their middle in it.
3. From the place of each such square in the suffix tree, walks along suffix links mark its rotations while the tree holds
   them and none is marked already: the vocabulary of all squares whose root is not a power.
4. All occurrences of a marked square are the leaves below its place; occurrences of one period at neighbouring places
   merge into runs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, id_text, small_batches, tidy

#: Fewest words of a run, fewest periods of a run, words of the strings by which texts are cut down.
LEAST, TIMES, GRAM = 24, 3, 8
_MULT = np.uint64(0x9E3779B97F4A7C15)


class SuffixTree:
    """Suffix order, extensions and tree of a sequence whose last number occurs once.

    Nodes are numbered from 0 (the root); len(depth) + r is the leaf of the suffix of rank r.
    """

    def __init__(self, s: np.ndarray):
        n = self.n = len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
        self.s, self.levels, step = rank, [rank], 1
        while step < n and rank.max() < n:
            second = np.zeros(n, np.int64)
            second[:-step] = rank[step:]
            rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64) + 1
            self.levels.append(rank)
            step *= 2
        self.rank = rank - 1
        self.order = np.argsort(rank)
        self.lcp = np.zeros(n, np.int64)
        self.lcp[1:] = self.forward(self.order[:-1], self.order[1:])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers from a on equal those from b on (a differs from b)."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            x, y = a + out, b + out
            there = np.flatnonzero((x < self.n) & (y < self.n))
            same = there[self.levels[j][x[there]] == self.levels[j][y[there]]]
            out[same] += 1 << j
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers up to a equal those up to b, both included."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            x, y = a - out - (1 << j) + 1, b - out - (1 << j) + 1
            there = np.flatnonzero((x >= 0) & (y >= 0))
            same = there[self.levels[j][x[there]] == self.levels[j][y[there]]]
            out[same] += 1 << j
        return out

    def blocks(self) -> np.ndarray:
        """Begins of the Lempel-Ziv blocks: each is as long as the longest factor that also begins earlier, or one number."""
        before, after, stack = np.full(self.n, -1), np.full(self.n, -1), []
        for place in self.order.tolist():
            while stack and stack[-1] > place:
                after[stack.pop()] = place
            if stack:
                before[place] = stack[-1]
            stack.append(place)
        longest = np.zeros(self.n, np.int64)
        for earlier in (before, after):
            some = np.flatnonzero(earlier >= 0)
            longest[some] = np.maximum(longest[some], self.forward(some, earlier[some]))
        out, at, longest = [], 0, longest.tolist()
        while at < self.n:
            out.append(at)
            at += max(1, longest[at])
        return np.array(out, np.int64)

    def covering(self) -> tuple[np.ndarray, np.ndarray]:
        """Begins and periods of squares that cover the leftmost occurrence of every square, those of powers left out."""
        h = self.blocks()
        h1 = np.append(h[1:], self.n)
        h2 = np.append(h1[1:], self.n)
        starts, periods = [], []
        for ends in (True, False):
            edge, reach = (h1, h1 - h) if ends else (h, h2 - h)
            block = np.repeat(np.arange(len(h)), reach)
            k = np.arange(len(block)) - np.repeat(np.cumsum(reach) - reach, reach) + 1
            own = edge[block]
            # the edge, and the same place one period to the left (block ends) or to the right (block begins)
            left, right = (own - k, own) if ends else (own, own + k)
            some = np.flatnonzero(right < self.n)
            some = some[self.s[left[some]] == self.s[right[some]]]
            block, k, left, right = block[some], k[some], left[some], right[some]
            k1, k2 = self.forward(left, right), self.backward(left - 1, right - 1)
            start = np.maximum(left - k2, left - k + 1)
            found = k1 + k2 >= k
            if not ends:
                found &= (start + k <= h1[block]) & (k2 > 0)
            starts.append(start[found])
            periods.append(k[found])
        start, k = np.concatenate(starts), np.concatenate(periods)
        whole = np.ones(len(k), bool)
        rest, p = k.copy(), 2
        while len(rest) and p <= rest.max():
            # k / p for each prime divisor p of k: is the root a power with exponent p?
            some = np.flatnonzero(rest % p == 0)
            if len(some):
                d = k[some] // p
                whole[some] &= self.forward(start[some], start[some] + d) < k[some] - d
                while len(some):
                    rest[some] //= p
                    some = some[rest[some] % p == 0]
            p += 1
            if p * p > rest.max():
                p = max(p, int(rest[rest > 1].min())) if (rest > 1).any() else p
        return start[whole], k[whole]

    def tree(self) -> None:
        """Nodes with their depths, ranges of ranks, parents and children, and the places that suffix links lead to."""
        lcp = [*self.lcp.tolist(), -1]
        depth, left, right, parent = [0], [0], [0], [-1]
        leaf, stack = [0] * self.n, [0]
        for i in range(1, self.n + 1):
            here, low, last = lcp[i], i - 1, None
            if here <= depth[stack[-1]]:
                leaf[i - 1] = stack[-1]
            while stack and here < depth[stack[-1]]:
                last = stack.pop()
                right[last], low = i - 1, left[last]
                if stack and here <= depth[stack[-1]]:
                    parent[last], last = stack[-1], None
            if stack and here > depth[stack[-1]]:
                depth.append(here)
                left.append(low)
                right.append(0)
                parent.append(stack[-1])
                new = len(depth) - 1
                if last is not None:
                    parent[last] = new
                else:
                    leaf[i - 1] = new
                stack.append(new)
        nodes = self.nodes = len(depth)
        right[0] = self.n - 1
        self.depth = np.concatenate([depth, self.n - self.order])
        self.left = np.concatenate([left, np.arange(self.n)])
        self.right = np.concatenate([right, np.arange(self.n)])
        self.parent = np.concatenate([parent, leaf])
        self.parent[0] = 0
        self.place = self.order[self.left]
        self.lifts = [self.parent]
        while (self.lifts[-1] > 0).any():
            self.lifts.append(self.lifts[-1][self.lifts[-1]])
        child = np.arange(1, len(self.parent))
        self.wide = int(self.s.max()) + 1
        first = self.s[self.place[child] + self.depth[self.parent[child]]]
        self.child = dict(zip((self.parent[child] * self.wide + first).tolist(), child.tolist(), strict=True))
        own = np.arange(1, nodes)
        self.link = np.concatenate([[0], self.locate(self.place[own] + 1, self.depth[own] - 1)])

    def locate(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The node at or below the place of each string (start, length) in the tree."""
        node = self.nodes + self.rank[start]
        for up in reversed(self.lifts):
            higher = up[node]
            node = np.where(self.depth[higher] >= length, higher, node)
        return node

    def vocabulary(self) -> tuple[list[int], list[int]]:
        """Nodes at or below the places of all squares that aren't powers, and their periods."""
        start, k = self.covering()
        if not len(k):
            return [], []
        self.tree()
        s, depth, place, parent, link = self.s.tolist(), self.depth.tolist(), self.place.tolist(), self.parent.tolist(), self.link.tolist()
        child, wide, marked = self.child, self.wide, set()
        for node, at, q in zip(self.locate(start, 2 * k).tolist(), start.tolist(), k.tolist(), strict=True):
            length = 2 * q - 1
            while (node, q) not in marked:
                marked.add((node, q))
                w = link[parent[node]]
                while depth[w] < length:
                    w = child[w * wide + s[at + 1 + depth[w]]]
                if depth[w] == length:
                    w = child.get(w * wide + s[at], -1)
                    if w < 0:
                        break
                elif s[place[w] + length] != s[at]:
                    break
                node, at = w, place[w]
        return [v for v, _ in marked], [q for _, q in marked]


def runs(s: np.ndarray) -> np.ndarray:
    """start, length, period (rows, by start and period) of all runs of two periods or more of a sequence of numbers."""
    s = np.asarray(s, np.int64)
    if len(s) < 2:
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree(np.append(s, s.max() + 1))
    nodes, periods = (np.array(x, np.int64) for x in tree.vocabulary())
    if not len(nodes):
        return np.zeros((0, 3), np.int64)
    low, n = tree.left[nodes], tree.right[nodes] - tree.left[nodes] + 1
    at = tree.order[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]
    period = np.repeat(periods, n)
    by = np.lexsort((at, period))
    at, period = at[by], period[by]
    first = np.flatnonzero((np.diff(at, prepend=-9) != 1) | (np.diff(period, prepend=-9) != 0))
    last = np.append(first[1:], len(at)) - 1
    out = np.stack([at[first], at[last] - at[first] + 2 * period[first], period[first]], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _grams(ids: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A hash of each string of GRAM numbers and its group; the last strings run over the ends of groups."""
    mixed = ids.astype(np.uint64)
    out = group[: max(0, len(ids) - GRAM + 1)].astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            out += mixed[j : j + len(out)] + np.uint64(1)
            out *= _MULT
            out ^= out >> np.uint64(29)
    return out


def stretches(ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of ids, none across one of the ends of texts, that hold all runs.

    The strings of GRAM words in a run all come again within it, at most a third of its length away; what doesn't is left
    out, again and again until nothing changes. Equal hashes of different strings can only leave more in.
    """
    begins = np.concatenate([[0], ends[:-1]])
    spans = np.stack([begins, ends], 1)
    while True:
        spans = spans[spans[:, 1] - spans[:, 0] >= LEAST]
        if not len(spans):
            return []
        size = spans[:, 1] - spans[:, 0]
        group = np.repeat(np.arange(len(spans)), size)
        at = np.arange(len(group)) + np.repeat(spans[:, 0] - np.cumsum(size) + size, size)
        stop = np.cumsum(size)
        gram = _grams(ids[at], group)
        inside = np.flatnonzero((np.arange(len(gram)) + GRAM <= stop[group[: len(gram)]]))
        by = inside[np.argsort(gram[inside], kind="stable")]
        gap = np.where(gram[by[1:]] == gram[by[:-1]], by[1:] - by[:-1], len(group) + 1)
        near = np.minimum(np.append(gap, len(group) + 1), np.insert(gap, 0, len(group) + 1))
        again = np.zeros(len(group) + 1, bool)
        again[by] = near * TIMES <= size[group[by]]
        # stretches of such strings; a text's last strings are never marked, so none goes on into the next text
        edge = np.diff(again.astype(np.int8), prepend=0)
        a, b = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        new = np.stack([at[a], at[b - 1] + GRAM], 1) if len(a) else np.zeros((0, 2), np.int64)
        new = new[new[:, 1] - new[:, 0] >= LEAST]
        if len(new) == len(spans) and (new == spans).all():
            return [tuple(x) for x in new.tolist()]
        spans = new


def text_runs(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start (in ids), length, period of the runs of all texts, whose words are numbered; by start and period."""
    parts = stretches(ids, ends)
    if not parts:
        return np.zeros((0, 3), np.int64)
    top = int(ids.max()) + 1
    a, b = np.array(parts).T
    size = b - a + 1
    begin = np.cumsum(size) - size
    joined = np.arange(size.sum()) + np.repeat(a - begin, size)
    last = begin + size - 1
    joined[last] = 0
    sequence = ids[joined]
    sequence[last] = top + np.arange(len(a))
    found = runs(sequence)
    found = found[(found[:, 1] >= LEAST) & (found[:, 1] >= TIMES * found[:, 2])]
    part = np.searchsorted(begin, found[:, 0], side="right") - 1
    found[:, 0] += (a - begin)[part]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def best(own: list[list[int]]) -> list[int | None]:
    """start, length, period, floor(1000 * length / period) of the run with the most periods; ties: smallest start, then period."""
    top = None
    for r in own:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return [*top, 1000 * top[1] // top[2]] if top else [None] * 4


def kept_words(n: int, own: list[list[int]]) -> np.ndarray:
    """Which of n words stay when every run is cut down to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in own:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


#: Gives the places of the words that a text of n words is taken to consist of, or none if it is taken as it is.
Choose = Callable[[int | None, int], np.ndarray | None]


def _each(docs: DataFrame, choose: Choose) -> DataFrame:
    """doc_id, text (bytes), chosen (places of words, or null) and runs (rows of start, length, period, packed) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                doc_ids = batch.column("doc_id").to_pylist()
                texts = batch.column("text")
                cut = pc.ascii_split_whitespace(pc.fill_null(texts, b"").view(pa.string()))
                words = cut.flatten()
                there = pc.greater(pc.binary_length(words), 0)
                upto = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[cut.offsets.to_numpy()]
                ids = words.filter(there).dictionary_encode().indices.to_numpy().astype(np.int64)
                begins, ends = upto[:-1], upto[1:]
                chosen = []
                for doc_id, a, b in zip(doc_ids, begins.tolist(), ends.tolist(), strict=True):
                    at = choose(doc_id, b - a)
                    if at is not None:
                        ids[a:b] = ids[a:b][at]
                        at = at.astype(np.int32).tobytes()
                    chosen.append(at)
                found = text_runs(ids, ends)
                text = np.searchsorted(ends, found[:, 0], side="right")
                found[:, 0] -= begins[text]
                bound = np.searchsorted(text, np.arange(len(ends) + 1))
                packed = [found[i:j].tobytes() if i < j else None for i, j in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, pa.array(chosen, pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "text", "chosen", "runs"])

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, text binary, chosen binary, runs binary")


def _as_it_is(doc_id: int | None, n: int) -> None:
    return None


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period: a row for each run of words of every row of docs. Null and empty texts have none; of
    repeated rows each gives its own; extra columns are left out; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                if own:
                    start, length, period = np.frombuffer(own, np.int64).reshape(-1, 3).T
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id] * len(start), pa.int64()), "start": start, "length": length, "period": period})

    return _each(docs, _as_it_is).filter("runs is not null").mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(raw: bytes, chosen: bytes | None, own: list[list[int]]) -> bytes:
    """The words of a text, or those chosen of it, joined by spaces, every run cut down to its first period."""
    words = raw.split()
    if chosen is not None:
        words = [words[i] for i in np.frombuffer(chosen, np.int32).tolist()]
    if own:
        words = [words[i] for i in np.flatnonzero(kept_words(len(words), own)).tolist()]
    return b" ".join(words)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row, every run of words cut down to its first period. Texts without a run stay as they are,
    null ones null; in the others one space stands between words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                texts = [collapse(t, None, np.frombuffer(r, np.int64).reshape(-1, 3).tolist()) if r else t for t, r in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return _each(docs, _as_it_is).mapInArrow(tidy(run), "doc_id long, text binary").select("doc_id", F.col("text").cast("string").alias("text"))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words that op13 takes a text to consist of: in a tenth of the texts the words from a on repeat p of them."""
    if doc_id is None or not n:
        return None
    g, digit = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if digit:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def digests(docs: DataFrame, choose: Choose = planted) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row.

    A null text has no words; texts without doc_id are taken as they are. Repeated rows come out as often; extra columns
    are left out; an empty table gives an empty one.
    """
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                rows = []
                for raw, chosen, packed in zip(*(batch.column(c).to_pylist() for c in ("text", "chosen", "runs")), strict=True):
                    own = np.frombuffer(packed, np.int64).reshape(-1, 3).tolist() if packed else []
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
                    text = collapse(raw or b"", chosen, own)
                    rows.append((len(own), *best(own), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *names])

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _each(docs, choose).mapInArrow(tidy(run), schema)


def op13_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
hashed AS (SELECT *, len(ws)::BIGINT AS n, xor(list_reduce(list_prepend(4294967295::UBIGINT::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT) AS h FROM docs),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM hashed),
planted AS (SELECT r, doc_id, n, CASE WHEN a < n THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END]) ELSE ws END AS ws FROM placed),
words AS (SELECT r, unnest(range(0, n)) AS i, unnest(ws) AS w FROM planted),
grams AS (SELECT r, i, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g, count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k FROM words),
-- a run of period q holds a string of eight words that comes again q words on
periods AS (SELECT DISTINCT a.r, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.g = b.g AND b.i > a.i WHERE a.k = 8 AND b.k = 8),
same AS (SELECT p.r, p.q, x.i, x.i - row_number() OVER (PARTITION BY p.r, p.q ORDER BY x.i) AS stretch FROM periods p JOIN words x ON x.r = p.r JOIN words y ON y.r = p.r AND y.i = x.i + p.q AND y.w = x.w),
found AS (SELECT r, min(i) AS start, count(*) + q AS length, q AS period FROM same GROUP BY r, q, stretch HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found s WHERE s.r = f.r AND s.period < f.period AND s.start <= f.start AND s.start + s.length >= f.start + f.length)),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT words.r, string_agg(w, ' ' ORDER BY words.i) AS txt FROM words LEFT JOIN dropped ON words.r = dropped.r AND words.i = dropped.i WHERE dropped.i IS NULL GROUP BY words.r),
summary AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY r),
best AS (SELECT * FROM runs x WHERE NOT EXISTS (SELECT 1 FROM runs y WHERE y.r = x.r AND (y.length * x.period > x.length * y.period OR (y.length * x.period = x.length * y.period AND (y.start < x.start OR (y.start = x.start AND y.period < x.period))))))
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(txt, '')) AS collapsed_sha256
FROM planted LEFT JOIN summary USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
