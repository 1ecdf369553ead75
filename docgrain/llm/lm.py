"""Language-model scores by online logistic context mixing.

A text (A-Z lowered) is a row of words, closed by a mark that no word is, and the white space between them. Every word is
coded as binary decisions along Huffman trees of its bytes, one tree for each class of the byte before. For each decision
several predictors, one per context inside the word (the last 3 bytes, the last 5 and the word so far), give a log-odds from
counts of all training texts. A weight set picked by how often the word so far was seen adds them up. Weights begin the same for every text and adapt while it is read, in blocks of words that grow, so a text's score depends on the
corpus and on itself alone. What the mix gives a word is then refined by a cache of the text's own earlier words, in shares
that the text itself weighs. White space costs what its kinds cost in the training texts.

Contexts inside words are the same for every occurrence of a word, so each is looked up once for the distinct words of a
chunk of text. Contexts of up to 5 bytes are hashed to tables of fixed size, which every worker reads from the shared folder;
longer ones, of which there are the more the more text there is, and the words themselves are counted by key in as many parts
as the input needs, and the answers go back to the chunk: neither the driver nor a broadcast holds them.

A plain word model (additive smoothing) stands beside it as the base score.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, chunks, discard, documents, folder, fresh, present, saved, small_batches, tidy

#: Tabled contexts: bytes of the word looked back on and the bits of the table's line number. The last table is for the first
#: LEAD bytes of a word: the end of the word before (TAIL bytes) and what there is of the word.
CONTEXTS = ((3, 14), (5, 17), (0, 17))
LEAD, TAIL = 3, 3
#: The word so far has a key of its own from this length on, up to this length; shorter ones are what the last table sees.
LEAST, MOST = 6, 32
#: Weight sets by how often the word so far was seen in training (under each bound, or more).
SEEN = (1, 3, 11, 101, 1001)
#: Weights of the predictors at the start of every text, by weight set.
START = ((0.64, 0.36, 0.0), (0.44, 0.28, 0.73), (0.4, 0.22, 0.54), (0.38, 0.15, 0.53), (0.33, 0.1, 0.62), (0.55, 0.0, 0.61))
GATES = len(START)
#: A predictor's log-odds come from counts plus this, and are kept in 1/QUANT in a signed byte.
ADD, QUANT = 0.05, 15.0
#: First and last block of the online steps, in words; the strength of the start values, in decisions; the step.
FIRST, LAST, PRIOR, RATE = 8, 2048, 200.0, 2.0
#: Words that are mixed at once; bytes of text whose distinct words are looked up together; lines of a slab of a table.
STRIDE, CHUNK, SLAB = 1 << 16, 8 << 20, 1 << 10
#: Distinct words whose decisions are laid out at once.
BLOCK = 1 << 13
#: Weights stay within this (over QUANT), which keeps every sum of log-odds within what a float's exponential can hold.
BOUND = 2.5 / QUANT
#: Shares that the cache of a text's own words may have in its probabilities, and their weights at the start of a text.
SHARES, TRUST = (0.0, 0.1, 0.3, 0.6), (0.1, 0.3, 0.3, 0.3)
#: Bytes of input for each part of the keyed counts.
PART = 16 << 20
#: Groups in which the tasks' rows of a table are added up before their sums are.
MERGED = 64
#: Ends a word, and a text as a word of its own; neither occurs in words.
DONE, STOP = 10, 0xFF
_MULT, _BASE = 0x9E3779B97F4A7C15, 0x100000001B3


def _symbols() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbol of each byte of a word, for ASCII bytes that share one the bits that tell them apart, and classes.

    Lowered words leave A-Z unused; rare control bytes share a symbol; a high byte has the symbol of its low six bits,
    and a further decision says whether it begins a character or goes on with one. The class of a byte picks the tree of
    the byte after it: begin of a word, single vowels and common consonants, other letters, digits, marks, high bytes.
    """
    table, extra, kind = np.zeros(256, np.uint8), np.zeros(256), np.full(256, 14, np.uint8)
    plain = [b for b in range(33, 127) if not 65 <= b <= 90]
    for k, b in enumerate(plain):
        table[b] = k
    odd = [b for b in range(128) if b not in plain and b not in WORD_SPACE]
    table[odd] = len(plain)
    extra[odd] = np.log2(len(odd))
    table[128:] = len(plain) + 1 + (np.arange(128, 256) & 63)
    table[DONE], table[STOP] = len(plain) + 65, len(plain) + 66
    kind[97:123], kind[48:58], kind[128:], kind[DONE] = 12, 13, 15, 0
    for k, c in enumerate(b"aeiounrstlh"):
        kind[c] = k + 1
    return table, extra, kind


SYMBOL, EXTRA, CLASS = _symbols()
WIDTH, CLASSES = int(SYMBOL.max()) + 1, 16
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[base] = np.cumprod(out)
    return _POWERS[base][:n]


def _scrambled(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h * np.uint64(_MULT)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_MULT)
    return h


class Spelling:
    """Distinct words (lowered, without white space) as one row of bytes, DONE after each, and the contexts of every byte."""

    def __init__(self, words: list[bytes]):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.joined = np.frombuffer(b"".join([w + b"\n" for w in words]), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        n = len(self.joined)
        self.symbol = SYMBOL[self.joined]
        self.before = np.full(n, DONE, np.uint8)
        self.before[1:] = self.joined[:-1]
        self.kind = CLASS[self.before]
        #: Place of each byte in its word.
        self.place = np.arange(n) - np.repeat(self.starts, self.sizes)
        #: The last bytes of each word, and its first ones before each of the LEAD places, as numbers.
        self.tail, head = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
        for k in range(TAIL):
            there = self.sizes > k + 1
            self.tail[there] |= self.joined[self.ends[there] - 2 - k].astype(np.uint64) << np.uint64(8 * k)
        self.heads, self.kinds = [], []
        for k in range(LEAD):
            self.heads.append(head | np.uint64(k << 24))
            self.kinds.append(self.kind[np.minimum(self.starts + k, n - 1)].astype(np.int64))
            there = self.sizes > k + 1
            head = head.copy()
            head[there] |= self.joined[self.starts[there] + k].astype(np.uint64) << np.uint64(8 * k)

    def lines(self) -> list[np.ndarray]:
        """The line of each table but the last at each byte."""
        n = len(self.joined)
        padded = np.zeros(n + 8, np.uint8)
        padded[8:] = self.joined
        eight = np.ndarray((n,), "<u8", padded.data, 0, (1,)).copy()  # the bytes before each byte, the nearest in the highest place
        out = []
        for order, bits in CONTEXTS[:-1]:
            depth = np.minimum(self.place, order)
            h = (eight >> np.uint64(1)) >> (63 - 8 * depth).astype(np.uint64)  # nothing before the word
            line = (_scrambled(h) >> np.uint64(64 - bits + 4)).astype(np.int64)
            line += self.kind.astype(np.int64) << (bits - 4)
            out.append(line)
        return out

    def leads(self, before: np.ndarray, word: np.ndarray, place: int) -> np.ndarray:
        """The line of the last table at a place of words after words that end like `before` (tails)."""
        bits = CONTEXTS[-1][1]
        h = _scrambled((before << np.uint64(32)) | self.heads[place][word])
        if not place:  # half of the lines are for first bytes
            return (h >> np.uint64(65 - bits)).astype(np.int64)
        return (h >> np.uint64(69 - bits)).astype(np.int64) + (1 << bits - 1) + (self.kinds[place][word] << (bits - 5))

    def keyed(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes whose word so far has a key, and for each 44 bits of that key, the class (4 bits) and the symbol (8)."""
        at = np.flatnonzero((self.place >= LEAST) & (self.place <= MOST))
        n = len(self.joined)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((self.joined.astype(np.uint64) + np.uint64(1)) * _powers(pow(_BASE, -1, 1 << 64), n), out=total[1:])
            h = (total[at] - total[at - self.place[at]]) * _powers(_BASE, n)[at]
        h = _scrambled(h) >> np.uint64(20)
        return at, (h << np.uint64(12)) | (self.kind[at].astype(np.uint64) << np.uint64(8)) | self.symbol[at].astype(np.uint64)


def _classes(table: int) -> list[tuple[int, int, int]]:
    """(class, first line, line after the last) of the ranges of lines of a table."""
    bits = CONTEXTS[table][1]
    if table < len(CONTEXTS) - 1:
        return [(k, k << bits - 4, k + 1 << bits - 4) for k in range(CLASSES)]
    half = 1 << bits - 1
    return [(0, 0, half)] + [(k, half + (k << bits - 5), half + (k + 1 << bits - 5)) for k in range(CLASSES)]


class Tree:
    """Huffman tree of symbol counts; leaves in depth-first order, so that each inner node covers a range of them."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        heap = [(float(c) + 0.01, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        serial = n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], serial, (a[2], b[2])))
            serial += 1
        self.leaf = np.zeros(n, np.int64)
        paths: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.ranges = np.zeros((n - 1, 3), np.int64)
        nodes = leaves = 0
        # a node's children come after it: (subtree, path so far); closing marks fill in the ranges
        stack: list[tuple] = [("open", heap[0][2], [])]
        while stack:
            kind, x, path = stack.pop()
            if kind == "open" and isinstance(x, tuple):
                me, nodes = nodes, nodes + 1
                self.ranges[me, 0] = leaves
                stack += [("close", me, 2), ("open", x[1], [*path, (me, 1)]), ("close", me, 1), ("open", x[0], [*path, (me, 0)])]
            elif kind == "open":
                self.leaf[x], paths[x] = leaves, path
                leaves += 1
            else:
                self.ranges[x, path] = leaves
        self.paths = paths

    def log_odds(self, counts: np.ndarray) -> np.ndarray:
        """For lines of symbol counts and each node, the log-odds of bit 1 in 1/QUANT; then the weight set of the line."""
        out = np.zeros((len(counts), WIDTH), np.int8)
        lo, mid, hi = self.ranges.T
        upto = np.zeros((len(counts), WIDTH + 1))
        own = np.empty_like(counts)
        own[:, self.leaf] = counts
        np.cumsum(own, axis=1, out=upto[:, 1:])
        odds = np.log((upto[:, hi] - upto[:, mid] + ADD) / (upto[:, mid] - upto[:, lo] + ADD)) * QUANT
        out[:, : WIDTH - 1] = np.clip(np.rint(odds), -127, 127)
        out[:, WIDTH - 1] = np.searchsorted(SEEN, upto[:, -1], side="right")
        return out


class Code:
    """The trees of all classes, with the paths of (class, symbol) one after another: node, sign and range bounds of each decision."""

    def __init__(self, pairs: np.ndarray):
        """pairs: counts of (byte before, byte), 256 by 256."""
        pairs = pairs.reshape(256, 256).astype(np.float64)
        by_symbol = np.zeros((256, WIDTH))
        np.add.at(by_symbol.T, SYMBOL, pairs.T)
        counts = np.zeros((CLASSES, WIDTH))
        np.add.at(counts, CLASS, by_symbol)
        self.trees = [Tree(c) for c in counts]
        paths = [p for t in self.trees for p in t.paths]
        self.length = np.array([len(p) for p in paths])
        self.first = (np.cumsum(self.length) - self.length).astype(np.int32)
        tree = np.repeat(np.arange(len(paths)) // WIDTH, self.length)
        self.node = np.array([n for p in paths for n, _ in p], np.int16)
        self.sign = np.array([2 * b - 1 for p in paths for _, b in p], np.int8)
        self.leaf = np.array([t.leaf for t in self.trees])
        self.ranges = np.array([t.ranges for t in self.trees])[tree, self.node]
        # what is left to tell apart bytes of one symbol: by the byte before, whether a high byte goes on
        on, begins = pairs[:, 128:192].sum(1) + 0.5, pairs[:, 192:255].sum(1) + 0.5
        rest = np.tile(EXTRA, (256, 1))
        rest[:, 128:192] = -np.log2(on / (on + begins))[:, None]
        rest[:, 192:255] = -np.log2(begins / (on + begins))[:, None]
        self.rest = rest.ravel().astype(np.float32)

    def runs(self, kind: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many decisions each (class, symbol) takes, and the numbers of them all in order."""
        which = kind.astype(np.int64) * WIDTH + symbol
        n = self.length[which]
        upto = np.cumsum(n) - n
        return n, np.repeat((self.first[which] - upto).astype(np.int32), n) + np.arange(int(n.sum()), dtype=np.int32)

    def answers(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted distinct keys (see Spelling.keyed) and their counts: how many decisions each takes, the log-odds of every
        decision's bit as it came, and the weight set of each key's context."""
        symbol, kind = (keys & np.uint64(255)).astype(np.int64), ((keys >> np.uint64(8)) & np.uint64(15)).astype(np.int64)
        n, decision = self.runs(kind, symbol)
        head = np.flatnonzero(np.diff(keys >> np.uint64(8), prepend=np.uint64((1 << 64) - 1)) != 0) if len(keys) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(head)), np.diff([*head, len(keys)]))
        total = np.add.reduceat(counts, head) if len(head) else counts[:0]
        gate = np.searchsorted(SEEN, total, side="right").astype(np.uint8)[group]
        alone = counts == total[group]  # nothing else follows there, or nothing at all
        sure = np.where(total[group] > 0, np.log((counts + ADD) / ADD) * QUANT, 0)
        values = np.repeat(sure, n)
        mixed = np.flatnonzero(np.repeat(~alone, n))
        if len(mixed):
            leaf = group * WIDTH + self.leaf[kind, symbol]
            order = np.argsort(leaf)
            places, upto = leaf[order], np.concatenate([[0], np.cumsum(counts[order])])
            base = np.repeat(group, n)[mixed] * WIDTH
            lo, mid, hi = (upto[np.searchsorted(places, base + self.ranges[decision[mixed], k])] for k in range(3))
            values[mixed] = np.log((hi - mid + ADD) / (mid - lo + ADD)) * QUANT * self.sign[decision[mixed]]
        return n, np.clip(np.rint(values), -127, 127).astype(np.int8), gate


class Mixer:
    def __init__(self, pairs: np.ndarray, cells: list[np.ndarray], counts: list[np.ndarray], start: np.ndarray | None = None):
        """pairs: counts of (byte before, byte), 256 by 256; cells and counts: see table_counts(); start: as START."""
        self.start = np.asarray(START if start is None else start, np.float32)
        self.code = Code(pairs)
        self.tables = []
        for kind, ((_, bits), own, n) in enumerate(zip(CONTEXTS, cells, counts, strict=True)):
            table = np.zeros((1 << bits, WIDTH), np.int8)
            for k, low, high in _classes(kind):
                i, j = np.searchsorted(own, [low * WIDTH, high * WIDTH])
                line, symbol = own[i:j] // WIDTH, own[i:j] % WIDTH
                used, row = np.unique(line, return_inverse=True)
                for a in range(0, len(used), 4096):
                    here = (row >= a) & (row < a + 4096)
                    dense = np.zeros((min(4096, len(used) - a), WIDTH))
                    dense[row[here] - a, symbol[here]] = n[i:j][here]
                    table[used[a : a + 4096]] = self.code.trees[k].log_odds(dense)
            self.tables.append(table.ravel())

    def decisions(self, spelling: Spelling, values: np.ndarray, gates: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
        """First decision and number of decisions of each word; four signed bytes of every decision (log-odds of the bit as it
        came, by predictor, and the weight set); each word's decisions at the LEAD places; and every decision's node, from 1,
        negative where the bit is 0. values and gates: answers to the keyed bytes, sorted by key; order: which of them each
        keyed byte has."""
        code, starts = self.code, spelling.starts
        n = code.length[spelling.kind.astype(np.int64) * WIDTH + spelling.symbol].astype(np.int32)
        per_word = np.add.reduceat(n, starts)
        first = np.cumsum(per_word, dtype=np.int64) - per_word
        packed, nodes = np.zeros((int(per_word.sum()), 4), np.int8), np.zeros(int(per_word.sum()), np.int16)
        at, _ = spelling.keyed()
        length = np.zeros(len(gates), np.int32)
        length[order] = n[at]
        begin = np.cumsum(length, dtype=np.int64) - length
        lines = spelling.lines()
        gate = self.tables[1][lines[1] * WIDTH + WIDTH - 1].view(np.uint8)
        gate[spelling.place >= LEAST] = 0
        gate[at] = gates[order]
        for a in range(0, len(starts), BLOCK):  # a few words at a time: their decisions take many times their bytes
            i, j = int(starts[a]), int(spelling.ends[min(a + BLOCK, len(starts)) - 1])
            own, base = n[i:j], int(first[a])
            _, decision = code.runs(spelling.kind[i:j], spelling.symbol[i:j])
            sign, node = code.sign[decision], code.node[decision]
            part = packed[base : base + len(decision)]
            for k in range(2):
                cell = np.repeat((lines[k][i:j] * WIDTH).astype(np.int32), own)
                cell += node
                part[:, k] = self.tables[k][cell] * sign
            part[:, 2] = np.where(np.repeat(spelling.place[i:j] < LEAST, own), part[:, 1], 0)
            part[:, 3] = np.repeat(gate[i:j], own)
            nodes[base : base + len(decision)] = (node + np.int16(1)) * sign
            low, high = np.searchsorted(at, [i, j])
            far, which = at[low:high] - i, order[low:high]
            many = own[far].astype(np.int64)
            upto, span = np.cumsum(many) - many, np.arange(int(many.sum()))
            place = np.cumsum(own, dtype=np.int64) - own
            part[span + np.repeat(place[far] - upto, many), 2] = values[span + np.repeat(begin[which] - upto, many)]
        lead = np.zeros((len(starts), LEAD), np.int32)
        for k in range(LEAD):
            there = spelling.sizes > k
            lead[there, k] = n[starts[there] + k]
        return first, per_word.astype(np.int64), packed.view(np.uint32).ravel(), lead, nodes

    def bits(self, count: np.ndarray, flat: np.ndarray, words: tuple, rest: np.ndarray, spelling: Spelling) -> np.ndarray:
        """Bits of the words of each text: count words each, flat their numbers, words as decisions() gives them, rest the
        bits that a word costs besides."""
        starts = np.cumsum(count) - count
        out = np.zeros((len(count), len(SHARES)))
        order = np.argsort(-count, kind="stable")
        at = 0
        while at < len(order):
            upto = np.cumsum(count[order[at : at + STRIDE]])
            stop = at + max(1, int(np.searchsorted(upto, STRIDE, side="right")))
            own = order[at:stop]
            self._slab(starts[own], count[own], flat, words, rest, spelling, out, own)
            at = stop
        # the shares are weighed by what each would have made of the whole text so far
        low = out.min(1, keepdims=True)
        return (low - np.log2((np.array(TRUST) * np.exp2(low - out)).sum(1, keepdims=True))).ravel()

    def _slab(self, starts: np.ndarray, count: np.ndarray, flat: np.ndarray, words: tuple, rest: np.ndarray, spelling: Spelling, out: np.ndarray, who: np.ndarray) -> None:
        """Texts in descending order of size, read in step: adds their bits by share of the cache to rows `who` of out."""
        n = len(count)
        first, size, packed, lead, nodes = words
        # the slab's own words, texts one after another
        flat = flat[np.arange(int(count.sum())) + np.repeat(starts - (np.cumsum(count) - count), count)]
        starts = np.cumsum(count) - count
        again, before = _earlier(count, flat), tails(count, flat, spelling)
        w = [np.tile(v / np.float32(QUANT), n) for v in self.start.T]
        seen = np.full(n * GATES, PRIOR)
        begin, block = 0, FIRST
        shares = np.array(SHARES)[:, None]
        while begin < count[0]:
            lanes = int(np.searchsorted(-count, -begin, side="left"))  # texts longer than begin
            each = np.minimum(count[:lanes] - begin, block)
            heads = np.cumsum(each) - each
            where = np.arange(int(each.sum())) + np.repeat(starts[:lanes] + begin - heads, each)
            word = flat[where]
            own = size[word]
            ends = np.cumsum(own)
            index = np.repeat(first[word] - (ends - own), own)
            index += np.arange(int(ends[-1]))
            group = np.repeat(np.repeat(np.arange(lanes) * GATES, each), own)
            inputs = packed[index].view(np.int8).reshape(-1, 4)
            group += inputs[:, 3]
            x = [inputs[:, k].astype(np.float32) for k in range(3)]
            # at the first bytes of a word, all of its own contexts say the same; one predictor looks at the word before
            many, past = lead[word], before[where]
            here = many.sum(1)
            place = np.arange(int(here.sum())) + np.repeat(ends - own - (np.cumsum(here) - here), here)
            node = nodes[index[place]]
            line = np.stack([spelling.leads(past, word, k) for k in range(LEAD)], 1)
            at = np.repeat((line * WIDTH).ravel(), many.ravel())
            at += np.abs(node) - 1
            x[0][place] = self.tables[-1][at] * np.sign(node).astype(np.float32)
            final = w[0][group]
            final *= x[0]
            for k in range(1, 3):
                part = w[k][group]
                part *= x[k]
                final += part
            np.negative(final, out=final)
            np.exp(final, out=final)
            whole = final + np.float32(1)
            miss = final
            miss /= whole
            np.log(whole, out=whole)
            cost = np.add.reduceat(whole, ends - own) / np.log(2)
            cost += rest[word]
            # the cache: the share of the text's words so far that are this one
            lane = np.repeat(np.arange(lanes), each)
            past = np.arange(len(word)) - heads[lane] + begin
            p = np.exp2(-np.minimum(cost, 1000.0))
            hit = again[where] / np.maximum(past, 1)
            refined = -np.log2(p * (1 - shares * (past > 0)) + shares * hit + 1e-300)
            refined[0] = cost
            out[who[:lanes]] += np.add.reduceat(refined, heads, axis=1).T
            if begin + block < count[0]:
                seen[: lanes * GATES] += np.bincount(group, minlength=lanes * GATES)
                rate = RATE / seen[: lanes * GATES]
                for k in range(3):
                    x[k] *= miss
                    step = rate * np.bincount(group, x[k], lanes * GATES) / (QUANT * QUANT)
                    w[k][: lanes * GATES] = np.clip(w[k][: lanes * GATES] + step, -BOUND, BOUND)
            begin += block
            block = min(block + max(FIRST, block // 2), LAST)
        self.ended = [v.reshape(n, GATES) for v in w], seen.reshape(n, GATES) - PRIOR


def tails(count: np.ndarray, flat: np.ndarray, spelling: Spelling) -> np.ndarray:
    """How the word before each word of a text ends; all bits set at the start of a text."""
    out = np.full(len(flat), (1 << 24) - 1, np.uint64)
    out[1:] = spelling.tail[flat[:-1]]
    out[np.cumsum(count) - count] = (1 << 24) - 1
    return out


def _earlier(count: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """How often each word came before in its own text."""
    text = np.repeat(np.arange(len(count)), count)
    key = text * (int(flat.max(initial=0)) + 1) + flat
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    out = np.empty(len(flat), np.int64)
    out[order] = np.arange(len(flat)) - np.repeat(head, np.diff([*head, len(flat)]))
    return out


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text (bytes; A-Z lowered, cut at white space), the number of every word in order, and the distinct words."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words = cut.flatten()
    there = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    coded = words.filter(there).dictionary_encode()
    return np.diff(upto[cut.offsets.to_numpy()]), coded.indices.to_numpy().astype(np.int64), coded.dictionary.view(pa.binary()).to_pylist()


_SPACE = np.zeros(256, np.uint8)
for _k, _b in enumerate(WORD_SPACE):
    _SPACE[_b] = _k + 1
KINDS = len(WORD_SPACE)
#: Counts of a text's white space: kinds that begin a gap, kinds that go on with one, whether it begins and ends with one.
GAPS = 2 * KINDS + 2


def gaps(texts: pa.Array) -> np.ndarray:
    """The GAPS counts of each text; a text without a word only begins with white space."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _SPACE[raw]
    at = np.flatnonzero(kind)
    text = np.searchsorted(offsets, at, side="right") - 1
    first = (at == offsets[text]) | (kind[np.maximum(at - 1, 0)] == 0)
    out = np.bincount(text * GAPS + kind[at] - 1 + KINDS * ~first, minlength=len(texts) * GAPS).reshape(-1, GAPS)
    sizes = np.diff(offsets)
    there = sizes > 0
    spaces = np.bincount(text, minlength=len(texts))
    out[there, -2] = kind[offsets[:-1][there]] > 0
    out[there, -1] = (kind[offsets[1:][there] - 1] > 0) & (spaces < sizes)[there]
    return out


def gap_bits(own: np.ndarray, totals: np.ndarray, texts: int) -> np.ndarray:
    """Bits of each text's white space (rows of gaps()) given the sums over all training texts."""
    first, on = totals[:KINDS] + 0.5, totals[KINDS : 2 * KINDS] + 0.5
    stop = totals[:KINDS].sum() + 0.5  # every gap ends once
    begins, ended = (totals[-2:] + 0.5) / (texts + 1)
    cost = np.concatenate([-np.log2(first / first.sum()) - np.log2(stop / (stop + on.sum())), -np.log2(on / (stop + on.sum()))])
    flags = [np.where(own[:, k] > 0, -np.log2(p), -np.log2(1 - p)) for k, p in ((-2, begins), (-1, ended))]
    return own[:, :-2] @ cost + flags[0] + flags[1]


def _token_key(token: bytes) -> int:
    """64 bits for a token: among 5 million distinct tokens two agree with a chance of 1 in a million."""
    return xxhash.xxh3_64_intdigest(token)


def word_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of words in ascending order, and the words' places in that order."""
    keys = np.fromiter(map(_token_key, words), np.uint64, len(words))
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def _part_of(high: np.ndarray, parts: int) -> np.ndarray:
    """The part of keys by their highest 32 bits: parts are ranges of keys."""
    return ((high.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _squeezed(x: object) -> bytes:
    """x (a number or a tuple) in few bytes; arrays are laid out byte by byte of their items, so that equal bytes meet."""
    plain = [("array", v.dtype.str, v.view(np.uint8).reshape(-1, v.dtype.itemsize).T.tobytes()) if isinstance(v, np.ndarray) else v for v in (x if isinstance(x, tuple) else (x,))]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((isinstance(x, tuple), plain), protocol=5))


def _opened(x: bytes) -> object:
    whole, plain = pickle.loads(zstandard.ZstdDecompressor().decompress(x))
    out = []
    for v in plain:
        if isinstance(v, tuple) and v[:1] == ("array",):
            kind = np.dtype(v[1])
            v = np.frombuffer(np.frombuffer(v[2], np.uint8).reshape(kind.itemsize, -1).T.tobytes(), kind)
        out.append(v)
    return tuple(out) if whole else out[0]


def _trained(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the text as bytes."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 10 == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"))


#: Rows of the first step. part >= 0: keys of a chunk for that part; HEAD: a chunk's texts; TOTALS: counts of one task;
#: PAIRS and below: its counts of one slab of a table.
HEAD, TOTALS, PAIRS = -1, -2, -3
_ROW = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("body", pa.binary())])
_ROWS = "chunk long, part int, body binary"


def _row(chunk: int, part: int, body: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"chunk": [chunk], "part": [part], "body": [_squeezed(body)]}, schema=_ROW)


def _slabs(bits: int) -> int:
    return max(1, (1 << bits) // SLAB)


def _moved(scratch: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a table (sorted cells, counts) with those of scratch, which is emptied."""
    here = np.flatnonzero(scratch).astype(np.int32)
    cells, place = np.unique(np.concatenate([table[0], here]), return_inverse=True)
    often = np.bincount(place, np.concatenate([table[1], scratch[here]]), len(cells)).astype(np.int64)
    scratch[here] = 0
    return cells, often


def _read(docs: DataFrame, parts: int) -> DataFrame:
    """The rows of the first step: the only one that reads texts."""
    small_batches(docs.sparkSession, 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        scratch = np.zeros(WIDTH << max(bits for _, bits in CONTEXTS), np.int32)
        tables = [(np.zeros(0, np.int32), np.zeros(0, np.int64)) for _ in CONTEXTS]  # cells that occur, and how often
        pairs = np.zeros(1 << 16, np.int64)
        sums, tokens, texts = np.zeros(GAPS, np.int64), 0, 0
        held_rows: list[pa.RecordBatch] = []

        def out(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal chunk, tokens, texts, sums
            doc_ids = pa.chunked_array([r.column("doc_id") for r in rows]).combine_chunks()
            held = np.array([x for r in rows for x in r.column("held_out").to_pylist()], bool)
            text = pa.chunked_array([r.column("text") for r in rows]).combine_chunks()
            count, flat, words = distinct_words(text)
            words.append(bytes([STOP]))
            # the more often a word occurs, the smaller its number; the mark that ends a text after its words
            times = np.append(np.bincount(flat, minlength=len(words) - 1), len(count))
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words))
            every = np.full(len(flat) + len(count), place[-1], np.int32)
            every[np.arange(len(flat)) + np.repeat(np.arange(len(count)), count)] = place[flat]
            words, count = [words[i] for i in order.tolist()], count + 1
            own = gaps(text)
            trained = np.bincount(every[np.repeat(~held, count)], minlength=len(words))
            sums, tokens, texts = sums + own[~held].sum(0), tokens + int(count[~held].sum()), texts + int((~held).sum())
            yield _row(chunk, HEAD, (doc_ids, held, count, every, b"\n".join(words), own.astype(np.uint32).ravel()))
            spelling = Spelling(words)
            times = np.repeat(trained, spelling.sizes)
            learnt = np.flatnonzero(times)
            pairs[:] += np.bincount((spelling.before[learnt].astype(np.int64) << 8) + spelling.joined[learnt], times[learnt], 1 << 16).astype(np.int64)
            for table, line in enumerate(spelling.lines()):
                np.add.at(scratch, line[learnt] * WIDTH + spelling.symbol[learnt], times[learnt].astype(np.int32))
                tables[table] = _moved(scratch, tables[table])
            del line, learnt, times
            before = tails(count, every, spelling)
            read = np.repeat(~held, count)
            for a in range(0, len(every), STRIDE):
                some = read[a : a + STRIDE]
                word, end = every[a : a + STRIDE][some], before[a : a + STRIDE][some]
                for k in range(LEAD):
                    some = spelling.sizes[word] > k
                    line = spelling.leads(end[some], word[some], k)
                    line *= WIDTH
                    line += spelling.symbol[spelling.starts[word[some]] + k]
                    np.add.at(scratch, line, np.int32(1))
            tables[-1] = _moved(scratch, tables[-1])
            times = np.repeat(trained, spelling.sizes)
            at, key = spelling.keyed()
            key, which = np.unique(key, return_inverse=True)
            often = np.bincount(which, times[at], len(key)).astype(np.uint32)
            keys, order = word_keys(words)
            word_part, key_part = _part_of(keys >> np.uint64(32), parts), _part_of(key >> np.uint64(24), parts)
            bounds = np.arange(parts + 1)
            a, b = np.searchsorted(word_part, bounds).tolist(), np.searchsorted(key_part, bounds).tolist()
            for part in range(parts):
                i, j, k, l = a[part], a[part + 1], b[part], b[part + 1]
                if j > i or l > k:
                    yield _row(chunk, part, (np.diff(keys[i:j], prepend=np.uint64(0)), trained[order[i:j]].astype(np.uint32), np.diff(key[k:l], prepend=np.uint64(0)), often[k:l]))
            chunk += 1

        size = 0
        for whole in batches:
            for batch in chunks(whole, limit=4 << 20):
                held_rows.append(batch)
                size += batch.nbytes
                if size >= CHUNK:
                    yield from out(held_rows)
                    held_rows, size = [], 0
        if held_rows:
            yield from out(held_rows)
        yield _row(-1, TOTALS, (tokens, texts, sums))
        here = np.flatnonzero(pairs)
        yield _row(-1, PAIRS, (here, pairs[here]))
        number = PAIRS
        for (cells, often), (_, bits) in zip(tables, CONTEXTS, strict=True):
            cuts = np.searchsorted(cells, np.arange(_slabs(bits) + 1) * (SLAB * WIDTH)).tolist()
            for slab, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                number -= 1
                if b > a:
                    yield _row(-1, number, (cells[a:b] - np.int32(slab * SLAB * WIDTH), often[a:b].astype(np.uint32)))

    return _trained(docs).mapInArrow(tidy(run), _ROWS)


def table_counts(rows: DataFrame) -> DataFrame:
    """The counts of all tasks added up: one row for TOTALS, PAIRS and every slab of a table, whatever the corpus. Tasks' rows are
    added in MERGED groups first, so that no task reads a row of every other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        total: object = None

        def out() -> Iterator[pa.RecordBatch]:
            if at == TOTALS:
                yield _row(-1, at, total)
            elif at is not None:
                here = np.flatnonzero(total)
                yield _row(-1, at, (here, total[here]))

        for batch in batches:
            for part, body in zip(batch.column("part").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if part != at:
                    yield from out()
                    at, total = part, (0, 0, np.zeros(GAPS, np.int64)) if part == TOTALS else np.zeros(1 << 16 if part == PAIRS else SLAB * WIDTH, np.int64)
                own = _opened(body)
                if part == TOTALS:
                    total = tuple(x + y for x, y in zip(total, own, strict=True))
                else:
                    total[own[0]] += own[1]
        yield from out()

    group = F.pmod(F.monotonically_increasing_id(), F.lit(MERGED)).alias("group")
    some = rows.select("*", group).repartition("part", "group").sortWithinPartitions("part", "group").select("chunk", "part", "body").mapInArrow(tidy(run), _ROWS)
    return some.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(run), _ROWS)


def unpacked(found: dict[int, tuple]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """A Mixer's arguments from the bodies of table_counts() by part."""
    pairs = np.zeros(1 << 16, np.int64)
    if PAIRS in found:
        pairs[found[PAIRS][0]] = found[PAIRS][1]
    cells, counts, number = [], [], PAIRS
    for _, bits in CONTEXTS:
        own, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for slab in range(_slabs(bits)):
            number -= 1
            if number in found:
                own.append(found[number][0] + slab * SLAB * WIDTH)
                n.append(found[number][1])
        cells.append(np.concatenate(own))
        counts.append(np.concatenate(n))
    return pairs, cells, counts


_MIXERS: dict[str, Mixer] = {}


def _mixer(path: str) -> Mixer:
    """The mixer whose counts lie below a path of the shared folder: read once by every worker."""
    if path not in _MIXERS:
        _MIXERS.clear()
        store, root = folder(path)
        rows = pq.read_table(root, filesystem=store, columns=["part", "body"])
        _MIXERS[path] = Mixer(*unpacked({p: _opened(b) for p, b in zip(rows["part"].to_pylist(), rows["body"].to_pylist(), strict=True)}))
    return _MIXERS[path]


def _look_up(rows: DataFrame, pairs: np.ndarray, parts: int) -> DataFrame:
    """Every part's training counts, and from them for each chunk the answers to its keys.

    chunk -1: the number of distinct training tokens of a part; else how often each word occurs in training, and for the keys
    of words so far the log-odds of all decisions and the weight sets."""
    code: list[Code] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not code:
            code.append(Code(pairs))
        held: list[tuple[int, tuple]] = []
        part: int | None = None

        def out() -> Iterator[pa.RecordBatch]:
            if part is None:
                return
            opened = [x for _, x in held]
            sizes, places = [len(x[0]) for x in opened], [len(x[2]) for x in opened]
            key, where = np.unique(np.concatenate([np.cumsum(x[0]) for x in opened]), return_inverse=True)
            c = np.bincount(where, np.concatenate([x[1] for x in opened]), len(key)).astype(np.int64)
            c = c.astype(np.uint32) if c.max(initial=0) < 1 << 32 else c  # a few words of a large corpus need more
            yield _row(-1, part, int((c > 0).sum()))
            key, at = np.unique(np.concatenate([np.cumsum(x[2]) for x in opened]), return_inverse=True)
            n = np.bincount(at, np.concatenate([x[3] for x in opened]), len(key))
            length, values, gate = code[0].answers(key, n)
            begin = np.cumsum(length) - length
            i = j = 0
            for (chunk, _), size, place in zip(held, sizes, places, strict=True):
                own = at[j : j + place]
                many = length[own]
                flat = np.arange(int(many.sum())) + np.repeat(begin[own] - (np.cumsum(many) - many), many)
                yield _row(chunk, part, (c[where[i : i + size]], values[flat], gate[own]))
                i, j = i + size, j + place

        for batch in batches:
            for chunk, own, body in zip(*(batch.column(n).to_pylist() for n in _ROW.names), strict=True):
                if own != part:
                    yield from out()
                    part, held = own, []
                held.append((chunk, _opened(body)))
        yield from out()

    return rows.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(tidy(run), _ROWS)


def _mixed(mixer: Mixer, head: tuple, answers: list[tuple], totals: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's texts the sums of log10(c + 0.1), the number of known tokens and the bits."""
    _, _, count, flat, joined, own = head
    distinct = joined.split(b"\n")
    spelling = Spelling(distinct)
    sorted_c, values, gates = (np.concatenate(x) for x in zip(*answers, strict=True))
    c = np.empty_like(sorted_c)
    c[word_keys(distinct)[1]] = sorted_c
    starts = np.cumsum(count) - count
    upto = lambda x: np.add.reduceat(x[flat], starts)
    base, known = upto(np.log10(c + 0.1)), upto((c > 0).astype(np.int64))
    _, key = spelling.keyed()
    _, order = np.unique(key, return_inverse=True)
    words = mixer.decisions(spelling, values, gates, order)
    extra = np.add.reduceat(mixer.code.rest[(spelling.before.astype(np.int64) << 8) + spelling.joined], spelling.starts).astype(np.float64)
    return base, known, mixer.bits(count, flat, words, extra, spelling) + gap_bits(own.reshape(-1, GAPS).astype(np.int64), totals[2], totals[1])


def score(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    The model learns from rows whose crc32(doc_id) mod 10 is not 0; a null doc_id is not held out. A null text counts
    as empty: its one token is the end. Repeated rows are separate documents (each learnt from). Without training rows
    counts are 0 and scores finite (base_score with V = 0 is log10(0.1 / 0.1) a token). Extra columns are left out.
    parts: of the keyed counts, by default the shuffle partitions or one for PART bytes of input.
    """
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if parts is None:
        size = int(str(docs.select("doc_id", "text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        parts = max(least, min(size // PART, 1 << 16) if size < 1 << 60 else least)
    rows, where = _read(docs, parts), fresh(spark, "lm-chunks")
    kind = F.when(F.col("part") >= 0, "keys").when(F.col("part") == HEAD, "texts").otherwise("counts")
    rows.withColumn("kind", kind).write.partitionBy("kind").parquet(where)

    def part(k: str) -> DataFrame:
        there = present(spark, f"{where}/kind={k}")
        return spark.read.schema(rows.schema).parquet(*there) if there else spark.createDataFrame([], rows.schema)

    texts, keys, counts = map(part, ("texts", "keys", "counts"))
    path = fresh(spark, "lm-tables")
    table_counts(counts).write.parquet(path)
    small = spark.read.schema(rows.schema).parquet(path).filter(F.col("part") >= PAIRS).collect()
    found = {r["part"]: _opened(r["body"]) for r in small}
    totals = found.get(TOTALS, (0, 0, np.zeros(GAPS, np.int64)))
    sums = saved(_look_up(keys, unpacked(found)[0], parts), "lm-answers")
    for k in ("keys", "counts"):
        discard(spark, f"{where}/kind={k}")
    counted = sums.filter("chunk = -1").mapInArrow(_unpickled, "n long").agg(F.sum("n")).first()[0]
    tokens, distinct = totals[0], counted or 0
    floor = np.log10(tokens + 0.1 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, answers = None, None, []

        def out() -> Iterator[pa.RecordBatch]:
            if at is None:
                return
            base, known, bits = _mixed(_mixer(path), head, answers, totals)
            doc_ids, held, count = head[:3]
            yield pa.RecordBatch.from_pydict({
                "doc_id": doc_ids,
                "held_out": pa.array(held),
                "n_tokens": pa.array(count),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(count), tokens)),
                "base_score": pa.array(base - count * floor),
                "score": pa.array(-bits * np.log10(2)),
            })

        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if chunk != at:  # its texts come first
                    yield from out()
                    at, head, answers = chunk, _opened(body), []
                else:
                    answers.append(_opened(body))
        yield from out()

    every = texts.union(sums.filter("chunk >= 0"))
    own = every.repartition(max(least, parts), "chunk").sortWithinPartitions("chunk", "part")
    return own.mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _unpickled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": pa.array([_opened(b) for b in batch.column("body").to_pylist()], pa.int64())})


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
