import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docgrain.llm import lm


def base(rows):
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    cut = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    c = Counter(w for ws, h in zip(cut, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    score = lambda w: math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1)))
    return [(d, h, len(ws), sum(w in c for w in ws), n, sum(map(score, ws))) for (d, _), h, ws in zip(rows, held, cut)]


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])


def test_base_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = lm.op4_context_mixing(spark, small).collect()
    same([tuple(r)[:6] for r in got], base(rows))


def test_model_beats_the_word_model_on_held_out_texts(spark):
    """From about 2 MB of training text on; with less, its contexts are too rarely seen."""
    got = [r for r in lm.op4_context_mixing(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = lm.score(odd).collect()
    same([tuple(r)[:6] for r in got], base(rows))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_without_training_rows(docs):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    got = lm.score(docs([(held, "some text")])).collect()
    same([tuple(r)[:6] for r in got], base([(held, "some text")]))
    assert lm.score(docs([])).count() == 0


HELD = [d for d in range(4000) if zlib.crc32(str(d).encode()) % 10 == 0]
LEARNT = [d for d in range(4000) if zlib.crc32(str(d).encode()) % 10]
TRAINING = ["the cat sat on the mat", "the dog sat  on the\nlog of the management", "é à ü management managed", " the management manages", ""] * 5


def scores(docs, texts):
    """Scores of held-out texts beside TRAINING."""
    rows = list(zip(LEARNT, TRAINING)) + list(zip(HELD, texts))
    got = {r["doc_id"]: r["score"] for r in lm.score(docs(rows)).collect()}
    return [got[d] for d, _ in zip(HELD, texts)]


def slow_bits(training, text):
    """A text's bits by loops over words, bytes and decisions; only the lines of hashed contexts come from the module."""
    words = lambda t: [*t.encode().lower().split(), b"\xff"]
    pairs, counts, tokens = np.zeros((256, 256)), {}, [words(t) for t in training]

    def contexts(word, tail):
        """For each byte and the end of a word: byte before, symbol, class and its contexts; the last is the word so far."""
        own = lm.Spelling([word])
        lines = own.lines()
        for k in range(len(word) + 1):
            before, byte = (word[k - 1] if k else 10), (word[k] if k < len(word) else 10)
            three, five = [("line", i, int(x[k])) for i, x in enumerate(lines)]
            lead = ("line", 2, int(own.leads(np.array([tail], np.uint64), np.array([0]), k)[0])) if k < 3 else None
            far = five if k < 6 else ("word", word[:k]) if k <= 32 else None
            yield before, byte, int(lm.SYMBOL[byte]), int(lm.CLASS[before]), (three, five, far, lead)

    ends = lambda ws: [(1 << 24) - 1, *(int.from_bytes(w[-3:][::-1], "little") for w in ws[:-1])]
    for ws in tokens:
        for w, tail in zip(ws, ends(ws)):
            for before, byte, symbol, _, own in contexts(w, tail):
                pairs[before, byte] += 1
                for c in set(own) - {None}:
                    at = counts.setdefault(c, Counter())
                    at[symbol] += 1
    code = lm.Code(pairs.ravel())

    def odds(context, kind, node):
        own, tree = counts.get(context, {}), code.trees[kind]
        lo, mid, hi = tree.ranges[node]
        left = sum(n for s, n in own.items() if lo <= tree.leaf[s] < mid)
        right = sum(n for s, n in own.items() if mid <= tree.leaf[s] < hi)
        return float(np.clip(np.rint(np.log((right + lm.ADD) / (left + lm.ADD)) * lm.QUANT), -127, 127))

    ws = words(text)
    w = {g: np.array(lm.START[g]) / lm.QUANT for g in range(lm.GATES)}
    seen = dict.fromkeys(range(lm.GATES), lm.PRIOR)
    totals, begin, block = np.zeros(len(lm.SHARES)), 0, lm.FIRST
    while begin < len(ws):
        steps = {g: np.zeros(3) for g in w}
        more = Counter()
        for i in range(begin, min(begin + block, len(ws))):
            cost = 0.0
            for before, byte, symbol, kind, (three, five, far, lead) in contexts(ws[i], ends(ws)[i]):
                cost += code.rest[before * 256 + byte]
                gate = int(np.searchsorted(lm.SEEN, sum(counts.get(far, {}).values()), side="right")) if far else 0
                for node, bit in code.trees[kind].paths[symbol]:
                    x = np.array([odds(c, kind, node) if c else 0.0 for c in (lead or three, five, far)]) * (2 * bit - 1)
                    p = 1 / (1 + np.exp(-w[gate] @ x))
                    cost -= np.log2(p)
                    steps[gate] += x * (1 - p)
                    more[gate] += 1
            hit = ws[:i].count(ws[i]) / max(i, 1)
            for k, share in enumerate(lm.SHARES):
                totals[k] -= np.log2(2.0**-cost * (1 - share * (i > 0)) + share * hit)
        for g in w:
            seen[g] += more[g]
            w[g] = np.clip(w[g] + lm.RATE / seen[g] * steps[g] / lm.QUANT**2, -lm.BOUND, lm.BOUND)
        begin, block = begin + block, min(block + max(lm.FIRST, block // 2), lm.LAST)
    return -np.log2(sum(t * 2.0 ** -x for t, x in zip(lm.TRUST, totals)))


def slow_gaps(texts, text):
    """Bits of a text's white space by a loop over its bytes."""

    def events(t):
        raw = t.encode()
        for i, b in enumerate(raw):
            if b in lm.WORD_SPACE:
                yield ("first" if i == 0 or raw[i - 1] not in lm.WORD_SPACE else "on"), b
        yield "begins", raw[:1].isspace()
        yield "ends", raw[-1:].isspace() and bool(raw.strip())

    n = Counter(e for t in texts for e in events(t))
    first = sum(n["first", b] + 0.5 for b in lm.WORD_SPACE)
    stop = sum(n["first", b] for b in lm.WORD_SPACE) + 0.5
    on = sum(n["on", b] + 0.5 for b in lm.WORD_SPACE)
    bits = 0.0
    for what, b in events(text):
        if what == "first":
            bits -= np.log2((n[what, b] + 0.5) / first) + np.log2(stop / (stop + on))
        elif what == "on":
            bits -= np.log2((n[what, b] + 0.5) / (stop + on))
        else:
            bits -= np.log2((n[what, b] + 0.5) / (len(texts) + 1))
    return bits


def test_score_equals_brute_force(docs):
    texts = ["", "the cat", " the  management\nof the unmanageable mat ", "é à qzx", "the management sat on the management " * 12, "\n \t", "The Dog", "x" * 60]
    got = scores(docs, texts)
    for text, own in zip(texts, got):
        want = slow_bits(TRAINING, text) + slow_gaps(TRAINING, text)
        assert -own / math.log10(2) == pytest.approx(want, rel=1e-4, abs=1e-3), text


def test_probabilities_of_texts_add_up(docs):
    """Over the empty text and all texts of one byte without white space."""
    texts = ["", *(chr(b) for b in range(128) if not chr(b).isupper() and b not in lm.WORD_SPACE)]
    total = sum(10.0**x for x in scores(docs, texts))
    assert 0 < total <= 1.0 + 1e-3


def test_scores_do_not_depend_on_neighbours(docs):
    texts = ["the cat", "", "a much longer text about the dog and the log " * 9, "éà", "x" * 3000]
    alone = [scores(docs, ["", t])[1] for t in texts[:3]]
    assert scores(docs, texts)[:3] == pytest.approx(alone, rel=1e-5)


def test_score_does_not_depend_on_parts_and_partitions(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    key = lambda rows: sorted((r["doc_id"], r["n_known"], round(r["score"], 3)) for r in rows)
    assert key(lm.score(df, parts=3).collect()) == key(lm.score(df.repartition(5), parts=11).collect())


def test_seen_text_costs_less(docs):
    known, unknown = scores(docs, ["the cat sat on the mat", "qzx vkj wpf bgh qx zvb"])
    assert known > 0.5 * unknown


def test_keys_look_only_into_their_own_word():
    words = [b"abcdefgh", b"x", b"zbcdefgh", b"abcdefgh", "ünïcödé".encode() * 9]
    whole = lm.Spelling(words)
    at, key = whole.keyed()
    alone = [lm.Spelling([w]).keyed()[1].tolist() for w in words]
    assert key.tolist() == [k for x in alone for k in x]
    assert not set(alone[0]) & set(alone[2]) and alone[0] == alone[3]
    for k, line in enumerate(whole.lines()):
        assert line.tolist() == [x for w in words for x in lm.Spelling([w]).lines()[k].tolist()]


def test_gaps_equal_a_loop():
    texts = ["", " ", "a", " a", "a ", "a  b\n\nc", "\n\t x \r", "é é"]
    got = lm.gaps(pa.array([t.encode() for t in texts], pa.binary()))
    bits = lm.gap_bits(got, got.sum(0), len(texts))
    assert bits.tolist() == pytest.approx([slow_gaps(texts, t) for t in texts])
