import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrain.llm import runs as R
from docgrain.llm.common import documents
from tests.oracle import same


def slow_runs(s, least=2, times=2):
    """All runs, period by period."""
    out = []
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            own = s[i : i + n]
            if n >= max(least, times * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words, 24, 3)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(0, 40))
def test_runs_of_sequences(head, root, n):
    s = head + (root * n)[:n] + head[:5]
    assert [tuple(r) for r in R.runs(np.array(s, np.int64)).tolist()] == slow_runs(s)


def test_powers_and_short():
    assert R.runs(np.zeros(3000, np.int64)).tolist() == [[0, 3000, 1]]
    assert R.runs(np.arange(50)).tolist() == R.runs(np.zeros(0, np.int64)).tolist() == R.runs(np.zeros(1, np.int64)).tolist() == []


def test_texts_are_cut_down_without_losing_a_run():
    rng = np.random.default_rng(3)
    for _ in range(300):
        parts = [list(rng.integers(0, 4, rng.integers(0, 40))) + list(np.resize(rng.integers(0, 9, rng.integers(1, 15)), rng.integers(0, 90))) for _ in range(3)]
        ends = np.cumsum([len(p) for p in parts])
        got = R.text_runs(np.array(sum(parts, []), np.int64), ends)
        want = [(e - len(p) + s, n, q) for p, e in zip(parts, ends.tolist(), strict=True) for s, n, q in slow_runs(p, 24, 3)]
        assert [tuple(r) for r in got.tolist()] == want


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_digests_of_all_documents(spark, small):
    docs = documents(spark, small)
    got = _rows(R.digests(docs))
    assert got == sorted((slow(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sum(r[1] > 0 for r in got) > 5


def test_sql(spark, small):
    same(spark, small, R.op13_tandem_runs, R.OP13_SQL)


def test_odd(spark, odd):
    got = _rows(R.digests(odd))
    assert got == sorted((slow(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()), key=repr)
    assert R.digests(odd.limit(0)).count() == 0
    assert [tuple(r) for r in R.periodic_runs(odd).collect()] == [(6, 0, 20_000, 1)]


@pytest.mark.parametrize(("text", "want"), [("a b " * 30 + "c", "a b c"), ("x  y\n", "x  y\n"), (None, None), ("", "")])
def test_collapse(docs, text, want):
    assert R.collapse_runs(docs([(1, text)])).collect()[0].text == want


def test_overlapping_runs_and_ties(docs):
    text = "a b c " * 12 + "c " * 30 + "d " * 30
    rows = R.periodic_runs(docs([(7, text), (7, text)])).collect()
    want = slow_runs(text.split(), 24, 3)
    assert sorted((r.start, r.length, r.period) for r in rows) == sorted(want * 2) and len(want) == 3
