"""Many passages in many texts, against plain searches."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrain.operators import matching as M


def table(pattern, text):
    """Edit distance of pattern to the closest stretch that ends at each character, row by row."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[1:]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, t in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=120))
def test_bit_vectors_equal_the_table(pattern, text):
    assert list(M.distances(pattern, text)) == table(pattern, text)
    assert list(M.distances(pattern, text, anchored=True)) == [distance(pattern, text[:j]) for j in range(1, len(text) + 1)]


def test_same_pairs_as_contains(spark, monkeypatch):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 200)))) for i in range(80)] + [(900, None), (901, ""), (902, "abab"), (902, "abab")]
    asked = [(i, "".join(rng.choice("ab é") for _ in range(rng.randint(1, 6)))) for i in range(50)] + [(77, ""), (78, None), (79, "ab"), (80, "ab"), (80, "é")]
    t, q = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    want = sorted({(n, d) for n, p in asked for d, x in texts if p is not None and x is not None and p in x})
    assert sorted(map(tuple, M.containing(t, q).collect())) == want
    monkeypatch.setattr(M, "BLOCK", 20)
    assert sorted(map(tuple, M.containing(t, q).collect())) == want
    assert M.containing(t, q.limit(0)).count() == M.containing(t.limit(0), q).count() == 0


def damaged(rng, text, rate):
    out = []
    for c in text:
        x = rng.random()
        out.append("" if x < rate / 3 else c + rng.choice("xyz") if x < 2 * rate / 3 else rng.choice("xyz") if x < rate else c)
    return "".join(out)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.25])
def test_closest_equals_the_table(spark, share):
    rng = random.Random(7)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (1, 5, 30, 64, 65, 200)]
    texts = []
    for i in range(30):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80)))
        for p in rng.sample(passages, 2):
            own += damaged(rng, p, rng.choice([0, 0.05, 0.15])) + "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80)))
        texts.append((i, own))
    want = []
    for n, p in enumerate(passages):
        for d, x in texts:
            row = table(p, x)
            e = M.errors(len(p), share)
            if row and min(row) <= e:
                end = row.index(min(row)) + 1
                start = max(s for s in range(end + 1) if distance(p, x[s:end]) == min(row))
                want.append((n, d, start, end, min(row)))
    got = M.closest(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(list(enumerate(passages)), "query_id long, text string"), share)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 30


def test_nothing_and_odd_texts(spark):
    t = spark.createDataFrame([(1, None), (2, ""), (3, "b"), (3, "ab")], "doc_id long, text string")
    q = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "query_id long, text string")
    assert list(map(tuple, M.closest(t, q, 0.9).collect())) == [(3, 3, 0, 1, 0)]
