import itertools
import random

import numpy as np
import pytest
import xxhash

from docgrain.llm import simhash


def slow(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def parts(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def brute(rows):
    fps = [slow(t) for _, t in rows]
    label = parts(fps)
    least = {}
    for (d, _), p in zip(rows, label):
        if d is not None:
            least[p] = min(d, least.get(p, d))
    return sorted(((d, f"{f:016x}", least.get(p)) for (d, _), f, p in zip(rows, fps, label)), key=repr)


def test_every_pair_within_the_radius_shares_a_table():
    rng = random.Random(0)
    masks = [m & (2**64 - 1) for m in simhash.covering_masks()]
    assert len(masks) == 15
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(d & m == 0 for m in masks)


@pytest.mark.parametrize("bucket", [512, 4])
def test_links_connect_exactly_the_parts(spark, bucket):
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(0, 64, 5), 2)}  # a crowded bucket
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r["node"] & (2**64 - 1): r["label"] for r in simhash.connected(simhash.links(df, bucket=bucket)).collect()}
    want = parts(fps)
    for i, j in itertools.combinations(range(len(fps)), 2):
        same = fps[i] in got and fps[j] in got and got[fps[i]] == got[fps[j]]
        assert same == (want[i] == want[j])


def test_equals_brute_force(docs):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, None), (7, None), (8, ""), (9, "one"), (10, "one two"), (11, "One  TWO"), (12, "É é")]
    for i in range(25):
        t = rng.choices(words, k=rng.randint(5, 400))
        rows.append((100 + i, " ".join(t)))
        for k in range(rng.randint(0, 3)):
            t = list(t)
            t[rng.randrange(len(t))] = "edit"
            rows.append((1000 - 10 * i - k, " ".join(t)))
    rows += rows[-3:]
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs(rows)).collect()), key=repr) == brute(rows)


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in simhash.op5_simhash(spark, small).collect()), key=repr) == brute(rows)


def test_odd_rows(odd, docs):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=repr) == brute(rows)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_long_chains_are_one_part(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r["label"] for r in simhash.connected(edges).collect()} == {0}
    assert np.unique(simhash.components(np.arange(n), np.arange(1, n + 1), n + 1)).tolist() == [0]
