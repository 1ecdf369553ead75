import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from docgrain.llm import jaccard as J
from docgrain.llm.common import documents, id_text
from tests.oracle import same


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    first, holders = {}, {}
    for i, s in enumerate(sets):
        if s:  # equal sets are linked at once; only the first of them is compared
            j = first.setdefault(frozenset(s), i)
            root[find(i)] = find(j)
            if i == j:
                for g in s:
                    holders.setdefault(g, []).append(i)
    for i in set(first.values()):
        shared = {}
        for g in sets[i]:
            for j in holders[g]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if j < i and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def got(df, **sizes):
    return sorted((tuple(r) for r in J.components(df, **sizes).collect()), key=repr)


def made(rng):
    """Chains of edits, pairs about the bound, a passage and a template that many share."""
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, ""), (2, None), (3, "one"), (4, "ONE "), (5, "one two three four"), (6, "one two three four five"), (7, "six")]
    for i in range(60):
        t = rng.choices(words, k=rng.choice([8, 20, 60, 120, 300, 1000]))
        rows.append((100 * i + 100, " ".join(t)))
        for k in range(4):
            t = list(t)
            for at in rng.sample(range(len(t)), max(1, len(t) // rng.choice([25, 40, 60]))):
                t[at] = f"edit{rng.random()}"
            rows.append((100 * i + 101 + k, " ".join(t)))
    passage, page = rng.choices(words, k=30), rng.choices(words, k=90)
    for i in range(120):
        rows.append((10_000 + i, " ".join(rng.choices(words, k=50) + passage)))
        own = rng.choice([4, 8, 12, 20, 30])
        rows.append((20_000 + i, " ".join(page + rng.choices(words, k=own))))
    return rows


def test_equals_brute_force(docs):
    rows = made(random.Random(1))
    want = slow(rows)
    assert len({r[2] for r in want}) < len(rows) - 100
    df = docs(rows).repartition(3)
    assert got(df) == want
    # blocks of a few members: large buckets are dealt out, keys of many parts come last
    assert got(df, tokens=1500, most=8, crowded=1) == want
    assert got(df, tokens=3000, most=16) == want


def test_equals_brute_force_on_the_table(spark, small):
    df = documents(spark, small)
    assert got(df) == slow([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_sql(spark, small):
    same(spark, small, J.op12_signature_trees, J.OP12_SQL)


def test_bound_is_met_exactly(docs):
    words = [f"w{i}" for i in range(200)]
    # 96 shingles; the second has 12 more: 96 / 120 with 24 more, 96 / 121 with 25
    rows = [(1, " ".join(words[:100])), (2, " ".join(words[:124])), (3, " ".join(words[:100] + ["x"] * 0)), (9, " ".join(words[:125] + [])), (11, "a b c d e f")]
    assert got(docs(rows)) == slow(rows)
    only = [rows[0], rows[3]]
    assert [r[2] for r in got(docs(only))] == [1, 9] and [r[2] for r in got(docs(rows[:2]))] == [1, 1]


def test_odd(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert got(odd) == slow(rows)
    assert J.components(odd.limit(0)).count() == 0


def test_trees_lose_no_pair_and_rule_out_most():
    rng = np.random.default_rng(5)
    sets, cell = [], []
    for c in range(6):
        base = rng.integers(0, 1 << 63, 300, np.uint64)
        for _ in range(40):
            keep = base[rng.random(300) < rng.choice([0.5, 0.88, 0.95, 0.99])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 40), np.uint64)])))
            cell.append(c)
    cell, comp, n = np.array(cell), np.arange(len(sets)), np.array(list(map(len, sets)))
    forest = J.Forest(cell, comp, n, list(map(J.bitmap, sets)))
    pairs = {tuple(sorted(p)) for x, y in forest.pairs() for p in zip(x.tolist(), y.tolist(), strict=True)}
    near = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if cell[i] == cell[j] and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert near and near <= pairs and len(pairs) < 6 * 40 * 39 / 2 * 0.8
    links = J.joined(forest, comp, sets, cell)
    assert set(map(tuple, map(sorted, links))) <= near
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert find(a) != find(b)
        root[find(a)] = find(b)
    assert all(find(i) == find(j) for i, j in near)


def test_template_pages_below_the_bound_make_no_large_bucket(spark):
    """Pages that share 3 of 4 shingles: once the template's keys come last, nothing is left to compare."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50_000)]
    page = rng.choices(words, k=150)
    rows = [(i, " ".join(page + rng.choices(words, k=54))) for i in range(2000)] + [(5000 + i, " ".join(page + ["same"] * i)) for i in range(5)]
    own = id_text(spark.createDataFrame(rows, "doc_id long, text string"))
    join = J.Join(own.withColumn("row", F.xxhash64("doc_id", "text")))
    none = spark.createDataFrame([], "c long, comp long")
    assert J.connected(join.rest(none, most=200, crowded=1)).count() == 5
    table, keyed = np.zeros(J.BITS >> 6, np.uint64), join.made.select(F.col("uid").alias("c"), "keys")
    members, buckets = join._buckets(keyed, none, J.TOKENS, 200)
    assert join._last(members, buckets, table, J.TOKENS, 200)
    _, buckets = join._buckets(join._moved(keyed, table), none, J.TOKENS, 200)
    assert buckets.agg(F.max("k")).first()[0] < 200


def test_connected_rows():
    x, y = np.array([5, 2, 7, 4]), np.array([2, 0, 6, 7])
    assert J.connected_rows(x, y, 9).tolist() == [0, 1, 0, 3, 4, 0, 4, 4, 8]
    assert J.connected_rows(x[:0], y[:0], 3).tolist() == [0, 1, 2]


def test_a_member_of_many_pairs_brings_its_set_once(spark):
    """Near-copies that meet in two buckets: a row a class is left, not one a pair."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 200, np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 63, 4, np.uint64)])) for _ in range(8)]
    rows = [(cell, -9, c, c, len(s), J.bitmap(s)) for cell in (1, 2) for c, s in enumerate(sets)]
    left = J._with_partner(spark.createDataFrame(rows, "cell long, size long, c long, comp long, n long, bits binary"))
    assert left.count() == 8 and left.select("c").distinct().count() == 8


def test_late_keys_make_no_bucket(spark):
    """Sets that share half of their shingles meet in the first ninth of these at most."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50_000)]
    page = rng.choices(words, k=400)
    own = id_text(spark.createDataFrame([(i, " ".join(page + rng.choices(words, k=250))) for i in range(20)], "doc_id long, text string"))
    join = J.Join(own.withColumn("row", F.xxhash64("doc_id", "text")))
    keyed = join.made.select(F.col("uid").alias("c"), "keys")
    members, _ = join._buckets(keyed, spark.createDataFrame([], "c long, comp long"), J.TOKENS, J.MEMBERS)
    keys = keyed.select(F.explode("keys").alias("key"), "c").groupBy("key").count().filter("count > 1").count()
    assert 0 < members.select("key").distinct().count() < 0.75 * keys


def test_sizes_of_other_parts():
    rng = np.random.default_rng(6)
    group, comp, n = np.sort(rng.integers(0, 30, 400)), rng.integers(0, 4, 400), rng.integers(1, 60, 400)
    up, down = J.near_sizes(group, comp, n)
    for i in range(400):
        other = n[(group == group[i]) & (comp != comp[i])]
        assert up[i] == any(n[i] <= x and 4 * x <= 5 * n[i] for x in other) and down[i] == any(x <= n[i] and 4 * n[i] <= 5 * x for x in other)


def test_a_passage_that_sets_share_makes_no_bucket(spark):
    """Sets that share a seventh of their shingles have fewer keys in common than a link has; near-copies among them still meet."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(50_000)]
    passage = rng.choices(words, k=150)
    rows = [(i, " ".join(rng.choices(words, k=900) + passage)) for i in range(40)]
    rows += [(100 + i, t.replace(t.split()[9], "edit")) for i, t in rows[:3]]
    own = id_text(spark.createDataFrame(rows, "doc_id long, text string"))
    join = J.Join(own.withColumn("row", F.xxhash64("doc_id", "text")))
    keyed = join.made.select(F.col("uid").alias("c"), "keys")
    members, _ = join._buckets(keyed, spark.createDataFrame([], "c long, comp long"), J.TOKENS, J.MEMBERS)
    wide = lambda df: df.groupBy("key").agg(F.countDistinct("c").alias("k")).filter("k > 6").count()
    # a partition's first and last key are taken whole; there are four
    assert wide(keyed.select(F.explode("keys").alias("key"), "c")) > 15 and wide(members) <= 4
    assert members.select("c").distinct().count() >= 6
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == slow(rows)


def test_all_sets_give_the_keys_below_the_cut():
    rng = np.random.default_rng(8)
    for n in (1, 4, 5, 9, 60, 400):
        grams = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        table = np.zeros(J.BITS >> 6, np.uint64)
        for x in (grams[: n // 3] & np.uint64(J.BITS - 1)).tolist():
            table[x >> 6] |= np.uint64(1 << (x & 63))
        for last in (None, table):
            keys = J.first_keys(grams, last)
            low = [x for x in grams.tolist() if x < J.CUT and (last is None or not J.in_table(np.array([x], np.uint64), last)[0])]
            assert set(low) <= set(keys.tolist()) and len(keys) >= n - -(-4 * n // 5) + 1
