import math
import re
from collections import Counter

from pyspark.sql import functions as F

from docgrain.llm import tput
from tests.oracle import same

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items, k):
    own = [(d, Counter(cut(t))) for d, t in docs]
    n = [sum(c.values()) for _, c in own]
    big_n, big_l = sum(x > 0 for x in n), sum(n)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        scored = []
        for (d, c), length in zip(own, n, strict=True):
            if not length:
                continue
            m = 25 + 75 * length * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in cut(text) if w in c)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sql(spark, small):
    same(spark, small, tput.op11_tput, tput.OP11_SQL)


def test_terms_are_cut_by_code_point():
    import pyarrow as pa

    texts = ["Ab-cÉ 中文!x\x00y", None, "", "É1_2~Z"]
    count, flat, words = tput.terms(pa.array([t and t.encode() for t in texts], pa.binary())[0:4])
    assert [words[i].as_py() for i in flat.tolist()] == sum(map(cut, texts), []) and count.tolist() == [5, 0, 0, 3]


def test_odd(spark, odd):
    items = spark.createDataFrame([(1, "hello text is"), (1, "hello text is"), (2, None), (3, "?? nothing here zzz"), (None, "中文字 another word word no"), (4, "")], "item_id long, text string").withColumn("row", F.lit("x"))
    want = slow([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()], 3)
    assert rows(tput.rank_documents(odd, items, 3)) == want and want
    assert tput.rank_documents(odd.limit(0), items).count() == 0
    assert tput.rank_documents(odd, items.limit(0)).count() == 0


def test_hot_terms_ties_and_long_lists(spark):
    docs = [(i, f"common line of words {i % 7} w{i % 50} w{i % 3} " + "common " * (i % 5)) for i in range(3000)]
    items = [(j, f"common w{j} w{j % 3} w{j % 3} line {j % 7}") for j in range(40)]
    made = {}
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(tput.rank_documents(d, q, 10, made)) == slow(docs, items, 10)
    assert made["seen"] < made["held"]


def test_lists_of_low_gain_are_not_read(spark):
    """Most documents have the common terms; rare ones decide."""
    docs = [(i, "alpha beta gamma " * (i % 5 > 0) + (f"rare{i % 40} rare{i % 41} " * 3 if i < 2000 else "") + "filler " * (i % 9)) for i in range(6000)]
    items = [(j, f"alpha rare{j} rare{j % 41} beta gamma") for j in range(20)]
    made = {}
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(tput.rank_documents(d, q, 3, made)) == slow(docs, items, 3)
    assert made["fetched"] < made["held"] / 20 and made["looked up"] < made["fetched"]


def test_every_term_has_a_list_without_items(spark, odd):
    held = tput.TermLists(odd).lists.groupBy("term").count().collect()
    assert {r.term: r["count"] for r in held} == Counter(w for r in odd.collect() for w in set(cut(r.text)))
