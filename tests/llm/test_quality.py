import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrain.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_plain_counts_equal_loops():
    rng = np.random.default_rng(3)
    texts = ["", " \n ", "#$ x", "é🙂 \x0b中", "a b c d e f g h " * 5, "a " * 30, "one\none\n\n one\none", "x\x1cy z"]
    texts += ["".join(rng.choice(list("ab \n#"), 60)) for _ in range(50)] + [" ".join(rng.choice(list("abc"), 40)) for _ in range(50)]
    for t in texts:
        assert quality.plain_counts(t.encode()) == slow(t), repr(t)


def restored(raws):
    codes, n = np.unique(np.concatenate([quality.gram_codes(r) for r in raws]), return_counts=True)
    return quality.KneserNey.restored(quality.KneserNey(codes, n).arrays())


def test_model_is_a_distribution():
    model = restored([b"the cat sat on the mat and the dog sat on the log, " * 3])
    for history in (b"the ", b"cat ", b"zzzz", b"t qq"):
        code = int(quality.gram_codes(b" " + history)[-1]) % quality.CLASSES ** (quality.ORDER - 1) * quality.CLASSES
        assert np.isclose((2.0 ** -model.bits(code + np.arange(quality.CLASSES)).astype(float)).sum(), 1, atol=1e-3)
    assert model.bits(quality.gram_codes(b"the cat")).mean() < model.bits(quality.gram_codes(b"xq zvj k")).mean()


def test_other_scripts_are_told_apart():
    """Words of a script the model knows cost less than the same characters in any order."""
    text = "кошка сидела на коврике и собака сидела на бревне "
    model = restored([(text * 3).encode()])
    mixed = "".join(np.random.default_rng(0).permutation(list(text)))
    assert model.bits(quality.gram_codes(text.encode())).mean() < 0.5 * model.bits(quality.gram_codes(mixed.encode())).mean()


def brute_bits(texts):
    """Bits a byte by a plain recursion over dictionaries, of the texts of one language."""
    c = quality.CLASSES
    counts = [Counter() for _ in range(quality.ORDER)]
    for t in texts:
        if t:
            counts[-1].update(quality.gram_codes(t.encode()).tolist())
    for k in range(quality.ORDER - 2, -1, -1):
        counts[k].update(g % c ** (k + 1) for g in counts[k + 1])
    cut = [quality._discounts(np.array(list(x.values()))) for x in counts]
    follow = [{} for _ in counts]
    for k, x in enumerate(counts):
        for g, n in x.items():
            follow[k].setdefault(g // c, []).append(n)

    @lru_cache(None)
    def p(g, k):
        low = p(g % c**k, k - 1) if k else 1 / c
        own = follow[k].get(g // c)
        if own is None:
            return low
        d, n, total = cut[k], counts[k].get(g, 0), sum(own)
        weight = sum(d[min(x, 3)] for x in own) / total
        return (n - d[min(n, 3)] if n else 0) / total + weight * low

    return [None if not t else float(np.mean([-np.log2(p(g, quality.ORDER - 1)) for g in quality.gram_codes(t.encode()).tolist()])) for t in texts]


def test_query_equals_brute_force(spark, small):
    """All documents, and some junk in each language, each by its own language's model and band."""
    rng = np.random.default_rng(1)
    df = spark.read.parquet(f"{small}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 9 > 0, F.col("lang")))
    junk = [(10**6 + i, "".join(rng.choice(list("bcdfghjklmnpqrstvwxz0123456789@#    "), 900)), lang) for i, lang in enumerate(["en", "de", "fr", "es", None])]
    df = df.select("doc_id", "text", "lang").union(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
    rows = [tuple(r) for r in df.collect()]
    got = {r["doc_id"]: r for r in quality.judge(df.repartition(3)).collect()}
    langs = {lang for _, _, lang in rows}
    assert len(langs) > 3 and None in langs and len(got) == len(rows)
    outside = 0
    for lang in langs:
        own = [(d, t) for d, t, x in rows if x == lang]
        bits = brute_bits([t for _, t in own])
        low, high = np.percentile(np.round([x for x in bits if x is not None], 2), [25, 75])
        width = max(high - low, 0.02)
        low, high = low - 4 * width, high + 2 * width
        for (d, t), x in zip(own, bits):
            r = got[d]
            assert tuple(r[k] for k in quality.COLUMNS) == slow(t)
            assert r["bits"] == (x if x is None else pytest.approx(x, abs=1e-4))
            failed = slow(t)[0] < 20 or 100 * slow(t)[4] > 30 * slow(t)[0]
            assert r["base_failed"] == failed
            if x is not None and min(abs(x - low), abs(x - high)) > 0.02:
                assert r["kept"] == (not failed and low <= x <= high)
                outside += not failed and not low <= x <= high
    assert outside


def test_planted_junk_goes(docs):
    """Prose of two languages; in each, letters in any order and the other language's words under its name are rejected."""
    rng = np.random.default_rng(5)
    words = {"en": "the cat sat on a mat while dogs ran over hills and birds sang about rain with some wind near our old house".split(), "xx": "kokko tatti muumuu vievii laala nenno rurra sisis pappa dodda".split()}
    prose = lambda lang: " ".join(rng.choice(words[lang], 120))
    rows = [(i, prose(lang), lang, "s") for i, lang in enumerate(["en", "xx"] * 60)]
    junk = [(1000 + k, "".join(rng.choice(list("bcdfghjklmnpqrstvwxz   "), 600)), lang, "s") for k, lang in enumerate(["en", "xx"])]
    wrong = [(2000, prose("xx"), "en", "s"), (2001, prose("en"), "xx", "s")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs(rows + junk + wrong)).collect()}
    assert not any(got[d] for d in (1000, 1001, 2000, 2001))
    assert all(got[i] for i, *_ in rows)


def test_good_documents_stay(spark, small):
    good = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").filter("quality = 1").collect()}
    rows = [r for r in quality.op7_quality(spark, small).collect() if r["doc_id"] in good and not r["base_failed"]]
    assert np.mean([r["kept"] for r in rows]) > 0.97


def test_odd_rows(odd, docs):
    want = sorted((str(r["doc_id"]), *slow(r["text"])) for r in odd.collect())
    rows = quality.judge(odd).collect()
    assert sorted((str(r["doc_id"]), *(r[k] for k in quality.COLUMNS)) for r in rows) == want
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 20)
    assert quality.judge(docs([])).count() == 0
