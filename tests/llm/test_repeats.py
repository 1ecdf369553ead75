import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docgrain.llm import repeats
from docgrain.llm.anchors import GRAM, anchors


def brute(rows, length=200):
    seen = Counter()
    raws = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raws:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in raws:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(b)) if mark[i] and (not i or not mark[i - 1]))
        out.append((d, len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    rand = lambda n, a="abcdé \n": "".join(rng.choice(a) for _ in range(n))
    passages = [rand(n) for n in (199, 200, 201, 260, 400, 900)]
    rows = [(0, None), (1, ""), (2, "x" * 150), (3, "y" * 700), (4, "ab" * 300), (None, rand(500)), (None, None)]
    for i in range(50):
        t = rand(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            t += p[rng.randint(0, len(p) // 3) :] + rand(rng.randint(0, 150))
        rows.append((10 + i, t))
    return [*rows, (200, rows[20][1]), (201, rows[20][1]), (20, rows[20][1][:-3]), rows[30], rows[30], (300, (rand(50, "ab") + "\n") * 30)]


@pytest.mark.parametrize("hot", [1024, 6])
def test_equals_brute_force(spark, docs, hot):
    rows = corpus()
    got = sorted((tuple(r) for r in repeats.digests(docs(rows), hot=hot).collect()), key=repr)
    assert got == brute(rows)


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in repeats.op2_repeats(spark, small).collect()), key=repr) == brute(rows)


def test_odd_rows_and_other_columns_stay(odd):
    got = repeats.remove_repeats(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert len(rows) == odd.count()
    by = {(r["doc_id"], r["source"]): r["text"] for r in rows}
    assert by[1, "a"] is None and by[6, "d"] == "" and all(r["h"] == "h" for r in rows)


def test_empty_table(docs):
    assert repeats.digests(docs([])).count() == 0


def test_pipeline_form_keeps_whole_characters(docs):
    # the passages differ up to the second byte of a character of two bytes
    rows = [(1, "a" + "é" * 120), (2, "b" + "é" * 120)]
    assert [r["text"] for r in repeats.remove_repeats(docs(rows)).orderBy("doc_id").collect()] == ["a", "b"]
    assert repeats.whole_characters("xéy".encode(), [(2, 4)]) == [(3, 4)]


def test_long_texts_are_cut_into_pieces_alike(monkeypatch):
    import docgrain.llm.anchors as module

    rng = random.Random(1)
    text = bytes(rng.choice(b"abc") for _ in range(5000))
    whole = anchors([text, text[:100]], 200)
    monkeypatch.setattr(module, "SLAB", 700)
    parts = anchors([text, text[:100]], 200)
    # pieces may name more anchors, never fewer, and each window still has its own
    assert set(whole[1].tolist()) <= set(parts[1].tolist())
    assert all(((a := whole[1]) >= i).any() and (a[(a >= i)][0] <= i + 200 - GRAM) for i in range(0, 4800, 37))


def test_run_index_equals_pairs():
    rng = random.Random(2)
    for _ in range(20):
        wide, length, n = rng.randint(1, 12), rng.randint(2, 6), rng.randint(2, 12)
        skip = np.array([rng.choice([0, 0, 2]) for _ in range(n)])
        bodies = [bytes(rng.choice(b"ab") for _ in range(max(0, wide - 1 + length - s - rng.choice([0, 0, 1])))) for s in skip.tolist()]
        group = np.sort(np.array([rng.randint(0, 2) for _ in range(n)]))
        got = repeats.RunIndex(group, skip, bodies, wide, length).repeats()
        window = lambda i, r: bodies[i][r - skip[i] : r - skip[i] + length] if r >= skip[i] and r - skip[i] + length <= len(bodies[i]) else None
        for i in range(n):
            for r in range(wide):
                w = window(i, r)
                assert got[i, r] == (w is not None and any(j != i and group[j] == group[i] and window(j, r) == w for j in range(n)))


def test_rows_of_one_id_and_text_give_each_span_once(spark, docs):
    rng = random.Random(9)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.random()) for _ in range(400))
    other = text[: len(text) // 2] + " ".join(str(rng.random()) for _ in range(200))
    rows = [(1, text)] * 1000 + [(2, other)]
    df = docs(rows).repartition(8)
    keyed = repeats._keyed(df, repeats.clashes(df)).drop("row")
    held = {r.k: len(r.spans) for r in repeats.spans(keyed).collect()}
    assert len(held) == 2 and max(held.values()) < len(text) / 20
    got = sorted(tuple(r) for r in repeats.digests(df).distinct().collect())
    assert got == brute([(1, text), (1, text), (2, other)])[1:]


def test_clashing_hashes_are_told_apart(monkeypatch, docs):
    from pyspark.sql import functions as F

    real = repeats._hash
    monkeypatch.setattr(repeats, "_hash", lambda *salt: F.pmod(real(*salt), F.lit(2)) if not salt else real(*salt))
    rng = random.Random(3)
    texts = [" ".join(str(rng.random()) for _ in range(60)) for _ in range(5)]
    rows = [(i, t + t[:300] * (i % 2)) for i, t in enumerate(texts)]
    assert sorted(tuple(r) for r in repeats.digests(docs(rows)).collect()) == sorted(brute(rows))
