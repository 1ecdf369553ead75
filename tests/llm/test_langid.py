import zlib

import numpy as np
import pytest

from docgrain.llm import langid


def test_gradients_equal_differences():
    model = langid.BiGru(["a", "b", "c"])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 257, (7, 5)), rng.integers(0, 3, 5)
    _, g = model.gradients(x, y)
    for name, w in model.p.items():
        at = (1, int(x[3, 2]), 4) if name == "e" else tuple(rng.integers(0, s) for s in w.shape)
        old = w[at]
        w[at] = old + 1e-3
        up, _ = model.gradients(x, y)
        w[at] = old - 1e-3
        down, _ = model.gradients(x, y)
        w[at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-5)


def test_held_out_accuracy(spark, small):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = langid.op3_language(spark, small).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(odd):
    model = langid.fit(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {1, 2, 3} <= und and 4 not in und
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in rows)
    kept = langid.keep_known(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == sum(r["lang_pred"] != "und" for r in rows)


def test_without_labels_or_rows(docs):
    df = docs([(1, "text", None), (2, "other", None)])
    assert langid.fit(df) is None
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(docs([]), langid.fit(docs([]))).count() == 0


def test_both_passes_agree():
    model = langid.BiGru(["a", "b"])
    x = np.random.default_rng(1).integers(0, 257, (20, 9))
    for d in (0, 1):
        assert np.allclose(model._states(x, d).transpose(0, 2, 1), model._pass(x, d)[0], atol=1e-6)


def test_every_byte_of_a_text_counts():
    model = langid.BiGru(["a", "b"])
    raw = bytes(range(32, 127)) * 5
    p = langid.label_texts(model, [raw])[0]
    parts = np.concatenate([model.forward(np.ascontiguousarray(w[None].T))[: min(langid.WINDOW, len(raw) - langid.WINDOW * i), 0, 0] for i, w in enumerate(langid.windows(raw))])
    assert len(parts) == len(raw) and abs(p[0] - parts.mean()) < 1e-5 and abs(p.sum() - 1) < 1e-5


def slow_label(model, raw):
    """Mean probabilities over a text by loops over windows, directions, bytes and gates."""
    k, total = langid.HIDDEN, np.zeros(len(model.langs))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for window in langid.windows(raw):
        states = np.zeros((2, len(window), k))
        for d in (0, 1):
            e, u, c = (model.p[n][d].astype(float) for n in "euc")
            h = np.zeros(k)
            for t in range(len(window)) if d == 0 else reversed(range(len(window))):
                z = sigmoid(e[window[t]][:k] + h @ u[:, :k])
                r = sigmoid(e[window[t]][k : 2 * k] + h @ u[:, k : 2 * k])
                s = np.tanh(e[window[t]][2 * k :] + r * (h @ u[:, 2 * k :] + c))
                h = z * h + (1 - z) * s
                states[d, t] = h
        for t in np.flatnonzero(window != langid.PAD):
            a = np.concatenate(states[:, t]) @ model.p["w"] + model.p["b"]
            total += np.exp(a) / np.exp(a).sum()
    return total / len(raw)


def test_labels_equal_a_slow_pass():
    model = langid.BiGru(["a", "b", "c"])
    for raw in (b"x", "Grüße, Köln — 中文".encode() * 9, bytes(range(1, 128)) * 2):
        assert np.allclose(langid.label_texts(model, [b"other", raw])[1], slow_label(model, raw), atol=1e-5)


def test_only_letters_have_a_language():
    model = langid.BiGru(["a", "b"])
    got = langid.classify(model, [t.encode() for t in ("½ ²", "① ② Ⅷ", "123 _ !", "", "ª", "x", "中", "ё½")])
    assert [lang == "und" for lang, _ in got] == [True, True, True, True, False, False, False, False]


def test_ties_go_to_the_first_language():
    model = langid.BiGru(["a", "b", "c"])
    model.p["w"][:], model.p["b"][:] = 0, 0
    assert langid.classify(model, [b"text"])[0][0] == "a"


def test_labels_of_any_string_and_rows_that_share_an_id(docs):
    """An empty label is a label; thousands of rows under one id, copies among them, give a bounded sample of whole texts."""
    rows = [(7, f"alpha beta gamma {i % 50} " * 40, "", "s") for i in range(600)] + [(7, "zzz yyy xxx " * 60, "x", "s")] * 900
    langs, x, y = langid.training_windows(docs(rows), per_lang=200, per_windows=100)
    assert langs == ["", "x"] and 20 <= (y == 0).sum() <= 200 and 1 <= (y == 1).sum() <= 200
    last = langid.windows(rows[0][1].encode())[-1]
    whole = langid.training_windows(docs(rows[:50]), per_lang=10**6, per_windows=10**6)[1]
    assert len(whole) == sum(len(langid.windows(t.encode())) for _, t, _, _ in rows[:50]) and (whole == last).all(1).any()
