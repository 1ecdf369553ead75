"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text is cut into windows of WINDOW bytes, all of them, to the end. One recurrent layer reads each window forwards and
another backwards; at every byte a softmax over both states gives probabilities of the languages. A document's
probabilities are the mean over all its bytes. Training is backpropagation through time with Adam on a bounded,
hash-chosen sample of the labelled rows, PER_LANG of each language, and of the windows of their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, saved, small_batches, tidy

WINDOW, HIDDEN, PAD = 96, 8, 256
#: Labelled rows of each language that training reads about, and windows of these rows' whole texts that it draws for each
#: language: both bound the sample that the classifier is fitted on, by hashes, wherever in a text a window lies.
PER_LANG, PER_WINDOWS = 512, 2048
STEPS, BATCH, RATE = 260, 128, 0.02
#: Windows that are labelled at once.
LANES = 2048
#: Unicode category L.
LETTER = regex.compile(r"\p{L}")


class BiGru:
    """Parameters e (inputs to gates by byte), u (state to gates), c (bias inside the reset gate's product), each for two directions, w and b (output)."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        h, self.langs = HIDDEN, langs
        self.p = {
            "e": rng.normal(0, 0.5, (2, PAD + 1, 3 * h)),
            "u": rng.normal(0, h**-0.5, (2, h, 3 * h)),
            "c": np.zeros((2, h)),
            "w": rng.normal(0, 0.3, (2 * h, len(langs))),
            "b": np.zeros(len(langs)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pass(self, x: np.ndarray, d: int) -> tuple[np.ndarray, list]:
        """States of direction d after each byte of windows x (time first), and what the way back needs."""
        e, u, c = self.p["e"][d], self.p["u"][d], self.p["c"][d]
        steps, n = x.shape
        k = HIDDEN
        h = np.zeros((n, k), np.float32)
        out, tape = np.empty((steps, n, k), np.float32), []
        # sigmoid(a) = (1 + tanh(a / 2)) / 2, so a halved input lets one tanh serve both gates
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = e[x[t]]
            m = h @ u
            g = a[:, : 2 * k]
            g += m[:, : 2 * k]
            g *= 0.5
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            z, r = g[:, :k], g[:, k:]
            q = m[:, 2 * k :]
            q += c
            s = a[:, 2 * k :]
            s += r * q
            np.tanh(s, out=s)
            tape.append((t, h, z, r, q, s))
            h = s + z * (h - s)
            out[t] = h
        return out, tape

    def _states(self, x: np.ndarray, d: int) -> np.ndarray:
        """As _pass, without a tape: (time, state, window). Gates lie in rows of all windows, so every step works on whole
        rows of memory; halving is put into the parameters."""
        k = HIDDEN
        half = np.repeat(np.array([0.5, 1.0], np.float32), [2 * k, k])
        e = np.ascontiguousarray((self.p["e"][d] * half).T)
        u = np.ascontiguousarray((self.p["u"][d] * half).T)
        c = self.p["c"][d][:, None]
        steps, n = x.shape
        h = np.zeros((k, n), np.float32)
        out = np.empty((steps, k, n), np.float32)
        a, m = np.empty((3 * k, n), np.float32), np.empty((3 * k, n), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            np.take(e, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=m)
            g, q, s = a[: 2 * k], m[2 * k :], a[2 * k :]
            g += m[: 2 * k]
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            q += c
            q *= g[k:]
            s += q
            np.tanh(s, out=s)
            h = h - s
            h *= g[:k]
            h += s
            out[t] = h
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every byte of windows x (time first): (time, language, window)."""
        x = x.astype(np.intp)
        w = np.ascontiguousarray(self.p["w"].T)
        a = np.matmul(w[:, :HIDDEN], self._states(x, 0))
        a += np.matmul(w[:, HIDDEN:], self._states(x, 1))
        a += self.p["b"][:, None]
        np.exp(a, out=a)
        a /= a.sum(1, keepdims=True)
        return a

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the bytes of windows x with languages y, and its gradients."""
        k, p = HIDDEN, self.p
        (hf, tf), (hb, tb) = self._pass(x, 0), self._pass(x, 1)
        both = np.concatenate([hf, hb], -1)
        a = both @ p["w"] + p["b"]
        a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(-1, keepdims=True)
        there = (x != PAD).astype(np.float32)
        total = max(there.sum(), 1)
        lanes = np.arange(x.shape[1])
        loss = float(-(np.log(a[:, lanes, y] + 1e-9) * there).sum() / total)
        a[:, lanes, y] -= 1
        a *= (there / total)[..., None]
        g = {n: np.zeros_like(v) for n, v in p.items()}
        g["w"] = np.einsum("tnh,tnk->hk", both, a, optimize=True)
        g["b"] = a.sum((0, 1))
        back = a @ p["w"].T
        for d, tape in ((0, tf), (1, tb)):
            e, u, into = g["e"][d], g["u"][d], back[..., d * k : (d + 1) * k]
            dh = np.zeros((x.shape[1], k), np.float32)
            for t, h, z, r, q, s in reversed(tape):
                dh = dh + into[t]
                ds = dh * (1 - z) * (1 - s * s)
                dz = dh * (h - s) * z * (1 - z)
                dq = ds * r
                dr = ds * q * r * (1 - r)
                gate = np.concatenate([dz, dr, dq], 1)
                np.add.at(e, x[t], np.concatenate([dz, dr, ds], 1))
                u += h.T @ gate
                g["c"][d] += dq.sum(0)
                dh = dh * z + gate @ p["u"][d].T
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> float:
        """Adam over shuffled windows x (window, byte), the rate falling to zero; the mean loss of the last tenth."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        order, losses = np.zeros(0, np.int64), []
        for step in range(steps):
            while len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(x))])
            part, order = order[:batch], order[batch:]
            loss, g = self.gradients(np.ascontiguousarray(x[part].T), y[part])
            losses.append(loss)
            norm = float(np.sqrt(sum((w * w).sum() for w in g.values())))
            for k, w in self.p.items():
                d = g[k] * min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                w -= rate * (1 - step / steps) * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (step + 1))) + 1e-7)
        return float(np.mean(losses[-max(1, steps // 10) :]))


def windows(raw: bytes) -> np.ndarray:
    """All bytes of a text in rows of WINDOW, the last one padded."""
    n = -(-len(raw) // WINDOW)
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def training_windows(docs: DataFrame, per_lang: int = PER_LANG, per_windows: int = PER_WINDOWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and their labels from labelled rows whose crc32(doc_id) mod 3 is not 1.

    Rows are drawn by a hash of the text with a chance that leaves about per_lang of each language, copies of a text once; of
    the windows of their whole texts, a further hash of the window and its place draws about per_windows of each language, so
    however many rows share an id or a text, what reaches the driver is bounded. A label may be any string, an empty one too.
    Texts without a byte teach nothing.
    """
    label, text = F.col("lang").cast("string"), F.col("text").cast("string")
    rows = docs.filter(F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 != 1).select(label.alias("lang"), text.cast("binary").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.greatest(F.approx_count_distinct(F.xxhash64("text")), F.lit(1)).alias("n")).collect()}  # distinct texts of each language
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, WINDOW), np.int16), np.zeros(0, np.int64)
    share = lambda n, of: F.create_map(*[F.lit(x) for k in sorted(of) for x in (k, min(1.0, n / of[k]))])
    below = lambda h, chance: F.pmod(h, F.lit(1 << 30)) < chance[F.col("lang")] * (1 << 30)
    some = saved(rows.filter(F.length("text") > 0).filter(below(F.xxhash64(F.lit("langid"), "text"), share(per_lang, counts))).dropDuplicates(["lang", "text"]), "langid-rows")
    cut = saved(some.mapInArrow(tidy(_cut), "lang string, x binary, h long").dropDuplicates(["lang", "h", "x"]), "langid-windows")
    found = {r["lang"]: r["n"] for r in cut.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not found:
        return langs, np.zeros((0, WINDOW), np.int16), np.zeros(0, np.int64)
    got = cut.filter(below(F.col("h"), share(per_windows, found))).toArrow()
    got = got.sort_by([("h", "ascending"), ("x", "ascending"), ("lang", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), "<i2").reshape(-1, WINDOW)
    return langs, x, np.array([langs.index(k) for k in got["lang"].to_pylist()], np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, x, h: all windows of texts, with a hash of each and its place."""
    for whole in batches:
        for batch in chunks(whole):
            langs, out, hashes = [], [], []
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for k, own in enumerate(windows(raw).astype("<i2")):
                    langs.append(lang)
                    out.append(own.tobytes())
                    hashes.append(xxhash.xxh3_64_intdigest(out[-1], k) >> 1)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "x": pa.array(out, pa.binary()), "h": pa.array(hashes, pa.int64())})


def fit(docs: DataFrame, per_lang: int = PER_LANG, per_windows: int = PER_WINDOWS) -> BiGru | None:
    """A network trained on docs; None if no row is labelled. If no labelled row has a text, all languages are alike to it."""
    langs, x, y = training_windows(docs, per_lang, per_windows)
    if not langs:
        return None
    model = BiGru(langs)
    if not len(x):
        model.p["w"][:] = 0
    elif len(langs) > 1:
        model.train(x, y)
    return model


def label_texts(model: BiGru, raws: list[bytes]) -> np.ndarray:
    """Mean probabilities of the languages over all bytes of each text; rows of zeros for empty texts."""
    parts = [windows(x) for x in raws]
    counts = [len(p) for p in parts]
    out = np.zeros((len(raws), len(model.langs)))
    if not sum(counts):
        return out
    x = np.concatenate(parts)
    pooled = np.empty((len(x), len(model.langs)))
    for a in range(0, len(x), LANES):
        t = np.ascontiguousarray(x[a : a + LANES].T)
        p = model.forward(t)
        if (t[-1] == PAD).any():
            p *= (t != PAD)[:, None]
        pooled[a : a + LANES] = p.sum(0).T
    np.add.at(out, np.repeat(np.arange(len(raws)), counts), pooled)
    return out / np.maximum([len(r) for r in raws], 1)[:, None]


def classify(model: BiGru | None, raws: list[bytes]) -> list[tuple[str, float]]:
    """Language and score of each text; `und` and 0 without a letter or a model. Of equal probabilities the first language in
    the order of code points counts."""
    lettered = [model is not None and LETTER.search(x.decode("utf-8", "replace")) is not None for x in raws]
    if not any(lettered):
        return [("und", 0.0)] * len(raws)
    p = label_texts(model, [x if ok else b"" for x, ok in zip(raws, lettered, strict=True)])
    best = p.argmax(1).tolist()
    return [(model.langs[i], min(1.0, float(p[k, i]))) if ok else ("und", 0.0) for k, (i, ok) in enumerate(zip(best, lettered, strict=True))]


def keep_known(docs: DataFrame, model: BiGru | None, least: float) -> DataFrame:
    """The rows of docs, all columns as they are, whose language the network tells with a score of `least` or more.

    Null texts, texts without a letter and, without a model, all rows go.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "raw"):
                found = classify(model, [x or b"" for x in batch.column("raw").to_pylist()])
                yield batch.select(["row"]).filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    kept = rows.mapInArrow(tidy(run), f"row {rows.schema['row'].dataType.simpleString()}")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def predict(docs: DataFrame, model: BiGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's mean probability) of every row.

    lang_pred is `und` with score 0 if the text is null or has no letter (Unicode category L), or if there is no model;
    ties go to the language that comes first by code point. A null doc_id is
    not held out. Repeated rows come out as often; extra columns are left out; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                found = classify(model, [x or b"" for x in batch.column("text").to_pylist()])
                langs, scores = [x[0] for x in found], [x[1] for x in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 1, F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs))
