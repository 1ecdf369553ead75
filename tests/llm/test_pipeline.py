import ast
import hashlib
import re
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import test_native
import test_near
import tiktoken

from docgrain.llm import bpe, langid, registry

ROOT = Path(__file__).resolve().parents[2]


def test_stages_hand_on_documents(spark, small):
    source = spark.read.parquet(f"{small}/documents.parquet")
    docs, counts = source, [source.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, small), name)
        assert docs.columns == source.columns and docs.dtypes == source.dtypes
        counts.append(docs.count())
    assert counts[2] < counts[1] <= counts[0] and counts[4] > counts[3] // 2
    assert corpus_pipeline.run(spark, small).count() == counts[4]


def test_run_equals_a_slow_twin(spark, small):
    """Every stage by loops over the rows that the one before kept; only the network's verdicts come from the module."""
    source = spark.read.parquet(f"{small}/documents.parquet")
    rows = [r.asDict() for r in source.collect()]
    model = langid.fit(source)
    verdicts = langid.classify(model, [(r["text"] or "").encode() for r in rows])
    rows = [r for r, (lang, score) in zip(rows, verdicts) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE]
    first = set(test_near.brute([(r["doc_id"], r["text"]) for r in rows]))
    rows = [r for r in rows if r["doc_id"] in first]
    raws = [(r["text"] or "").encode() for r in rows]
    starts = Counter(raw[i : i + 200] for raw in raws for i in range(len(raw) - 199))
    for r, raw in zip(rows, raws):
        cover = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - 199):
            if starts[raw[i : i + 200]] > 1:
                cover[i] += 1
                cover[i + 200] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        at, kept = 0, []
        for c in r["text"] or "":  # a character goes if all of its bytes do
            n = len(c.encode())
            if not gone[at : at + n].all():
                kept.append(c)
            at += n
        r["text"] = "".join(kept)
    word = re.compile("[^\x20\x09-\x0d]+")
    sizes = {}
    for r in rows:
        r["size"] = len(word.findall(r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    targets = test_native.level(sizes)
    out = []
    for source, size in sizes.items():
        left = round(targets[source])
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (int(hashlib.md5(f"{r['doc_id']}|{r['size']}".encode()).hexdigest()[:8], 16), r["doc_id"], r["size"]))
        taken = Counter()
        for _ in range(2):
            for r in own:
                part = min(r["size"], left)
                taken[r["doc_id"]] += part
                left -= part
        for r in own:
            times = int(taken[r["doc_id"]] / r["size"] + 0.5) if r["size"] else 0
            out += [(r["doc_id"], r["text"])] * times
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())) for d, t in out for ids in [encode.encode(t, disallowed_special=())])
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, small).collect())
    assert got == want


def test_stages_take_odd_rows_and_nothing(spark, odd, docs, small):
    for make in (odd, docs([])):
        df = make
        for name, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.saved(stage(spark, df, small), name)
        assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_every_operator_has_one_query():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "docgrain").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                assert "llm" not in " ".join([getattr(node, "module", "") or "", *(a.name for a in node.names)]), path
