import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from docgrain.llm import bpe, token_file

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


TEXTS = [
    "", " ", "  a", "a  b", "a\n b \n  c", "\x1c x \x85 y", "x' s's  'll 12 34  z ", "\t\tq\n\n", " lead", "trail ", "é ü 　 中文 字", "🙂🙂 x🙂", "aaaaaaaaaaaa bbbb",
    "don't we'll THEY'RE", "line\r\nend\r\n", "a" * 3000, "ab " * 2000, "\x00 \x01", "½ ² x² ١٢٣ x", "<|endoftext|> is text",
]


def test_replay_equals_the_library(library):
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice(" \n\t'abcdeéß19.,!  ") for _ in range(rng.randint(0, 120))) for _ in range(400)]
    codec = bpe.BpeCodec(RANKS)
    for text, packed in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert codec.decode(packed) == text.encode()


def test_lower_rank_made_by_a_merge_comes_first_in_its_word():
    rng = random.Random(1)
    for trial in range(200):
        tokens = [bytes([b]) for b in range(256)]
        extra = {bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 5))) for _ in range(10)}
        extra = rng.sample(sorted(extra), len(extra))
        ranks = {t: i for i, t in enumerate(tokens + extra)}
        replay = bpe.MergeReplay(ranks)
        words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(20)]

        def slow(word):
            if word in ranks:
                return [ranks[word]]
            parts = [bytes([b]) for b in word]
            while True:
                best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
                if best is None:
                    return [ranks[p] for p in parts]
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]

        assert replay.encode_words(words) == [slow(w) for w in words], trial


def test_small_caches_change_nothing(library):
    codec = bpe.BpeCodec(RANKS)
    codec.units.cache_units = 3
    for text in TEXTS * 2:
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_query_equals_the_library(spark, small, library):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {r["doc_id"]: np.array(library.encode_ordinary(r["text"]), "<u4") for r in rows}
    want = sorted((r["doc_id"], len(ids[r["doc_id"]]), sha(ids[r["doc_id"]].tobytes()), sha(r["text"].encode())) for r in rows)
    assert sorted(map(tuple, bpe.op9_bpe_replay(spark, small).collect())) == want


def test_odd_rows_encode_and_decode(odd, docs, library):
    rows = bpe.encode(odd).collect()
    want = sorted((str(r["doc_id"]), (r["text"] or "").encode()) for r in odd.collect())
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in rows) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    assert bpe.encode(docs([])).count() == 0


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 9], [0, 10**12], list(range(3000)), sorted(random.Random(2).choices(range(10**7), k=5000))])
def test_elias_fano_round_trip(values):
    ef = token_file.EliasFano.build(np.array(values))
    assert ef.select(np.arange(len(values))).tolist() == values
    if len(values) > 1000:
        assert 8 * (len(ef.low) + len(ef.high) + 4 * len(ef.directory)) < len(values) * (3.5 + max(0, np.log2(values[-1] / len(values))))


def expected(rows):
    tokenizer = Tokenizer.from_file(JSON)
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_query_equals_the_library(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, token_file.op8_token_file(spark, small).collect())) == sorted(expected(rows))


def test_odd_rows_and_small_shards(spark, odd, docs, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    manifest = token_file.write_tokens(odd, f"file://{tmp_path}/t", shard_ids=10)
    assert len(manifest) > 3 and [m["start"] for m in manifest] == sorted(m["start"] for m in manifest)
    got = sorted((tuple(r) for r in token_file.read_tokens(spark, manifest).collect()), key=lambda r: r[1])
    # null and empty texts of one id tie; both are the end alone
    assert got == expected(rows)
    shard = token_file.Shard(manifest[-1]["shard"])
    assert shard.tokens(shard.n_docs - 1)[-1] == 2
    assert token_file.read_tokens(spark, token_file.write_tokens(docs([]), f"file://{tmp_path}/e")).count() == 0


def test_broken_shard_is_refused(odd, tmp_path):
    manifest = token_file.write_tokens(odd, str(tmp_path / "t"))
    path = manifest[0]["shard"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[3] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="not a whole token shard"):
        token_file.Shard(path)


def test_other_tokenizers_encode_whole_texts(docs, tmp_path):
    """A tokenizer that lower-cases first, or splits by white space, isn't cut into units."""
    from tokenizers import Tokenizer as T
    from tokenizers import models, normalizers, pre_tokenizers

    texts = ["Hello  World, hello world", "A b  C", ""]
    for normal, before in ((normalizers.Lowercase(), pre_tokenizers.ByteLevel(add_prefix_space=False)), (None, pre_tokenizers.Whitespace()), (None, pre_tokenizers.ByteLevel(add_prefix_space=True))):
        own = T(models.BPE({c: i for i, c in enumerate(sorted({*pre_tokenizers.ByteLevel.alphabet(), "he", "wo"}))}, [("h", "e"), ("w", "o")]))
        if normal:
            own.normalizer = normal
        own.pre_tokenizer = before
        path = str(tmp_path / f"{type(normal).__name__}{type(before).__name__}{before is None}{len(list(tmp_path.iterdir()))}.json")
        own.save(path)
        width = 2
        want = [np.array(own.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
        assert token_file.encoder(path, width).encode(texts) == want


def test_rows_of_one_id_are_dealt_to_many_tasks(spark, docs, tmp_path):
    rows = [(None if i % 2 else 5, f"text {i * 7919 % 200:03d}") for i in range(200)]
    manifest = token_file.write_tokens(docs(rows), f"file://{tmp_path}/t")
    assert len(manifest) > 2
    got = sorted((tuple(r) for r in token_file.read_tokens(spark, manifest).collect()), key=lambda r: r[1])
    assert got == expected(rows)
