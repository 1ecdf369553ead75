import json

import pytest
from pyspark.sql import functions as F

from docgrain.operators.chunking import chunk_documents
from docgrain.sources import files, semi, sinks
from docgrain.streaming import jobs


def test_json_leaves_depth_first(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": [1, {"b": None}], "c": True})), (2, "not json"), (3, None)], "id long, json string")
    rows = [(r["path"], r["value"]) for r in semi.json_leaves(df).orderBy("id", "pos").collect()]
    assert rows == [("root.a.[0]", "1"), ("root.a.[1].b", "None"), ("root.c", "True")]


def test_read_blocks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nbody\n## S\nmore\n")
    (tmp_path / "b.json").write_text('{"k": ["v"]}')
    (tmp_path / "c.exe").write_bytes(b"\x00")
    (tmp_path / "d.json").write_text("{broken")
    blocks, rejected = files.read_blocks(spark, str(tmp_path))
    got = {(r["path"].rsplit("/", 1)[1], r["text"], tuple(r["section_path"])) for r in blocks.collect()}
    assert ("a.md", "more", ("T", "S")) in got and ("b.json", "**root.k.[0]**: v", ("root.k.[0]",)) in got
    assert {r["path"].rsplit("/", 1)[1] for r in rejected.collect()} == {"c.exe", "d.json"}


def test_read_corpus(spark, tmp_path):
    qa = lambda i, a: {"id": f"q{i}", "question": "what?", "answers": a}
    data = {"data": [{"title": "T", "paragraphs": [{"context": "ctx text", "qas": [qa(1, [{"text": "ctx", "answer_start": 0}]), qa(2, [])]}]}]}
    (tmp_path / "c.json").write_text(json.dumps(data))
    contracts, queries = files.read_corpus(spark, str(tmp_path / "c.json"))
    assert contracts.first()["char_length"] == 8
    assert [(r["query_id"], r["is_unanswerable"], r["gold_evidence"]) for r in queries.orderBy("query_id").collect()] == [("q1", False, "ctx"), ("q2", True, None)]


def test_upsert_and_versions(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, sinks.upserted(old, new, "id").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(ValueError, match="repeated"):
        sinks.upserted(old, new.union(new), "id")
    t = old.withColumnRenamed("v", "x")
    sinks.write_version(t, str(tmp_path / "t"), 1)
    sinks.write_version(t.limit(1), str(tmp_path / "t"), 2)
    assert sinks.latest(spark, str(tmp_path / "t")).count() == 1


def test_chunk_documents(spark):
    text = "\n".join(f"Line {i} starts. It goes on; And ends here." for i in range(30))
    docs = spark.createDataFrame([(1, text, "s"), (2, "One line.", None)], "doc_id int, text string, section string")
    parents, children = chunk_documents(docs, child=20, overlap=5, parent=60)
    kids = children.collect()
    assert parents.count() > 2 and len(kids) > parents.count()
    assert {k["parent_id"] for k in kids} == {p["parent_id"] for p in parents.collect()}
    assert all(k["refs"] for k in kids)


def test_stream_rates_equal_batch(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{small}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    events = lambda df: df.select(F.col("ts").cast("timestamp").alias("ts"))
    stream = events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = jobs.run_once(jobs.stream_rates(stream, limit=2), "rates", str(tmp_path / "cp"))
    q.awaitTermination()
    batch = jobs.rate_windows(events(spark.read.parquet(f"{small}/events.parquet")), limit=2)
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, batch.collect()))


def test_ingest_stream_is_repeatable(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "land"))
    run = lambda: jobs.ingest_stream(spark, str(tmp_path / "land"), "id long", str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b.withColumn("x", F.col("id") * 2)).awaitTermination()
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_cached_answers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("a", 50), ("b", 10), ("a", 200)], "key string, s int").select("key", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    jobs.run_once(jobs.cached_answers(stream, 100), "answers", str(tmp_path / "cp"), "append").awaitTermination()
    got = sorted((r["key"], r["hit"]) for r in spark.table("answers").collect())
    assert got == [("a", False), ("a", False), ("a", True), ("b", False)]


def test_failure_streaks(spark):
    calls = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, True, False, True, True, True])], "k int, t int, failed boolean")
    assert [tuple(r) for r in jobs.failure_streaks(calls, "k", ["t"], 3).collect()] == [(1, 4, 3)]
