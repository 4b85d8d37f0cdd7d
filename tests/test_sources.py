"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import search, tuning
from tessera.sources import readers, writers
from tessera.streaming import ingest


def test_text_sections(spark):
    df = spark.createDataFrame([("a.txt", "intro\n\n# First Head\n\nbody one\n\nbody two\n\nSECOND HEAD\n\nmore text here.")], "source_file string, text string")
    got = readers.text_sections(df).orderBy("section").collect()
    assert [(r["heading"], r["content"]) for r in got] == [(None, "intro"), ("First Head", "body one\n\nbody two"), ("SECOND HEAD", "more text here.")]


def test_marked_sections(spark):
    text = ["=== LEVEL1: One ===", "aa", "=== LEVEL2: Two ===", "bb", "=== LEVEL1: Three ===", "cc"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "source_file string, seq long, line string")
    got = readers.marked_sections(df).orderBy("section").collect()
    assert [(r["level1"], r["level2"], r["content"]) for r in got] == [("One", None, "aa"), ("One", "Two", "bb"), ("Three", None, "cc")]


def test_heading_list(spark):
    a, b = readers.heading_list(F.col("l"))
    assert tuple(spark.createDataFrame([("Level 2: Some title ",)], "l string").select(a, b).first()) == (2, "Some title")


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sections": [{"title": "T", "body": "B"}, {"title": " ", "body": "C"}]}))
    got = readers.records(spark, str(tmp_path / "a.json")).collect()
    assert [(r["heading"], r["content"]) for r in got] == [("T", "B"), (None, "C")]
    (tmp_path / "c.jsonl").write_text('{"chunk_id": 1, "source_file": "f", "content": "x"}\n\n{broken\n')
    assert readers.chunk_lines(spark, str(tmp_path / "c.jsonl")).select("chunk_id", "content").collect() == [("1", "x")]
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        readers.chunk_lines(spark, str(tmp_path / "c.jsonl"), strict=True).collect()
    (tmp_path / "b.jsonl").write_text('{"source_file": "f", "text": "t", "bbox": [1.0, 2.0]}\n')
    r = readers.parsed_blocks(spark, str(tmp_path / "b.jsonl")).first()
    assert (r["page_index"], r["min_y"], r["max_y"], r["doc_item_type"]) == (0, 2.0, 0.0, "text")


def test_format_of():
    assert readers.format_of("x.MD") == "md" and readers.format_of("x", "json") == "json"
    with pytest.raises(ValueError, match="no reader"):
        readers.format_of("x.doc")


def test_index_round_trip(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = search.build_sparse(d)
    writers.save_index(index, "idx_test", buckets=4)
    again = writers.load_index(spark, "idx_test", "plain")
    q = search.query_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    a, b = (sorted((r["query_id"], r["key"], round(r["score"], 9)) for r in search.bm25(i, q).collect()) for i in (index, again))
    assert a == b
    with pytest.raises(ValueError, match="tokenizer"):
        writers.load_index(spark, "idx_test", "stemmed")
    for t in ("postings", "terms", "stats"):
        spark.sql(f"DROP TABLE idx_test_{t}")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x"]), ("b", 2, ["y"])], "source_file string, chunk_id long, l array<string>")
    writers.csv_report(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    writers.replace_sources(df, f"{tmp_path}/t")
    writers.replace_sources(df.where("source_file = 'a'").withColumn("chunk_id", F.lit(9).cast("long")), f"{tmp_path}/t")
    assert sorted(r["chunk_id"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [2, 9]
    assert json.loads(writers.tree_json(df.select(F.lit("L").alias("level1"), F.lit(None).cast("string").alias("level2"), F.lit(None).cast("string").alias("level3"), "chunk_id")).first()["json"])["children"][0]["level2"] == "(none)"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = ingest.source(spark, f"{sf_dir}/event[s].parquet", schema).withColumn("r", F.col("value") / 100)
    ingest.rewards(stream, "event_type", "r", "arms_test", f"{tmp_path}/c").awaitTermination()
    want = tuning.beta_posterior(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("r", F.col("value") / 100), "event_type", "r")
    a, b = ({r["arm"]: (round(r["alpha"], 6), r["pulls"]) for r in d.collect()} for d in (spark.table("arms_test"), want))
    assert a == b
