import zlib

from pyspark.sql import functions as F

from tessera.llm import sharding


def test_rows_law_slots_and_groups(spark):
    rows = [(i, f"copy {i // 40}") for i in range(400)] + [(1000 + i, f"single {i}") for i in range(900)] + [(5000 + i, "hot") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(df).cache()
    per = {r["shard"]: (r["n"], r["m"], r["d"]) for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("d")).collect()}
    assert set(per) == set(range(16)) and sum(n for n, _, _ in per.values()) == len(rows)
    assert max(n for n, _, _ in per.values()) - min(n for n, _, _ in per.values()) <= 1
    assert all(m == n - 1 and d == n for n, m, d in per.values())
    spread = {r["grp"]: r["s"] for r in got.where("members > 1").groupBy("grp").agg(F.count_distinct("shard").alias("s")).collect()}
    hot = got.where("members = 1200").first()["grp"]
    assert spread.pop(hot) <= 10 and sum(n > 1 for n in spread.values()) <= 2
    start = got.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int"))
    before, after = (sharding.cut_share(x).first()["cut"] for x in (start, got))
    assert after < 0.95 * before  # 1200 rows need eight shards, so most of their pairs stay apart


def test_reruns_agree_and_sizes(docs):
    a, b = (sorted(map(tuple, sharding.shard_documents(docs).select("key", "shard", "slot", "size", "text_crc32").collect())) for _ in range(2))
    assert a == b
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(s == len(text[k].encode()) + 1 and c == zlib.crc32(text[k].encode()) for k, _, _, s, c in a)


def test_odd_rows(odd):
    got = sharding.shard_documents(odd)
    assert got.count() == odd.count() and got.where("size = 1").count() == 2
