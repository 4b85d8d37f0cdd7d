"""Queries of joins, set operations, conversations and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import relational, tuning
from tessera.plans.common import table
from tessera.shared import shared_dir
from tessera.streaming import ingest


def dedup_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("text_md5"))
    return relational.first_of(d, ["source", "text_md5"], ["doc_id"])


def upsert_absent(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = d.where("lang in ('en', 'fr')").withColumn("source", F.lit("new"))
    return relational.insert_absent(d.where("lang in ('en', 'de')"), new, ["doc_id"])


def replace_by_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_file"))
    new = d.where("source_file in ('src1', 'src2')").withColumn("source_file", F.upper("source_file"))
    return relational.replace_by_source(d, new)


def append_parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return relational.append(d, table(spark, sf_dir, "labels").select("doc_id", "quality")).groupBy("lang", "quality").agg(F.count("*").alias("n"))


def ordered_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").alias("r"))
    return relational.ordered_union(a, d.select("doc_id", F.col("n_chars").alias("r")), "doc_id", "r")


def row_slice(spark, sf_dir):
    return relational.row_slice(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 11, 40)


def join_kinds(spark, sf_dir):
    """Rows that each kind of join gives, in one table."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    parts = {"inner": d.join(lab, "doc_id").where("quality = 1"), "full": d.where("lang = 'en'").join(lab.where("quality = 1"), "doc_id", "full_outer"), "left": d.join(lab, "doc_id", "left"), "semi": d.join(lab.where("toxic = 1"), "doc_id", "left_semi"), "anti": d.join(lab, "doc_id", "left_anti")}
    out = None
    for k, p in parts.items():
        one = p.agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.coalesce(F.sum("doc_id"), F.lit(0)).alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "n", "ids")


def null_safe_left(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"), "source")
    right = d.groupBy("lang", "source").agg(F.max("doc_id").alias("last_id"))
    return relational.null_safe_left(d, right, ["lang", "source"], "last_id").select("doc_id", "last_id")


def star_join(spark, sf_dir):
    """Revenue by region and year: a plain star join with its filters at the scans."""
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("r_name").alias("region"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def conversation_summary(spark, sf_dir):
    return ingest.conversations(table(spark, sf_dir, "conversations"), ("urgent", "help"))


def event_windows(spark, sf_dir):
    w = ingest.event_windows(table(spark, sf_dir, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_ingest_equals_batch(spark, sf_dir):
    """Documents ingested as a stream, twice: the second run finds them all and adds none. (A pattern may be one file or a folder.)"""
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i in (1, 2):
        stream = ingest.source(spark, f"{sf_dir}/document[s].parquet", docs.schema)
        ingest.insert_absent(stream, f"{base}/table", ["doc_id"], ["n_chars"], f"{base}/check{i}", docs.schema).awaitTermination()
    return spark.read.parquet(f"{base}/table").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("doc_id").alias("ids"))


def stream_rewards(spark, sf_dir):
    """Arms' posteriors from a stream of the events."""
    events = table(spark, sf_dir, "events")
    name = f"rewards_{uuid.uuid4().hex}"
    base = f"{shared_dir(spark)}/{name}"
    stream = ingest.source(spark, f"{sf_dir}/event[s].parquet", events.schema).withColumn("r", F.col("value") / 100)
    ingest.rewards(stream, "event_type", "r", name, base).awaitTermination()
    return spark.table(name).select("arm", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "pulls")


def new_arms(spark, sf_dir):
    arms = spark.createDataFrame([("click",), ("never seen",)], "arm string")
    post = tuning.beta_posterior(table(spark, sf_dir, "events").withColumn("r", F.col("value") / 100), "event_type", "r")
    return tuning.with_new_arms(arms, post).select("arm", F.round("alpha", 6).alias("alpha"), "pulls", F.round("mean", 6).alias("mean"))


_KIND = lambda k, q: f"SELECT '{k}' AS kind, count(*) AS n, coalesce(sum(doc_id), 0)::BIGINT AS ids FROM ({q})"

SQL = {
    "dedup_first": "SELECT min(doc_id) AS doc_id, source, md5(text) AS text_md5 FROM documents GROUP BY source, md5(text)",
    "upsert_absent": "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') UNION ALL SELECT doc_id, lang, 'new' FROM documents WHERE lang = 'fr'",
    "replace_by_source": "SELECT doc_id, source AS source_file FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id, upper(source) FROM documents WHERE source IN ('src1', 'src2')",
    "append_parts": "SELECT lang, quality, count(*) AS n FROM (SELECT lang, NULL::INT AS quality FROM documents UNION ALL SELECT NULL, quality FROM labels) GROUP BY 1, 2",
    "ordered_union": "WITH u AS (SELECT doc_id, min(l) AS l, arg_min(r, l) AS r FROM (SELECT doc_id, doc_id AS r, 0 AS l FROM labels UNION ALL SELECT doc_id, n_chars, 1 FROM documents) GROUP BY doc_id) SELECT doc_id, row_number() OVER (ORDER BY l, r, doc_id) AS place FROM u",
    "row_slice": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 30 OFFSET 10",
    "join_kinds": " UNION ALL ".join([_KIND("inner", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1"), _KIND("full", "SELECT doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en') FULL JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)"), _KIND("left", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id)"), _KIND("semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"), _KIND("anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")]),
    "null_safe_left": "WITH d AS (SELECT doc_id, CASE WHEN lang <> 'fr' THEN lang END AS lang, source FROM documents), r AS (SELECT lang, source, max(doc_id) AS last_id FROM d GROUP BY 1, 2) SELECT d.doc_id, last_id FROM d LEFT JOIN r ON d.lang IS NOT DISTINCT FROM r.lang AND d.source IS NOT DISTINCT FROM r.source",
    "star_join": "SELECT r_name AS region, year(o_orderdate)::INTEGER AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "conversation_summary": "SELECT conv_id, left(arg_min(text, turn) FILTER (WHERE role = 'user'), 52) AS title, CASE WHEN coalesce(bool_or(role = 'user' AND (contains(lower(text), 'urgent') OR contains(lower(text), 'help'))), false) THEN 'urgent' ELSE 'general' END AS category, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns FROM conversations GROUP BY conv_id",
    "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_ingest_equals_batch": "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT doc_id) AS ids FROM documents GROUP BY 1",
    "stream_rewards": "SELECT event_type AS arm, round(1 + sum(r), 6) AS alpha, round(1 + sum(1 - r), 6) AS beta, count(r) AS pulls FROM (SELECT event_type, greatest(0, least(1, value / 100)) AS r FROM events) GROUP BY 1",
    "new_arms": "SELECT a.arm, round(coalesce(1 + sum(r), 1), 6)::DOUBLE AS alpha, count(r) AS pulls, round((1 + coalesce(sum(r), 0)) / (2 + count(r)), 6)::DOUBLE AS mean FROM (VALUES ('click'), ('never seen')) a(arm) LEFT JOIN (SELECT event_type, greatest(0, least(1, value / 100)) AS r FROM events) ON arm = event_type GROUP BY 1",
}

QUERIES = {f.__name__: f for f in (dedup_first, upsert_absent, replace_by_source, append_parts, ordered_union, row_slice, join_kinds, null_safe_left, star_join, conversation_summary, event_windows, stream_ingest_equals_batch, stream_rewards, new_arms)}
