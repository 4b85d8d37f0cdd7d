"""The pipeline's stages against plain versions of them, each over what the one before kept."""

import re

import pytest

import corpus_pipeline
from tessera.llm import mixing, secrets
from tests.llm.test_neardup import brute as fingerprints
from tests.llm.test_neardup import closure


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:5])


def test_quality_keeps_good_documents(spark, sf_dir, steps):
    kept = {r["doc_id"] for r in steps[1].collect()}
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet").join(steps[0], "doc_id").collect()
    long = [r for r in lab if len(r["text"].split()) >= 20]
    assert all(r["doc_id"] in kept for r in long if r["quality"] == 1)
    assert sum(r["doc_id"] in kept for r in long if r["quality"] == 0) <= 0.1 * len(long)


def test_one_of_each_near_duplicate_stays(steps):
    rows = steps[1].orderBy("doc_id").collect()
    keys = [r["doc_id"] for r in rows]
    roots = closure(fingerprints([r["text"] for r in rows]), keys)
    assert {r["doc_id"] for r in steps[2].collect()} <= set(roots)


def test_secrets_are_gone(steps):
    ratio = secrets.train(secrets.sample())
    before, after = steps[2].collect(), steps[3].collect()
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)
    assert not any(secrets.spans([r["text"] for r in after], ratio))
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_mix_and_ids(steps):
    size = {r["key"]: r["taken"] / r["size"] for r in mixing.taken(steps[3]).collect() if r["size"]}
    times = {}
    for r in steps[4].collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {k: int(v + 0.5) for k, v in size.items() if v >= 0.5}
    out = steps[5].collect()
    assert len(out) == sum(times.values()) and all(r["lossless"] for r in out)


def test_run(spark, sf_dir, steps):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in steps[5].collect())
    assert re.fullmatch("doc_id,n_tokens,ids,lossless", ",".join(got.columns))
