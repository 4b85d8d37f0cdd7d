"""Every query of the catalogue against its SQL; those without one run and give rows."""

import pytest

from tessera.plans import catalog
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, sf_dir, name):
    oracle.check(spark, con, catalog.QUERIES[name], catalog.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_prompt_context_holds_whole_texts(spark, sf_dir):
    from hashlib import md5

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    best, want = {}, {}
    for r in sorted(catalog.QUERIES["bm25_topk"](spark, sf_dir).collect(), key=lambda r: r["rank"]):
        if r["rank"] <= 3:
            best.setdefault(r["query_id"], []).append(docs[r["doc_id"]])
    for q, chosen in best.items():
        whole = "\n\n".join(f"[Source: {d['source'][:1].upper()}{d['source'][1:]}]\n{d['text']}" for d in chosen)
        want[q] = md5(whole[:8500].encode()).hexdigest()
    assert any(len(d["text"]) > 350 for chosen in best.values() for d in chosen)
    assert {r["question_id"]: r["context_md5"] for r in catalog.QUERIES["prompt_context"](spark, sf_dir).collect()} == want
