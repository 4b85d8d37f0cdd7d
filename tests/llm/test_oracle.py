"""Queries that SQL can express against it; every operator on an empty table."""

import pytest

from tessera.llm import licenses, mixing, neardup, oracle as sql, pieces, quality, queries, secrets, sharding
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_equals_sql(spark, con, sf_dir, name):
    oracle.check(spark, con, queries.QUERIES[name], sql.SQL[name], sf_dir)


@pytest.mark.parametrize("op", [licenses.scan, quality.judge, quality.clean, mixing.taken, mixing.mixed, secrets.scan, secrets.redact, pieces.encoded, neardup.near_duplicates, neardup.deduplicated, sharding.shard_documents])
def test_empty_table(empty, op):
    assert op(empty).count() == 0


def test_names():
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 11))
