import pytest

from tessera.llm import common, neardup


class Session:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "yarn"


def test_a_cluster_needs_a_shared_folder(spark):
    for master in ("yarn", "spark://x:7077", "k8s://x", "local-cluster[2,1,1024]"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(Session)
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [
    [],
    [(1, 1)],
    [(i, i + 1) for i in range(300)],
    [(0, i) for i in range(1, 4000)] + [(5000, i) for i in range(3000, 4500)],
    [(i * 37 % 1000, i * 91 % 1000) for i in range(700)],
])
def test_components_of_chains_and_hot_ids(spark, edges):
    got = {r["id"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in plain([e for e in edges if e[0] != e[1]]).items() if x != r}
