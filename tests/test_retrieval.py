import json
import os
import shutil
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Chunking, Config
from tessera.functions import predicates as P
from tessera.functions import text as T
from tessera.operators import adapters, chunking, relational, retrieval, search
from tessera.operators.retrieval import Corpus, Mode

TEXTS = {1: "red apples grow on old trees", 2: "green apples are sour", 3: "old cars rust in the rain", 4: "rain falls on trees and cars", 5: "nothing of the kind"}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, f"s{k % 2}", k, "L", None, t) for k, t in TEXTS.items()]
    chunks = spark.createDataFrame(rows, "key long, source_file string, seq long, level1 string, level2 string, content string")
    embed = adapters.embedding_udf(lambda: adapters.HashingEmbedder(32))
    return Corpus(chunks, chunks.select("key", embed(F.col("content")).alias("raw")).select("key", search.unit(F.col("raw")).alias("vec")), embed)


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")


def test_modes_and_presets(spark, corpus):
    q = asked(spark, "sour apples", "rain falls on trees")
    for mode in [*retrieval.PRESETS.values(), Mode("bm25", 3, None, False), Mode("embedding", 2, 1, True)]:
        rows = retrieval.search(corpus, q, mode, search.overlap_score).collect()
        best = {r["query_id"]: r["key"] for r in rows if r["rank"] == 1}
        assert best == {0: 2, 1: 4}
        assert all(r["rank"] <= (mode.top or mode.k) for r in rows)
        assert ("parent_context" in rows[0].asDict()) == mode.parents
    only = retrieval.search(corpus, q, Mode("embedding", 5, None, False), filters={"source_file": "s1"})
    assert {r["key"] for r in only.collect()} <= {1, 3, 5}
    with pytest.raises(ValueError, match="no search"):
        retrieval.search(corpus, q, Mode("else"))


def test_decompose_takes_only_arrays_of_texts(spark):
    answers = ['I say ["a", "b", "q", "a", " "] so', "none", '["broken', '{"a": 1}', None, "[]"]
    df = spark.createDataFrame([(i, "q", a) for i, a in enumerate(answers)], "question_id long, question string, a string")
    got = retrieval.decompose(df, F.col("a")).orderBy("question_id", "sub_no").collect()
    assert [(r["question_id"], r["sub_no"], r["sub_query"]) for r in got] == [(0, 0, "q"), (0, 1, "a"), (0, 2, "b"), *[(i, 0, "q") for i in range(1, 6)]]


def test_budget_and_first_seen(spark, corpus):
    subs = spark.createDataFrame([(7, 0, "apples"), (7, 1, "sour apples"), (7, 2, "rain")], "question_id long, sub_no long, sub_query string")
    mode = Mode("bm25", 5, 2, False)
    got = [(r["sub_no"], r["key"]) for r in retrieval.retrieve(corpus, subs, mode, search.overlap_score, budget=60).orderBy("sub_no", "rank").collect()]
    # both apples take 28 + 21 characters; no text about rain fits what is left
    assert got == [(0, 1), (0, 2)]
    plain = retrieval.retrieve_plain(corpus, subs, Mode("bm25", 5, None, False), 3).orderBy("place").collect()
    assert [(r["sub_no"], r["key"]) for r in plain][:2] in ([(0, 1), (0, 2)], [(0, 2), (0, 1)]) and len({r["key"] for r in plain}) == 3


def test_verify_asks_again_once_and_keeps_what_it_has(spark, corpus):
    questions = spark.createDataFrame([(1, "apples"), (2, "rain"), (3, "cars"), (4, "unheard of words"), (5, "trees")], "question_id long, question string")
    find = lambda subs: retrieval.retrieve(corpus, subs, Mode("bm25", 5, 1, False), search.overlap_score)
    first = find(retrieval.decompose(questions, None))
    said = {"apples": '{"relevant": false, "refined_queries": ["old cars"]}', "rain": '{"relevant": false, "refined_queries": ["unfindable"]}', "cars": "not JSON", "unheard of words": '{"relevant": false, "refined_queries": ["rain"]}', "trees": '{"relevant": true, "refined_queries": ["rain"]}'}
    answer = lambda question, previews: F.element_at(F.create_map(*[F.lit(x) for kv in said.items() for x in kv]), question)
    was = {r["question_id"]: r["key"] for r in first.collect()}
    got = {r["question_id"]: r["key"] for r in retrieval.verify(first, questions, answer, find).collect()}
    assert got == {**was, 1: 3} and 4 not in got
    shown = {r["question_id"]: r["previews"] for r in retrieval.previews(first).collect()}
    assert shown[5].startswith("[Chunk 1: S") and shown[5].endswith(TEXTS[was[5]])


def test_prompts_answers_and_windows(spark, corpus):
    questions = spark.createDataFrame([(1, "sour apples"), (2, "unheard")], "question_id long, question string")
    got = retrieval.retrieve(corpus, retrieval.decompose(questions, None), Mode("bm25", 5, 2, False), search.overlap_score)
    prompted = retrieval.prompts(got, questions, "C: {context}|Q: {question}")
    rows = {r["question_id"]: r["prompt"] for r in prompted.collect()}
    assert rows[2] == "C: |Q: unheard" and rows[1].startswith("C: [Source: S0]\ngreen apples are sour") and rows[1].endswith("|Q: sour apples")
    echo = lambda prompt: F.concat(F.lit("<"), F.right(prompt, F.lit(8)), F.lit(">"))
    out = {r["question_id"]: (r["draft"], r["answer"]) for r in retrieval.answers(prompted, echo).collect()}
    assert out[1] == ("<r apples>", "<r apples>") and out[2][0] == "< unheard>"
    sweep = retrieval.window_sweep(got, questions, (5, 400), lambda part, q: F.length(part).cast("double")).collect()
    assert {(r["question_id"], r["size"]): r["chars"] for r in sweep}[(1, 5)] == 5 and all(r["chars"] <= r["size"] for r in sweep)


def test_token_similarity_equals_a_plain_version(spark):
    rows = [("a b c", "a c d"), ("", "x"), (None, "x"), ("w " * 100, "w"), ("same words here", "same words here")]
    model = adapters.HashingEmbedder(64)

    def plain(ref, ans):
        r, a = (ref or "").split()[:64], (ans or "").split()[:64]
        if not r or not a:
            return (0.0, 0.0, 0.0)
        cos = [[float(model.encode([x])[0] @ model.encode([y])[0]) for y in r] for x in a]
        p, c = np.mean([max(x) for x in cos]), np.mean([max(x[j] for x in cos) for j in range(len(r))])
        return (p, c, 2 * p * c / (p + c) if p + c > 0 else 0.0)

    f = adapters.token_similarity_udf(lambda: adapters.HashingEmbedder(64))
    got = spark.createDataFrame(rows, "r string, a string").select(f("r", "a").alias("s")).select("s.*").collect()
    for g, (r, a) in zip(got, rows, strict=True):
        assert tuple(g) == pytest.approx(plain(r, a))


def test_scorers_and_splitters_are_pluggable(spark):
    df = spark.createDataFrame([("a b", "b c"), (None, "x"), ("a", None)], "q string, c string")
    assert [r[0] for r in df.select(adapters.pair_udf(adapters.OverlapScorer, batch=2)("q", "c")).collect()] == [0.5, 0.0, 0.0]
    cut = adapters.sentence_udf(lambda: lambda t: t.split(";"))
    assert spark.createDataFrame([("a;b",), (None,)], "t string").select(cut("t")).collect()[0][0] == ["a", "b"]


def test_dense_blocks_equal_a_broadcast(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    index = search.build_dense(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dim=None)
    asked = index.where("key % 3 = 0").select(F.col("key").alias("query_id"), F.col("vec").alias("qvec"))
    one, many = (sorted(map(tuple, search.search_dense(index, asked, 4, **o).select("query_id", "key", "rank").collect())) for o in ({}, {"most": 500, "salts": 7}))
    assert one == many and len(one) == 67 * 4


def test_places_and_pairs(spark):
    df = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)], "k long, v string").repartition(5)
    got = relational.numbered(df, ["k"], "place").collect()
    assert {r["k"]: r["place"] for r in got} == {i: i + 1 for i in range(101)}
    assert relational.numbered(df.limit(0), ["k"], "place").count() == 0
    a = spark.createDataFrame([("g", 3, "c"), ("g", 1, "a"), ("h", 1, "z")], "g string, n int, x string")
    b = spark.createDataFrame([("g", 10, "A"), ("g", 20, "B")], "g string, n int, y string")
    assert sorted((r["x"], r["y"]) for r in relational.zipped(a, b, ["g"], ["n"]).collect()) == [("a", "A"), ("c", "B")]
    assert sorted((r["x"], r["y"] or "") for r in relational.zipped(a, b, ["g"], ["n"], "left").collect())[-1] == ("z", "")


def test_config_from_values_and_files(tmp_path):
    c = Config.of({"search": {"alpha": 0.3}, "cleaning": {"known_artifacts": ["x", "y"]}, "repair": None})
    assert c.search.alpha == 0.3 and c.search.k1 == Config().search.k1 and c.cleaning.known_artifacts == ("x", "y") and c.repair == Config().repair
    for bad in ({"nothing": {}}, {"search": {"nothing": 1}}):
        with pytest.raises(ValueError, match="nothing"):
            Config.of(bad)
    (tmp_path / "c.json").write_text(json.dumps({"chunking": {"min_words": 5}}))
    assert Config.load(str(tmp_path / "c.json")).chunking == Chunking(min_words=5)
    (tmp_path / "c.yaml").write_text("chunking:\n  min_words: 6\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="yaml"):
            Config.load(str(tmp_path / "c.yaml"))
    else:
        assert Config.load(str(tmp_path / "c.yaml")).chunking.min_words == 6


def test_symbols_and_letters(spark):
    """A letter is no mark: only rows of marks or digits are artifacts."""
    c = Config().cleaning
    df = spark.createDataFrame([("e",), ("ee-e",), ("®",), ("•*",), ("12",), ("Ü",), ("--",)], "t string")
    assert [r[0] for r in df.select(T.is_artifact(F.col("t"), c.known_artifacts, c.noise_patterns)).collect()] == [False, False, True, True, True, True, True]


def test_block_predicates(spark):
    df = spark.createDataFrame([("text", False, False, False, 13.0), ("", False, False, False, 13.0), ("share", False, False, False, 20.0), ("text", True, False, None, 13.0), ("text", None, None, None, 12.0)], "t string, m boolean, v boolean, b boolean, s double")
    keeps = P.keeps_block(F.col("t"), F.col("m"), F.col("v"), F.col("b"), ("share",))
    assert [tuple(r) for r in df.select(keeps, P.is_lead_in(keeps, F.col("s"))).collect()] == [(True, True), (False, False), (False, False), (False, False), (True, False)]


def test_many_wrapped_lines_take_linear_time(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit(" of many"))).alias("l"))
    began = time.time()
    assert df.select(F.size(T.merge_wrapped(F.col("l")))).first()[0] == 1
    assert time.time() - began < 20
    assert spark.range(1).select(T.merge_wrapped(F.array().cast("array<string>"))).first()[0] == []


def test_boilerplate_meets_lines_in_any_part(spark):
    chunks = spark.createDataFrame([(i, f"Copyright of the Example Press {i % 3}\nbody text number {i} with its own words") for i in range(30)], "k int, content string")
    patterns = spark.createDataFrame([("Copyright of the Example Press 9", 5)], "line string, n long")
    for salts in (1, 64):
        got = {r["k"]: r["content"] for r in chunking.strip_boilerplate(chunks, patterns, ["k"], salts=salts).collect()}
        assert got == {i: f"body text number {i} with its own words" for i in range(30)}


def test_entry_without_the_corpus_operators(tmp_path):
    """With their folders gone, and with an empty one left over."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tessera"), tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    for left in (False, True):
        if left:
            (tmp_path / "tessera" / "llm" / "__pycache__").mkdir(parents=True)
        out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[-2]) > 80 and out[-1] == "False"
