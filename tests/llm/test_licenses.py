import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, oracle


def test_spellings_and_copyright_lines_do_not_matter(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, "Copyright (c) 2021 A. Person\nAll rights reserved.\n\n" + mit.upper()), (2, mit.replace("sublicense", "sub-license").replace("\n", "  ")), (3, mit + " Not."), (4, "© 2020 x\n" + licenses.TEXTS["Zlib"].replace("acknowledgment", "acknowledgement")), (5, "Released under the MIT license"), (6, None), (7, "...")]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: "Zlib", 5: "MIT notice", 6: None, 7: None}


def test_licences_differ_and_are_their_own_match(spark):
    df = spark.createDataFrame(list(licenses.TEXTS.items()), "doc_id string, text string")
    assert all(r["doc_id"] == r["license_id"] for r in licenses.scan(df).collect())


def test_own_table_with_ties(spark):
    own = licenses.known(spark, {"B": "Some terms.", "A": "some TERMS"})
    assert own.select("license_id").collect() == [("A",)]
    assert licenses.scan(spark.createDataFrame([(1, "SOME terms")], "doc_id int, text string"), own).first()["license_id"] == "A"


def test_odd_rows(odd):
    got = licenses.scan(odd)
    assert got.count() == odd.count() and got.where(F.col("license_id").isNotNull()).count() == 0
    assert got.where("doc_id in (1, 2, 3)").select("digest").distinct().count() == 1


MIT, BSD = licenses.TEXTS["MIT"], licenses.TEXTS["BSD-3-Clause"]
FILES = {
    "title and statement": ("MIT License\n\nCopyright (c) 2021 A. Person\n\n" + MIT, "MIT"),
    "title with a name": ("\n  The MIT License (MIT)\r\n\r\nCopyright © 2021, A. Person, Inc.\r\n\r\n" + MIT.replace("\n", "\r\n"), "MIT"),
    "several statements": ("BSD 3-Clause License\n\nCopyright (c) 2019-2021, A\nCopyright 2022 B and others.\n(c) 2023 C\nAll rights reserved.\n\n" + BSD, "BSD-3-Clause"),
    "typographic": (MIT.replace('"Software"', "“Software”").replace("non", "non").replace(", ", ",\u00a0"), "MIT"),
    "comment marks": ("# MIT License\n#\n# Copyright (c) 2021 A\n#\n" + "\n".join("# " + x for x in MIT.split("\n")), "MIT"),
    "block comment": ("/*\n * Copyright (c) 2021 A\n *\n" + "\n".join(" * " + x for x in MIT.split("\n")) + "\n */", "MIT"),
    "one line": ("Copyright (c) 2020 A. Person " + MIT.replace("\n", " "), "MIT"),
    "British": (BSD.replace("license", "licence").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS"), "BSD-3-Clause"),
    "clause added": (MIT + "\n(c) You must pay me ten dollars a copy.", None),
    "duty behind a statement": ("Copyright (c) 2020 A. You must pay A for each copy.\n" + MIT, None),
    "clause changed": (MIT.replace("without limitation", "with the limitation"), None),
    "half of it": (MIT[: len(MIT) // 2], None),
    "title alone": ("MIT License", None),
    "statement alone": ("Copyright (c) 2020 A. Person", None),
    "more before it": ("A story of the MIT License.\n" + MIT, None),
    "many blank lines": ("\n" * 50_000 + MIT, "MIT"),
    "long statement": ("Copyright (c) 2020 " + "name " * 50_000, None),
}


def test_ordinary_files_and_changed_ones(spark):
    """By Spark, and by the SQL over the same rows."""
    rows = [(i, text) for i, (text, _) in enumerate(FILES.values())]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: (r["digest"], r["canonical_chars"], r["license_id"]) for r in licenses.scan(df).collect()}
    assert {name: got[i][2] for i, name in enumerate(FILES)} == {name: want for name, (_, want) in FILES.items()}
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    con.sql("CREATE TABLE documents AS SELECT * FROM documents")
    assert {r[0]: r[1:] for r in con.sql(oracle.SQL["op3_license_scan"]).fetchall()} == got


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence files on this machine")
def test_licence_files_of_a_folder(spark):
    lic = licenses.from_files(spark, "file:///usr/share/common-licenses")
    text = open("/usr/share/common-licenses/Apache-2.0").read()
    rows = [(1, text), (2, text.upper().replace("\n", "\n# ")), (3, text[:-20]), (4, "some words"), (5, open("/usr/share/common-licenses/MPL-2.0").read())]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string"), lic).collect()}
    assert got == {1: "Apache-2.0", 2: "Apache-2.0", 3: None, 4: None, 5: "MPL-2.0"}
