"""Source-file scans."""

from pyspark.sql import functions as F

from loomwork.sources import code


def test_syntax(spark):
    rows = [("a.py", '"""Does a.\n\nMore."""\nimport os, x.y\nfrom z import q\nfrom . import own\ndef f(): pass\n'), ("b.py", "def f(): pass\ndef g(): pass\n"), ("c.py", "def (:"), ("d.py", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r.s for r in files.select("path", code.syntax(F.col("text")).alias("s")).collect()}
    assert (got["a.py"].imports, got["a.py"].docstring, got["a.py"].functions) == (["os", "x.y", "z"], "Does a.", ["f"])
    assert got["c.py"].imports == [] and got["d.py"].docstring is None
    assert [tuple(r) for r in code.repeated_functions(files).collect()] == [("f", ["a.py", "b.py"])]


def test_front_matter_and_json(spark):
    text = spark.createDataFrame([("---\nname: x\ntags: a, b\n---\nbody: no",), ("body: no",), (None,)], "t string")
    assert [r[0] for r in text.select(code.front_matter(F.col("t"))).collect()] == [{"name": "x", "tags": "a, b"}, None, None]
    answers = spark.createDataFrame([('so ```json\n{"a": 1}\n``` end',), ('{"a": 2}',), ("none",)], "t string")
    assert [r[0] and r[0].a for r in answers.select(code.fenced_json(F.col("t"), "a int")).collect()] == [1, 2, None]


def test_decoded(spark):
    content = spark.createDataFrame([("é".encode(),), ("測試".encode("cp950"),), (None,)], "c binary")
    assert [r[0] for r in content.select(code.decoded(F.col("c"))).collect()] == ["é", "測試", None]
