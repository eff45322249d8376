import pytest
from pyspark.sql import functions as F

from seamline.functions import text as tx
from seamline.functions.regex import SearchOption
from seamline.operators import lines


def docs(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")


def test_lines_of_odd_texts(spark, rows):
    df = docs(spark, None, "", "a", "a\n", "a\n\n", "\n", "x\r\ny\r", "é\n日本")
    assert rows(lines.lines(df, ["doc_id"])) == sorted([(2, 1, "a"), (3, 1, "a"), (4, 1, "a"), (4, 2, ""), (5, 1, ""), (6, 1, "x"), (6, 2, "y"), (7, 1, "é"), (7, 2, "日本")], key=repr)


def test_grep_modes(spark, rows):
    df = docs(spark, "TODO: a\nb\nTODO\n", "none", None)
    option = SearchOption("TODO")
    assert rows(lines.grep(df, ["doc_id"], option).select("doc_id", "line_no")) == [(0, 1), (0, 3)]
    assert rows(lines.grep(df, ["doc_id"], option, invert=True).select("doc_id", "line_no")) == [(0, 2), (1, 1)]
    assert rows(lines.count_matches(lines.grep(df, ["doc_id"], option), ["doc_id"])) == [(0, 2)]
    with pytest.raises(ValueError):
        lines.grep(df, ["doc_id"], SearchOption(""))
    very_long = docs(spark, "x" * 2_000_000 + "\nneedle")
    assert rows(lines.grep(very_long, ["doc_id"], SearchOption("needle")).select("line_no")) == [(2,)]


def test_context(spark, rows):
    df = docs(spark, "1\n2\nhit\n4\nhit\n6\n7\n8")
    assert rows(lines.with_context(df, ["doc_id"], SearchOption("hit"), 1, 1).select("line_no", "is_match")) == [(2, False), (3, True), (4, False), (5, True), (6, False)]


def test_extensions(spark, rows):
    df = spark.createDataFrame([("main.go", "match"), ("notes.txt", "match"), ("Config.YAML", "match"), ("log.log", "match"), ("none", "match")], "path string, text string")
    assert len(rows(lines.grep(df, ["path"], SearchOption("match"), path="path"))) == 5
    assert [r[0] for r in rows(lines.grep(df, ["path"], SearchOption("match", extensions=(".go", "yaml")), path="path"))] == ["Config.YAML", "main.go"]


def test_slices(spark):
    text = "".join(f"line {k}\n" for k in range(1, 6))
    df = docs(spark, text, "alpha\nbeta\ngamma\ndelta\nepsilon", None, "")
    cut = lambda a, b: [r[0] for r in df.orderBy("doc_id").select(tx.line_slice(F.col("text"), F.lit(a), F.lit(b))).collect()]
    assert cut(1, 2)[:2] == ["line 1\nline 2", "alpha\nbeta"]
    assert cut(2, 4)[0] == "line 2\nline 3\nline 4" and cut(5, 5)[0] == "line 5" and cut(7, 9)[:2] == ["", ""]
    assert cut(4, 99)[:2] == ["line 4\nline 5\n", "delta\nepsilon"] and cut(1, 1)[2:] == [None, ""]


def test_hits_to_chunks(spark, rows):
    chunks = spark.createDataFrame([("a", "p", 1, 5), ("b", "p", 4, 2000), ("b", "p", 4, 2000), ("c", "q", 1, 9), ("d", "p", 9, 3), ("e", "p", None, None)], "id string, path string, line_start int, line_end int")
    hits = spark.createDataFrame([("p", 5), ("p", 5), ("p", 1999), ("q", 50), (None, 1)], "path string, line_no long")
    assert [r[0] for r in rows(lines.hits_to_chunks(hits, chunks, block=7).select("id"))] == ["a", "b"]


def test_text_predicates(spark):
    df = spark.createDataFrame([("Hello", "hELL"), ("abc", ""), ("É", "é"), ("abc", "abcd")], "a string, b string")
    assert [r[0] for r in df.select(tx.contains_fold(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]
    binary = spark.createDataFrame([(bytearray(b"ab\0c"),), (bytearray(b"abc"),), (bytearray(b"\xff\xfe"),), (bytearray(b"x" * 8000 + b"\0"),)], "c binary")
    assert [r[0] for r in binary.select(lines.is_text(F.col("c"))).collect()] == [False, True, True, True]
    paths = spark.createDataFrame([("/a/b", "/a/b"), ("/a/b2/x", "/a/b"), ("/a/b/c.GO", "/a/b")], "p string, r string")
    got = paths.select(tx.within(F.col("p"), F.col("r")), tx.relative_to(F.col("p"), F.col("r")), tx.extension(F.col("p")), tx.parent(F.col("p")), tx.base_name(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, "/a/b", "", "/a", "b"), (False, "/a/b2/x", "", "/a/b2", "x"), (True, "c.GO", ".go", "/a/b", "c.GO")]
