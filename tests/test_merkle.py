import hashlib

from pyspark.sql import functions as F

from seamline.operators import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_hashes(spark, rows):
    chunks = spark.createDataFrame([("/r/a.py", 0, "x"), ("/r/a.py", 1, "y"), ("/r/b.py", 0, None)], "path string, ord int, content string")
    made = merkle.file_hashes(chunks.withColumn("h", merkle.chunk_hash(F.col("content"))), "path", ["ord"], "h")
    assert dict(rows(made)) == {"/r/a.py": sha(sha("x") + sha("y")), "/r/b.py": sha(sha(""))}
    moved = chunks.select(merkle.chunk_hash(F.col("content"), F.col("ord"), F.col("ord"))).distinct()
    assert moved.count() == 3
    files = spark.createDataFrame([("/r/d/e/x", "1"), ("/r/d/y", "2"), ("/r/z", "3"), ("/r/z", "3")], "node_path string, node_hash string")
    e, d = sha("x1"), None
    d = sha("e" + e + "y2")
    want = {"/r/d/e": e, "/r/d": d, "/r": sha("d" + d + "z3")}
    assert dict(rows(merkle.folder_hashes(files))) == want
    assert set(dict(rows(merkle.folder_hashes(files, spark.createDataFrame([("/r/d",)], "root string"))))) == {"/r/d", "/r/d/e"}
    assert merkle.folder_hashes(files.limit(0)).count() == 0


def test_diff(spark, rows):
    schema = "codebase string, path string, h string"
    a = spark.createDataFrame([("A", "main.go", "1"), ("A", "src/helper.go", "2"), ("B", "main.go", "1"), ("A", "nul", None)], schema)
    b = spark.createDataFrame([("A", "src/helper.go", "3"), ("A", "src/config.tf", "4"), ("B", "main.go", "1"), ("A", "nul", None)], schema)
    made = merkle.diff(a, b, ["codebase", "path"], "h")
    assert rows(made) == [("A", "main.go", "deleted"), ("A", "src/config.tf", "added"), ("A", "src/helper.go", "modified")]
    assert rows(merkle.change_counts(made)) == [("added", 1), ("deleted", 1), ("modified", 1)]
    assert merkle.diff(a, a, ["codebase", "path"], "h").count() == 0
    assert merkle.diff(a.limit(0), b, ["codebase", "path"], "h").filter("change_kind <> 'added'").count() == 0


def test_no_folder_is_compared_with_all_roots(spark):
    files = spark.createDataFrame([("/r/d/x", "1"), ("/q/y", "2")], "node_path string, node_hash string")
    made = merkle.folder_hashes(files, spark.createDataFrame([("/r",)], "root string"))
    assert {r.node_path for r in made.collect()} == {"/r/d", "/r"}
    plan = merkle._tops(files, spark.createDataFrame([("/r",)], "root string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
