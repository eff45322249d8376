import math
import random
from datetime import datetime as D

import pytest

from pyspark.sql import functions as F

from seamline.llm.handwritten import classify_files, composition, find_copies, line_index, opening_says

SCHEMA = "id string, cwd string, file_path string, content string, start_line int, created_at timestamp_ntz, kind string, n int"


def rows(spark, *files):
    return spark.createDataFrame([(f"{c}{p}{k}", c, c + p, t, k * 50 + 1, at, "k", 1) for c, p, parts, at in files for k, t in enumerate(parts)], SCHEMA)


def kinds(spark, *files):
    return {r.file_path: r.kind for r in classify_files(rows(spark, *files)).collect()}


def code(seed, n=20):
    return "\n".join(f"    value_{seed}_{k} = compute_{seed}({k}, other_{seed})" for k in range(n))


@pytest.mark.parametrize(
    "text,said",
    [
        ("// Code generated by protoc-gen. DO NOT EDIT.\npackage a", "generated"), ("# rendered from templates/x.tmpl, do not change by hand\n", "generated"), ("# This file is produced by the x compiler from a.def;\n# changes made here are lost on the next build.\n", "generated"),
        ("# AUTOGENERATED on 2025-01-01 - regenerate with `make x`", "generated"), ("// a\n" * 40 + "// @machine-generated abc\nfunc", "generated"), ("// x\n//line 3 \"a.y\"\n", "generated"), ("/*\n * @generated\n */\nx", "generated"),
        ("# Copied verbatim from xlib v1.2 (upstream commit a1).\n", "vendored"), ("// Imported from the x project, release 1; send fixes upstream.", "vendored"), ("# Upstream: https://h/x - local copy, keep in sync.", "vendored"),
        ("# Copyright (c) 2017 the xio contributors\n# This copy of xio may be passed on unchanged together with this notice;\n", "vendored"),
        ("# Copyright (c) 2025 the owners of this repository\n", None), ("# written and edited by hand; nothing here is generated or vendored", None), ("# the renderer adds its own generated-by banner to what it writes", None),
        ("const banner = '// @generated';\n", None), ("BANNER = '# Code generated by {}. DO NOT EDIT.'", None), ("x = 1\n# Code generated by y. DO NOT EDIT.", None), ("", None), ("// Made from scratch", None),
    ],
)
def test_openings(text, said):
    assert opening_says(text) == said


def test_kinds(spark):
    table = "\n".join(f"    {k}.25, -{k}.5, 0.{k}, 8.1," for k in range(40))
    at = D(2025, 1, 1)
    got = kinds(
        spark,
        ("/r", "/vendor/h.io/lib/a.go", [code(1)], at), ("/r", "/app/vendors/a.py", [code(2)], at), ("/r", "/src/third_party_billing/a.py", [code(3)], at), ("/r", "/deps/lib-1.2.3/a.py", [code(4)], at), ("/r", "/node_modules/@x/a/b.js", [code(5)], at),
        ("/r", "/a.pb.go", [None], at), ("/r", "/api/gen/a.go", [code(6)], at), ("/r", "/codegen/a.py", [code(7)], at), ("/r", "/x.min.js", ["!"], at), ("/r", "/m.js", ["!function(e,t){" + "a&&b;c(d);" * 80 + "}"], at),
        ("/r", "/d.py", ["t = [\n" + table + "\n]"], at), ("/r", "/d2.go", ["var t = []byte{\n" + table, table + "\n}"], at), ("/r", "/small.py", ["STEPS = [1, 2, 3]\n" + code(8)], at), ("/r", "/conf.json", ['{\n' + '\n'.join(f'"k{k}": "v{k}",' for k in range(60)) + "}"], at),
        ("/r", "/hand.py", [None, code(9)], at), ("/r", "/key.py", ["@retry(3)\ndef f():\n    key = '" + "Zx9" * 300 + "'\n" + code(30)], at), ("/r", "/.env.local", ["\n".join(f"K_{k}=12345678" for k in range(60))], at), ("/r", "/g.py", ["# Code generated by x. DO NOT EDIT.\n", code(10)], at), ("/r", "/e.py", ["", None], at), ("/vendor", "/own.py", [code(11)], at),
    )
    want = {"/r/vendor/h.io/lib/a.go": "vendored", "/r/deps/lib-1.2.3/a.py": "vendored", "/r/node_modules/@x/a/b.js": "vendored", "/r/a.pb.go": "generated", "/r/api/gen/a.go": "generated", "/r/g.py": "generated", "/r/x.min.js": "minified", "/r/m.js": "minified", "/r/d.py": "data", "/r/d2.go": "data"}
    assert got == {p: want.get(p, "handwritten") for p in got} and len(got) == 20


def test_copies_with_edits_across_codebases(spark):
    common = "\n".join(f"    if err_{k % 3} != nil {{ return wrapped_error_{k % 3} }}" for k in range(12))
    original, edited = code("o", 30) + "\n" + common, code("o", 27) + "\n" + code("edit", 2) + "\n" + common
    files = [
        ("/a", "/orig.py", [original], D(2024, 1, 1)), ("/b", "/copy.py", [edited], D(2025, 1, 1)), ("/b", "/copy2.py", [edited], D(2025, 1, 1)), ("/a", "/twin.py", [original], D(2025, 1, 1)), ("/c", "/vendor/lib/x.py", [code("v")], D(2025, 1, 1)), ("/d", "/early.py", [code("v")], D(2020, 1, 1)),
        ("/e", "/part.py", [code("o", 10) + "\n" + code("p", 10)], D(2025, 1, 1)), ("/e", "/tiny.py", ["\n".join(code("o", 30).split("\n")[:4])], D(2025, 1, 1)), ("/g", "/common.py", [common + "\n" + code("q", 9)], None),
    ]
    df = rows(spark, *files)
    assert links(df) == {"/b/copy.py": "/a/orig.py", "/b/copy2.py": "/a/orig.py", "/c/vendor/lib/x.py": "/d/early.py", "/e/tiny.py": "/a/orig.py"}
    assert links(df, "/c/vendor") == {"/b/copy.py": "/a/orig.py", "/b/copy2.py": "/a/orig.py", "/d/early.py": "/c/vendor/lib/x.py", "/e/tiny.py": "/a/orig.py"}
    got = {r.file_path: r.evidence for r in classify_files(df.unionByName(df)).collect() if r.kind == "vendored"}
    assert got == {"/b/copy.py": "copy", "/b/copy2.py": "copy", "/c/vendor/lib/x.py": "path", "/d/early.py": "copy", "/e/tiny.py": "copy"}


def links(df, vendored="-"):
    """Each copy's path with that of the file it is held by."""
    files = df.groupBy("cwd", "file_path").agg(F.min("created_at").cast("timestamp").alias("dated")).withColumn("vendored", F.col("file_path").startswith(vendored))
    found = find_copies(line_index(df), files).collect()
    assert len({r.file_path for r in found}) == len(found)
    return {r.file_path: r.other_path for r in found}


def brute(files, contained=0.8):
    """Of files (cwd, path, set of lines, date) those that an earlier file of another codebase holds."""
    return {p for c, p, x, d in files if any(c != c2 and (d2, p2) < (d, p) and len(x & y) >= (math.ceil(contained * len(x)) if len(x) >= 8 else len(x)) for c2, p2, y, d2 in files)}


def test_copies_against_all_pairs(spark):
    rng = random.Random(5)
    files = []
    for family in range(6):
        text = [f"statement number {k} of family {family} here" for k in range(30)]
        for k in range(12):
            for j in range(rng.randrange(4)):  # versions drift away from the first
                text[rng.randrange(len(text))] = f"edited line {rng.randrange(10**6)} in family {family}"
            files.append((f"/c{rng.randrange(5)}", f"/f{family}_{k}.py", list(text), D(2025, 1, 1 + rng.randrange(20))))
    files = [(c, c + p, t, at) for c, p, t, at in files]
    df = rows(spark, *[(c, p.removeprefix(c), ["\n".join(t)], at) for c, p, t, at in files])
    got = set(links(df))
    assert got == brute([(c, p, set(t), at) for c, p, t, at in files]) and 10 < len(got) < len(files)


def test_small_copies(spark):
    small = "alpha_value = compute_alpha(first)\nbeta_value = compute_beta(second)"
    common = [(f"/r{k}", f"/u{k}.py", [f"import common_module_of_all\n{code(k, 3)}"], D(2025, 1, 1)) for k in range(12)]
    df = rows(spark, ("/a", "/s.py", [small], D(2024, 1, 1)), ("/b", "/s.py", [small], D(2025, 1, 1)), ("/c", "/t.py", [small + "\n" + code("w", 2)], D(2025, 1, 1)), ("/d", "/one.py", ["import common_module_of_all"], D(2025, 1, 1)), *common)
    assert links(df) == {"/b/s.py": "/a/s.py"}


def test_a_file_in_many_codebases(spark):
    df = rows(spark, *[(f"/r{k}", "/x.py", [code("m", 12)], D(2025, 1, 1 + k % 20)) for k in range(60)])
    got = classify_files(df).collect()
    assert sorted(r.kind for r in got).count("handwritten") == 1 and len(got) == 60 and len(links(df)) == 59


def test_empty_and_long(spark):
    assert classify_files(rows(spark, ("/r", "/a.py", ["x"], None)).limit(0)).count() == 0
    got = kinds(spark, ("/r", "/long.py", [code("z", 30_000)], None), ("/r", "/line.py", ["x = '" + "y" * 1_000_000 + "'"], None))
    assert got["/r/long.py"] == "handwritten" and composition("")[0] == 0


MINIFIED = "(function(e,t){if(e&&t){for(var n=0;n<e.length;n++){t[n]=e[n]^(n<<3);}return(t.x=e.y,t)}else{e.q=t.z+1}})(window,document);" * 8


@pytest.mark.parametrize("text,path", [(";" + MINIFIED, "a.js"), ("/*! lib 1.2 */!" + MINIFIED, "a.js"), ("--i;" + MINIFIED, "a"), ("/* a\n * b */" + MINIFIED, "a.js"), ("*{box-sizing:border-box;margin:0}" * 20, "a.css"), ("#app{color:#fff;top:0}.b>p{left:1px}" * 20, "a.css"), ("<!-- x --><script>" + MINIFIED, "a.html")])
def test_long_lines_after_a_marker_are_measured(text, path):
    chars, _, space, _, dense, _ = composition(text, path)
    assert dense >= 0.5 * chars and space <= 0.12 * chars and chars >= 300


def test_comments_are_not_measured():
    long = "x" * 400
    for line, path in ((f"# {long}", "a.py"), (f"// {long}", "a.js"), (f"/* {long} */", "a.css"), (f"/* {long}", "a.css"), (f"-- {long}", "a.sql"), (f"; {long}", "a.ini"), (" * said", "a.js"), ("# short", "a"), ("/* a */ // b", "a.go"), ("*/", "a.c")):
        assert composition(line, path)[0] == 0
    assert composition("/* a */ x = 1;", "a.js")[0] == 6


def test_minified_file_that_begins_like_a_comment(spark):
    rows = [("/r/a", "/r/a/app.js", ";" + MINIFIED), ("/r/a", "/r/a/site.css", "*{box-sizing:border-box;margin:0}" * 20), ("/r/a", "/r/a/own.py", "# a note\n" + "x = compute(y)\n" * 30)]
    df = spark.createDataFrame([(c, p, 1, None, t) for c, p, t in rows], "cwd string, file_path string, start_line int, created_at timestamp, content string")
    assert {r.file_path: r.kind for r in classify_files(df).collect()} == {"/r/a/app.js": "minified", "/r/a/site.css": "minified", "/r/a/own.py": "handwritten"}
