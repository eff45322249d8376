import os
import urllib.error

import pytest
from pyspark.sql import functions as F

from seamline.config import Config, read_env_file
from seamline.engine import Engine
from seamline.operators.incremental import Ledger
from seamline.sources import embedding
from seamline.sources.embedding import HashEmbedder, HttpEmbedder, embed
from seamline.sources.scan import ignored, list_tree, scan_tree, text_files, to_json_rows, walk, write_lines
from seamline.streaming.sync import consume, event_windows, schedule, sweep

FILES = {
    "main.go": "package main\n\n// main runs\nfunc main() {\n\tprocess()\n}\n\nfunc process() {\n\t// TODO: implement logic\n\tconnect()\n}\n",
    "db/db.go": "package db\n\nfunc connect() error {\n\treturn nil\n}\n",
    "app/svc.py": "import os\n\nclass Service:\n    def run(self):\n        self.stop()\n\n    def stop(self):\n        pass\n",
    "infra/main.tf": 'resource "aws_vpc" "main" {\n  cidr = "x"\n}\n',
    "__init__.py": "X = 1\n",
    ".gitignore": "ignored/\n*.log\n/skip.py\n",
    "ignored/a.go": "package a\n",
    "skip.py": "pass\n",
    "x.log": "TODO",
    "node_modules/lib/index.py": "pass\n",
    "bin.py": "a\0b",
    "empty.py": "",
    "notes.txt": "text",
}


def lay(root, files):
    for name, body in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(body)


def test_listing(spark, rows, tmp_path):
    root = str(tmp_path / "r")
    lay(root, FILES)
    os.symlink(root, os.path.join(root, "db", "loop"))
    found = sorted(os.path.relpath(p, os.path.realpath(root)) for p in walk(root))
    assert found == ["__init__.py", "app/svc.py", "bin.py", "db/db.go", "empty.py", "infra/main.tf", "main.go"]
    got = sorted(os.path.relpath(r.path, os.path.realpath(root)) for r in scan_tree(spark, [root]).collect())
    assert got == ["__init__.py", "app/svc.py", "db/db.go", "infra/main.tf", "main.go"]
    for spread in (1, 2, 3):  # folders left to the executors
        assert sorted(r.path for r in list_tree(spark, [root], spread=spread).collect()) == sorted(walk(root))
    assert len(list(walk(os.path.join(root, "notes.txt"), ()))) == 1 and not list(walk(os.path.join(root, "notes.txt"))) and not list(walk(root + "/none"))
    assert ignored("a/b.log", ["*.log"]) and ignored("x/dist/y", ["dist"]) and not ignored("distinct", ["dist"])
    assert text_files(spark, root + "/app").count() == 1
    write_lines(to_json_rows(spark.createDataFrame([(1, "a")], "k int, v string")), f"{tmp_path}/out")
    assert rows(spark.read.text(f"{tmp_path}/out")) == [('{"k":1,"v":"a"}',)]


def test_life_of_a_codebase(spark, tmp_path):
    root, other = str(tmp_path / "r"), str(tmp_path / "r2")
    lay(root, FILES)
    lay(other, {"main.go": FILES["main.go"]})
    engine = Engine(spark, Config(f"{tmp_path}/store", dim=32))
    assert engine.codebases().count() == 0 and engine.search("x").count() == 0
    assert engine.sync(root) == {"added": 5, "modified": 0, "deleted": 0, "failed": 0}
    assert engine.sync(root) == {"added": 0, "modified": 0, "deleted": 0, "failed": 0}
    assert engine.sync(other)["added"] == 1
    base = os.path.realpath(root)
    assert [(r.path, r.line_no) for r in engine.grep("TODO", cwd=root).collect()] == [(f"{base}/main.go", 9)]
    assert engine.grep(r"func [a-z]+\(", True).count() == 5 and engine.grep("pass", extensions=("py",)).count() == 1
    hits = engine.search("process", root, 3).collect()
    assert hits[0].path == f"{base}/main.go" and "process" in hits[0].content and all(h.path.startswith(base + "/") for h in hits)
    report = engine.call_graph("main", root, "callee", 3).collect()
    assert [(r.depth, r.name) for r in sorted(report, key=lambda r: r.depth)] == [(1, "process"), (2, "connect")]
    with pytest.raises(ValueError):
        engine.call_graph("main", str(tmp_path))
    lay(root, {"db/db.go": "package db\n\nfunc open() error {\n\treturn nil\n}\n", "new.yaml": "- name: a\n"})
    os.remove(os.path.join(root, "app/svc.py"))
    assert engine.sync(root) == {"added": 1, "modified": 1, "deleted": 1, "failed": 0}
    assert engine.call_graph("main", root, "callee", 3).filter("name = 'connect'").count() == 0
    assert engine.table("chunks", base).filter("path LIKE '%svc.py'").count() == 0
    assert engine.table("chunks").count() == engine.table("vectors").count() == engine.stats().first().n_vectors
    assert set(sweep(engine)) == {base, os.path.realpath(other)}
    for name in os.listdir(root):
        os.system(f"rm -rf '{root}/{name}'")
    assert engine.sync(root)["deleted"] == 5 and engine.table("chunks", base).count() == 0 and engine.table("chunks").count() > 0
    q = schedule(engine, f"{tmp_path}/cp", once=True)
    assert q.awaitTermination(120)


def test_failed_embeddings_are_retried(spark, tmp_path):
    root = str(tmp_path / "r")
    lay(root, {k: FILES[k] for k in ("main.go", "app/svc.py")})
    whole = HashEmbedder(16)

    def flaky(text):
        if "stop" in text:
            raise ValueError("no vector today")
        return whole(text)

    assert Engine(spark, Config(f"{tmp_path}/s", dim=16), flaky).sync(root) == {"added": 1, "modified": 0, "deleted": 0, "failed": 1}
    engine = Engine(spark, Config(f"{tmp_path}/s", dim=16))
    assert engine.sync(root) == {"added": 1, "modified": 0, "deleted": 0, "failed": 0}
    assert embed(spark.createDataFrame([(1, None)], "id int, text string"), HashEmbedder(4)).first().embedding == [0.0] * 4


def test_http_embedder(monkeypatch):
    calls = []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def read(self, *a):
            return b'{"data":[{"embedding":[1.0,2.0]}]}'

    def urlopen(request, timeout):
        calls.append(request.full_url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, None)
        return Answer()

    monkeypatch.setattr(embedding.urllib.request, "urlopen", urlopen)
    monkeypatch.setattr(embedding.time, "sleep", lambda s: None)
    assert HttpEmbedder("http://h", "m", 2)("t") == [1.0, 2.0] and calls == ["http://h/embeddings"] * 3

    def refused(request, timeout):
        calls.append("x")
        raise urllib.error.HTTPError(request.full_url, 400, "bad", {}, None)

    monkeypatch.setattr(embedding.urllib.request, "urlopen", refused)
    calls.clear()
    with pytest.raises(urllib.error.HTTPError):
        HttpEmbedder("http://h", "m", 2)("t")
    assert calls == ["x"]


def test_settings(tmp_path):
    (tmp_path / "env").write_text("# c\nEMBEDDING_DIM=8\nBAD\nSEARCH_DEFAULT_LIMIT=x\n")
    assert read_env_file(f"{tmp_path}/none") == {}
    c = Config.load("s", f"{tmp_path}/env")
    assert (c.dim, c.default_limit) == (8, 10)


def test_stream_is_consumed_once(spark, rows, tmp_path):
    data = spark.range(100).selectExpr("'s' AS scope", "id AS seq", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) AS ts", "'v' AS event_type", "1.5D AS value")
    data.write.parquet(f"{tmp_path}/in")
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    stream = lambda: spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
    done = lambda: [r.seq for r in ledger.outputs("seq long").orderBy("seq").collect()]
    consume(spark, stream(), ledger, "scope", "seq", lambda df, n: df.select("seq"), f"{tmp_path}/c1").awaitTermination(120)
    assert done() == list(range(100))
    data.withColumn("seq", F.col("seq") + 50).write.mode("append").parquet(f"{tmp_path}/in")
    consume(spark, stream(), ledger, "scope", "seq", lambda df, n: df.select("seq").distinct(), f"{tmp_path}/c2").awaitTermination(120)
    assert done() == list(range(150)) and rows(ledger.processed().agg(F.sum(F.col("hi") - F.col("lo") + 1))) == [(150,)]
    q = event_windows(stream(), "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n_events for r in spark.sql("SELECT * FROM w").collect()) == 200


def test_only_changed_texts_are_chunked(spark, tmp_path, monkeypatch):
    import seamline.engine as module

    root, seen = str(tmp_path / "r"), []
    lay(root, FILES)
    real = module.chunk_files
    monkeypatch.setattr(module, "chunk_files", lambda df, *a: seen.append(sorted(os.path.basename(r.path) for r in df.select("path").collect())) or real(df, *a))
    engine = Engine(spark, Config(f"{tmp_path}/store", dim=16))
    told = {}
    assert engine.sync(root, told.__setitem__)["added"] == 5
    assert told == {"files": 5, "changes": 5, "embedded": engine.table("chunks").count(), "failed": 0}
    lay(root, {"infra/main.tf": FILES["infra/main.tf"] + "\n# outside of all blocks\n", "app/svc.py": FILES["app/svc.py"] + "\ndef more():\n    pass\n"})
    assert engine.sync(root) == {"added": 0, "modified": 1, "deleted": 0, "failed": 0}
    assert engine.sync(root) == {"added": 0, "modified": 0, "deleted": 0, "failed": 0}
    assert len(seen[0]) == 5 and seen[1:] == [["main.tf", "svc.py"], []]
