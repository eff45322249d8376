import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.operators import quantizer as qz
from seamline.operators import vectors as vx
from seamline.operators.evaluation import recall_and_mrr
from seamline.operators.hybrid import reciprocal_ranks, search
from seamline.sources import vectorfile

RNG = np.random.default_rng(42)


def table(spark, x, ids=None):
    return spark.createDataFrame([(ids[k] if ids else k, [float(a) for a in v]) for k, v in enumerate(x)], "id long, embedding array<float>")


def test_arithmetic(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], [])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(got[0], 0.96) and got[1:] == [0.0, None, None, 0.0]
    casts = spark.createDataFrame([([1.5, -2.5, 300.0, -1.0], bytearray(b"\x00\xff\x10"))], "v array<float>, b binary")
    r = casts.select(vx.to_ints(F.col("v")).alias("i"), vx.floats_to_bytes(F.col("v")).alias("y"), vx.bytes_to_floats(F.col("b")).alias("f")).first()
    assert r.i == [2, -3, 300, -1] and bytes(r.y) == b"\x02\x00\xff\x00" and r.f == [0.0, 255.0, 16.0]


def test_exact_top_k(spark):
    x = RNG.standard_normal((200, 16))
    df = table(spark, x)
    df = df.unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 16), (902, [1.0]), (903, [float("nan")] * 16)], df.schema))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = np.argsort(-(u @ u[7]))[:5].tolist()
    assert [r.id for r in vx.top_k(df.filter("id < 900"), x[7], 5).collect()] == want
    many = vx.top_k_many(df, df.filter("id < 40"), 5)
    got = {}
    for r in many.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for q in range(40):
        assert [got[q][k] for k in range(1, 6)] == np.argsort(-(u @ u[q]))[:5].tolist()
    assert all(r.query_id != r.id for r in vx.top_k_many(df, df.filter("id < 5"), 2, exclude_self=True).collect())
    assert vx.top_k_many(df, df.limit(0), 5).count() == 0 and vx.top_k(df.limit(0), [1.0] * 16, 3).count() == 0
    with pytest.raises(ValueError):
        vx.top_k(df, x[0], 0)


def test_codebook_fills_its_levels():
    for dim in (64, 1536):
        c, b = qz.codebook(dim, 4)
        assert len(c) == 16 and len(b) == 15 and (np.diff(c) > 0).all() and np.allclose(c, -c[::-1], atol=1e-4)
        x = RNG.standard_normal((2000, dim))
        used = np.bincount(np.searchsorted(b, (x / np.linalg.norm(x, axis=1)[:, None]).ravel(), side="right"), minlength=16)
        assert (used > 0).all()
    with pytest.raises(ValueError):
        qz.codebook(8, 2, init="other")


@pytest.mark.parametrize("bits", [2, 3, 4])
def test_packing_round_trip(bits):
    codes = RNG.integers(0, 1 << bits, (50, 37), dtype=np.uint8)
    packed = qz.pack(codes, bits)
    assert packed.shape[1] == -(-37 * bits // 8) and (qz.unpack(packed, bits, 37) == codes).all()


def test_quantizer_accuracy_and_rotation():
    q = qz.Quantizer(128, 4)
    r = qz.rotation(128, 42)
    assert np.allclose(r @ r.T, np.eye(128)) and (qz.rotation(128, 42) == r).all()
    x = RNG.standard_normal((300, 128)) * 3
    norms, codes = q.encode(x)
    back = q.decode(norms, codes)
    cos = (back * x).sum(1) / np.linalg.norm(back, axis=1) / np.linalg.norm(x, axis=1)
    assert codes.max() <= 15 and cos.min() > 0.98
    query = RNG.standard_normal(128)
    exact = back @ query / np.linalg.norm(back, axis=1) / np.linalg.norm(query)
    assert np.abs(q.score(q.prepare(query), norms, codes)[0] - exact).max() < 1e-5
    n0, c0 = q.encode(np.zeros(128))
    assert n0[0] == 0 and not c0.any() and q.score(q.prepare(query), n0, c0)[0, 0] == 0
    assert abs(q.ratio() - 32 * 128 / (32 + 512)) < 1e-9
    for bad in (np.full(128, np.nan), np.zeros(5)):
        with pytest.raises(ValueError):
            q.encode(bad)
    for args in ((1, 4), (8, 5)):
        with pytest.raises(ValueError):
            qz.Quantizer(*args)


def test_index_search(spark, rows, tmp_path):
    q = qz.Quantizer(64, 4, seed=7)
    x = RNG.standard_normal((100, 64))
    index = q.quantize(table(spark, x).unionByName(spark.createDataFrame([(500, None), (501, [1.0])], "id long, embedding array<float>"))).selectExpr("cast(id as string) id", "norm", "codes")
    assert index.count() == 100
    for k in (3, 50):
        got = q.search(index, x[k] + 0.05 * RNG.standard_normal(64), 3).collect()
        assert got[0].id == str(k) and got[0].similarity > 0.9 and got[0].similarity >= got[1].similarity >= got[2].similarity
    only = spark.createDataFrame([("4",), ("5",)], "id string")
    assert sorted(r.id for r in q.search(index, x[3], 5, only).collect()) == ["4", "5"]
    assert q.search(index.limit(0), x[3], 5).count() == 0
    for bad in ((x[3], 0), (x[3][:5], 3)):
        with pytest.raises(ValueError):
            q.search(index, *bad)
    many = q.search_many(index, table(spark, x[:9]), 2).collect()
    assert len(many) == 18 and all(int(r.id) == r.query_id for r in many if r["rank"] == 1)
    assert q.search_many(index, table(spark, x).limit(0), 2).count() == 0
    assert rows(qz.footprint(index)) == [(100, 3600)]
    assert qz.compact(index, only).count() == 2 and qz.delete_rows(index, only).count() == 98 and qz.replace_rows(index, index.limit(3)).count() == 100
    back = {int(r.id): r.embedding for r in q.dequantize(index).collect()}
    assert min(np.dot(back[k], x[k]) / np.linalg.norm(back[k]) / np.linalg.norm(x[k]) for k in range(100)) > 0.97
    path = f"{tmp_path}/v.tqv"
    vectorfile.write(index, path, 64, 4)
    assert rows(vectorfile.read(spark, path)) == rows(index)
    dim, bits, records = vectorfile.parse(vectorfile.build(64, 4, [("id", 1.5, b"\1" * 32)], version=1))
    assert (dim, bits, records) == (64, 4, [("id", 1.5, b"\1" * 32)])
    for bad in (b"", b"TQLM" + b"\0" * 12, open(path, "rb").read()[:40]):
        with pytest.raises(Exception):  # noqa: B017
            vectorfile.parse(bad)


def test_fusion_and_measures(spark, rows):
    sem = spark.createDataFrame([("A", 1), ("B", 2)], "id string, rank int")
    lex = spark.createDataFrame([("B", 1), ("C", 2)], "id string, rank int")
    got = {r.id: r.rrf for r in reciprocal_ranks(sem, lex).collect()}
    assert math.isclose(got["B"], 1 / 62 + 1 / 61) and math.isclose(got["A"], 1 / 61) and math.isclose(got["C"], 1 / 62)
    ranked = spark.createDataFrame([(1, "a", 1), (2, "b", 4)], "query_id int, id string, rank int")
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, id string")
    r = recall_and_mrr(ranked, truth).first()
    assert (r.n_queries, r.recall_at_1, r.recall_at_3, r.recall_at_5) == (3, 0.333333333, 0.333333333, 0.666666667) and math.isclose(r.mrr, 1.25 / 3, abs_tol=1e-8)


def test_hybrid_scope(spark):
    e = np.eye(4)
    memories = spark.createDataFrame(
        [(f"m{k}", f"f{k}", p, 1, 3, [float(a) for a in e[k]]) for k, p in enumerate(["/r/a.go", "/r/b.go", "/r2/a.go"])], "id string, symbol_name string, path string, line_start int, line_end int, embedding array<float>"
    )
    files = spark.createDataFrame([("/r/a.go", "x\nProcessPayment()\n"), ("/r/b.go", "SendNotification"), ("/r2/a.go", "ProcessPayment"), ("/r/n.txt", "ProcessPayment")], "path string, text string")
    ids = lambda *a: [r.id for r in search(memories, files, *a).collect()]
    assert ids("ProcessPayment", [0.0] * 4, 5)[0] == "m0"
    assert set(ids("ProcessPayment", e[2], 5, "/r")) == {"m0"}
    assert set(ids("ProcessPayment|SendNotification", [0.0] * 4, 5, "/r")) == {"m0", "m1"}
    assert ids(" ", e[1], 5, "/r") == ["m1"] and ids("zzz", e[3], 5) == []
    with pytest.raises(ValueError):
        search(memories, files, "x", e[0], 0)


def test_records_and_arrays(spark, rows, tmp_path):
    from seamline.sources.arrays import read_npy

    q = qz.Quantizer(8, 3)
    x = RNG.standard_normal((25, 8)).astype(np.float32)
    index = q.quantize(table(spark, x))
    assert rows(qz.deserialize(qz.serialize(index), 8, 3)) == rows(index)
    with pytest.raises(Exception):  # noqa: B017
        qz.deserialize(qz.serialize(index), 9, 4).collect()
    np.save(f"{tmp_path}/x.npy", x)
    got = {r.id: r.embedding for r in read_npy(spark, f"{tmp_path}/x.npy", 7).collect()}
    assert len(got) == 25 and all(np.allclose(got[k], x[k]) for k in got)
    text = spark.createDataFrame([("aé",), ("",), (None,)], "t string").select(vx.text_to_floats(F.col("t")).alias("v"))
    assert [r.v for r in text.collect()] == [[97.0, 195.0, 169.0], [], None]
    assert [r[0] for r in text.select(vx.floats_to_text(F.col("v"))).collect()] == ["aé", "", None]


def test_hybrid_search_of_parts_of_files(spark, tmp_path):
    from seamline.plans.queries import QUERIES

    x = RNG.standard_normal((40, 64)).astype(np.float32).astype(float)
    parts = []
    for k in range(40):  # four parts of five lines in each of ten files, some words in the last lines only
        word = {0: "prune", 3: "merge()", 7: "unpruned"}.get(k % 11, "other")
        parts.append((f"id{k:02}", f"/r/f{k // 4}.go", "\n".join(["a", "b", "c", f"  {word}", "d"]), 5 * (k % 4) + 1, 5 * (k % 4) + 5))
    spark.createDataFrame(parts, "id string, file_path string, content string, start_line int, end_line int").write.parquet(f"{tmp_path}/chunks.parquet")
    memories = [(p[0], f"s{k}", p[1], p[3], p[4], [float(a) for a in x[k]]) for k, p in enumerate(parts)]
    memories.append(("nan", "s", "/r/f0.go", 90, 99, [float("nan")] * 64))
    spark.createDataFrame(memories, "id string, symbol_name string, cwd string, line_start int, line_end int, embedding array<float>").write.parquet(f"{tmp_path}/memory_items.parquet")

    near = sorted(((-float(x[0] @ v / np.linalg.norm(x[0]) / np.linalg.norm(v)), p[0]) for v, p in zip(x, parts)))[:30]
    lists = [[i for s, i in near if -s >= 0.10], [p[0] for p in sorted(parts, key=lambda p: (p[1], p[3], p[4], p[0])) if "prune" in p[2] or "merge" in p[2]][:30]]
    score = {i: sum(1 / (60 + at.index(i) + 1) for at in lists if i in at) for i in {i for at in lists for i in at}}
    want = sorted(score, key=lambda i: (-round(score[i], 12), i))[:10]
    got = QUERIES["hybrid_search"](spark, str(tmp_path)).collect()
    assert [r.id for r in got] == want and all(math.isclose(r.rrf, score[r.id]) for r in got)


def test_top_k_many_of_queries_of_several_lengths(spark, rows):
    odd = [[1.0], [], [1.0, 2.0, 3.0], None]
    df = table(spark, RNG.standard_normal((20, 4)), list(range(10, 30))).unionByName(spark.createDataFrame(list(enumerate(odd)), "id long, embedding array<float>"))
    got = {r.query_id: r.id for r in vx.top_k_many(df, df.orderBy("id"), 1).collect()}
    assert got == {k: k for k in [0, 2, *range(10, 30)]}


def test_quantized_search_of_several_blocks(spark, rows, monkeypatch):
    x = RNG.standard_normal((30, 8))
    q = qz.Quantizer(8, 4)
    index, asked = q.quantize(table(spark, x)), table(spark, x)
    found = lambda **how: rows(q.search_many(index, asked, 3, **how).select("query_id", "id", "rank"))
    whole = found()
    monkeypatch.setattr(vx, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vx, "ROW_BLOCK", 11)
    assert len(whole) == 90 and found() == whole and found(most_bytes=0) == whole
    best = lambda **how: rows(vx.top_k_many(asked, asked.filter("id % 2 = 0"), 4, exclude_self=True, **how).select("query_id", "id", "rank"))
    assert best(most_bytes=0) == best() and len(best()) == 60 and vx.top_k_many(asked.limit(0), asked, 2, most_bytes=0).count() == 0
