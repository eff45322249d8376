import numpy as np

from seamline.llm.neighbors import estimate, pack, rotation, rounded, similar_pairs, similar_vectors, unit_vectors

RNG = np.random.default_rng(3)
SCHEMA = "id long, embedding array<float>, key int, cell string"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(ids[k] if ids else k, None if v is None else [float(a) for a in v], 1, "c") for k, v in enumerate(x)], SCHEMA)


def test_estimates_are_unbiased_and_bounded():
    dim = 128
    turn = rotation(dim)
    assert np.allclose(turn @ turn.T, np.eye(dim), atol=1e-4)
    v = RNG.standard_normal((400, dim)).astype(np.float32)
    q = RNG.standard_normal((50, dim)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1)[:, None]
    length = np.linalg.norm(v, axis=1)
    own = np.abs(v @ turn.T).sum(1) / np.sqrt(dim) / length
    est, slack = estimate(*rounded(q @ turn.T), pack(v @ turn.T > 0), own, length)
    error = (est - q @ v.T) / slack
    assert abs(error.mean()) < 0.05 and (np.abs(error) > 3).mean() < 0.01


def clustered(n, copies=4):
    base = RNG.standard_normal((n, 64))
    return np.concatenate([base] + [base + 0.3 * RNG.standard_normal((n, 64)) for _ in range(copies - 1)])


def exact(x, k, least):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(s)):
        out |= {(min(i, int(j)), max(i, int(j))) for j in np.argsort(-s[i])[:k] if s[i, j] >= least}
    return out


def test_recall(spark):
    x = clustered(300)
    got = {(r.id_a, r.id_b) for r in similar_pairs(similar_vectors(frame(spark, x), "id", "embedding", 64, 10, 0.85)).collect()}
    want = exact(x, 10, 0.85)
    assert len(want) > 1000 and len(got & want) / len(want) >= 0.97 and not got - want
    small = {(r.id_a, r.id_b) for r in similar_pairs(similar_vectors(frame(spark, x), "id", "embedding", 64, 10, 0.85, block=16)).collect()}
    assert small == got, "blocks must not change the result"


def test_queries_against_all(spark):
    x = RNG.standard_normal((600, 64))
    df = frame(spark, x)
    asked = df.filter("id % 20 = 0").select("id")
    got = similar_vectors(df, "id", "embedding", 64, 10, probes=10_000, queries=asked).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(0, 600, 20) for j in np.argsort(-s[i])[:10]}
    assert len({(r.id, r.other) for r in got} & want) / len(want) >= 0.98 and len(got) == 300
    assert all(abs(r.similarity - s[r.id, r.other]) < 1e-5 for r in got)


def test_bad_equal_and_few_vectors(spark):
    good = [[1.0] + [0.0] * 63, [1.0, 0.1] + [0.0] * 62]
    odd = [None, [0.0] * 64, [1.0] * 3, [float("nan")] * 64, [float("inf")] * 64, []]
    df = frame(spark, good + odd)
    assert unit_vectors(df, "id", "embedding", 64).count() == 2
    assert [(r.id_a, r.id_b) for r in similar_pairs(similar_vectors(df.unionByName(df), "id", "embedding", 64, 10, 0.85)).collect()] == [(0, 1)]
    assert similar_vectors(df.limit(0), "id", "embedding", 64).count() == 0 and similar_vectors(frame(spark, odd), "id", "embedding", 64).count() == 0
    assert similar_vectors(frame(spark, good[:1]), "id", "embedding", 64).count() == 0


def test_a_third_of_all_are_equal(spark):
    x = np.concatenate([np.tile(RNG.standard_normal(64), (200, 1)) * 2, clustered(100)])
    got = similar_vectors(frame(spark, x), "id", "embedding", 64, 10, 0.85)
    per = {}
    for r in got.collect():
        per.setdefault(r.id, set()).add(r.other)
    assert all(len(per[i]) == 10 and per[i] <= set(range(200)) for i in range(200))


def test_more_vectors_than_a_step_takes(spark):
    base = RNG.standard_normal((5000, 8))
    x = np.concatenate([base, base * 2 + 1e-4])
    got = similar_vectors(frame(spark, x).repartition(1), "id", "embedding", 8, 2, 0.999).collect()
    assert {(r.id, r.other) for r in got} >= {(k, k + 5000) for k in range(5000)}
