import math
import random

import pytest
from datetime import datetime as D

from seamline.llm.fusion import fused, latest_scores, top
from seamline.llm.mixing import mix, shares, sized_documents

SCORES = ["a", "b"]
SCHEMA = "q bigint, id string, a double, b double, at timestamp_ntz, grp string, item int"
NAN = float("nan")


def brute(rows, k=60):
    last = {}
    for q, i, a, b, at, *_ in rows:
        if q is None or i is None:
            continue
        clean = tuple(None if x is None or math.isnan(x) else x for x in (a, b))
        key = (at is not None, at or D.min, tuple((x is not None, x or 0) for x in clean))
        if (q, i) not in last or key > last[q, i][0]:
            last[q, i] = (key, clean)
    out = {}
    for (q, i), (_, s) in last.items():
        for c in range(2):
            others = [x[c] for (p, _), (_, x) in last.items() if p == q and x[c] is not None]
            rank = 1 + (len(others) if s[c] is None else sum(x > s[c] for x in others))
            out[q, i] = out.get((q, i), 0) + 1 / (k + rank)
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    pick = lambda: rng.choice([None, NAN, 1e9, -5.0, 0.5, rng.random()])
    data = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *"abcdefghijkl"]), pick(), pick(), rng.choice([None, D(2025, 1, rng.randrange(1, 28))]), "g", 1) for _ in range(150)]
    data += data[:20]
    df = spark.createDataFrame(data, SCHEMA)
    ranking = fused(latest_scores(df, "q", "id", SCORES, "at"), SCORES)
    got = {(r.grp, r.item): r.rrf for r in ranking.collect()}
    want = brute(data)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    best = {(r.grp, r.item) for r in top(ranking, 3).collect()}
    for q in (1, 2, 3):
        order = sorted(((-round(s, 12), i) for (p, i), s in want.items() if p == q))[:3]
        assert {i for p, i in best if p == q} == {i for _, i in order}
    assert fused(latest_scores(df.limit(0), "q", "id", SCORES, "at"), SCORES).count() == 0


def test_a_hot_query(spark):
    df = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS q", "cast(id as string) AS id", "cast(id AS double) AS a", "cast(NULL AS double) AS b", "timestamp_ntz'2025-01-01' AS at")
    got = top(fused(latest_scores(df, "q", "id", SCORES, "at"), SCORES), 3).filter("grp = 1")
    assert sorted(r.item for r in got.collect()) == ["8991", "8994", "8997"]


DOCS = "doc_id bigint, text string, source string, n_tokens int"
TARGETS = "source string, target_share double, max_repeats int"


def test_mixing(spark):
    rng = random.Random(3)
    docs = [(i, "word " * rng.randrange(1, 40), rng.choice(["Big", "big ", "BIG"]), 9) for i in range(300)]
    docs += [(1000 + i, "word " * 20, "small", 9) for i in range(10)] + [(2000 + i, "word", "unasked", 9) for i in range(5)] + [(3000, None, "big", 9), (3001, "x", None, 9), (3002, "x", "  ", 9), (3003, "", "small", 9)]
    targets = spark.createDataFrame([(" big", 0.3, 2), ("small", 0.5, 3), ("absent", 0.2, 1), (None, 0.1, 1)], TARGETS)
    sized = sized_documents(spark.createDataFrame(docs + docs[:9], DOCS))
    rows = {r.doc_id: r for r in mix(sized, targets).collect()}
    assert len(rows) == len(docs)
    have = {s: sum(r.n_tokens for r in rows.values() if r.source == s) for s in ("big", "small")}
    total = sum(have.values())
    used = {s: sum(r.n_tokens * r.n_uses for r in rows.values() if r.source == s) for s in ("big", "small", "unasked", None)}
    assert used["small"] == 3 * have["small"] and all(rows[1000 + i].n_uses == 3 for i in range(10))
    largest = max(r.n_tokens for r in rows.values())
    assert int(0.3 * total) - largest < used["big"] <= int(0.3 * total) and used["unasked"] == used[None] == 0 and rows[3000].n_uses == 0
    report = {r.source: r for r in shares(mix(sized, targets), targets).collect()}
    assert {s: r.state for s, r in report.items()} == {"big": "over", "small": "short", "absent": "absent", "unasked": "no target", None: "no target"}
    assert math.isclose(sum(r.actual_share for r in report.values()), 1, abs_tol=1e-5) and math.isclose(report["big"].actual_share, used["big"] / (used["big"] + used["small"]), abs_tol=1e-6)
    more = {r.source: r.used_tokens for r in shares(mix(sized, targets, total_tokens=10 * total), targets, 10 * total).collect()}
    assert more["big"] == 2 * have["big"]
    even = {r.source: r for r in shares(mix(sized, targets, fit="shares"), targets, fit="shares").collect()}
    assert {s: r.state for s, r in even.items()} == {"big": "met", "small": "met", "absent": "absent", "unasked": "no target", None: "no target"}
    assert even["small"].used_tokens == 3 * have["small"] and abs(even["big"].used_tokens - 3 * have["small"] * 0.3 / 0.5) <= largest
    less = {r.source: r for r in shares(mix(sized, targets, 100, fit="shares"), targets, 100, fit="shares").collect()}
    assert less["small"].state == less["big"].state == "met" and less["small"].used_tokens <= 62
    with pytest.raises(ValueError):
        mix(sized, targets, fit="some")
    again = {r.doc_id: r.n_uses for r in mix(sized.repartition(3), targets).collect()}
    assert again == {d: r.n_uses for d, r in rows.items()}, "the draw must not depend on the layout"


def test_mixing_nothing(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mix(sized_documents(docs), targets).count() == 0
    assert [r.state for r in shares(mix(sized_documents(docs), targets), targets).collect()] == ["absent"]
    some = spark.createDataFrame([(1, "x", "a", 1)], DOCS)
    assert [r.n_uses for r in mix(sized_documents(some), targets.limit(0)).collect()] == [0]
