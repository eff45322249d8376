import pytest
import random

from seamline.operators.hierarchy import descendants, parent_links, resolve_hierarchy

SCHEMA = "node_id bigint, cwd string, caller string, callee string, children array<string>"


def brute(rows):
    """Expected (id -> root, depth, below) by walking parents."""
    byid = {r[0]: r for r in rows if r[0] is not None}
    key = {}
    for i, r in sorted(byid.items()):
        if r[1] is not None and r[3]:
            key.setdefault((r[1], r[3]), i)
    parent = {}
    for i, r in byid.items():
        if r[1] is None:
            continue
        if r[2] and (r[1], r[2]) in key:
            parent.setdefault(i, set()).add(key[r[1], r[2]])
        for k in r[4] or []:
            if k and (r[1], k) in key:
                parent.setdefault(key[r[1], k], set()).add(i)
    parent = {i: min(p) for i, p in parent.items()}
    out, below = {}, {i: 0 for i in byid}
    for i in byid:
        at, seen = i, []
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            out[i] = None
        else:
            out[i] = (at, len(seen))
            for a in [*seen[1:], at] if seen else []:
                below[a] += 1
    return {i: (-1, -1, -1) if o is None else (o[0], o[1], below[i]) for i, o in out.items()}


def check(spark, data):
    got = resolve_hierarchy(parent_links(spark.createDataFrame(data, SCHEMA))).collect()
    assert {r.id: (r.root_id, r.depth_no, r.n_below) for r in got} == brute(data)
    assert len(got) == len({r[0] for r in data if r[0] is not None})


def test_links_told_either_way_and_loops(spark):
    check(
        spark,
        [
            (1, "a", None, "r", ["x", None, "x", "gone"]),
            (2, "a", None, "x", None),
            (3, "a", "x", "y", []),
            (3, "a", "x", "y", []),
            (4, "b", "r", "z", None),
            (5, "a", "q", "p", None),
            (6, "a", "p", "q", None),
            (7, "a", "q", "hang", None),
            (8, "a", "self", "self", None),
            (9, None, "r", "r", None),
            (10, "a", "r", None, None),
            (11, "a", "", "", ["r2"]),
            (None, "a", "r", "nobody", None),
        ],
    )


def test_chain_star_and_empty(spark):
    chain = [(i, "c", f"n{i - 1}" if i else None, f"n{i}", None) for i in range(300)]
    star = [(1000 + i, "c", "n150", f"s{i}", None) for i in range(200)]
    check(spark, chain + star)
    assert resolve_hierarchy(parent_links(spark.createDataFrame([], SCHEMA))).count() == 0


def test_random_forests(spark):
    rng = random.Random(7)
    data = []
    for i in range(400):
        p = rng.randrange(-40, 400)
        data.append((i, f"c{i % 3}", f"m{p}" if p >= 0 else None, f"m{i}", [f"m{rng.randrange(400)}"] if rng.random() < 0.05 else None))
    # a link told twice may contradict: keep one teller per child
    told = {(d[1], d[3]) for d in data if d[2]}
    data = [(i, c, p, n, [k for k in ks if (c, k) not in told] if ks else ks) for i, c, p, n, ks in data]
    check(spark, data)


def test_paths_and_descendants_with_clashing_columns(spark):
    data = [(1, "a", None, "r", None), (2, "a", "r", "x", None), (3, "a", "x", "y", None), (4, "a", "l", "l", None)]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS id", "2 AS size", "'q' AS name", "3 AS depth_no")
    made = resolve_hierarchy(parent_links(df), with_paths=True)
    assert {r.id: r.path for r in made.collect()} == {1: "r", 2: "r > x", 3: "r > x > y", 4: None}
    assert sorted(tuple(r) for r in descendants(made).collect()) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]


def test_descendants_of_the_whole_tree(spark):
    import os

    from seamline.plans.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    made = QUERIES["p2_descendants"](spark, folder)
    below = QUERIES["p2_found"](spark, folder).filter("n_below > 0")
    assert made.columns == ["ancestor_id", "id", "levels"] and {tuple(r) for r in made.groupBy("ancestor_id").count().collect()} == {(r.node_id, r.n_below) for r in below.collect()}
