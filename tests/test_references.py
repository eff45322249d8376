from datetime import datetime as D

from seamline.operators.references import orphan_report, unresolved_references

NODES = "cwd string, symbol_name string, indexed_at timestamp_ntz, deleted_at timestamp_ntz, edge_id int"
EDGES = "edge_id bigint, cwd string, callee string, indexed_at timestamp_ntz, loaded_at timestamp_ntz, known boolean"
T1, T2, T3 = D(2025, 1, 1), D(2025, 2, 1), D(2025, 3, 1)


def test_states(spark, rows):
    nodes = spark.createDataFrame([("a", "C.f", T1, None, 1), ("a", "C.f", T1, None, 1), ("a", "g", T1, T2, 1), ("a", "h", T3, None, 1), ("a", "t", None, None, 1), (None, "f", T1, None, 1), ("a", None, T1, None, 1)], NODES)
    edges = spark.createDataFrame(
        [
            (1, "a", " f\t", T2, T2, True), (2, "a", "C.f", T2, T2, True), (3, "a", "g", T2, T2, True), (3, "a", "g", T2, T2, True), (4, "a", "h", T2, T3, True), (5, "a", "h", None, T3, True),
            (6, "b", "f", None, T2, True), (7, "a", "F", None, None, True), (8, "a", None, T1, T1, True), (9, "a", "  ", T1, T1, True), (10, None, "f", T1, T1, True), (11, "a", "t", T1, T1, True), (12, "a", ".f", T1, T1, True),
        ],
        EDGES,
    )
    got = unresolved_references(nodes, edges)
    assert rows(got.select("edge_id", "ref_state")) == sorted([(3, "deleted"), (4, "late"), (6, "missing"), (7, "missing"), (10, "missing"), (12, "missing")], key=repr)
    assert rows(orphan_report(got).select("month", "ref_state", "n_refs")) == sorted([("2025-02", "deleted", 1), ("2025-02", "late", 1), ("2025-02", "missing", 1), (None, "missing", 1), ("2025-01", "missing", 2)], key=repr)


def test_empty_and_long(spark, rows):
    none = unresolved_references(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    assert none.count() == 0 and orphan_report(none).count() == 0
    long = "x" * 100_000
    edges = spark.createDataFrame([(1, "a", long, T1, T1, True)], EDGES)
    assert rows(unresolved_references(spark.createDataFrame([], NODES), edges).select("edge_id", "ref_state")) == [(1, "missing")]
    nodes = spark.createDataFrame([("a", "m." + long, T1, None, 1)], NODES)
    assert unresolved_references(nodes, edges).count() == 0
    dots = "a." * 30_000 + "end"
    nodes = spark.createDataFrame([("a", dots, T1, None, 1), ("a", "q.r", T1, None, 1)], NODES)
    edges = spark.createDataFrame([(1, "a", "a.a.end", T1, T1, True), (2, "a", "nd", T1, T1, True), (3, "a", dots, T1, T1, True), (4, "a", "r", T1, T1, True), (5, "a", "a.r", T1, T1, True)], EDGES)
    assert rows(unresolved_references(nodes, edges).select("edge_id", "ref_state")) == [(2, "missing"), (5, "missing")]


def test_hot_callee(spark):
    edges = spark.range(20_000).selectExpr("id AS edge_id", "'a' AS cwd", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('f', id % 100) END AS callee", "timestamp_ntz'2025-01-01' AS indexed_at", "timestamp_ntz'2025-01-01' AS loaded_at")
    nodes = spark.createDataFrame([("a", f"f{i}", T1, None, 1) for i in range(100)], NODES)
    got = unresolved_references(nodes, edges)
    assert got.count() == 6667 and got.filter("ref_state <> 'missing'").count() == 0


def test_dangling_references_of_any_tables(spark, rows):
    from seamline.operators.references import Relation, dangling_references

    a = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (None, "y")], "a_id int, month string")
    b = spark.createDataFrame([("p",), ("",)], "name string")
    uses = spark.createDataFrame([(1, "2024-01-05"), (3, "2024-01-06"), (3, "2024-02-06"), (3, "2024-02-07"), (4, None), (None, "2024-01-01")], "ref bigint, at string").selectExpr("ref", "cast(at AS timestamp) AS at", "'k' AS key")
    names = spark.createDataFrame([("p",), ("q",), ("",), (None,)] + [("hot",)] * 500, "n string")
    parents = {"a": (a, "a_id"), "b": (b, "name")}
    got = dangling_references(parents, [Relation("uses", uses, "ref", "a", "at"), Relation("names", names, "n", "b")])
    assert rows(got) == sorted([("uses", "a", "2024-01", 1, 1), ("uses", "a", "2024-02", 2, 1), ("uses", "a", None, 1, 1), ("names", "b", None, 501, 2)], key=repr)
    assert dangling_references({k: (d.limit(0), c) for k, (d, c) in parents.items()}, [Relation("uses", uses.limit(0), "ref", "a", "at")]).count() == 0
