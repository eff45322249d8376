import json
import random
from datetime import datetime as D

import pytest

from seamline.operators import intervals
from seamline.operators.commits import CommitLog
from seamline.operators.incremental import Catalogue, Ledger, Overtaken, changed_versions, pending_changes, same_roots, tree_files
from seamline.operators.positions import sorted_positions
from seamline.operators.prefix import running_totals

NODES = "cwd string, node_path string, node_type string, node_hash string, scanned_at timestamp_ntz, seq string"
TREES = "run_id bigint, cwd string, tree_json string, updated_at timestamp_ntz"
RUNS = "run_id bigint, cwd string, started_at timestamp_ntz, run_state string"


def tree(**files):
    kids = {n: {"type": "file", "name": n, "path": f"/a/{n}", "hash": h} for n, h in files.items()}
    return json.dumps({"type": "directory", "name": "a", "path": "/a", "hash": "x", "children": {"d": {"type": "directory", "name": "d", "children": kids}}})


def test_changes(spark, rows):
    t = [D(2025, 1, k) for k in range(1, 9)]
    nodes = spark.createDataFrame(
        [
            ("a", "/a/same", "file", "AB", t[1], ""), ("a", "/a/same", "file", "AB", t[1], ""), ("a", "/a/mod", "file", "old", t[1], ""), ("a", "/a/mod", "file", "new", t[2], ""), ("a", "/a/add", "file", None, t[1], ""),
            ("a", "/a/d", "directory", "z", t[1], ""), ("b", "/b/x", "file", "1", t[1], ""), ("a", None, "file", "1", t[1], ""),
        ],
        NODES,
    )
    trees = spark.createDataFrame(
        [(1, "a", tree(same="0"), None), (2, "a", tree(same="aB", mod="old", gone="g"), None), (2, "a", tree(same="aB", mod="old", gone="g"), None), (3, "a", tree(), None), (4, "b", tree(x="1"), None), (5, "c", "{}", None), (6, "d", tree(k="1"), None)], TREES
    )
    runs = spark.createDataFrame(
        [(1, "a", t[0], "ok"), (2, "a", t[2], "running"), (2, "a", t[2], "ok"), (3, "a", t[4], "running"), (3, "a", t[4], "failed"), (4, "b", t[2], "aborted"), (5, "c", t[2], "ok"), (6, "d", t[2], "ok"), (6, "d", t[2], "ok")], RUNS
    )
    got = pending_changes(nodes, trees, runs)
    assert rows(got.select("node_path", "change_kind")) == sorted([("/a/mod", "modified"), ("/a/add", "added"), ("/a/gone", "deleted"), ("/b/x", "added"), ("/a/k", "deleted")], key=repr)
    assert pending_changes(nodes.limit(0), trees.limit(0), runs.limit(0)).count() == 0
    assert pending_changes(nodes, trees.limit(0), runs).filter("change_kind <> 'added'").count() == 0


def test_tree_files_tolerates_anything():
    assert list(tree_files(None)) == list(tree_files("")) == list(tree_files("{}")) == list(tree_files("[1")) == list(tree_files("3")) == []
    assert list(tree_files('{"type":"file","path":"/f","hash":null}')) == [("/f", "")]
    deep = '{"type":"directory","path":"/a","children":{"b":' * 1000 + '{"type":"file","hash":"H"}' + "}}" * 1000
    assert [h for _, h in tree_files(deep)] == ["h"]


def spans(spark, sets):
    return spark.createDataFrame([(s, lo, hi) for s, x in sets.items() for lo, hi in x], "scope string, lo long, hi long")


def numbers(df):
    out = {}
    for r in df.collect():
        assert r.lo <= r.hi
        got = out.setdefault(r.scope, set())
        part = set(range(r.lo, r.hi + 1))
        assert not part & got, "intervals overlap"
        got |= part
    return {k: v for k, v in out.items() if v}


def test_interval_sets_against_sets(spark):
    rng = random.Random(3)
    make = lambda: {s: [(x, x + rng.randrange(9)) for x in (rng.randrange(120) for _ in range(12))] for s in "ab"}
    one, other = make(), make()
    as_set = lambda x: {s: {n for lo, hi in v for n in range(lo, hi + 1)} for s, v in x.items()}
    a, b = as_set(one), as_set(other)
    for block in (8, 1000):
        assert numbers(intervals.subtract(spans(spark, one), spans(spark, other), block)) == {s: a[s] - b[s] for s in a if a[s] - b[s]}
        assert numbers(intervals.merge(spans(spark, one), spans(spark, other), block)) == {s: a[s] | b[s] for s in a}
        flat = spark.createDataFrame([(s, n) for s in a for n in a[s]] * 2 + [("a", None)], "s string, n long")
        assert numbers(intervals.from_numbers(flat, "s", "n", block)) == a
        kept = intervals.members(flat.dropna().distinct(), "s", "n", spans(spark, other), block)
        assert {tuple(r) for r in kept.distinct().collect()} == {(s, n) for s in a for n in a[s] & b.get(s, set())}


def test_ledger_survives_failures_and_late_numbers(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", block=16)
    avail = spans(spark, {"s": [(0, 9), (20, 29)]})
    assert numbers(ledger.pending(avail)) == {"s": {*range(10), *range(20, 30)}}
    assert ledger.commit(ledger.pending(avail)) == 1
    assert not numbers(ledger.pending(avail))
    late = spans(spark, {"s": [(0, 29)]})
    assert numbers(ledger.pending(late)) == {"s": set(range(10, 20))}
    broken = spark.range(1).selectExpr("raise_error('lost') AS n")
    with pytest.raises(Exception, match="lost"):
        ledger.commit(ledger.pending(late), broken)
    assert ledger.version() == 1 and numbers(ledger.pending(late)) == {"s": set(range(10, 20))}
    ledger.commit(ledger.pending(late))
    assert numbers(ledger.processed()) == {"s": set(range(30))}
    ledger.commit(spans(spark, {"s": [(40, 44)]}), retired=spans(spark, {"s": [(3, 4)]}))
    assert numbers(ledger.processed()) == {"s": set(range(30)) - {3, 4} | set(range(40, 45))}
    assert len([f for f in ledger.log.folders() if f.startswith("set-")]) == 2 and not [f for f in ledger.log.folders() if f.startswith("done-")]


def overtaking(ledger, first, *args):
    """Commit through `ledger` while another run commits `first` after this one has read the ledger's version."""
    add, other = ledger.log.add, Ledger(ledger.spark, ledger.path, ledger.block)

    def late(n, entry):
        ledger.log.add = add
        other.commit(*first)
        return add(n, entry)

    ledger.log.add = late
    return ledger.commit(*args)


def test_two_runs_at_once_lose_and_repeat_nothing(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", block=16)
    out = lambda lo, hi: spark.range(lo, hi + 1).select("id")
    one, other = spans(spark, {"s": [(1, 10)]}), spans(spark, {"s": [(50, 60)]})
    assert overtaking(ledger, (one, out(1, 10)), other, out(50, 60)) == 2
    assert numbers(ledger.processed()) == {"s": {*range(1, 11), *range(50, 61)}}
    both = spans(spark, {"s": [(61, 70)]})
    with pytest.raises(Overtaken):
        overtaking(ledger, (both, out(61, 70)), spans(spark, {"s": [(65, 80)]}), out(65, 80))
    assert sorted(r.id for r in ledger.outputs("id long").collect()) == [*range(1, 11), *range(50, 71)]
    assert numbers(ledger.pending(spans(spark, {"s": [(60, 80)]}))) == {"s": set(range(71, 81))}
    assert ledger.vacuum() == 0


def test_a_crash_between_output_and_entry_changes_nothing(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    one, out = spans(spark, {"s": [(1, 10)]}), spark.range(1, 11)

    class Killed(BaseException):
        pass

    def die(*_):
        raise Killed

    ledger.log.drop = lambda name: None  # a killed run cleans nothing up
    ledger.log.add = die
    with pytest.raises(Killed):
        ledger.commit(one, out)
    after = Ledger(spark, f"file://{tmp_path}/ledger")
    assert after.version() == 0 and after.outputs("id long").count() == 0 and numbers(after.pending(one)) == {"s": set(range(1, 11))}
    after.commit(after.pending(one), out)
    assert after.vacuum() == 3 and sorted(r.id for r in after.outputs("id long").collect()) == list(range(1, 11))


@pytest.mark.parametrize("scheme", ["file", "other"])
def test_log_entries_are_written_once(spark, tmp_path, scheme):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    if scheme == "other":  # as on a file system that isn't this machine's
        real = log._fs

        class Remote:
            def __init__(self, fs):
                self.fs = fs

            def __getattr__(self, name):
                return getattr(self.fs, name)

            def getUri(self):
                return spark._jvm.java.net.URI("x://h/")

        log._fs = lambda path: (lambda fs, p: (Remote(fs), p))(*real(path))
    assert log.last() == 0 and log.read(0) == {}
    assert log.add(1, {"a": "é"}) and not log.add(1, {"a": "b"}) and log.add(2, {})
    assert log.last() == 2 and log.read(1) == {"a": "é"}
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.startswith(".")) == ["commit-1", "commit-2"]


def test_numbers_are_given_once_and_runs_process_only_gaps(spark, tmp_path):
    catalogue, ledger = Catalogue(spark, f"file://{tmp_path}/v"), Ledger(spark, f"file://{tmp_path}/l")
    files = lambda **f: spark.createDataFrame([("c", p, h) for p, h in f.items()] + [(None, "n", "1")], "cwd string, node_path string, node_hash string")

    def run(commit=True, **f):
        fresh, gone, changes = changed_versions(catalogue, ledger, files(**f))
        got = {r.node_path: r.change_kind for r in changes.collect()}
        if commit:
            ledger.commit(fresh, changes, gone)
        return got

    assert run(a="1", b="1", commit=False) == run(a="1", b="1") == {"a": "added", "b": "added", "n": "added"}
    seqs = {r.node_path: r.seq for r in catalogue.numbered(files(a="1", b="1")).collect()}
    assert sorted(seqs.values()) == [0, 1, 2] and catalogue.log.last() == 1
    assert run(a="2", c="1") == {"a": "modified", "b": "deleted", "c": "added"} and catalogue.log.last() == 2
    assert run(a="2", c="1") == {} and catalogue.log.last() == 2
    assert run(a="1", c="1") == {"a": "modified"}  # an old version that is back
    assert {r.node_path: r.seq for r in catalogue.numbered(files(a="1", b="1")).collect()} == seqs
    assert ledger.outputs("node_path string").count() == 3 + 3 + 1


def test_unchanged_codebases_drop_out_by_their_root(spark, rows):
    at = D(2025, 1, 1)
    nodes = spark.createDataFrame([("a", "a", "directory", "AB", at, ""), ("b", "b", "directory", "1", at, ""), ("b", "b", "directory", "2", D(2025, 1, 2), ""), ("c", "c", "directory", "", at, "")], NODES)
    trees = spark.createDataFrame([(1, "a", "{}", None, "aB"), (1, "a", "{}", None, "Ab"), (2, "b", "{}", None, "1"), (3, "c", "{}", None, "")], TREES + ", root_hash string")
    runs = spark.createDataFrame([(k, c, at, "ok") for k, c in ((1, "a"), (2, "b"), (3, "c"))], RUNS)
    assert rows(same_roots(nodes, trees, runs)) == [("a",)]


def test_positions_and_running_totals(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", rng.randrange(10**9), rng.choice([None, 1, 2, 3])) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, k long, n int")
    order = sorted(data, key=lambda r: (r[0], r[1]))
    assert [r.pos for r in sorted_positions(df, ["g", "k"]).orderBy("g", "k").collect()] == list(range(len(data)))
    sums, expected = {}, []
    for g, k, n in order:
        expected.append(sums.get(g, 0))
        sums[g] = sums.get(g, 0) + (n or 0)
    assert [r.before for r in running_totals(df, ["g"], ["k"], "n").orderBy("g", "k").collect()] == expected
    assert running_totals(df.limit(0), ["g"], ["k"], "n").count() == 0
