"""Processing only new or changed records, surviving failures.

A *version* of a record is its identity and content hash. The catalogue gives each version, when it is first seen, a
sequence number that it keeps; only unseen versions are sorted. What a scope (codebase) has processed is a set of
numbers, kept as disjoint intervals in a ledger; what it holds now is another. Subtracting the first from the second
leaves the gaps a run has to process, late commits included; the other way round, the versions that are gone. A run
commits its output and the merged intervals by one entry of a log: failed runs never enter the ledger, and of two runs
that processed the same numbers one succeeds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline.operators import intervals
from seamline.operators.commits import CommitLog
from seamline.operators.positions import sorted_positions
from seamline.session import Stage


def latest_files(nodes: DataFrame) -> DataFrame:
    """(cwd, node_path, node_hash): each file as its latest scan found it; on equal times the greatest hash holds.

    Hashes are lower-cased; a null hash counts as "". Rows without a path are left out.
    """
    return (
        nodes.filter((F.col("node_type") == "file") & F.col("node_path").isNotNull())
        .groupBy("cwd", "node_path")
        .agg(F.max(F.struct("scanned_at", F.lower(F.coalesce("node_hash", F.lit(""))).alias("h"))).alias("m"))
        .select("cwd", "node_path", F.col("m.h").alias("node_hash"))
    )


def last_good_runs(runs: DataFrame) -> DataFrame:
    """(cwd, run_id) of each codebase's last successful run: one with a row that says ok, latest started_at, then run_id."""
    return (
        runs.filter((F.col("run_state") == "ok") & F.col("run_id").isNotNull())
        .groupBy("cwd")
        .agg(F.max(F.struct("started_at", "run_id")).alias("m"))
        .select("cwd", F.col("m.run_id").alias("run_id"))
    )


def tree_files(text: str | None) -> Iterator[tuple[str, str]]:
    """(path, hash) of the files of a nested tree; nothing for null, empty or broken JSON."""
    try:
        root = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return
    todo = [(root, "")]
    while todo:
        node, at = todo.pop()
        if not isinstance(node, dict):
            continue
        path = node.get("path") or at
        if node.get("type") == "file" and path:
            yield path, str(node.get("hash") or "").lower()
        kids = node.get("children")
        for name, kid in kids.items() if isinstance(kids, dict) else ():
            todo.append((kid, f"{path}/{name}"))


def explode_trees(trees: DataFrame) -> DataFrame:
    """(cwd, node_path, node_hash) of all files in the trees' `tree_json`."""
    schema = pa.schema([("cwd", pa.string()), ("node_path", pa.string()), ("node_hash", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cwd, text in zip(batch.column("cwd").to_pylist(), batch.column("tree_json").to_pylist()):
                files = list(tree_files(text))
                for k in range(0, len(files), 10_000):
                    part = files[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cwd] * len(part), pa.string()), pa.array([p for p, _ in part], pa.string()), pa.array([h for _, h in part], pa.string())], schema=schema
                    )

    return trees.select("cwd", "tree_json").mapInArrow(parse, "cwd string, node_path string, node_hash string")


def saved_files(trees: DataFrame, runs: DataFrame) -> DataFrame:
    """The files of the tree that each codebase's last successful run saved."""
    good = trees.join(last_good_runs(runs), ["cwd", "run_id"]).groupBy("cwd").agg(F.max("tree_json").alias("tree_json"))
    return explode_trees(good.repartition(F.col("cwd"))).groupBy("cwd", "node_path").agg(F.max("node_hash").alias("node_hash"))


class Catalogue:
    """Versions with the sequence numbers they got when first seen: (key..., seq), in a folder of immutable parts.

    An entry of the log names one part and the next free number. Two writers that number at the same time can't both take
    an entry: the later one numbers anew what the earlier left.
    """

    KEY = ("cwd", "node_path", "node_hash")

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = KEY):
        self.spark, self.key, self.log = spark, key, CommitLog(spark, path)

    def _parts(self, entry: dict, like: DataFrame) -> DataFrame:
        schema = like.select(*self.key, F.lit(0).cast("long").alias("seq")).schema
        if not entry.get("parts"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.log.path}/{p}" for p in entry["parts"]])

    def numbered(self, versions: DataFrame) -> DataFrame:
        """The distinct `versions` (key...) with their numbers; unseen ones are numbered, in the order of the key, and kept first."""
        stage = Stage(self.spark, "numbering")
        wanted = stage.write(versions.select(*self.key).distinct())
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.key]
        while True:
            n = self.log.last()
            entry = self.log.read(n)
            known = self._parts(entry, wanted).select(*[F.col(c).alias(f"_{c}") for c in self.key])
            fresh = sorted_positions(wanted.join(known, same, "left_anti") if n else wanted, list(self.key), "_at", stage)
            start, part = entry.get("next", 0), f"part-{uuid.uuid4().hex}"
            fresh.select(*self.key, (F.col("_at") + start).alias("seq")).write.parquet(f"{self.log.path}/{part}")
            count = self.spark.read.parquet(f"{self.log.path}/{part}").count()
            if not count:
                self.log.drop(part)
                break
            if self.log.add(n + 1, {"parts": [*entry.get("parts", []), part], "next": start + count}):
                break
            self.log.drop(part)
        known = self._parts(self.log.read(self.log.last()), wanted).select(*[F.col(c).alias(f"_{c}") for c in self.key], "seq")
        return wanted.join(known, same).select(*self.key, "seq")

    def of_intervals(self, parts: DataFrame, like: DataFrame) -> DataFrame:
        """The versions whose numbers lie in intervals (scope, lo, hi) of their own scope, the first column of the key."""
        return intervals.members(self._parts(self.log.read(self.log.last()), like), self.key[0], "seq", parts)


class Overtaken(RuntimeError):
    """Another run has committed some of the same numbers: ask for the pending ones again."""


class Ledger:
    """Processed sequence numbers of any source as disjoint intervals, and the outputs of the runs that processed them.

    A commit writes its output and the merged set to folders of its own and then one entry of a log that names both:
    either both become visible or neither. A run that dies before leaves the ledger as it was. Where another run's entry
    comes first, the set is merged anew with that run's; if the two share numbers, the later one is refused and its output dropped.
    """

    SCHEMA = "scope string, lo long, hi long"

    def __init__(self, spark: SparkSession, path: str, block: int = intervals.BLOCK):
        self.spark, self.path, self.block = spark, path.rstrip("/"), block
        self.log = CommitLog(spark, path)

    def version(self) -> int:
        """Number of the newest commit; 0 if there is none."""
        return self.log.last()

    def processed(self, version: int | None = None) -> DataFrame:
        """The intervals processed as of the newest or, while it is kept, an older commit."""
        entry = self.log.read(self.version() if version is None else version)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{entry['set']}") if entry else self.spark.createDataFrame([], self.SCHEMA)

    def pending(self, available: DataFrame) -> DataFrame:
        """Gaps of `available` (scope, lo, hi): new numbers and those of late or failed runs alike."""
        return intervals.subtract(available, self.processed(), self.block)

    def gone(self, available: DataFrame) -> DataFrame:
        """What was processed and is in `available` no more."""
        return intervals.subtract(self.processed(), available, self.block)

    def outputs(self, schema) -> DataFrame:
        """The rows of all committed outputs; those of failed and refused runs are in none."""
        named = [e["output"] for e in map(self.log.read, range(1, self.version() + 1)) if e.get("output")]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{o}" for o in named]) if named else self.spark.createDataFrame([], schema)

    def commit(self, done: DataFrame, output: DataFrame | None = None, retired: DataFrame | None = None) -> int:
        """Make `done` (scope, lo, hi) processed, `retired` numbers open again, and `output` visible, all at once. Returns the commit's number."""
        made: list[str] = []

        def write(kind: str, rows: DataFrame) -> str:
            made.append(f"{kind}-{uuid.uuid4().hex}")
            rows.write.parquet(f"{self.path}/{made[-1]}")
            return made[-1]

        try:
            kept = write("out", output) if output is not None else None
            mine = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{write('done', done.select('scope', 'lo', 'hi'))}")
            while True:
                n = self.version()
                before = self.processed(n)
                if n and not intervals.intersect(mine, before, self.block).isEmpty():
                    raise Overtaken(f"commit {n} or an earlier one holds some of these numbers")
                left = intervals.subtract(before, retired.select("scope", "lo", "hi"), self.block) if retired is not None else before
                held = write("set", intervals.merge(left, mine, self.block))
                if self.log.add(n + 1, {"set": held, "output": kept}):
                    made = [m for m in made if m not in (held, kept)]
                    break
        finally:
            for name in made:
                self.log.drop(name)
        if n > 1:  # a reader may still hold the set before this one
            self.log.drop(self.log.read(n - 1)["set"])
        return n + 1

    def vacuum(self) -> int:
        """Delete the folders of runs that died before their entry; only while no run is writing. Returns how many."""
        n = self.version()
        named = {e[k] for e in map(self.log.read, range(1, n + 1)) for k in ("set", "output") if e.get(k)}
        lost = [f for f in self.log.folders() if f not in named]
        for name in lost:
            self.log.drop(name)
        return len(lost)


def changed_versions(catalogue: Catalogue, ledger: Ledger, now: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fresh, gone, changes): the intervals a run has to process, those of vanished versions, and (cwd, node_path, change_kind).

    `now` (cwd, node_path, node_hash) holds one version per file. Numbers are looked up, given to unseen versions only, and compared
    as intervals; only versions in a gap are read back. A run that handled the changes commits them by `ledger.commit(fresh, output, gone)`.
    """
    available = intervals.from_numbers(catalogue.numbered(now), "cwd", "seq")
    stage = Stage(now.sparkSession, "available")
    available = stage.write(available)
    fresh, gone = stage.write(ledger.pending(available)), stage.write(ledger.gone(available))
    new = catalogue.of_intervals(fresh, now).withColumn("fresh", F.lit(True))
    old = catalogue.of_intervals(gone, now).withColumn("fresh", F.lit(False))
    kind = F.when(F.min("fresh"), "added").when(F.max("fresh"), "modified").otherwise("deleted")
    return fresh, gone, new.unionByName(old).groupBy("cwd", "node_path").agg(kind.alias("change_kind"))


def same_roots(nodes: DataFrame, trees: DataFrame, runs: DataFrame) -> DataFrame:
    """(cwd): the codebases whose folder hash, as last scanned, is that of the tree their last successful run saved: nothing in them changed."""
    now = (
        nodes.filter((F.col("node_type") == "directory") & (F.col("node_path") == F.col("cwd")))
        .groupBy("cwd")
        .agg(F.max(F.struct("scanned_at", F.lower("node_hash").alias("h"))).alias("m"))
        .select("cwd", F.col("m.h").alias("h"))
    )
    then = trees.join(last_good_runs(runs), ["cwd", "run_id"]).groupBy("cwd").agg(F.min(F.lower("root_hash")).alias("lo"), F.max(F.lower("root_hash")).alias("hi"))
    return now.join(then, "cwd").filter((F.col("h") != "") & (F.col("h") == F.col("lo")) & (F.col("h") == F.col("hi"))).select("cwd")


def pending_changes(nodes: DataFrame, trees: DataFrame, runs: DataFrame, folder: str | None = None) -> DataFrame:
    """(cwd, node_path, change_kind): files added, modified or deleted since the codebase's last successful run.

    The ledger of earlier runs is set up from the trees they saved, in `folder` (a new one of the shared folder, if not named): each
    codebase's last successful tree is what was processed. Codebases whose root hash is the saved one drop out before their
    trees are read. Without a successful run all files of a codebase are added. Case of hashes means nothing. Repeated rows
    count once, empty tables are allowed, other columns are ignored, rows without a path are left out.
    """
    spark = nodes.sparkSession
    folder = folder or Stage(spark, "changes").root
    catalogue, ledger = Catalogue(spark, f"{folder}/versions"), Ledger(spark, f"{folder}/ledger")
    if "root_hash" in trees.columns:
        same = Stage(spark, "same").write(same_roots(nodes, trees, runs))
        nodes, trees = (t.join(same, "cwd", "left_anti") for t in (nodes, trees))
    if not ledger.version():
        saved = catalogue.numbered(saved_files(trees, runs))
        ledger.commit(intervals.from_numbers(saved, "cwd", "seq"))
    return changed_versions(catalogue, ledger, latest_files(nodes))[2]
