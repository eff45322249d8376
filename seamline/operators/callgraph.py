"""Call graphs: extraction of definitions and calls, resolution of names, bounded traversal."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.functions import hcl, steps
from seamline.functions.golang import GoError, GoFile
from seamline.functions.text import line_numbers
from seamline.operators.references import lengths_of, suffixes_of_lengths
from seamline.session import Stage

Node = tuple[str, int, int]
Edge = tuple[str, str]
#: Python functions whose calls are no edges.
UNTRACKED = ("print", "len", "range")
#: Terraform blocks that are nodes.
TRACKED = ("resource", "module", "variable", "output")


def graph_go(text: str) -> tuple[list[Node], list[Edge]]:
    """Functions, methods as (T).M or (*T).M, and the names they call; closures count to the function around them."""
    source = GoFile(text)
    nodes, edges = [], []
    for d in source.declarations:
        if d.kind == "func":
            name = f"({d.receiver}).{d.name}" if d.receiver else d.name
            nodes.append((name, source.line(d.start), source.line(max(d.start, d.end - 1))))
            edges += [(name, callee) for callee in source.calls(d)]
    return nodes, edges


class _PythonVisitor(ast.NodeVisitor):
    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.edges: list[Edge] = []
        self.owner, self.inside = "", ""

    def _scoped(self, node: ast.AST, owner: str, inside: str) -> None:
        kept = self.owner, self.inside
        self.owner, self.inside = owner, inside
        self.generic_visit(node)
        self.owner, self.inside = kept

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.nodes.append((node.name, node.lineno, node.end_lineno or node.lineno))
        decorators, node.decorator_list = node.decorator_list, []
        for d in decorators:
            self.visit(d)
        self._scoped(node, node.name, self.inside)

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        name = f"{self.owner}.{node.name}" if self.owner else node.name
        self.nodes.append((name, node.lineno, node.end_lineno or node.lineno))
        decorators, node.decorator_list = node.decorator_list, []
        for d in decorators:
            self.visit(d)
        self._scoped(node, self.owner, name)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        callee = ""
        if isinstance(node.func, ast.Name):
            callee = node.func.id
        elif isinstance(node.func, ast.Attribute):
            own = isinstance(node.func.value, ast.Name) and node.func.value.id == "self" and self.owner
            callee = f"{self.owner}.{node.func.attr}" if own else node.func.attr
        if self.inside and callee and callee not in UNTRACKED:
            self.edges.append((self.inside, callee))
        self.generic_visit(node)


def graph_python(text: str) -> tuple[list[Node], list[Edge]]:
    """Classes, functions and methods as Class.method, and the calls inside functions; self.m() calls Class.m."""
    visitor = _PythonVisitor()
    visitor.visit(ast.parse(text))
    return visitor.nodes, visitor.edges


def graph_terraform(text: str) -> tuple[list[Node], list[Edge]]:
    """Blocks as resource.type.name, module.x, variable.x, output.x, and the modules and resources that their bodies refer to."""
    line = line_numbers(text)
    nodes: list[Node] = []
    edges: list[Edge] = []
    for b in hcl.blocks(text):
        if b.kind in TRACKED and b.labels:
            name = ".".join([b.kind, *b.labels[: 2 if b.kind == "resource" else 1]])
            nodes.append((name, line(b.start), line(b.end - b.closed)))
            for first, then, *_ in b.references:
                if first == "module" or "_" in first:
                    edges.append((name, f"module.{then}" if first == "module" else f"resource.{first}.{then}"))
    return nodes, edges


def graph_yaml(text: str) -> tuple[list[Node], list[Edge]]:
    """Steps by their name or id, each up to the next one, and what they need, use or run, an edge for every item of a list."""
    seen = [(n, key in steps.NAMES, f"step.{v}") for n, key, values in steps.entries(text) for v in values]
    starts = [(n, name) for n, named, name in seen if named]
    ends = [n - 1 for n, _ in starts[1:]] + [text.count("\n") + 1]
    nodes = [(name, n, max(n, end)) for (n, name), end in zip(starts, ends)]
    edges, owner = [], None
    for _, named, name in seen:
        if named:
            owner = name
        elif owner:
            edges.append((owner, name))
    return nodes, edges


def graph_of(path: str, text: str) -> tuple[list[Node], list[Edge]]:
    """Nodes and edges of one file; of nodes with one name the last holds; none for other files and for ones that can't be parsed."""
    ending = re.search(r"(\.[^./]*)?$", path).group().lower()
    parser = {".go": graph_go, ".py": graph_python, ".tf": graph_terraform, ".yml": graph_yaml, ".yaml": graph_yaml}.get(ending)
    try:
        nodes, edges = parser(text) if parser else ([], [])
    except (GoError, SyntaxError, ValueError, IndexError, RecursionError):
        return [], []
    return list({n[0]: n for n in nodes}.values()), edges


def extract_graph(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(file_path, kind, name, callee, start_line, end_line): kind `node` with its lines or `edge` with its callee, in one pass over the files."""
    names = ["file_path", "kind", "name", "callee", "start_line", "end_line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                nodes, edges = graph_of(p, t.as_py() or "")
                rows = [(p, "node", n, None, a, b) for n, a, b in nodes] + [(p, "edge", a, b, None, None) for a, b in edges]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k < 4 else pa.int32()) for k in range(6)], names=names)

    source = df.filter(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "file_path string, kind string, name string, callee string, start_line int, end_line int")


def nodes_of(graph: DataFrame) -> DataFrame:
    return graph.filter("kind = 'node'").select("name", "file_path", "start_line", "end_line")


def edges_of(graph: DataFrame) -> DataFrame:
    return graph.filter("kind = 'edge'").select(F.col("name").alias("caller"), "callee", "file_path")


def find_node(nodes: DataFrame, name: str) -> DataFrame:
    """The node of a name, at most one: an exact match first, then one that ends in "." and the name; by name and path."""
    hit = nodes.filter((F.col("name") == name) | F.endswith("name", F.lit("." + name)))
    return hit.orderBy((F.col("name") != name).cast("int"), "name", "file_path").limit(1)


def name_suffixes(nodes: DataFrame, callees: DataFrame, strict: bool) -> DataFrame:
    """Nodes under every name they can be called by: all suffixes, or with `strict` those after a dot. Only suffixes as long as some callee are made."""
    sized = nodes.crossJoin(lengths_of("callee", callees))  # one row
    return sized.withColumn("suffix", F.explode(suffixes_of_lengths(F.col("name"), F.col("_lengths"), strict))).drop("_lengths")


def resolve(edges: DataFrame, nodes: DataFrame, strict: bool = False, scope: list[str] | None = None) -> DataFrame:
    """(scope..., caller, callee, name, file_path, start_line, end_line): each call with the nodes it may mean, distinct.

    A callee means the nodes whose name is or ends with it (`strict`: is it or ends with "." and it). Suffixes are exploded once and
    hash-joined on, so no pair is compared; edges are made distinct first, so a callee called everywhere is one row per caller.
    """
    by = scope or []
    calls = edges.filter(F.length("callee") > 0).select(*by, "caller", "callee").distinct()
    named = name_suffixes(nodes.select(*by, "name", "file_path", "start_line", "end_line").distinct(), calls.select("callee"), strict)
    return calls.join(named.withColumnRenamed("suffix", "callee"), [*by, "callee"]).select(*by, "caller", "callee", "name", "file_path", "start_line", "end_line").distinct()


def callers(edges: DataFrame, nodes: DataFrame, strict: bool = False, scope: list[str] | None = None) -> DataFrame:
    """(scope..., source, name, file_path, start_line, end_line): each node `source` with the nodes `name` that call it, distinct; callers without a node are left out."""
    by = scope or []
    calling = resolve(edges, nodes, strict, scope).select(*by, F.col("name").alias("source"), F.col("caller").alias("name")).distinct()
    return calling.join(nodes.select(*by, "name", "file_path", "start_line", "end_line").distinct(), [*by, "name"]).select(*by, "source", "name", "file_path", "start_line", "end_line")


def callees_of(edges: DataFrame, nodes: DataFrame, caller: str, strict: bool = False) -> DataFrame:
    """The distinct nodes a function may call."""
    return resolve(edges.filter(F.col("caller") == caller), nodes, strict).select("name", "file_path", "start_line", "end_line").distinct()


def callers_of(edges: DataFrame, nodes: DataFrame, callee: str, strict: bool = False) -> DataFrame:
    """The distinct nodes that call a name, or a suffix of it: the suffixes of one name are a short list to filter by."""
    cuts = [callee[k:] for k in range(len(callee)) if not strict or k == 0 or callee[k - 1] == "."]
    calling = edges.filter(F.col("callee").isin(cuts)).select(F.col("caller").alias("name")).distinct()
    return nodes.join(calling, "name", "left_semi").select("name", "file_path", "start_line", "end_line").distinct()


def call_tree(starts: DataFrame, steps: DataFrame, max_depth: int, scope: list[str] | None = None) -> DataFrame:
    """(scope..., root, depth, path, name, file_path, start_line, end_line): what can be reached from each start in so many steps.

    `starts` has (scope..., name); `steps` has (scope..., source, name, file_path, start_line, end_line), distinct. A name already on its own path
    comes once more as a leaf and is not followed; a node reached along several paths comes once per path.
    """
    by = scope or []
    stage = Stage(steps.sparkSession, "call-tree")
    steps = stage.write(steps.distinct())
    level = starts.select(*by, F.col("name").alias("root"), F.col("name").alias("at"), F.array("name").alias("path"), F.lit(False).alias("closed")).distinct()
    out = None
    for depth in range(1, max_depth + 1):
        level = stage.write(
            level.filter(~F.col("closed"))
            .drop("closed")
            .join(steps.withColumnRenamed("source", "at"), [*by, "at"])
            .select(*by, "root", F.concat("path", F.array("name")).alias("path"), F.col("name").alias("at"), F.array_contains("path", F.col("name")).alias("closed"), "file_path", "start_line", "end_line")
        )
        found = level.select(*by, "root", F.lit(depth).alias("depth"), "path", F.col("at").alias("name"), "file_path", "start_line", "end_line")
        out = found if out is None else out.unionByName(found)
        if level.isEmpty():
            break
        level = level.select(*by, "root", "at", "path", "closed")
    if out is None:
        raise ValueError("max_depth must be at least 1")
    return out


def call_report(nodes: DataFrame, edges: DataFrame, name: str, direction: str = "both", max_depth: int = 2, strict: bool = False) -> DataFrame:
    """(direction, depth, path, name, file_path, start_line, end_line) around a node; no rows for an unknown name or direction."""
    start = find_node(nodes, name).select("name")
    resolved = resolve(edges, nodes, strict)
    parts = []
    if direction in ("callee", "both"):
        steps = resolved.select(F.col("caller").alias("source"), "name", "file_path", "start_line", "end_line")
        parts.append(call_tree(start, steps, max_depth).withColumn("direction", F.lit("callee")))
    if direction in ("caller", "both"):
        steps = callers(edges, nodes, strict)
        parts.append(call_tree(start, steps, max_depth).withColumn("direction", F.lit("caller")))
    columns = ["direction", "depth", "path", "name", "file_path", "start_line", "end_line"]
    if not parts:
        return nodes.sparkSession.createDataFrame([], "direction string, depth int, path array<string>, name string, file_path string, start_line int, end_line int")
    made = parts[0].select(*columns)
    return made.unionByName(parts[1].select(*columns)) if len(parts) > 1 else made


def replace_graph(graph: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """The graph with the rows of `files` (file_path) dropped and the new rows added: exact, as every row knows its file."""
    return graph.join(files.select("file_path").distinct(), "file_path", "left_anti").unionByName(new)
