"""The core's named queries, with DuckDB SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from seamline.functions import text as tx
from seamline.functions.regex import SearchOption, route
from seamline.operators import callgraph, chunkers, evaluation, hierarchy, hybrid, incremental, lines, merkle, quantizer, references, vectors
from seamline.operators.prefix import row_numbers
from seamline.session import Stage, ship
from seamline.sources.tables import table
from seamline.streaming.sync import event_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `name`, with the SQL it must agree with."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return f(spark, sf)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


_LINKS = """
n AS (SELECT node_id, any_value(cwd) cwd, any_value(callee) callee, any_value(caller) caller, any_value(children) children FROM call_tree GROUP BY node_id),
k AS (SELECT cwd, callee, min(node_id) key_id FROM n WHERE callee <> '' GROUP BY ALL),
l AS (SELECT n.node_id AS id, k.key_id AS parent_id FROM n JOIN k ON k.cwd = n.cwd AND k.callee = n.caller
  UNION SELECT k.key_id, c.node_id FROM (SELECT node_id, cwd, unnest(children) kid FROM n) c JOIN k ON k.cwd = c.cwd AND k.callee = c.kid),
p AS (SELECT id, min(parent_id) parent_id FROM l GROUP BY id),
t AS (SELECT node_id AS id, parent_id FROM n LEFT JOIN p ON p.id = n.node_id),
w AS (SELECT id, id AS root_id, 0 AS depth_no FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, w.root_id, w.depth_no + 1 FROM w JOIN t ON t.parent_id = w.id)"""


@query(
    "p2_found",
    f"""WITH RECURSIVE {_LINKS},
a AS (SELECT t.id AS below, t.parent_id AS above FROM t JOIN w USING (id) WHERE t.parent_id IS NOT NULL
  UNION ALL SELECT a.below, t.parent_id FROM a JOIN t ON t.id = a.above WHERE t.parent_id IS NOT NULL),
c AS (SELECT above AS id, count(*) n FROM a GROUP BY above)
SELECT t.id AS node_id, coalesce(w.root_id, -1) AS root_id, CAST(coalesce(w.depth_no, -1) AS INTEGER) AS depth_no,
  CAST(CASE WHEN w.id IS NULL THEN -1 ELSE coalesce(c.n, 0) END AS INTEGER) AS n_below
FROM t LEFT JOIN w USING (id) LEFT JOIN c USING (id)""",
)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    links = hierarchy.parent_links(table(spark, sf, "call_tree"))
    return hierarchy.resolve_hierarchy(links).select(F.col("id").alias("node_id"), "root_id", "depth_no", "n_below")


@query(
    "p2_paths",
    f"""WITH RECURSIVE {_LINKS},
q AS (SELECT t.id, n.callee AS path FROM t JOIN n ON n.node_id = t.id WHERE parent_id IS NULL
  UNION ALL SELECT t.id, q.path || ' > ' || n.callee FROM q JOIN t ON t.parent_id = q.id JOIN n ON n.node_id = t.id)
SELECT t.id AS node_id, q.path FROM t LEFT JOIN q USING (id)""",
)
def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    links = hierarchy.parent_links(table(spark, sf, "call_tree"))
    return hierarchy.resolve_hierarchy(links, with_paths=True).select(F.col("id").alias("node_id"), "path")


@query(
    "p2_descendants",
    f"""WITH RECURSIVE {_LINKS},
a AS (SELECT t.id AS below, t.parent_id AS above, 1 AS levels FROM t JOIN w USING (id) WHERE t.parent_id IS NOT NULL
  UNION ALL SELECT a.below, t.parent_id, a.levels + 1 FROM a JOIN t ON t.id = a.above WHERE t.parent_id IS NOT NULL)
SELECT above AS ancestor_id, below AS id, levels FROM a""",
)
def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every node below each node, with the levels between them; nodes on a loop or below one have none."""
    links = hierarchy.parent_links(table(spark, sf, "call_tree"))
    return hierarchy.descendants(hierarchy.resolve_hierarchy(links, with_paths=True))


_REFS = """
e AS (SELECT edge_id, cwd, trim(callee) AS callee, any_value(indexed_at) AS indexed_at, any_value(loaded_at) AS loaded_at
  FROM call_edges WHERE trim(callee) <> '' GROUP BY edge_id, cwd, trim(callee)),
s AS (SELECT cwd, indexed_at, deleted_at, unnest(list_transform(range(1, len(string_split(symbol_name, '.')) + 1), lambda i: array_to_string(string_split(symbol_name, '.')[i:], '.'))) AS key FROM call_nodes),
k AS (SELECT cwd, key, bool_or(deleted_at IS NULL) AS alive, min(CASE WHEN deleted_at IS NULL THEN indexed_at END) AS alive_from FROM s GROUP BY cwd, key),
u AS (SELECT edge_id, CASE WHEN k.key IS NULL THEN 'missing' WHEN NOT k.alive THEN 'deleted' WHEN k.alive_from > e.indexed_at THEN 'late' END AS ref_state, coalesce(e.indexed_at, e.loaded_at) AS seen_at
  FROM e LEFT JOIN k ON k.cwd = e.cwd AND k.key = e.callee)"""


@query("p6_found", f"WITH {_REFS} SELECT DISTINCT edge_id, ref_state FROM u WHERE ref_state IS NOT NULL")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return references.unresolved_references(table(spark, sf, "call_nodes"), table(spark, sf, "call_edges")).select("edge_id", "ref_state")


@query(
    "p6_report",
    f"""WITH {_REFS} SELECT 'call_edges' AS child_table, 'call_nodes' AS parent_table, strftime(seen_at, '%Y-%m') AS month, ref_state, count(DISTINCT edge_id) AS n_refs
FROM u WHERE ref_state IS NOT NULL GROUP BY ALL""",
)
def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_report(references.unresolved_references(table(spark, sf, "call_nodes"), table(spark, sf, "call_edges")))


_PAIRS = (("search_candidates", "id", "memory_items", "id", "scored_at"), ("memory_items", "id", "chunks", "id", "created_at"), ("call_tree", "caller", "call_nodes", "symbol_name", "reported_at"), ("lineitem", "l_orderkey", "orders", "o_orderkey", "l_shipdate"), ("orders", "o_custkey", "customer", "c_custkey", "o_orderdate"))


@query(
    "p6_tables",
    " UNION ALL ".join(
        f"SELECT '{c}' AS child_table, '{p}' AS parent_table, strftime({at}, '%Y-%m') AS month, count(*) AS n_refs, count(DISTINCT {k}) AS n_keys FROM (SELECT DISTINCT * FROM {c}) WHERE {k}::VARCHAR <> '' AND {k} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL) GROUP BY ALL"
        for c, k, p, pk, at in _PAIRS
    ),
)
def p6_tables(spark: SparkSession, sf: str) -> DataFrame:
    """References between tables that point to no row, per pair of tables and month."""
    parents = {p: (table(spark, sf, p), pk) for _, _, p, pk, _ in _PAIRS}
    return references.dangling_references(parents, [references.Relation(c, table(spark, sf, c).distinct(), k, p, at) for c, k, p, _, at in _PAIRS])


@query(
    "p7_found",
    """WITH f AS (SELECT cwd, node_path, arg_max(lower(node_hash), scanned_at) AS h FROM merkle_nodes WHERE node_type = 'file' GROUP BY ALL),
g AS (SELECT cwd, arg_max(run_id, (started_at, run_id)) AS run_id FROM index_runs WHERE run_state = 'ok' GROUP BY cwd),
j AS (SELECT cwd, any_value(tree_json) AS tree FROM merkle_trees JOIN g USING (cwd, run_id) GROUP BY cwd),
o AS (SELECT DISTINCT j.cwd, x.value->>'path' AS node_path, lower(x.value->>'hash') AS h FROM j, json_tree(j.tree) AS x WHERE x.type = 'OBJECT' AND x.value->>'type' = 'file')
SELECT coalesce(f.node_path, o.node_path) AS node_path, CASE WHEN o.h IS NULL THEN 'added' WHEN f.h IS NULL THEN 'deleted' ELSE 'modified' END AS change_kind
FROM f FULL JOIN o ON o.cwd = f.cwd AND o.node_path = f.node_path WHERE f.h IS DISTINCT FROM o.h""",
)
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.pending_changes(*(table(spark, sf, t) for t in ("merkle_nodes", "merkle_trees", "index_runs"))).select("node_path", "change_kind")


# Line search

_LINES = """
a AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text <> ''),
b AS (SELECT doc_id, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS line_no, len(p) AS n FROM a),
l AS (SELECT doc_id, line_no, regexp_replace(line, '\\r$', '') AS line FROM b WHERE NOT (line_no = n AND line = ''))"""


def _grep(spark: SparkSession, sf: str, option: SearchOption, **how: bool) -> DataFrame:
    return lines.grep(table(spark, sf, "documents"), ["doc_id"], option, **how)


@query("grep_literal", f"WITH {_LINES} SELECT doc_id, line_no, line FROM l WHERE contains(line, 'vector range')")
def grep_literal(spark: SparkSession, sf: str) -> DataFrame:
    return _grep(spark, sf, SearchOption("vector range"))


_PATTERN = r"(?i)\b(func|def|class)\s+[[:alpha:]_]+(\(|:)"


@query("grep_regex", f"WITH {_LINES} SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '{_PATTERN}')")
def grep_regex(spark: SparkSession, sf: str) -> DataFrame:
    return _grep(spark, sf, SearchOption(_PATTERN, True))


@query("grep_multiword_or", f"WITH {_LINES} SELECT doc_id, line_no, line FROM l WHERE contains(line, 'callee') OR contains(line, 'résumé')")
def grep_multiword_or(spark: SparkSession, sf: str) -> DataFrame:
    return _grep(spark, sf, route(" callee  résumé "))


@query("grep_invert", f"WITH {_LINES} SELECT doc_id, line_no, line FROM l WHERE NOT regexp_matches(line, '[a-z]{{3,}}')")
def grep_invert(spark: SparkSession, sf: str) -> DataFrame:
    return _grep(spark, sf, SearchOption("[a-z]{3,}", True), invert=True)


@query("grep_count", f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines FROM l WHERE contains(line, 'search') GROUP BY doc_id")
def grep_count(spark: SparkSession, sf: str) -> DataFrame:
    return lines.count_matches(_grep(spark, sf, SearchOption("search")), ["doc_id"])


@query("grep_files_with_match", f"WITH {_LINES} SELECT DISTINCT doc_id FROM l WHERE contains(line, 'return')")
def grep_files_with_match(spark: SparkSession, sf: str) -> DataFrame:
    return lines.files_with_match(_grep(spark, sf, SearchOption("return")), ["doc_id"])


@query(
    "grep_context",
    f"""WITH {_LINES}, h AS (SELECT doc_id, line_no FROM l WHERE contains(line, 'hash'))
SELECT l.doc_id, l.line_no, l.line, bool_or(l.line_no = h.line_no) AS is_match FROM l JOIN h ON h.doc_id = l.doc_id AND l.line_no BETWEEN h.line_no - 1 AND h.line_no + 2 GROUP BY ALL""",
)
def grep_context(spark: SparkSession, sf: str) -> DataFrame:
    return lines.with_context(table(spark, sf, "documents"), ["doc_id"], SearchOption("hash"), 1, 2)


@query(
    "grep_output",
    f"WITH {_LINES} SELECT concat_ws(':', d.file_path, l.line_no::VARCHAR, l.line) AS value FROM l JOIN documents d USING (doc_id) WHERE contains(l.line, 'score') AND lower(regexp_extract(d.file_path, '(\\.[^./]*)$', 1)) IN ('.go', '.py')",
)
def grep_output(spark: SparkSession, sf: str) -> DataFrame:
    option = SearchOption("score", extensions=("go", ".PY"))
    return lines.grep_output(lines.grep(table(spark, sf, "documents"), ["file_path"], option, path="file_path"), "file_path")


@query(
    "grep_first",
    f"WITH {_LINES} SELECT concat_ws(':', line_no::VARCHAR, line) AS value FROM (SELECT * FROM l JOIN documents USING (doc_id) WHERE contains(line, 'score') ORDER BY file_path NULLS FIRST, line_no, doc_id LIMIT 20)",
)
def grep_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty hits, without the names of their files."""
    hits = lines.grep(table(spark, sf, "documents"), ["file_path", "doc_id"], SearchOption("score"))
    named = hits.select(F.struct("file_path", "line_no", "doc_id").alias("place"), "line_no", "line")
    return lines.grep_output(lines.first_hits(named, "place", 20), "place", names=False)


@query(
    "line_dedup_consecutive",
    f"WITH {_LINES}, w AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM l) SELECT doc_id, line_no, line FROM w WHERE before IS DISTINCT FROM line",
)
def line_dedup_consecutive(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    rows = lines.lines(table(spark, sf, "documents"), ["doc_id"]).withColumn("before", before)
    return rows.filter(~F.col("before").eqNullSafe(F.col("line"))).drop("before")


@query(
    "line_slice",
    "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS slice FROM documents WHERE text IS NOT NULL",
)
def line_slice(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", tx.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("slice"))


@query(
    "hit_to_chunk",
    """WITH c AS (SELECT DISTINCT id, file_path, content, start_line, end_line FROM chunks),
l AS (SELECT file_path, start_line + unnest(range(0, len(string_split(content, chr(10))))) AS line_no, unnest(string_split(content, chr(10))) AS line FROM c WHERE content <> '')
SELECT DISTINCT c.id, c.file_path, c.start_line, c.end_line FROM c JOIN l ON l.file_path = c.file_path AND l.line_no BETWEEN c.start_line AND c.end_line WHERE contains(l.line, 'return')""",
)
def hit_to_chunk(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks").select("id", "file_path", "content", "start_line", "end_line").distinct()
    hits = lines.grep(chunks, ["file_path", "start_line"], SearchOption("return"), "content").select(F.col("file_path").alias("path"), (F.col("start_line") + F.col("line_no") - 1).alias("line_no"))
    spans = chunks.select("id", "file_path", "start_line", "end_line").withColumn("path", F.col("file_path"))
    return lines.hits_to_chunks(hits, spans, "path", "start_line", "end_line").drop("path")


# Text functions

@query(
    "text_functions",
    """SELECT DISTINCT id, lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) AS ending, sha256(content) AS content_hash,
  CASE WHEN starts_with(file_path, cwd || '/') THEN substring(file_path, length(cwd) + 2) ELSE file_path END AS below,
  contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'return') AS has_return FROM chunks""",
)
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    path, content = F.col("file_path"), F.col("content")
    return table(spark, sf, "chunks").select(
        "id", tx.extension(path).alias("ending"), F.sha2(content, 256).alias("content_hash"), tx.relative_to(path, F.col("cwd")).alias("below"), tx.contains_fold(content, F.lit("RETURN")).alias("has_return")
    ).distinct()


@query(
    "embedding_text",
    "SELECT DISTINCT id, 'File: ' || file_path || ' (Lines: ' || start_line || '-' || end_line || ')' || chr(10) || 'Content:' || chr(10) || content AS body FROM chunks WHERE content IS NOT NULL",
)
def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunks").filter("content IS NOT NULL")
    return rows.select("id", tx.embedding_text(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("body")).distinct()


@query(
    "corpus_totals",
    "SELECT cwd, count(DISTINCT file_path) AS n_files, count(DISTINCT id) AS n_chunks, sum(len(string_split(content, chr(10))))::BIGINT AS n_lines FROM (SELECT DISTINCT id, cwd, file_path, content FROM chunks) GROUP BY cwd",
)
def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.corpus_totals(table(spark, sf, "chunks"))


# Structure

@query(
    "chunk_yaml",
    """WITH c AS (SELECT DISTINCT id, content FROM chunks WHERE content IS NOT NULL AND (ends_with(file_path, '.yaml') OR ends_with(file_path, '.yml'))),
d AS (SELECT id, content, unnest(string_split(content, CASE WHEN contains(content, chr(13) || chr(10) || '---' || chr(13) || chr(10)) THEN chr(13) || chr(10) || '---' || chr(13) || chr(10) ELSE chr(10) || '---' || chr(10) END)) AS doc FROM c)
SELECT id, greatest(count(*) FILTER (WHERE regexp_matches(doc, '\\S')), 1) AS n_chunks FROM d GROUP BY id""",
)
def chunk_yaml(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunks").filter("content IS NOT NULL").filter(tx.has_extension(F.col("file_path"), ["yml", "yaml"])).select("id", "content").distinct()
    made = chunkers.chunk_files(rows.select(F.concat("id", F.lit(".yaml")).alias("path"), F.col("content").alias("text")), most=1 << 30)
    return made.groupBy(F.regexp_replace("path", r"\.yaml$", "").alias("id")).agg(F.count(F.lit(1)).alias("n_chunks"))


@query("chunk_structure")
def chunk_structure(spark: SparkSession, sf: str) -> DataFrame:
    return chunkers.chunk_files(table(spark, sf, "documents").filter("file_path IS NOT NULL"), "file_path", "text")


@query("callgraph_extract")
def callgraph_extract(spark: SparkSession, sf: str) -> DataFrame:
    return callgraph.extract_graph(table(spark, sf, "documents").filter("file_path IS NOT NULL"), "file_path", "text")


# Call graph

_STEPS = """
n AS (SELECT DISTINCT cwd, symbol_name AS name, file_path, start_line, end_line FROM call_nodes WHERE deleted_at IS NULL),
e AS (SELECT DISTINCT cwd, caller, callee FROM call_edges WHERE callee <> ''),
k AS (SELECT DISTINCT cwd, name, file_path, start_line, end_line, unnest(list_transform(range(1, len(string_split(name, '.')) + 1), lambda i: array_to_string(string_split(name, '.')[i:], '.'))) AS callee FROM n),
s AS (SELECT DISTINCT e.cwd, e.caller AS source, e.callee, k.name, k.file_path, k.start_line, k.end_line FROM e JOIN k ON k.cwd = e.cwd AND k.callee = e.callee)"""


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf, "call_nodes").filter("deleted_at IS NULL").select("cwd", F.col("symbol_name").alias("name"), "file_path", "start_line", "end_line").distinct()
    return nodes, table(spark, sf, "call_edges").select("cwd", "caller", "callee")


@query("callgraph_callees", f"WITH {_STEPS} SELECT cwd, source AS caller, callee, name, file_path, start_line, end_line FROM s")
def callgraph_callees(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return callgraph.resolve(edges, nodes, strict=True, scope=["cwd"])


@query(
    "callgraph_suffix_join",
    """WITH n AS (SELECT DISTINCT cwd, symbol_name AS name, file_path, start_line, end_line FROM call_nodes WHERE deleted_at IS NULL), e AS (SELECT DISTINCT cwd, caller, callee FROM call_edges WHERE length(callee) > 0)
SELECT DISTINCT e.cwd, e.caller, e.callee, n.name, n.file_path, n.start_line, n.end_line FROM e JOIN n ON n.cwd = e.cwd AND ends_with(n.name, e.callee)""",
)
def callgraph_suffix_join(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return callgraph.resolve(edges, nodes, scope=["cwd"])


@query("callgraph_callers", f"WITH {_STEPS} SELECT DISTINCT s.cwd, s.name AS source, n.name, n.file_path, n.start_line, n.end_line FROM s JOIN n ON n.cwd = s.cwd AND n.name = s.source")
def callgraph_callers(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return callgraph.callers(edges, nodes, strict=True, scope=["cwd"])


@query(
    "graph_purge",
    """WITH f AS (SELECT cwd, node_path, arg_max(lower(node_hash), scanned_at) AS h FROM merkle_nodes WHERE node_type = 'file' GROUP BY ALL),
g AS (SELECT cwd, arg_max(run_id, (started_at, run_id)) AS run_id FROM index_runs WHERE run_state = 'ok' GROUP BY cwd),
j AS (SELECT cwd, any_value(tree_json) AS tree FROM merkle_trees JOIN g USING (cwd, run_id) GROUP BY cwd),
o AS (SELECT DISTINCT j.cwd, x.value->>'path' AS node_path, lower(x.value->>'hash') AS h FROM j, json_tree(j.tree) AS x WHERE x.type = 'OBJECT' AND x.value->>'type' = 'file'),
c AS (SELECT coalesce(f.node_path, o.node_path) AS file_path FROM f FULL JOIN o ON o.cwd = f.cwd AND o.node_path = f.node_path WHERE f.h IS DISTINCT FROM o.h)
SELECT DISTINCT cwd, symbol_name, file_path, start_line, end_line FROM call_nodes n WHERE file_path IS NULL OR NOT EXISTS (FROM c WHERE c.file_path = n.file_path)""",
)
def graph_purge(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes that stay in the graph when the files changed since the last successful run are taken out of it."""
    nodes = table(spark, sf, "call_nodes").select("cwd", "symbol_name", "file_path", "start_line", "end_line").distinct()
    changed = incremental.pending_changes(*(table(spark, sf, t) for t in ("merkle_nodes", "merkle_trees", "index_runs"))).select(F.col("node_path").alias("file_path"))
    return callgraph.replace_graph(nodes, nodes.limit(0), changed)


@query(
    "call_tree_recursive",
    f"""WITH RECURSIVE {_STEPS},
r AS (SELECT cwd, min(name) AS root FROM n GROUP BY cwd),
t AS (SELECT r.cwd, r.root, 1 AS depth, [r.root, s.name] AS path, s.name, s.file_path, s.start_line, s.end_line, s.name = r.root AS closed FROM r JOIN (SELECT DISTINCT cwd, source, name, file_path, start_line, end_line FROM s) s ON s.cwd = r.cwd AND s.source = r.root
  UNION ALL SELECT t.cwd, t.root, t.depth + 1, list_append(t.path, s.name), s.name, s.file_path, s.start_line, s.end_line, list_contains(t.path, s.name)
  FROM t JOIN (SELECT DISTINCT cwd, source, name, file_path, start_line, end_line FROM s) s ON s.cwd = t.cwd AND s.source = t.name WHERE t.depth < 3 AND NOT t.closed)
SELECT cwd, root, depth, array_to_string(path, ' > ') AS path, name, file_path, start_line, end_line FROM t""",
)
def call_tree_recursive(spark: SparkSession, sf: str) -> DataFrame:
    """Three levels of calls below each codebase's first symbol."""
    nodes, edges = _graph(spark, sf)
    steps = callgraph.resolve(edges, nodes, strict=True, scope=["cwd"]).select("cwd", F.col("caller").alias("source"), "name", "file_path", "start_line", "end_line").distinct()
    starts = nodes.groupBy("cwd").agg(F.min("name").alias("name"))
    return callgraph.call_tree(starts, steps, 3, ["cwd"]).withColumn("path", F.array_join("path", " > "))


# Hashes and snapshots

@query(
    "merkle_file_hash",
    """WITH c AS (SELECT DISTINCT id, file_path, start_line, end_line, content FROM chunks)
SELECT file_path, sha256(string_agg(sha256(coalesce(content, '')), '' ORDER BY start_line NULLS FIRST, end_line NULLS FIRST, id)) AS file_hash FROM c GROUP BY file_path""",
)
def merkle_file_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunks").select("id", "file_path", "start_line", "end_line", merkle.chunk_hash(F.col("content")).alias("h")).distinct()
    return merkle.file_hashes(rows, "file_path", ["start_line", "end_line", "id"], "h")


@query("merkle_folder_hash", "SELECT DISTINCT node_path, arg_max(lower(node_hash), scanned_at) AS node_hash FROM merkle_nodes WHERE node_type = 'directory' GROUP BY node_path")
def merkle_folder_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Folder hashes made anew from those of the files; they must equal the scanned ones."""
    nodes = table(spark, sf, "merkle_nodes")
    files = incremental.latest_files(nodes).select("node_path", "node_hash")
    return merkle.folder_hashes(files, nodes.select(F.col("cwd").alias("root")).distinct())


_SNAPSHOTS = """
g AS (SELECT cwd, arg_min(run_id, (started_at, run_id)) AS first_run, arg_max(run_id, (started_at, run_id)) AS last_run FROM index_runs WHERE run_state = 'ok' GROUP BY cwd),
j AS (SELECT cwd, run_id, any_value(tree_json) AS tree FROM merkle_trees GROUP BY cwd, run_id),
f AS (SELECT DISTINCT j.cwd, j.run_id, x.value->>'path' AS node_path, lower(x.value->>'hash') AS h FROM j, json_tree(j.tree) AS x WHERE x.type = 'OBJECT' AND x.value->>'type' = 'file'),
b AS (SELECT f.* FROM f JOIN g ON g.cwd = f.cwd AND g.first_run = f.run_id), a AS (SELECT f.* FROM f JOIN g ON g.cwd = f.cwd AND g.last_run = f.run_id),
d AS (SELECT coalesce(a.cwd, b.cwd) AS cwd, coalesce(a.node_path, b.node_path) AS node_path, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'deleted' ELSE 'modified' END AS change_kind
  FROM a FULL JOIN b ON a.cwd = b.cwd AND a.node_path = b.node_path WHERE a.h IS DISTINCT FROM b.h)"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """From the tree of each codebase's first successful run to that of its last."""
    trees, runs = table(spark, sf, "merkle_trees"), table(spark, sf, "index_runs")
    good = runs.filter("run_state = 'ok'").groupBy("cwd")
    first = good.agg(F.min(F.struct("started_at", "run_id")).alias("m")).select("cwd", F.col("m.run_id").alias("run_id"))

    def files(which: DataFrame) -> DataFrame:
        return incremental.explode_trees(trees.join(which, ["cwd", "run_id"]).select("cwd", "tree_json").distinct()).distinct()

    return merkle.diff(files(first), files(incremental.last_good_runs(runs)), ["cwd", "node_path"], "node_hash")


@query("merkle_diff", f"WITH {_SNAPSHOTS} SELECT cwd, node_path, change_kind FROM d")
def merkle_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf)


@query("merkle_diff_counts", f"WITH {_SNAPSHOTS} SELECT change_kind, count(*) AS n_files FROM d GROUP BY change_kind")
def merkle_diff_counts(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.change_counts(_changes(spark, sf))


@query("codebases_by_update", "SELECT cwd, max(updated_at) AS updated_at FROM merkle_trees GROUP BY cwd")
def codebases_by_update(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.by_update(table(spark, sf, "merkle_trees"))


@query(
    "scope_resolve",
    """WITH c AS (SELECT DISTINCT cwd FROM merkle_nodes), f AS (SELECT DISTINCT cwd AS path FROM memory_items WHERE cwd IS NOT NULL)
SELECT f.path, arg_max(c.cwd, length(c.cwd)) AS codebase FROM f JOIN c ON f.path = c.cwd OR starts_with(f.path, c.cwd || '/') GROUP BY f.path""",
)
def scope_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The longest registered codebase above each file: every folder above it is looked up, so it is an equi-join."""
    return hybrid.scope_roots(table(spark, sf, "merkle_nodes"), table(spark, sf, "memory_items").filter("cwd IS NOT NULL").select(F.col("cwd").alias("path")))


# Vectors

@query("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query(
    "cosine_topk",
    """SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, id LIMIT 25""",
)
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    one = rows.filter("vec_id = 0").select("embedding").first()[0]
    return vectors.top_k(rows, one, 25, "vec_id").withColumn("similarity", F.round("similarity", 6))


@query(
    "cosine_topk_per_query",
    """WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS x FROM q, embeddings e),
r AS (SELECT query_id, id, round(x, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12) DESC, id) AS rank FROM s) SELECT query_id, id, similarity, rank::INTEGER AS rank FROM r WHERE rank <= 5""",
)
def cosine_topk_per_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    asked = rows.filter(F.col("vec_id") % 20 == 0).select("vec_id", "embedding")
    return vectors.top_k_many(rows, asked, 5, "vec_id").withColumn("similarity", F.round("similarity", 6))


@query("quantized_topk")
def quantized_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 best for the first vector, scored on four-bit codes."""
    rows = table(spark, sf, "embeddings")
    q = quantizer.Quantizer(64, 4)
    return q.search(q.quantize(rows, "vec_id"), rows.filter("vec_id = 0").select("embedding").first()[0], 25)


@query("quantized_recall")
def quantized_recall(spark: SparkSession, sf: str) -> DataFrame:
    """(k, recall): how often the most similar other vector is among the first k by four-bit codes, for every vector whose id is divisible by 20."""
    rows = table(spark, sf, "embeddings")
    asked = rows.filter(F.col("vec_id") % 20 == 0).select("vec_id", "embedding")
    q = quantizer.Quantizer(64, 4)
    best = vectors.top_k_many(rows, asked, 1, "vec_id", exclude_self=True).select("query_id", "id")
    coded = q.search_many(q.quantize(rows, "vec_id"), asked, 33).filter(F.col("query_id") != F.col("id"))
    place = coded.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("place"))
    found = best.join(place, ["query_id", "id"], "left")
    ks = F.explode(F.array(*[F.lit(k) for k in (1, 2, 4, 8, 16, 32)])).alias("k")
    return found.select("place", ks).groupBy("k").agg(F.round(F.avg(F.when(F.col("place") <= F.col("k"), 1.0).otherwise(0.0)), 4).alias("recall"))


@query("quantized_footprint", "SELECT count(*) AS n_vectors, (count(*) * 36)::BIGINT AS code_bytes FROM embeddings")
def quantized_footprint(spark: SparkSession, sf: str) -> DataFrame:
    return quantizer.footprint(quantizer.Quantizer(64, 4).quantize(table(spark, sf, "embeddings"), "vec_id"))


@query(
    "vector_casts",
    """WITH h AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS digits FROM documents WHERE text <> '')
SELECT doc_id, n AS n_numbers, list_sum(list_transform(string_split_regex(regexp_replace(digits, '(..)', '\\1,', 'g')[:-2], ','), lambda x: ('0x' || x)::INTEGER))::BIGINT AS total, true AS same FROM h""",
)
def vector_casts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as vectors of their bytes and back."""
    rows = table(spark, sf, "documents").filter("text <> ''").withColumn("v", vectors.text_to_floats(F.col("text")))
    total = F.aggregate(vectors.to_ints(F.col("v")), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total")
    return rows.select("doc_id", F.size("v").cast("bigint").alias("n_numbers"), total, (vectors.floats_to_text(F.col("v")) == F.col("text")).alias("same"))


@query("quantized_round_trip", "SELECT vec_id AS id, 36::BIGINT AS n_bytes, true AS same FROM embeddings")
def quantized_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Codes packed into records and read back: four bytes of norm and four bits a number, nothing lost."""
    index = quantizer.Quantizer(64, 4).quantize(table(spark, sf, "embeddings"), "vec_id")
    back = quantizer.deserialize(quantizer.serialize(index), 64, 4).select("id", F.col("norm").alias("n2"), F.col("codes").alias("c2"))
    return index.join(back, "id").select("id", (F.length("c2") + 4).cast("bigint").alias("n_bytes"), ((F.col("norm") == F.col("n2")) & (F.col("codes") == F.col("c2"))).alias("same"))


@query("quantized_accuracy", "SELECT vec_id AS id, true AS close FROM embeddings")
def quantized_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each vector decoded from its four-bit codes has a cosine of 0.98 and more with the vector itself, and its length within a tenth."""
    rows, q = table(spark, sf, "embeddings"), quantizer.Quantizer(64, 4)
    back = q.dequantize(q.quantize(rows, "vec_id")).select("id", F.col("embedding").alias("made"))
    both = rows.join(back, F.col("vec_id") == F.col("id"))
    size = F.abs(vectors.norm(F.col("made")) / vectors.norm(F.col("embedding")) - 1) < 0.1
    return both.select("id", ((vectors.cosine(F.col("embedding"), F.col("made")) >= 0.98) & size).alias("close"))


@query("index_compact", "SELECT DISTINCT m.id FROM memory_items m WHERE m.id IN (SELECT id FROM chunks WHERE content IS NOT NULL)")
def index_compact(spark: SparkSession, sf: str) -> DataFrame:
    return quantizer.compact(table(spark, sf, "memory_items").select("id"), table(spark, sf, "chunks").filter("content IS NOT NULL")).distinct()


@query("index_stale", "SELECT DISTINCT id FROM memory_items WHERE id NOT IN (SELECT id FROM chunks WHERE content IS NOT NULL AND id IS NOT NULL)")
def index_stale(spark: SparkSession, sf: str) -> DataFrame:
    return quantizer.delete_rows(table(spark, sf, "memory_items").select("id"), table(spark, sf, "chunks").filter("content IS NOT NULL")).distinct()


# Fusion and measures

@query(
    "rrf_hybrid",
    """WITH c AS (SELECT query_id, id, max(similarity) FILTER (WHERE NOT isnan(similarity)) AS a, max(lex_score) FILTER (WHERE NOT isnan(lex_score)) AS b FROM search_candidates GROUP BY ALL),
s AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, id) AS rank FROM c WHERE a IS NOT NULL), x AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, id) AS rank FROM c WHERE b IS NOT NULL)
SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM (SELECT * FROM s UNION ALL SELECT * FROM x) GROUP BY query_id, id""",
)
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    def best(c: str) -> F.Column:
        return F.max(F.when(~F.isnan(c), F.col(c)))

    rows = Stage(spark, "candidates").write(table(spark, sf, "search_candidates").groupBy("query_id", "id").agg(best("similarity").alias("a"), best("lex_score").alias("b")))

    def ranks(c: str) -> DataFrame:
        numbered = row_numbers(rows.filter(F.col(c).isNotNull()), ["query_id"], [F.col(c).desc(), F.col("id")])
        return numbered.select(F.struct("query_id", "id").alias("id"), "rank")

    return hybrid.reciprocal_ranks(ranks("a"), ranks("b")).select("id.query_id", "id.id", F.round("rrf", 9).alias("rrf"))


@query(
    "hybrid_search",
    """WITH m AS (SELECT id, any_value(symbol_name) AS symbol_name, any_value(cwd) AS path, any_value(line_start) AS line_start, any_value(line_end) AS line_end, any_value(embedding) AS embedding FROM memory_items WHERE len(embedding) = 64 GROUP BY id),
q AS (SELECT embedding FROM m ORDER BY id LIMIT 1),
s AS (SELECT id, list_cosine_similarity(m.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS x FROM m, q WHERE NOT list_bool_or(list_transform(m.embedding, lambda v: isnan(v))) AND list_sum(list_transform(m.embedding, lambda v: abs(v))) > 0),
a AS (SELECT id, row_number() OVER (ORDER BY x DESC, id) AS rank FROM (FROM s ORDER BY x DESC, id LIMIT 30) WHERE x >= 0.1),
f AS (SELECT DISTINCT file_path, content, start_line FROM chunks WHERE content <> '' AND lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) IN ('.go', '.py', '.tf', '.yaml', '.yml')),
l AS (SELECT file_path, coalesce(start_line, 1) + unnest(range(0, len(string_split(content, chr(10))))) AS line_no, unnest(string_split(content, chr(10))) AS line FROM f),
h AS (SELECT DISTINCT m.id, m.path, m.line_start, m.line_end FROM m JOIN l ON l.file_path = m.path AND l.line_no BETWEEN m.line_start AND m.line_end WHERE contains(l.line, 'prune') OR contains(l.line, 'merge')),
b AS (SELECT id, row_number() OVER (ORDER BY path, line_start, line_end, id) AS rank FROM (FROM h ORDER BY path, line_start, line_end, id LIMIT 30)),
r AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (FROM a UNION ALL FROM b) GROUP BY id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, id LIMIT 10)
SELECT id, round(rrf, 12) AS rrf, symbol_name, path, line_start, line_end FROM r JOIN m USING (id)""",
)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best chunks for a text and the vector of the first usable memory."""
    items = table(spark, sf, "memory_items").filter("size(embedding) = 64").dropDuplicates(["id"])
    memories = items.select("id", "symbol_name", F.col("cwd").alias("path"), "line_start", "line_end", "embedding")
    files = table(spark, sf, "chunks").filter("content IS NOT NULL").select(F.col("file_path").alias("path"), F.col("content").alias("text"), "start_line")
    vector = memories.orderBy("id").select("embedding").first()[0]
    return hybrid.search(memories, files, "prune merge", vector, 10, first_line="start_line").withColumn("rrf", F.round("rrf", 12))


@query(
    "recall_mrr",
    """WITH c AS (SELECT query_id, id, max(similarity) FILTER (WHERE NOT isnan(similarity)) AS a, max(rerank_score) FILTER (WHERE NOT isnan(rerank_score)) AS b FROM search_candidates GROUP BY ALL),
t AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST, id) AS n FROM c) WHERE n = 1),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY a DESC NULLS LAST, id) AS rank FROM c), p AS (SELECT rank FROM t JOIN r USING (query_id, id))
SELECT count(*) AS n_queries, round(avg(1.0::DOUBLE / rank), 9) AS mrr, round(avg((rank <= 1)::INT), 9) AS recall_at_1, round(avg((rank <= 3)::INT), 9) AS recall_at_3, round(avg((rank <= 5)::INT), 9) AS recall_at_5 FROM p""",
)
def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """How the ranking by similarity places the candidate that the reranker likes best."""
    def best(c: str) -> F.Column:
        return F.max(F.when(~F.isnan(c), F.col(c)))

    rows = Stage(spark, "candidates").write(table(spark, sf, "search_candidates").groupBy("query_id", "id").agg(best("similarity").alias("a"), best("rerank_score").alias("b")))

    def ranks(c: str) -> DataFrame:
        return row_numbers(rows.select("query_id", "id", c), ["query_id"], [F.col(c).desc_nulls_last(), F.col("id")]).select("query_id", "id", "rank")

    return evaluation.recall_and_mrr(ranks("a"), ranks("b").filter("rank = 1").select("query_id", "id"))


# Relational baseline

@query(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n_rows
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def tpch_q1(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n_rows"))
    )


@query(
    "tpch_q3",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, l_orderkey LIMIT 10""",
)
def tpch_q3(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    made = joined.groupBy("l_orderkey", "o_orderdate").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return made.orderBy(F.col("r").desc(), "l_orderkey").limit(10).select("l_orderkey", F.round("r", 2).alias("revenue"), "o_orderdate")


@query("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def tpch_q6(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)).agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 2) AS sum_value FROM events GROUP BY ALL")
def event_windows_query(spark: SparkSession, sf: str) -> DataFrame:
    return event_windows(table(spark, sf, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
