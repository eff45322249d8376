"""The engine: a store of indexed codebases with line search, hybrid search and call-graph queries over it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from seamline import schemas
from seamline.config import Config
from seamline.functions.regex import INDEXED, SearchOption, to_java
from seamline.functions.text import chunk_id, embedding_text, line_slice, relative_to, within
from seamline.operators import callgraph, hybrid, lines, merkle, quantizer
from seamline.operators.chunkers import chunk_files
from seamline.session import Stage, ship
from seamline.sources.embedding import Embedder, HashEmbedder, embed
from seamline.sources.scan import scan_tree


class Engine:
    """All tables are Parquet folders partitioned by codebase; a sync replaces the partition of its codebase, the file state last."""

    def __init__(self, spark: SparkSession, config: Config, embedder: Embedder | None = None):
        ship(spark)
        self.spark, self.config = spark, config
        self.embedder = embedder or HashEmbedder(config.dim)
        self.quantizer = quantizer.Quantizer(config.dim, config.bits, config.seed)

    # Store

    def table(self, name: str, codebase: str | None = None) -> DataFrame:
        """A table of the store, empty where nothing was written; one codebase's partition only, if named."""
        path = f"{self.config.store}/{name}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schemas.TABLES[name])
        df = self.spark.read.schema(schemas.TABLES[name]).parquet(path)
        return df.filter(F.col("codebase") == codebase) if codebase else df

    def _replace(self, name: str, codebase: str, rows: DataFrame) -> None:
        out = rows.withColumn("codebase", F.lit(codebase))
        columns = [c.split()[0] for c in schemas.TABLES[name].split(", ")]
        writer = out.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("codebase")
        if out.isEmpty():
            self._drop(name, codebase)
        else:
            writer.parquet(f"{self.config.store}/{name}")

    def _drop(self, name: str, codebase: str) -> None:
        names = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.config.store}/{name}/codebase={names.escapePathName(codebase)}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    # Indexing

    def sync(self, root: str, progress: Callable[[str, int], None] | None = None) -> dict[str, int]:
        """Bring a codebase up to date and return how many files were added, modified and deleted, and how many failed.

        Only files whose text changed are chunked, only those whose chunks or their lines changed are embedded. Files of which a text can't be embedded
        keep their old state and are tried again next time. The file state is written last: a run that dies before it is repeated, not lost.
        `progress` is told how many files were read, changed and failed and how many chunks were embedded, as each becomes known.
        """
        tell = progress or (lambda *_: None)
        codebase = os.path.realpath(root)
        stage = Stage(self.spark, "sync")
        files = stage.write(scan_tree(self.spark, [codebase]).select("path", "text"))
        settings = F.lit(f"{self.config.max_chunk_bytes} {self.config.yaml_compat}")
        texts = files.select("path", F.sha2(F.concat_ws("\u001f", settings, "text"), 256).alias("text_hash"))
        before = self.table("file_state", codebase).select("path", "file_hash", "text_hash")
        touched = stage.write(texts.join(before.select("path", "text_hash"), ["path", "text_hash"], "left_anti"))
        pieces = stage.write(chunk_files(files.join(touched, "path", "left_semi"), "path", "text", self.config.max_chunk_bytes, self.config.yaml_compat))
        hashed = pieces.withColumn("h", merkle.chunk_hash(F.col("content"), F.col("start_line"), F.col("end_line")))
        state = merkle.file_hashes(hashed, "path", ["ord"], "h")
        state = touched.join(state, "path", "left").select("path", F.coalesce("file_hash", F.lit(merkle.EMPTY)).alias("file_hash"), "text_hash")
        state = stage.write(state.unionByName(before.join(texts, ["path", "text_hash"], "left_semi")))
        changes = stage.write(merkle.diff(before, state, ["path"], "file_hash"))
        if progress:
            tell("files", files.count())
            tell("changes", changes.count())
        fresh = changes.filter("change_kind <> 'deleted'").select("path")
        new = pieces.join(fresh, "path", "left_semi").withColumn("id", chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content")))
        new = stage.write(new.dropDuplicates(["id"]))
        text = embedding_text(relative_to(F.col("path"), F.lit(codebase)), F.col("start_line"), F.col("end_line"), F.col("content"))
        made = stage.write(embed(new.select("id", text.alias("text")), self.embedder))
        failed = stage.write(new.join(made.filter("embedding IS NULL").select("id"), "id", "left_semi").select("path").distinct())
        if progress:
            tell("embedded", made.filter("embedding IS NOT NULL").count())
            tell("failed", failed.count())
        done = stage.write(changes.join(failed, "path", "left_anti"))
        gone = done.select("path")
        new = new.join(failed, "path", "left_anti")
        vectors = self.quantizer.quantize(made.join(new.select("id"), "id", "left_semi"))
        kept = self.table("chunks", codebase).join(gone, "path", "left_anti")
        added = new.select("id", F.col("symbol").alias("symbol_name"), "path", F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), F.current_timestamp().alias("created_at"))
        chunks = stage.write(kept.drop("codebase").unionByName(added))
        old_vectors = quantizer.compact(self.table("vectors", codebase).drop("codebase"), chunks)
        vectors = stage.write(quantizer.replace_rows(old_vectors, vectors))
        graph = callgraph.extract_graph(files.join(done.filter("change_kind <> 'deleted'").select("path"), "path", "left_semi"))
        graph = stage.write(callgraph.replace_graph(self.table("graph", codebase).drop("codebase"), graph, gone.withColumnRenamed("path", "file_path")))
        states = stage.write(state.join(failed, "path", "left_anti").unionByName(before.join(failed, "path", "left_semi")))
        for name, rows in (("files", files), ("chunks", chunks), ("vectors", vectors), ("graph", graph)):
            self._replace(name, codebase, rows)
        root_hash = merkle.folder_hashes(states.select(F.col("path").alias("node_path"), F.col("file_hash").alias("node_hash"))).filter(F.col("node_path") == codebase).select("node_hash").collect()
        self._replace("codebases", codebase, self.spark.createDataFrame([(root_hash[0][0] if root_hash else "",)], "root_hash string").withColumn("updated_at", F.current_timestamp()))
        self._replace("file_state", codebase, states)
        counts = {r.change_kind: r.n_files for r in merkle.change_counts(done).collect()}
        out = {k: counts.get(k, 0) for k in ("added", "modified", "deleted")} | {"failed": failed.count()}
        stage.clear()
        return out

    # Queries

    def codebases(self) -> DataFrame:
        return merkle.by_update(self.table("codebases"), "codebase").join(self.table("codebases").select("codebase", "root_hash"), "codebase").orderBy(F.col("updated_at").desc_nulls_last(), "codebase")

    def grep(self, pattern: str, regex: bool = False, extensions: tuple[str, ...] = INDEXED, cwd: str | None = None) -> DataFrame:
        """(path, line_no, line) of matching lines."""
        if regex:
            to_java(pattern)
        files = self.table("files")
        files = files.filter(within(F.col("path"), F.lit(os.path.realpath(cwd)))) if cwd else files
        return lines.grep(files, ["path"], SearchOption(pattern, regex, tuple(extensions)), "text", path="path")

    def search(self, query: str, cwd: str | None = None, limit: int | None = None) -> DataFrame:
        """(symbol_name, path, line_start, line_end, content, rrf) of the best chunks for a text, by quantized vectors and by lines.

        Scored are the vectors of the scope only; the text of the few results is cut from their files last.
        """
        limit = min(limit or self.config.default_limit, self.config.most_results)
        if limit < 1:
            raise ValueError("limit must be at least 1")
        scope = None
        if cwd:
            known = self.table("codebases").select(F.col("codebase").alias("cwd"))
            scope = hybrid.scope_root(known, os.path.realpath(cwd))
        chunks, files, vectors = (self.table(t) for t in ("chunks", "files", "vectors"))
        if scope:
            inside = within(F.col("path"), F.lit(scope))
            chunks, files = chunks.filter(inside), files.filter(inside)
        vector = self.embedder(query)
        budget = min(hybrid.MOST_CANDIDATES, 3 * limit)
        best = self.quantizer.search(vectors, vector, budget, chunks if scope else None)
        if any(vector):
            best = best.filter(F.col("similarity") >= hybrid.LEAST_SIMILARITY)
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "id")))  # at most MOST_CANDIDATES rows
        words = hybrid.lexical(files, chunks, query, limit)
        fused = hybrid.reciprocal_ranks(ranked, *([words] if words is not None else [])).orderBy(F.round("rrf", 12).desc(), "id").limit(limit)
        found = fused.join(chunks, "id").select("id", "rrf", "symbol_name", "path", "line_start", "line_end")
        whole = files.join(found.select("path").distinct(), "path", "left_semi").select("path", "text")
        return (
            found.join(whole, "path")
            .select("symbol_name", "path", "line_start", "line_end", line_slice(F.col("text"), F.col("line_start"), F.col("line_end")).alias("content"), "rrf", "id")
            .orderBy(F.round("rrf", 12).desc(), "id")
            .drop("id")
        )

    def call_graph(self, symbol: str, cwd: str | None = None, direction: str = "both", depth: int | None = None, strict: bool = False) -> DataFrame:
        """(direction, depth, path, name, file_path, start_line, end_line) around a symbol. A `cwd` outside all codebases is refused."""
        graph = self.table("graph")
        if cwd:
            known = self.table("codebases").select(F.col("codebase").alias("cwd"))
            here = os.path.realpath(cwd)
            scope = hybrid.scope_root(known, here)
            if known.filter(F.col("cwd") == scope).isEmpty():
                raise ValueError(f"{cwd} is in no indexed codebase")
            graph = graph.filter(F.col("codebase") == scope)
        return callgraph.call_report(callgraph.nodes_of(graph), callgraph.edges_of(graph), symbol, direction, depth or self.config.call_depth, strict)

    def stats(self) -> DataFrame:
        """(n_vectors, code_bytes, ratio) of the vector index."""
        return quantizer.footprint(self.table("vectors")).withColumn("ratio", F.lit(self.quantizer.ratio()))
