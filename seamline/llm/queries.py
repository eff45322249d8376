"""Named queries of the training-data problems, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline.llm import credentials, fusion, handwritten, lookalikes, mixing, neighbors, tokenizer
from seamline.session import Stage, ship
from seamline.sources.tables import table

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


@query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.classify_files(table(spark, sf, "chunks")).filter(F.col("kind") != "handwritten").select("file_path").distinct()


@query("p1_sources")
def p1_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every file of the last scan with its kind; files without chunks are judged by their path."""
    files = table(spark, sf, "merkle_nodes").filter(F.col("node_type") == "file").select("cwd", F.col("node_path").alias("file_path")).distinct()
    kinds = handwritten.classify_files(table(spark, sf, "chunks"))
    by_path = handwritten.path_kind(F.col("file_path"), F.coalesce("cwd", F.lit("")))
    return files.join(kinds, ["cwd", "file_path"], "left").select("cwd", "file_path", F.coalesce("kind", by_path, F.lit("handwritten")).alias("kind"))


@query("p1_evidence")
def p1_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """(kind, evidence, n_files): how many files each kind of evidence decides."""
    return handwritten.classify_files(table(spark, sf, "chunks")).groupBy("kind", "evidence").agg(F.count(F.lit(1)).alias("n_files"))


@query("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.find_credentials(table(spark, sf, "chunks")).select("id", "line_no").distinct()


@query("p3_redacted")
def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.redact_credentials(table(spark, sf, "chunks").select("id", "file_path", "content"))


@query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    found = neighbors.similar_vectors(table(spark, sf, "memory_items"), "id", "embedding", 64, k=10, least=0.85)
    return neighbors.similar_pairs(found).select("id_a", "id_b")


@query(
    "p4_nearest",
    """WITH s AS (SELECT q.vec_id, e.vec_id AS other_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS x FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
SELECT vec_id, other_id, round(x, 4) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(x, 12) DESC, other_id) <= 10""",
)
def p4_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar of every vector whose id is divisible by 20, among all vectors: every cell is looked into."""
    vectors = table(spark, sf, "embeddings")
    found = neighbors.similar_vectors(vectors, "vec_id", "embedding", 64, k=10, probes=neighbors.MOST_PIVOTS, queries=vectors.filter(F.col("vec_id") % 20 == 0).select("vec_id"))
    return found.select(F.col("id").alias("vec_id"), F.col("other").alias("other_id"), F.round("similarity", 4).alias("similarity"))


SCORES = ["similarity", "lex_score", "rrf_score", "rerank_score"]

_RRF = """
WITH d AS (SELECT query_id, id, arg_max(struct_pack(a := similarity, b := lex_score, c := rrf_score, d := rerank_score), scored_at) AS s
  FROM search_candidates WHERE query_id IS NOT NULL AND id IS NOT NULL GROUP BY query_id, id),
v AS (SELECT query_id, id, unnest([1, 2, 3, 4]) AS list, unnest([s.a, s.b, s.c, s.d]) AS score FROM d),
r AS (SELECT query_id, id, rank() OVER (PARTITION BY query_id, list ORDER BY CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST) AS rnk FROM v),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rnk)), 12) AS rrf FROM r GROUP BY query_id, id),
p AS (SELECT query_id, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS place_no FROM f)"""


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    rows = Stage(spark, "scores").write(fusion.latest_scores(table(spark, sf, "search_candidates"), "query_id", "id", SCORES, "scored_at"))
    return fusion.fused(rows, SCORES)


@query("p5_found", _RRF + "SELECT query_id, id FROM p WHERE place_no <= 3")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.top(_fused(spark, sf), 3).select(F.col("grp").alias("query_id"), F.col("item").alias("id"))


@query("p5_ranking", _RRF + "SELECT query_id, id, round(rrf, 12) AS fused_score FROM p")
def p5_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select(F.col("grp").alias("query_id"), F.col("item").alias("id"), F.round("rrf", 12).alias("fused_score"))


@query("p8_ids")
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf, "documents"))


def _mixed(spark: SparkSession, sf: str, fit: str = "total") -> DataFrame:
    sized = Stage(spark, "sizes").write(mixing.sized_documents(table(spark, sf, "documents")))
    return mixing.mix(sized, table(spark, sf, "mix_targets"), fit=fit)


@query("p9_mix")
def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)


@query("p9_shares")
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    mixed = Stage(spark, "mixed").write(_mixed(spark, sf))
    return mixing.shares(mixed, table(spark, sf, "mix_targets"))


@query("p9_even_shares")
def p9_even_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares of the largest mix in which every source with documents reaches its own."""
    mixed = Stage(spark, "mixed").write(_mixed(spark, sf, "shares"))
    return mixing.shares(mixed, table(spark, sf, "mix_targets"), fit="shares")


@query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = lookalikes.lookalike_pairs(lookalikes.visual_classes(table(spark, sf, "documents")))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


@query("p10_classes")
def p10_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document with the class of texts it looks like."""
    return lookalikes.visual_classes(table(spark, sf, "documents")).select(F.col("id").alias("doc_id"), "form_key")
