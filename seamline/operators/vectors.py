"""Exact vector arithmetic and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Queries and rows compared at a time, and the most bytes of queries that are broadcast: more of them meet the rows in a grid of blocks.
QUERY_BLOCK, ROW_BLOCK, BROADCAST_BYTES = 4096, 16384, 32 << 20


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for zero or empty vectors, null where lengths differ or a vector is null."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) < 0) | (F.size(b) < 0) | (F.size(a) != F.size(b)), None).when(size == 0, 0.0).otherwise(dot(a, b) / size)


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def top_k(df: DataFrame, query, k: int, id_col: str = "id", vec_col: str = "embedding", least: float | None = None) -> DataFrame:
    """(id, similarity) of the k vectors most similar to one query vector, ties by id. k must be at least 1."""
    if k < 1:
        raise ValueError("k must be at least 1")
    scored = df.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), vector_literal(query)).alias("similarity")).filter(F.col("similarity").isNotNull())
    best = scored.orderBy(F.col("similarity").desc(), "id").limit(k)
    return best.filter(F.col("similarity") >= least) if least is not None else best


def in_blocks(rows: DataFrame, queries: DataFrame, score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows that `score` makes of every block of `queries` (query_id, v) and every batch or block of `rows` (id, ...), exactly.

    Queries of at most `most_bytes` go to where the rows are. More of them are dealt, as the rows are, into blocks of bounded size by hash, and each pair of blocks is
    one task's work, so that nothing is gathered on the driver or in one task, whatever their number. `score` must keep per query only what it needs.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    if 8 * size.numbers + 64 * size.n <= most_bytes:
        shared = rows.sparkSession.sparkContext.broadcast(queries.toPandas())  # checked: at most most_bytes

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked = shared.value
            for pdf in batches:
                for at in range(0, len(asked) if len(pdf) else 0, QUERY_BLOCK):
                    yield score(asked.iloc[at : at + QUERY_BLOCK], pdf)

        return rows.mapInPandas(near, schema)
    blocks, width = -(-size.n // QUERY_BLOCK), -(-rows.count() // ROW_BLOCK) or 1

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left, right = dealt(queries, "_q", blocks, "_r", width), dealt(rows, "_r", width, "_q", blocks)
    pairs = left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r"))
    return pairs.applyInPandas(lambda q, r: score(q, r), schema)


def keep_best(scores: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row and of what ties with the last of them, above `least`."""
    limit = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    return np.nonzero((scores >= limit[:, None]) & (scores > least))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by similarity to 12 digits, then id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k_many(df: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", exclude_self: bool = False, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, id, similarity, rank) of the k most similar vectors of every query (query_id, vector), exactly, ties by id.

    Blocks of queries are compared with blocks of the vectors of their own length by matrix products that keep their best k, so that only k rows per query and block are
    shuffled for the final ranks. Vectors that are null, zero, not finite or of a length no query has score nothing.
    """
    asked = queries.select(F.col(queries.columns[0]).alias("query_id"), F.col(queries.columns[1]).alias("v")).filter("size(v) > 0")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("size(v) > 0")

    def score(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = []
        q_size, r_size = q["v"].map(len).to_numpy(), r["v"].map(len).to_numpy()
        for dim in np.intersect1d(q_size, r_size):
            names, own = q["query_id"].to_numpy()[q_size == dim], r["id"].to_numpy()[r_size == dim]
            a, b = (np.array(x["v"][n == dim].tolist(), np.float64).reshape(-1, dim) for x, n in ((q, q_size), (r, r_size)))
            length, n = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
            good = np.isfinite(n) & (n > 0)
            a, b, own = a / np.where(length > 0, length, 1)[:, None], b[good] / n[good][:, None], own[good]
            for at in range(0, len(names), 256):
                s = a[at : at + 256] @ b.T
                if exclude_self:
                    s[names[at : at + 256, None] == own[None, :]] = -2
                i, j = keep_best(s, k, -1.5)
                found.append(pd.DataFrame({"query_id": names[at + i], "id": own[j], "similarity": s[i, j]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": q["query_id"][:0], "id": r["id"][:0], "similarity": np.zeros(0)})

    kinds = dict(asked.dtypes)["query_id"], dict(rows.dtypes)["id"]
    return ranked(in_blocks(rows, asked, score, f"query_id {kinds[0]}, id {kinds[1]}, similarity double", most_bytes), k)


def to_floats(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("float"))


def to_ints(v: Column) -> Column:
    """Rounded half away from zero."""
    return F.transform(v, lambda x: F.round(x.cast("double")).cast("int"))


def bytes_to_floats(v: Column) -> Column:
    """Each byte of a binary as a number of 0 to 255."""
    pairs = F.regexp_extract_all(F.hex(v), F.lit(".."), 0)
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("float"))


def floats_to_bytes(v: Column) -> Column:
    """Rounded and clamped to 0 to 255."""
    return F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.round(x.cast("double")).cast("int")))), 2, "0")), ""))


def text_to_floats(v: Column) -> Column:
    """Each byte of a text as a number of 0 to 255."""
    return bytes_to_floats(F.encode(v, "UTF-8"))


def floats_to_text(v: Column) -> Column:
    """The text whose bytes the rounded numbers are."""
    return F.decode(floats_to_bytes(v), "UTF-8")
