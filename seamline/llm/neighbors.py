"""The most similar vectors for every vector, by randomly rotated one-bit codes.

Vectors are scaled to unit length, equal ones collapsed, and each assigned to the nearest of a set of pivots drawn from the
data (so that dense regions get as many pivots as they have vectors). Against its pivot, a vector's residual is
padded to twice its dimension, rotated and kept as one bit per coordinate with correction scalars: its length and its inner product with its own code. A
query looks into the cells of its nearest pivots, estimates the inner products from the packed bits, and the error bound of
the estimate tells which candidates may still be among its best: only those are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from seamline.operators.prefix import running_totals
from seamline.session import Stage

#: Pivots: at least so many, about so many times the root of the number of vectors, at most so many (a documented sample).
LEAST_PIVOTS, PIVOTS_PER_ROOT, MOST_PIVOTS = 16, 2, 65_536
#: Most bytes of pivots that go to the driver and out to the executors: of long vectors there are fewer pivots, and so larger cells.
PIVOT_BYTES = 64 << 20
#: Cells each query looks into; standard deviations of the estimate's error that are allowed for; rows of a cell compared at a time.
PROBES, EPSILON, BLOCK = 8, 3.0, 2048
SEED = 42


def rotation(dim: int, bits: int | None = None, seed: int = SEED) -> np.ndarray:
    """A random matrix of `bits` (default `dim`) rows with orthonormal columns: it pads a vector with zeros and rotates it. The same for the same arguments."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits or dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _records(rows: np.ndarray) -> list[bytes]:
    """The rows of a matrix as bytes."""
    rows = np.ascontiguousarray(rows)
    return rows.view(f"V{rows.dtype.itemsize * rows.shape[1]}").ravel().tolist()


def code_bits(dim: int) -> int:
    """Bits of a code: twice the dimension, in whole words."""
    return -(-2 * dim // 64) * 64


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec) of the usable vectors at unit length; null, zero, otherwise long or not finite ones are left out. Repeated rows count once."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            fit = pc.and_(pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False), pc.is_valid(batch.column(0)))
            ids, vectors = batch.column(0).filter(fit), vectors.filter(fit)
            flat = vectors.flatten()
            x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                norms = np.linalg.norm(x, axis=1)
            good = np.isfinite(norms) & (norms > 0)
            unit = (x[good] / norms[good][:, None]).astype(np.float32)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, dim), pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), values], names=["id", "vec"])

    kind = dict(df.dtypes)[id_col]
    source = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    return source.mapInArrow(scale, f"id {kind}, vec array<float>").dropDuplicates(["id"])


def _matrix(s: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(s.to_numpy()).astype(np.float32).reshape(len(s), dim) if len(s) else np.zeros((0, dim), np.float32)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def rounded(query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(levels, low, step): rows rounded to 256 levels between their least and greatest number."""
    low, high = query.min(1), query.max(1)
    step = np.maximum((high - low) / 255.0, 1e-12)
    return np.rint((query - low[:, None]) / step[:, None]).astype(np.uint8), low, step


def estimate(levels: np.ndarray, low: np.ndarray, step: np.ndarray, codes: np.ndarray, own: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rotated, rounded queries with coded residuals, and one standard deviation of their error.

    With code x in {-1, 1}^d / sqrt(d), <x, q> = (2 sum of q over the set bits - sum of q) / sqrt(d), and the sum over the set
    bits adds up the popcounts of code AND bit plane of the query. Dividing by the code's product with its own residual unbiases it.
    """
    dim = levels.shape[1]
    ones = np.bitwise_count(codes).sum(1).astype(np.float32)
    over = np.zeros((len(levels), len(codes)), np.float32)
    for plane in range(8):
        mask = pack((levels >> plane) & 1 > 0)
        counts = np.zeros(over.shape, np.uint16)
        for w in range(codes.shape[1]):
            counts += np.bitwise_count(mask[:, w, None] & codes[None, :, w])
        over += np.float32(1 << plane) * counts
    values = low[:, None] + step[:, None] * levels
    dots = (2 * (low[:, None] * ones[None, :] + step[:, None] * over) - values.sum(1, keepdims=True)) / np.sqrt(dim)
    safe = np.maximum(own, 1e-6)[None, :]
    slack = np.sqrt(np.maximum(0, 1 - safe**2)) / safe / np.sqrt(max(1, dim - 1)) * np.linalg.norm(values, axis=1, keepdims=True)
    return dots / safe * length[None, :], (slack + step[:, None] / safe) * length[None, :]


def similar_vectors(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    dim: int,
    k: int = 10,
    least: float = -1.0,
    queries: DataFrame | None = None,
    probes: int = PROBES,
    epsilon: float = EPSILON,
    block: int = BLOCK,
) -> DataFrame:
    """(id, other, similarity): of every vector (or those whose id is in `queries`) the k most similar others with cosine of `least` or more.

    All vectors are indexed; the loss comes from cells not looked into and from bounds exceeded. Equal vectors are one entry of the index
    and are given back as each other's most similar: of more than k+1 equal ones each gets the k that follow it in the order
    of ids. Ties in similarity go by id. Fewer than k come out where fewer qualify. An empty table gives an empty result.
    """
    spark = df.sparkSession
    stage = Stage(spark, "neighbors")
    all_ids = stage.write(unit_vectors(df, id_col, vec_col, dim).withColumn("key", F.xxhash64("vec")))
    entries = stage.write(all_ids.groupBy("key").agg(F.min("id").alias("rep"), F.first("vec").alias("vec")))
    n = entries.count()
    kind = dict(all_ids.dtypes)["id"]
    if not n:
        return spark.createDataFrame([], f"id {kind}, other {kind}, similarity double")
    wanted = min(n, max(LEAST_PIVOTS, min(MOST_PIVOTS, PIVOT_BYTES // (4 * dim), int(PIVOTS_PER_ROOT * n**0.5))))
    # Keys are hashes, so the smallest are a random sample, bounded by MOST_PIVOTS and PIVOT_BYTES.
    pivots = _matrix(entries.orderBy("key").limit(wanted).select("vec").toPandas()["vec"], dim)
    probes = min(probes, len(pivots))
    shared = spark.sparkContext.broadcast(pivots)
    dim_, bits = dim, code_bits(dim)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per vector for its home cell, with its code, and one per cell it looks into, with the rotated, rounded query and its product with the pivot."""
        turn, cells = rotation(dim_, bits), shared.value
        for pdf in batches:
            height = max(1, min(4096, 8_000_000 // len(cells)))  # keeps the matrix of products at 32 MB
            for at in range(0, len(pdf), height):
                part = pdf.iloc[at : at + height]
                x = _matrix(part["vec"], dim_)
                near = x @ cells.T
                best = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
                home = np.argmax(near, axis=1)
                rest = (x - cells[home]) @ turn.T
                length = np.linalg.norm(rest, axis=1)
                own = np.abs(rest).sum(1) / np.sqrt(bits) / np.maximum(length, 1e-12)
                codes = pack(rest > 0)
                yield pd.DataFrame({
                    "cell": home.astype(np.int32), "key": part["key"], "code": _records(codes), "own": np.where(length > 1e-6, own, 1.0).astype(np.float32),
                    "length": length.astype(np.float32), "low": np.float32(0), "step": np.float32(0), "is_query": False,
                })
                asked = part["asked"].to_numpy()
                if not asked.any():
                    continue
                best, near, keys = best[asked], near[asked], part["key"].to_numpy()[asked]
                levels, low, step = rounded(x[asked] @ turn.T)
                yield pd.DataFrame({
                    "cell": best.ravel().astype(np.int32), "key": np.repeat(keys, probes), "code": np.repeat(np.array(_records(levels), object), probes), "own": np.float32(0),
                    "length": near[np.arange(len(best))[:, None], best].ravel(), "low": np.repeat(low, probes).astype(np.float32), "step": np.repeat(step, probes).astype(np.float32), "is_query": True,
                })

    schema = "cell int, key long, code binary, own float, length float, low float, step float, is_query boolean"
    flagged = entries.select("key", "vec", F.lit(True).alias("asked"))
    if queries is not None:
        chosen = queries.select(F.col(queries.columns[0]).alias("id")).join(all_ids, "id").select("key", F.lit(True).alias("asked")).distinct()
        flagged = entries.select("key", "vec").join(chosen, "key", "left").select("key", "vec", F.coalesce("asked", F.lit(False)).alias("asked"))
    placed = stage.write(flagged.mapInPandas(assign, schema))
    # A cell's members go in blocks of bounded size, and each block meets the cell's queries in blocks.
    sizes = placed.filter("NOT is_query").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / block).cast("int").alias("n_m"))
    asks = placed.filter("is_query").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / (block * 4)).cast("int").alias("n_q"))
    grid = F.broadcast(sizes.join(asks, "cell"))  # one row per pivot at most: bounded by MOST_PIVOTS
    members = placed.filter("NOT is_query").join(grid, "cell").select("cell", F.pmod(F.xxhash64("key"), "n_m").cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)).alias("q"), "key", "code", "own", "length")
    seekers = (
        placed.filter("is_query")
        .join(grid, "cell")
        .select(F.col("cell").alias("to_cell"), F.explode(F.sequence(F.lit(0), F.col("n_m") - 1)).alias("to_m"), F.pmod(F.xxhash64("key"), "n_q").cast("int").alias("to_q"), F.col("key").alias("seeker"), F.col("code").alias("levels"), F.col("length").alias("near"), F.col("low").alias("low_"), F.col("step").alias("step_"))
    )

    def compare(group, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Candidates of one block of members and one block of queries: those whose upper bound reaches the k-th lower bound and `least`."""
        out = [pd.DataFrame({"key": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "estimate": np.zeros(0), "upper": np.zeros(0)})]
        if not len(left) or not len(right):
            return out[0]
        codes = np.frombuffer(b"".join(left["code"]), np.uint64).reshape(len(left), -1)
        own, length, keys = left["own"].to_numpy(), left["length"].to_numpy(), left["key"].to_numpy()
        for at in range(0, len(right), 512):
            part = right.iloc[at : at + 512]
            levels = np.frombuffer(b"".join(part["levels"]), np.uint8).reshape(len(part), bits)
            # <q, v> = <q, pivot> + |v - pivot| <q, direction of the residual>
            est, slack = estimate(levels, part["low_"].to_numpy(), part["step_"].to_numpy(), codes, own, length)
            est = est + part["near"].to_numpy()[:, None]
            upper, lower = est + epsilon * slack, est - epsilon * slack
            same = part["seeker"].to_numpy()[:, None] == keys[None, :]
            lower[same] = upper[same] = -np.inf
            kth = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] >= k else np.full(len(part), -np.inf)
            rows, cols = np.nonzero(upper >= np.maximum(kth, least - 1e-6)[:, None])
            out.append(pd.DataFrame({"key": part["seeker"].to_numpy()[rows], "other": keys[cols], "estimate": est[rows, cols].astype(float), "upper": upper[rows, cols].astype(float)}))
        return pd.concat(out)

    found = members.groupBy("cell", "m", "q").cogroup(seekers.groupBy("to_cell", "to_m", "to_q")).applyInPandas(compare, "key long, other long, estimate double, upper double")
    found = stage.write(found)
    # Across cells: what can't reach the k-th lower bound (estimate - (upper - estimate)) of its query drops out before the exact comparison.
    lower = (2 * F.col("estimate") - F.col("upper")).alias("lower")
    by_lower = Window.partitionBy("key").orderBy(F.col("lower").desc(), "other")
    kth = found.select("key", "other", lower).withColumn("r", F.row_number().over(by_lower)).filter(F.col("r") == k).select("key", F.col("lower").alias("kth"))
    survivors = found.join(kth, "key", "left").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).select("key", "other")
    a, b = entries.select("key", F.col("vec").alias("va")), entries.select(F.col("key").alias("other"), F.col("vec").alias("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    exact = survivors.join(a, "key").join(b, "other").select("key", "other", F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)).alias("similarity")).filter(F.col("similarity") >= least)
    nearest = exact.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.col("similarity").desc(), "other"))).filter(F.col("r") <= k)
    # Back to ids: equal vectors first, each with the next k of its ring, then the others' ids, cut at k. The places in a ring are
    # running totals, so that vectors all equal to each other are not gathered in one task.
    counts = all_ids.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    placed_ids = running_totals(all_ids.select("key", "id").withColumn("one", F.lit(1)), ["key"], ["id"], "one", stage)
    numbered = stage.write(placed_ids.join(counts, "key").select("key", "id", "n", (F.col("before") + 1).alias("r")))
    twins = numbered.filter(F.col("n") > 1)
    step = twins.select("key", "id", "n", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n") - 1).cast("int"))).alias("s"), "r").withColumn("to", F.pmod(F.col("r") - 1 + F.col("s"), F.col("n")) + 1)
    equal = step.join(twins.select("key", F.col("id").alias("other"), F.col("r").alias("to")), ["key", "to"]).select("id", "other", F.lit(1.0).alias("similarity"))
    firsts = numbered.filter(F.col("r") <= k).select(F.col("key").alias("other_key"), F.col("id").alias("other"))
    unequal = (
        nearest.select("key", F.col("other").alias("other_key"), "similarity")
        .join(numbered.filter(F.col("n") <= k).select("key", "id"), "key")
        .join(firsts, "other_key")
        .select("id", "other", "similarity")
    )
    union = equal.unionByName(unequal)
    if queries is not None:
        union = union.join(queries.select(F.col(queries.columns[0]).alias("id")).distinct(), "id", "left_semi").select("id", "other", "similarity")
    best = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "other")
    return union.filter(F.col("similarity") >= least).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("id", "other", "similarity")


def similar_pairs(neighbors: DataFrame) -> DataFrame:
    """(id_a, id_b, similarity) with id_a < id_b: pairs of which one is among the other's most similar."""
    return neighbors.groupBy(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).agg(F.max("similarity").alias("similarity"))
