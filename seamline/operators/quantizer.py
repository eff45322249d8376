"""Vector quantization: random rotation, a scalar codebook fitted to the rotated coordinates, packed codes.

After a random rotation each coordinate of a unit vector follows Beta((d-1)/2, (d-1)/2) on (-1, 1), whatever the data, so
one Lloyd-Max codebook per dimension and width serves all vectors and nothing is trained on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seamline.operators.vectors import BROADCAST_BYTES, in_blocks, keep_best, ranked

WIDTHS = (2, 3, 4)


@lru_cache(maxsize=32)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix; the same for the same dimension and seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=32)
def codebook(dim: int, bits: int, grid: int = 50_000, rounds: int = 300, init: str = "quantile") -> tuple[np.ndarray, np.ndarray]:
    """(centroids, boundaries). init="quantile" starts from equal masses; "uniform" from equal widths on [-1, 1], which leaves levels unused in high dimensions."""
    sigma = 1 / np.sqrt(dim)
    x = np.linspace(max(-1 + 1e-9, -6 * sigma), min(1 - 1e-9, 6 * sigma), grid)
    mass = np.exp((dim - 3) / 2 * np.log1p(-(x**2)))
    total, moment = np.concatenate([[0], np.cumsum(mass)]), np.concatenate([[0], np.cumsum(mass * x)])
    n = 1 << bits
    if init == "quantile":
        centroids = x[np.searchsorted(total[1:], (np.arange(n) + 0.5) / n * total[-1])]
    elif init == "uniform":
        centroids = -1 + (2 * np.arange(n) + 1) / n
    else:
        raise ValueError("init must be quantile or uniform")
    for _ in range(rounds):
        edges = np.concatenate([[0], np.searchsorted(x, (centroids[1:] + centroids[:-1]) / 2), [grid]])
        weight = np.diff(total[edges])
        moved = np.where(weight > 0, np.diff(moment[edges]) / np.where(weight > 0, weight, 1), centroids)
        if np.abs(moved - centroids).max() < 1e-12:
            break
        centroids = moved
    return centroids, (centroids[1:] + centroids[:-1]) / 2


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of codes as rows of bytes, least bit first."""
    planes = ((codes[..., None] >> np.arange(bits, dtype=np.uint8)) & 1).astype(np.uint8)
    return np.packbits(planes.reshape(len(codes), -1), axis=1, bitorder="little")


def unpack(data: np.ndarray, bits: int, dim: int) -> np.ndarray:
    planes = np.unpackbits(data, axis=1, bitorder="little", count=dim * bits).reshape(len(data), dim, bits)
    return (planes << np.arange(bits, dtype=np.uint8)).sum(2).astype(np.uint8)


@dataclass(frozen=True)
class Quantizer:
    """Encoder and scorer of vectors of one dimension."""

    dim: int = 1536
    bits: int = 4
    seed: int = 42
    init: str = "quantile"

    def __post_init__(self) -> None:
        if self.bits not in WIDTHS:
            raise ValueError("bits must be 2, 3 or 4")
        if self.dim < 2:
            raise ValueError("dim must be at least 2")

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(norms, codes); ValueError for numbers that aren't finite. A zero vector has norm 0 and codes 0."""
        x = np.atleast_2d(np.asarray(x, np.float64))
        if x.shape[1] != self.dim:
            raise ValueError(f"vectors must have {self.dim} numbers")
        norms = np.linalg.norm(x, axis=1)
        if not np.isfinite(norms).all():
            raise ValueError("vectors must be finite")
        turned = x / np.where(norms > 0, norms, 1)[:, None] @ rotation(self.dim, self.seed).T
        codes = np.searchsorted(codebook(self.dim, self.bits, init=self.init)[1], turned, side="right").astype(np.uint8)
        codes[norms == 0] = 0
        return norms.astype(np.float32), codes

    def decode(self, norms: np.ndarray, codes: np.ndarray) -> np.ndarray:
        centroids = codebook(self.dim, self.bits, init=self.init)[0]
        if codes.size and codes.max() >= len(centroids):
            raise ValueError("code out of range")
        return (centroids[codes] @ rotation(self.dim, self.seed) * norms[:, None]).astype(np.float32)

    def prepare(self, query: np.ndarray) -> np.ndarray:
        """Queries at unit length, rotated; zero stays zero."""
        q = np.atleast_2d(np.asarray(query, np.float64))
        n = np.linalg.norm(q, axis=1, keepdims=True)
        return q / np.where(n > 0, n, 1) @ rotation(self.dim, self.seed).T

    def score(self, prepared: np.ndarray, norms: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Cosine of each prepared query with each decoded vector; 0 for zero vectors."""
        c = codebook(self.dim, self.bits, init=self.init)[0][codes]
        s = prepared @ c.T / np.linalg.norm(c, axis=1)[None, :]
        return np.where(norms[None, :] > 0, s, 0.0)

    def ratio(self) -> float:
        """Bits of float vectors per bit of codes and norm."""
        return 32 * self.dim / (32 + self.dim * self.bits)

    def quantize(self, df: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
        """(id, norm, codes) of the usable vectors, in Arrow batches; null, otherwise long and not finite ones are left out."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf[[v is not None and len(v) == self.dim and all(a is not None for a in v) for v in pdf["v"]]]
                if len(pdf):
                    x = np.array(pdf["v"].tolist(), np.float64)
                    good = np.isfinite(x).all(1)
                    norms, codes = self.encode(x[good]) if good.any() else (np.zeros(0), np.zeros((0, self.dim), np.uint8))
                    yield pd.DataFrame({"id": pdf["id"][good], "norm": norms, "codes": [r.tobytes() for r in pack(codes, self.bits)]})

        kind = dict(df.dtypes)[id_col]
        return df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInPandas(run, f"id {kind}, norm float, codes binary")

    def dequantize(self, df: DataFrame) -> DataFrame:
        """(id, embedding) of (id, norm, codes)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                data = np.frombuffer(b"".join(pdf["codes"]), np.uint8).reshape(len(pdf), -1)
                yield pd.DataFrame({"id": pdf["id"], "embedding": list(self.decode(pdf["norm"].to_numpy(), unpack(data, self.bits, self.dim)))})

        return df.select("id", "norm", "codes").mapInPandas(run, f"id {dict(df.dtypes)['id']}, embedding array<float>")

    def search(self, index: DataFrame, query, k: int, active: DataFrame | None = None) -> DataFrame:
        """(id, similarity) of the k best of an index (id, norm, codes), ties by id; among the ids of `active` if given.

        Each batch is scored by one matrix product and keeps its best k. An empty index gives no rows; k must be at least 1.
        """
        if k < 1:
            raise ValueError("k must be at least 1")
        if len(query) != self.dim:
            raise ValueError(f"a query must have {self.dim} numbers")
        prepared = self.prepare(query)
        rows = index.join(active.select("id").distinct(), "id", "left_semi") if active is not None else index

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    data = np.frombuffer(b"".join(pdf["codes"]), np.uint8).reshape(len(pdf), -1)
                    s = self.score(prepared, pdf["norm"].to_numpy(), unpack(data, self.bits, self.dim))[0]
                    keep = s >= np.partition(s, -k)[-k] if len(s) > k else np.ones(len(s), bool)
                    yield pd.DataFrame({"id": pdf["id"][keep], "similarity": s[keep]})

        scored = rows.select("id", "norm", "codes").mapInPandas(run, f"id {dict(index.dtypes)['id']}, similarity double")
        return scored.orderBy(F.round("similarity", 12).desc(), "id").limit(k)

    def search_many(self, index: DataFrame, queries: DataFrame, k: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """(query_id, id, similarity, rank) of the k best of an index for each query (query_id, vector), ties by id; queries of another length are left out."""
        asked = queries.select(F.col(queries.columns[0]).alias("query_id"), F.col(queries.columns[1]).alias("v")).filter(F.size("v") == self.dim)

        def score(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(r):
                return pd.DataFrame({"query_id": q["query_id"][:0], "id": r["id"][:0], "similarity": np.zeros(0)})
            data = np.frombuffer(b"".join(r["codes"]), np.uint8).reshape(len(r), -1)
            s = self.score(self.prepare(np.array(q["v"].tolist(), np.float64)), r["norm"].to_numpy(), unpack(data, self.bits, self.dim))
            i, j = keep_best(s, k)
            return pd.DataFrame({"query_id": q["query_id"].to_numpy()[i], "id": r["id"].to_numpy()[j], "similarity": s[i, j]})

        schema = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(index.dtypes)['id']}, similarity double"
        return ranked(in_blocks(index.select("id", "norm", "codes"), asked, score, schema, most_bytes), k)


def replace_rows(index: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The index with rows added or, by key, replaced."""
    return index.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_rows(index: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return index.join(gone.select(key).distinct(), key, "left_anti")


def compact(index: DataFrame, active: DataFrame, key: str = "id") -> DataFrame:
    """The index rows whose key is still active."""
    return index.join(active.select(key).distinct(), key, "left_semi")


def footprint(index: DataFrame) -> DataFrame:
    """(n_vectors, code_bytes) of an index."""
    return index.agg(F.count(F.lit(1)).alias("n_vectors"), F.coalesce(F.sum(F.length("codes") + 4), F.lit(0)).alias("code_bytes"))


def serialize(index: DataFrame) -> DataFrame:
    """(id, data): norm as a little-endian float32, then the packed codes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            norms = pdf["norm"].to_numpy(np.dtype("<f4"))
            yield pd.DataFrame({"id": pdf["id"], "data": [n.tobytes() + bytes(c) for n, c in zip(norms, pdf["codes"])]})

    return index.select("id", "norm", "codes").mapInPandas(run, f"id {dict(index.dtypes)['id']}, data binary")


def deserialize(df: DataFrame, dim: int, bits: int) -> DataFrame:
    """(id, norm, codes) of (id, data). Records of another length than the dimension and width ask for are refused."""
    size = 4 + -(-dim * bits // 8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if any(len(d) != size for d in pdf["data"]):
                raise ValueError(f"a record must have {size} bytes")
            yield pd.DataFrame({"id": pdf["id"], "norm": [float(np.frombuffer(d, "<f4", 1)[0]) for d in pdf["data"]], "codes": [bytes(d[4:]) for d in pdf["data"]]})

    return df.select("id", "data").mapInPandas(run, f"id {dict(df.dtypes)['id']}, norm float, codes binary")
