"""Embedding of texts through a function or an HTTP service."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

Embedder = Callable[[str], list[float]]


@dataclass(frozen=True)
class HashEmbedder:
    """A deterministic embedding of words, for tests and offline use."""

    dim: int = 64

    def __call__(self, text: str) -> list[float]:
        out = np.zeros(self.dim)
        for word in text.lower().split():
            seed = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out += np.random.default_rng(seed).standard_normal(self.dim)
        n = np.linalg.norm(out)
        return (out / n if n else out).tolist()


@dataclass(frozen=True)
class HttpEmbedder:
    """A service that answers POST {base}/embeddings. Up to `retries` more tries, at growing intervals, after transport errors, 429 and 5xx."""

    base: str
    model: str
    dim: int
    key: str = ""
    timeout: float = 10.0
    retries: int = 3

    def __call__(self, text: str) -> list[float]:
        body = json.dumps({"model": self.model, "input": text, "dimensions": self.dim}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        wait = 0.05
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{self.base}/embeddings", body, headers), timeout=self.timeout) as r:
                    rows = json.load(r).get("data") or []
                if not rows or not rows[0].get("embedding"):
                    raise ValueError("the service returned no embedding")
                return rows[0]["embedding"]
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500 or attempt == self.retries:
                    raise
            except (urllib.error.URLError, TimeoutError):
                if attempt == self.retries:
                    raise
            time.sleep(wait)
            wait = min(wait * 4, 2.0)
        raise RuntimeError("unreachable")


def embed(df: DataFrame, embedder: Embedder, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, embedding, error): a text that can't be embedded has a null embedding and the reason, so that its file stays unprocessed."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors, errors = [], []
            for text in pdf["text"]:
                try:
                    vectors.append(list(map(float, embedder(text or ""))))
                    errors.append(None)
                except Exception as e:
                    vectors.append(None)
                    errors.append(str(e)[:200])
            yield pd.DataFrame({"id": pdf["id"], "embedding": vectors, "error": errors})

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, embedding array<float>, error string")
