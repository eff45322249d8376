"""Vectors kept as NumPy arrays on storage that all executors can read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_npy(spark: SparkSession, path: str, rows_per_task: int = 10_000) -> DataFrame:
    """(id, embedding) of a two-dimensional .npy file: row numbers and rows. Each task maps the file and reads its own rows."""
    rows = np.load(path, mmap_mode="r").shape[0]
    tasks = max(1, -(-rows // rows_per_task))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = np.load(path, mmap_mode="r")
        for pdf in batches:
            for start in pdf["id"]:
                for at in range(start, min(rows, start + rows_per_task), 1000):
                    part = np.asarray(data[at : min(rows, at + 1000, start + rows_per_task)], np.float32)
                    yield pd.DataFrame({"id": np.arange(at, at + len(part)), "embedding": list(part)})

    return spark.range(0, rows, rows_per_task, tasks).mapInPandas(read, "id long, embedding array<float>")
