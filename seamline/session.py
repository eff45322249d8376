"""Spark session factory and shared-storage staging."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings a session of this engine wants; callers may override any of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def make_session(app: str = "seamline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` keys use double underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can read: the one in spark.checkpoint.dir, else the context's own.

    Only where neither is set (tests, local master) a folder of this machine is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="seamline-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


class Stage:
    """Tables written to the shared folder to cut lineage; dropped when superseded or at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/seamline-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: list[str] = []
        atexit.register(self.clear)

    def write(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        self.paths.append(path)
        (df.coalesce(partitions) if partitions else df).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but(self, keep: int = 1) -> None:
        """Delete every table but the last `keep`."""
        for path in self.paths[: len(self.paths) - keep]:
            if path:
                _delete(self.spark, path)
        self.paths = [""] * max(0, len(self.paths) - keep) + self.paths[len(self.paths) - keep :]

    def clear(self) -> None:
        _delete(self.spark, self.root)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_seamline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="seamline-ship-")) / "seamline.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._seamline_shipped = True
