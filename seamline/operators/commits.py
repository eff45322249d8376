"""A log of numbered entries, each written once and whole, by one writer."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class CommitLog:
    """Entries 1, 2, 3, ... (JSON objects) in a folder of any file system Spark knows.

    An entry is written beside the log under a name of its own and then put in place by one step that fails if the number
    is taken: a hard link on a file system of this machine, a rename that doesn't overwrite elsewhere. So a reader sees an
    entry whole or not at all, and of two writers of one number exactly one succeeds.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def last(self) -> int:
        """Number of the newest entry; 0 if there is none."""
        fs, p = self._fs(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[7:]) for n in names if n.startswith("commit-")), default=0)

    def read(self, n: int) -> dict:
        """Entry `n`; {} for 0."""
        if not n:
            return {}
        fs, p = self._fs(f"{self.path}/commit-{n}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def add(self, n: int, entry: dict) -> bool:
        """Write entry `n`; False if another writer has."""
        body = json.dumps(entry)
        made = f"{self.path}/_new-{uuid.uuid4().hex}"
        fs, p = self._fs(made)
        fs.mkdirs(p.getParent())
        if fs.getUri().getScheme() == "file":
            local, target = (unquote(urlparse(x).path) if "://" in x or x.startswith("file:") else x for x in (made, f"{self.path}/commit-{n}"))
            with open(local, "x") as f:
                f.write(body)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(local, target)
                return True
            except FileExistsError:
                return False
            except OSError:  # a file system without hard links: the first writer creates the entry
                try:
                    with open(target, "x") as f:
                        f.write(body)
                    return True
                except FileExistsError:
                    return False
            finally:
                os.unlink(local)
        out = fs.create(p, False)
        out.write(bytearray(body.encode()))
        out.close()
        jvm = self.spark._jvm
        kinds = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commit-{n}")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(p, target, options)
            return True
        except Exception as e:
            fs.delete(p, False)
            if "FileAlreadyExists" in str(getattr(e, "java_exception", e)):
                return False
            raise

    def drop(self, name: str) -> None:
        """Delete a folder beside the entries."""
        fs, p = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)

    def folders(self) -> list[str]:
        """Names of the folders beside the entries."""
        fs, p = self._fs(self.path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []
