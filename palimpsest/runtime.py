"""Tables that outlive the executors that made them, and small helpers on plans."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a local session names no shared folder, as in tests.
_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session, else, on a local master only, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _FALLBACK:
        _FALLBACK[key] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return _FALLBACK[key]


class Scratch:
    """Written tables in the shared folder. `keep` cuts the lineage there; `drop` frees one that is read no more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Write df as Parquet and return it read back; it survives the loss of any executor."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._palimpsest_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete kept tables and let Spark free the shuffle files that made them."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._palimpsest_path)
            path.getFileSystem(conf).delete(path, True)
        self.sweep()

    def sweep(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def null_safe(pairs: list[tuple[Column, Column]]) -> Column:
    return all_of([a.eqNullSafe(b) for a, b in pairs])


def micros(c: Column) -> Column:
    """A timestamp as microseconds since 1970."""
    return F.unix_micros(c)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of the session's executors, once an application."""
    import os
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="palimpsest-"), "palimpsest.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(folder, f)
                    z.write(p, os.path.join("palimpsest", os.path.relpath(p, root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
