"""Tables that an operator writes and reads again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in a local session without one, a folder of our own."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if found:
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return (f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole).rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
    spark.conf.set(_KEY, own)
    return own


def unused_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Executions begun inside leave no shuffle files once they end; nothing that runs later reads them."""
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


class Scratch:
    """Written tables cut the lineage, so a lost executor costs only the tasks it ran."""

    def __init__(self, spark: SparkSession, name: str, free: bool = False):
        """With free, shuffle files go as soon as the table that needed them is written."""
        self.spark, self.free = spark, free
        self.root = f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with freed(self.spark) if self.free else nullcontext():
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the session is already gone at exit
            pass
