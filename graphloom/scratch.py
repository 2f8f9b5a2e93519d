"""Tables that cut lineage: written to the folder all executors share, and read back.

A written table survives lost executors, gives Catalyst a real size to plan with, and starts the next
step from a plain scan. The folder is the one named by ``spark.checkpoint.dir``; only where that
is unset and Spark runs in one process (tests, a laptop) a folder is made under the system's temporary one.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    made = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """A folder of intermediate tables for one query.

    Tables are dropped by name once the next one has been written; what a returned DataFrame still
    reads stays until the application ends.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        target = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def save_observed(self, df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
        """The saved table, and aggregates of it that the same job takes; df must have rows."""
        seen = Observation()
        return self.save(df.observe(seen, *(x.alias(k) for k, x in measures.items())), name), seen.get

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone by then
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
