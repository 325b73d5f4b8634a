"""Intermediate tables in the folder that driver and executors share.

``Scratch.keep`` writes a frame as Parquet below the checkpoint folder the session
names and returns a frame that reads it back: lineage is cut, the rows survive a
lost executor, and later steps read only the columns they need. Tables that no
returned frame still reads can be dropped with ``Scratch.drop``.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local run without one gets a fresh folder;
    a cluster without one is an error, because executors would not see each other's files."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tessera-llm-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


class Scratch:
    """One folder of intermediate tables, of its own for each call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as written and read back. Batches to and from Python hold ``BATCH`` rows meanwhile: whole texts are large."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(BATCH_KEY)
        self.spark.conf.set(BATCH_KEY, min(int(before), BATCH) if int(before) > 0 else BATCH)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(BATCH_KEY, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Let Spark delete the shuffle files of finished steps now: it does so when the driver collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
