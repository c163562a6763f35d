"""Tables between the rounds of iterated operators: in the folder that the cluster names in spark.checkpoint.dir, so that they cut the
lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Rounds:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local one is set if the master is local; a cluster has to name one."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="strandline-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.folder, self.last = spark, f"{base.rstrip('/')}/strandline-{uuid.uuid4().hex}", {}

    def table(self, df: DataFrame, name: str, last: bool = False) -> DataFrame:
        """df written and read again. The table before the one before under this name is deleted, as no plan reads it any more; with
        `last` the one before as well."""
        old = self.last.setdefault(name, [])
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        old.append(path)
        while len(old) > (1 if last else 2):
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old.pop(0))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return self.spark.read.schema(df.schema).parquet(path)
