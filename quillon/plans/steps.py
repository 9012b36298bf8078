"""Cutting the lineage of iterative plans: every kept step is a table in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Steps:
    def __init__(self, spark: SparkSession, name: str = "steps") -> None:
        conf = spark.sparkContext.getConf()
        at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not at:  # a temporary folder on one machine only, else one in the warehouse
            master = spark.sparkContext.master
            one_machine = master.startswith("local") and not master.startswith("local-cluster")
            at = tempfile.mkdtemp(prefix="quillon-") if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"
            spark.conf.set("spark.checkpoint.dir", at)
        self.spark, self.root, self.n = spark, f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        if self.n == 1:  # results read their steps as long as the application lives
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")
