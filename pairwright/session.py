"""Session settings and the shared folder for data that outlives one executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the plans are written for; all can be changed at run time.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles a method of more than 8000 bytes. Reading six fields at once makes a
    # fused method larger than that; below the limit Spark splits the work into methods that are
    # compiled, which is three times as fast.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended settings an existing session leaves open; those it has made stay."""
    for key, value in RECOMMENDED.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    That is the checkpoint folder, else a folder of the warehouse. A warehouse on a local disk is
    refused unless the executors run in the driver's own process: other machines cannot see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    master = spark.sparkContext.master
    in_process = master == "local" or master.startswith("local[")
    if not in_process and warehouse.startswith(("file:", "/")):
        raise ValueError(
            f"stages need a folder all executors share: set spark.checkpoint.dir ({warehouse} is local)"
        )
    return f"{warehouse}/pairwright-stages"


def new_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    Cuts the lineage of something several outputs read, and survives lost executors.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Stages:
    """Stages kept in a folder of their own, which goes when the work that reads them is done.

    Give it as ``stage`` to a plan, use the plan's results inside the ``with`` block, and write what
    is to stay before it ends.
    """

    def __init__(self, spark: SparkSession, label: str = "stages"):
        self.spark = spark
        self.root = new_dir(spark, label)
        self.count = 0

    def __call__(self, df: DataFrame, label: str = "stage") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete the folder, wherever it is kept."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(hadoop, True)

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        self.close()
