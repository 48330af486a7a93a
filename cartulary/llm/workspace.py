"""Tables that outlive a lost executor: Parquet in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of whole texts in an Arrow batch.
LEAN_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a folder of this machine for local masters only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='cartulary-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def lean(df: DataFrame) -> DataFrame:
    """df; where the session has Spark's default of rows in an Arrow batch, it gets LEAN_ROWS: batches of whole texts are large."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(key, "10000") == "10000":
        conf.set(key, str(LEAN_ROWS))
    return df


class Workspace:
    """Named intermediate tables of one run of an operator."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/cartulary/{purpose}-{uuid.uuid4().hex[:12]}"

    def table(self, name: str, df: DataFrame, compression: str = "zstd", **options: int) -> DataFrame:
        """Writes df once; later reads neither recompute it nor depend on the executors that made it."""
        path = f"{self.root}/{name}"
        df.write.options(**options).option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
