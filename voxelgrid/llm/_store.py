"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's setting that removes an execution's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset, a local master gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="voxelgrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes a Parquet table in the shared folder and reads it back.

    What the write has shuffled is not needed again, so its files go when it has ended.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, when all that was read from them is written, too."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def identified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """Columns id, text and a unique long ``node`` for each row, and whether nodes are new numbers.

    Where ids are whole numbers, unique and never null, the node is the id, and nothing is
    written. Otherwise rows are written once with node numbers, which stay with them.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if isinstance(docs.schema["id"].dataType, T.IntegralType):
        # exact without a global distinct of large rows: one long per row, counted per id
        odd = docs.groupBy("id").count().where("count > 1 or id is null").limit(1).count()
        if not odd:
            return docs.withColumn("node", F.col("id").cast("long")), False
    return written(docs.withColumn("node", F.monotonically_increasing_id())), True


def tasks_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
