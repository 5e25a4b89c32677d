"""What the operators of this package share: tables, durable intermediate results, query registry."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset on one machine, as in tests, a temporary
    folder stands in; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="voxtable-"))
    return sc.getCheckpointDir()


def delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def spool(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back. Lineage is cut, a lost
    executor costs nothing that is already written, and later joins know the table's size.
    The files go when the session ends, or with release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.spooled = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete the files of spooled tables. What was made of them must have been spooled itself."""
    for t in tables:
        where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.spooled)
        where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_parts(spark: SparkSession, least: int = 1) -> int:
    """How many tasks a keyed repartition is dealt to; follows the session's setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
