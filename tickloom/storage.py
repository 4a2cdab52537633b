"""Tables written to the shared checkpoint folder to cut lineage, and table loading."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

#: Estimated bytes of a range partition, and the most partitions of one shuffle.
PARTITION_BYTES, MAX_PARTITIONS = 128 << 20, 100_000

def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = getattr(spark, "_tickloom_dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="tickloom-")
            spark._tickloom_dir = named
    return named


def materialize(df: DataFrame, name: str = "table", group_rows: int | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: survives lost executors, cuts lineage.

    ``group_rows`` are the rows of a row group at most, the unit in which the table is read. The table is removed when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("parquet.block.row.count.limit", str(group_rows)) if group_rows else df.write
    writer.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def observed(metrics: Observation, name: str) -> int:
    """An observed count; 0 where the plan was found to be empty while it ran, as then nothing was observed."""
    try:
        return metrics.get[name] or 0
    except Py4JJavaError as error:
        if "AssertionError" not in str(error.java_exception):
            raise
        return 0


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of df's bytes; 0 where it has none (an input without statistics counts as unbounded there)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def partitions_for(df: DataFrame, named: int | None = None) -> int:
    """Partitions of a shuffle of df: as many as the session has, more where its estimated bytes ask for it."""
    wanted = min(-(-estimated_bytes(df) // PARTITION_BYTES), MAX_PARTITIONS)
    return named or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
