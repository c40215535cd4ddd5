"""Session helpers: where intermediate results go and how lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where none is set in local mode; a cluster without one is an error."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="pilegrain-")
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


#: Estimated sizes of more bits than this are forgotten: in a loop of joins each estimate is a product of earlier ones and its digits grow exponentially.
ESTIMATE_BITS = 96


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, keep it in the checkpoint folder and forget how it was made. Partitioning is kept, an absurd estimate of its size is not."""
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    run = done._jdf.queryExecution()
    if run.optimizedPlan().stats().sizeInBytes().bit_length() <= ESTIMATE_BITS:
        return done
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(run.toRdd(), done._jdf.schema(), False), df.sparkSession)


def release(spark: SparkSession) -> None:
    """Shuffles that nothing refers to any more leave the executors' disks when the driver collects its garbage; a small job first makes the scheduler forget the last one."""
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def width(spark: SparkSession) -> int:
    """Number of partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for costly work on a small file; a larger scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
