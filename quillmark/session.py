"""Session helpers: where shared state lives, how lineage is cut, how tables are read."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none a folder of our own is used, and only where executors share this machine.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    own = spark.conf.get("quillmark.checkpoint.dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.conf.set("quillmark.checkpoint.dir", own)
    return own


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager)


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of what :func:`checkpoint` gave, when nothing will read it again: sessions need not do that by themselves."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the test data, file or folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: A row group is read by one task, so a table of fewer bytes for each core may leave cores without rows.
ROW_GROUP = 128 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where the scan may have too few row groups for that; a larger input stays as it is scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * ROW_GROUP else df.repartition(2 * cores, key)


def once_per_key(df: DataFrame, key: str, *values: str | Column, order: str | Column | None = None) -> DataFrame:
    """Rows sent again count once: the earliest by ``order`` of each non-null ``key``.

    A null key is no key; such rows are dropped. Ties on ``order`` fall to the smallest values, so the
    result doesn't depend on the order of the rows. Without ``order`` the smallest values win.
    """
    cols = [F.col(v) if isinstance(v, str) else v for v in values]
    packed = F.struct(*cols)
    picked = F.min(packed) if order is None else F.min_by(packed, F.struct(F.col(order) if isinstance(order, str) else order, packed))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(picked.alias("_row")).select(key, "_row.*")
