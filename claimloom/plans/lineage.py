"""Cutting the lineage of iterative plans so that they survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; a temporary one only where driver and executor are one process."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="claimloom-checkpoint-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there.

    The result knows nothing of how it was made, so a lost executor costs at most a
    read.  Unlike ``checkpoint()`` it also forgets the optimiser's size estimates,
    which multiply at every join and in a loop grow beyond all bounds; a table has
    its true size, by which small sides are broadcast.  The folder is deleted when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the table behind a result of ``cut`` that no plan needs any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("cut-"):
            fs, p = _file_system(df.sparkSession, path)
            fs.delete(p, True)
