"""Folders that all executors share, and tables that are swapped in whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used only by local masters whose session sets no ``spark.checkpoint.dir``.
LOCAL_FOLDER = "file:///tmp/checkpoints/clausemill"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = LOCAL_FOLDER
    return folder.rstrip("/")


def _system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _system(spark, path)
    return system.exists(p)


def swapped_in(spark: SparkSession, path: str, write) -> None:
    """Calls ``write`` with a folder beside ``path``, which takes the place of ``path`` once it is
    whole.  If ``write`` fails, what was at ``path`` stays."""
    aside = f"{path}.{uuid.uuid4().hex}"
    try:
        write(aside)
    except BaseException:
        system, p = _system(spark, aside)
        system.delete(p, True)
        raise
    system, p = _system(spark, path)
    system.delete(p, True)
    if not system.rename(_system(spark, aside)[1], p):
        raise OSError(f"{aside} couldn't take the place of {path}")
