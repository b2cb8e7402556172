"""Scratch tables in the folder that driver and executors share, and table access.

All intermediate data goes to the folder named by ``spark.checkpoint.dir``, the
one place that driver and executors both see.  Only in local mode, where that
setting may be absent, a temporary folder is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; in local mode a temporary one is set where it is unset, on a cluster that is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="caseloom-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder; removed when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it once as Parquet in the shared folder and reread it.

    Lost executors cannot take the table along, and its true size steers later joins.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(df: DataFrame) -> None:
    """Remove a table that ``written`` gave and that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path in _MADE:
        remove(_MADE.pop(path), path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in _MADE.items():
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before
            return


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
