"""Intermediate tables written to the shared folder of the cluster."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FOLDER = "harbor"


def _root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the checkpoint folder that the session's owner has set.

    Where neither is set, a session on a single machine gets a folder of its own as
    its checkpoint folder. A cluster is refused: its executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="harbor-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{FOLDER}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table is still there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


FILES_PER_CORE = 2  # of a table of few files


def materialize(df: DataFrame, name: str, few: bool = False, dense: bool = False) -> DataFrame:
    """Write ``df`` once and return the written table.

    The result has no lineage, survives lost executors, and the planner knows its
    size. The table stays until ``release`` is called. ``few`` bounds the number of its files
    by the cores, for the many small tables of a loop; the parts of a file are written one after
    another, so it takes no more memory. ``dense`` compresses harder, for texts.
    """
    if few:
        df = df.coalesce(max(8, FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism))
    path = scratch_path(df.sparkSession, name)
    (df.write.option("compression", "zstd") if dense else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, few: bool = False) -> tuple[DataFrame, int]:
    """``materialize`` and the number of rows, counted while they are written."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows")), name, few)
    return table, seen.get.get("rows", 0)  # nothing is seen of what is known to be empty


def written_bytes(table: DataFrame) -> int:
    """Size at rest of a written table."""
    spark = table.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    size = 0
    for file in table.inputFiles():
        path = hadoop.Path(file)
        size += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return size


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize`` once nothing that is still to run reads it."""
    hadoop = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    for path in {hadoop.Path(file).getParent().toString() for file in table.inputFiles()}:
        folder = hadoop.Path(path)
        folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> bool:
    """Delete every table written below ``spark.checkpoint.dir`` so far.

    For the owner of the session, once no result that was built on them is needed.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_root(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
