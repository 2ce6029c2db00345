"""What the corpus operators share: the cluster's shared folder, written intermediate tables, words and file access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the space and the controls U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch that Python workers get.
BATCH_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset in local mode (tests), one of our own, set from then on.

    On a cluster no folder of one machine will do, so there it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of df has, in whatever case: names followed by as many underscores as it takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Batches of rows with whole texts stay small on their way to Python, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def file_system(uri: str):
    """The pyarrow file system and path of a shared folder's URI, for the files that Spark has no writer for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
