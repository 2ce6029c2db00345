"""Written tables: intermediate ones in the cluster's shared folder, snapshots by partition, and JSON lines."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only in local mode (tests) one of our own, where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder with all that is in it; False: there was none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a written file at most, and bytes that one task scans of files (Spark adds 4 MB for opening each). The catalog's columns
#: take few bytes a row, so that by Spark's own 128 MB the rows of a task, and with them its memory, would grow with the input.
FILE_ROWS, SCAN_BYTES = 500_000, 16 << 20
#: Bytes of the driver's tables for each partition of a shuffle, where these are more than the session has; small ones are joined at run time.
SHUFFLE_BYTES = 8 << 20
_SCAN, _SHUFFLE = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_CATALOG = ("lineitem", "orders", "customer", "part", "supplier", "events")
#: What a session had set before fit(), by application.
_BEFORE: dict[str, dict[str, str | None]] = {}


def fit(spark: SparkSession, sf_dir: str) -> None:
    """Makes the tasks of a scan hold a bounded part of the tables, and shuffles have partitions in proportion to them, until unfit()."""
    jvm, size = spark._jvm, 0
    for name in _CATALOG:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        size += files.getContentSummary(path).getLength() if files.exists(path) else 0
    _BEFORE.setdefault(spark.sparkContext.applicationId, {c: spark.conf.get(c, None) for c in (_SCAN, _SHUFFLE)})
    spark.conf.set(_SCAN, SCAN_BYTES)
    spark.conf.set(_SHUFFLE, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHUFFLE_BYTES)))


def unfit(spark: SparkSession) -> None:
    """The session as it was before fit()."""
    for name, value in _BEFORE.pop(spark.sparkContext.applicationId, {}).items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths and schemas of stored tables, by application, folder, its state and name.
_STORED: dict[tuple[str, str, str, str], tuple] = {}


def folder_state(spark: SparkSession, folder: str) -> str:
    """A digest of names, sizes and times of a folder's files, two levels deep: another after any of its tables was written anew."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    seen, todo = [], [(root, 0)]
    while todo:
        at, depth = todo.pop()
        for status in files.listStatus(at):
            seen.append(f"{status.getPath().getName()}:{status.getLen()}:{status.getModificationTime()}")
            if status.isDirectory() and depth < 1:
                todo.append((status.getPath(), depth + 1))
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """A table derived from the tables in sf_dir: written to the shared folder (partitioned by the columns `by`) when it is first asked
    for in an application, read from there afterwards, and written anew if it is gone, or if the files in sf_dir have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir), name)
    if key in _STORED:
        path, schema = _STORED[key]
        try:
            return spark.read.schema(schema).parquet(path).select(*schema.names)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    df, path = make(), fresh_path(spark, name)
    df.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(*by).parquet(path)
    _STORED[key] = (path, df.schema)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def forget(sf_dir: str) -> None:
    """Stored tables of sf_dir are not used any more."""
    for key in [k for k in _STORED if k[1] == sf_dir]:
        del _STORED[key]


def write_snapshot(df: DataFrame, path: str, by: tuple[str, ...] = ("version",)) -> None:
    """Replaces those partitions of a table that df has rows of; others stay. Never the table that df is read from."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def parse_jsonl(lines: DataFrame, schema: str) -> DataFrame:
    """Objects of a schema from the column value; lines that are no object, or a broken one, are skipped."""
    parsed = lines.where(F.col("value").rlike(r"^\s*\{")).select(F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.where("r._broken is null").select("r.*").drop("_broken")


def read_catalog_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_jsonl(spark.read.text(path), schema)
