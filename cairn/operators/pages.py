"""Pages and samples of a table whose containers lie in windows of keys: only as many windows are read as the answer takes."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .criteria import Term
from .search import KEY, search


@dataclass(frozen=True)
class Windowed:
    """Rows in folders window=0, 1, ...: each a range of (version, container_id), no container in two. windows(version, window, low, high,
    containers) has a row for each version in a window."""

    rows: DataFrame
    windows: DataFrame

    def only(self, numbers: Sequence[int]) -> DataFrame:
        """Rows of some windows: the others are pruned before they are listed or read."""
        return self.rows.where(F.col("window").isin(list(numbers))).drop("window")


def write_windows(rows: DataFrame, folder: str, windows: int) -> None:
    in_windows(rows, windows).write.partitionBy("window").parquet(f"{folder}/rows")
    spans_of(read_rows(rows.sparkSession, folder, rows.schema)).write.parquet(f"{folder}/windows")


def in_windows(rows: DataFrame, windows: int) -> DataFrame:
    """rows with window, dealt into about so many of equal size, each sorted by key. A container is never cut, however large."""
    return rows.repartitionByRange(windows, *KEY).withColumn("window", F.spark_partition_id()).sortWithinPartitions(*KEY)


def spans_of(rows: DataFrame) -> DataFrame:
    spans = rows.groupBy("version", "window").agg(F.min("container_id").alias("low"), F.max("container_id").alias("high"), F.countDistinct("container_id").alias("containers"))
    return spans.coalesce(1).sortWithinPartitions("version", "low")


def read_rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("window", IntegerType())])).parquet(f"{folder}/rows")


def read_windows(spark: SparkSession, folder: str, schema) -> Windowed:
    return Windowed(read_rows(spark, folder, schema), spark.read.parquet(f"{folder}/windows"))


def page_of(table: Windowed, version: str, find: Callable[[DataFrame], DataFrame], after: str | None, limit: int) -> tuple[DataFrame, int]:
    """((version, container_id, ...) of the next limit + 1 found containers in byte order of the key, windows read).

    find turns rows of whole containers into found containers. Windows are read one after another from the cursor on, first one, then
    twice as many each time, until enough are found or none is left. Rows beyond limit tell that there is more.
    """
    spark = table.rows.sparkSession
    ahead = table.windows.where(F.col("version") == version)
    ahead = ahead if after is None else ahead.where(F.col("high") > after)
    out, held, step, read, last = None, 0, 1, 0, None
    while True:
        left = ahead if last is None else ahead.where(F.col("low") > last)
        part = left.orderBy("low").limit(step).collect()
        if not part:
            break
        rows = table.only([w.window for w in part]).where(F.col("version") == version)
        rows = rows if after is None else rows.where(F.col("container_id") > after)
        found = find(rows).orderBy("container_id").limit(limit + 1 - held)
        got = found.collect()  # limit + 1 rows at most, over all steps
        if got or out is None:
            more = spark.createDataFrame(got, found.schema)
            out = more if out is None else out.unionByName(more)
        held, read, last, step = held + len(got), read + len(part), part[-1].high, step * 2
        if held > limit:
            break
    if out is None:
        out = find(table.rows.drop("window").limit(0))
    return out.orderBy("container_id"), read


def search_page(table: Windowed, version: str, terms: Sequence[Term], after: str | None, limit: int) -> tuple[DataFrame, int]:
    return page_of(table, version, lambda rows: search(rows, terms), after, limit)


def sample_by_seeks(table: Windowed, version: str, n: int, seed: int) -> tuple[DataFrame, int]:
    """((version, container_id) of at most n containers, windows read): for each of n random cursors the first key beyond it, from the
    beginning again after the last. Draws that meet are one, so there may be fewer.

    A cursor is nine digits between those of the least and the greatest key; keys are not sorted: each cursor's window is looked up, and
    of these windows alone the key columns are read."""
    spark, draw = table.rows.sparkSession, random.Random(seed)
    ahead = table.windows.where(F.col("version") == version)
    cursors = spark.createDataFrame([(i, str(draw.randrange(100_000_000, 1_000_000_000))) for i in range(n)], "draw int, cursor string")
    # of windows that end beyond a cursor the one that begins first; none: the first of all. Cursors are n, windows one row each
    beyond = ahead.join(F.broadcast(cursors), F.col("high") > F.col("cursor"))
    sought = beyond.groupBy("draw", "cursor").agg(F.min(F.struct("low", "window")).alias("w")).select("draw", "cursor", F.col("w.window").alias("window"))
    first = ahead.orderBy("low").limit(1).collect()
    if not first:
        return table.rows.select(KEY).limit(0), 0
    seeks = cursors.join(sought.drop("cursor"), "draw", "left").select("cursor", F.col("window").isNull().alias("wraps"), F.coalesce("window", F.lit(first[0].window)).alias("window")).collect()
    at = spark.createDataFrame(seeks, "cursor string, wraps boolean, window int")
    numbers = sorted({s.window for s in seeks})
    keys = table.rows.where(F.col("window").isin(numbers) & (F.col("version") == version)).select(*KEY, "window")
    met = keys.join(F.broadcast(at), "window").where("wraps or container_id > cursor")
    return met.groupBy("version", "cursor").agg(F.min("container_id").alias("container_id")).select(KEY).distinct(), len(numbers)
