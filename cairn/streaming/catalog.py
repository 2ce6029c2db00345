"""Incremental ingest: micro-batches that replace places, keep counters, extend the name index and take the first flag of a session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import keyed_hash
from ..operators import ingest
from ..operators.index import trigrams
from ..sources.tables import fresh_path
from .store import CatalogStore, Log, checkpoint_epoch


class PlaceStore(CatalogStore):
    """Entry rows by place: a place of a batch replaces the old. Of a place's records in a batch the last by arrival counts."""

    def __init__(self, spark: SparkSession, folder: str, record: str | None = None):
        super().__init__(spark, folder)
        self.record = record

    @property
    def current(self) -> DataFrame | None:
        found = self.tables()
        return None if found is None else found[1]

    def upsert(self, batch: DataFrame, batch_id: int, epoch: str = "") -> bool:
        return self.append(None, ingest.latest_per_place(batch, record=self.record), epoch, batch_id)


def stream_ingest(source: DataFrame, store: PlaceStore, checkpoint: str):
    """source: a stream of entry rows with version, container_id, place and arrival. A place sent again replaces the old, however late."""
    run = lambda batch, batch_id: store.upsert(batch, batch_id, checkpoint_epoch(batch.sparkSession, checkpoint))
    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(source: DataFrame) -> DataFrame:
    """Running counts of arrivals by version and origin (complete mode)."""
    return source.groupBy("version", "origin").agg(F.count("*").alias("arrivals"))


def stream_flags(source: DataFrame, key: bytes, watermark: str | None = None) -> DataFrame:
    """The first flag of each version, container and session. Without a watermark the state grows with the sessions; with one, a
    repeat that comes later than it passes again."""
    hashed = source.withColumn("session", keyed_hash(F.col("session"), key)).withColumn("query", F.substring("query", 1, 500))
    keys = ["version", "container_id", "session"]
    return hashed.withWatermark("at", watermark).dropDuplicatesWithinWatermark(keys) if watermark else hashed.dropDuplicates(keys)


class NameIndex:
    """A trigram index with the highest id that it covers (its mark); each batch adds the trigrams of the names beyond it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.entered = spark, folder, Log(spark, folder)

    @property
    def mark(self) -> int:
        return self.entered.last("")[2]

    @property
    def grams(self) -> DataFrame | None:
        paths = [r.path for r in self.entered.rows().select("path").collect()]
        return self.spark.read.parquet(*paths) if paths else None

    def catch_up(self, batch: DataFrame, batch_id: int, epoch: str = "") -> None:
        seq, done, mark = self.entered.last(epoch)
        new = batch.where(F.col("id") > mark)
        top = None if batch_id <= done else new.agg(F.max("id")).first()[0]
        if top is None:
            return
        path = f"{self.folder}/names-{uuid.uuid4().hex}"
        trigrams(new.withColumnRenamed("val", "name")).write.parquet(path)
        self.entered.enter(seq + 1, epoch, batch_id, "names", path, top)


def stream_name_index(source: DataFrame, index: NameIndex, checkpoint: str):
    run = lambda batch, batch_id: index.catch_up(batch, batch_id, checkpoint_epoch(batch.sparkSession, checkpoint))
    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has put out once it has read all that is there. Complete mode: its last result."""
    spark, out, checkpoint = stream.sparkSession, fresh_path(stream.sparkSession, "stream"), fresh_path(stream.sparkSession, "offsets")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        run = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    else:
        run = writer.format("parquet").option("path", out).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
