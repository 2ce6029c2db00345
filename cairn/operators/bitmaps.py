"""Postings as bitmaps over ordinals: lists are intersected bucket by bucket, and the rarest list decides which buckets are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import KEY

#: A criterion has a bitmap for containers that hold at least so many; counts between are looked up in the postings.
LEAST = (1, 2, 4, 8)
#: As many bucket numbers are put into a filter that reaches the scan; of more, their span is, and a semi join does the rest.
MOST_BUCKETS = 1000
_LIST = ["kind", "a", "b"]


def build_bitmaps(postings: DataFrame, ordinals: DataFrame) -> DataFrame:
    """(version, kind, a, b, least, bucket, bits, card): a bitmap of 32,768 ordinals for each list, least count and bucket with a bit."""
    rows = postings.join(ordinals.select(*KEY, "ord"), KEY)
    each = rows.select("version", *_LIST, "ord", F.explode(F.filter(F.array(*[F.lit(n) for n in LEAST]), lambda n: n <= F.col("count"))).alias("least"))
    grouped = each.groupBy("version", *_LIST, "least", F.bitmap_bucket_number("ord").alias("bucket"))
    return grouped.agg(F.bitmap_construct_agg(F.bitmap_bit_position("ord")).alias("bits"), F.count("*").alias("card"))


def in_order(bitmaps: DataFrame) -> DataFrame:
    """Sorted by list and bucket, so that filters on both skip row groups of what is written."""
    order = ["version", *_LIST, "least", "bucket"]
    return bitmaps.repartitionByRange(*order).sortWithinPartitions(*order)


def cards_of(bitmaps: DataFrame) -> DataFrame:
    """(kind, a, b, least, card): the length of each list."""
    return bitmaps.groupBy(*_LIST, "least").agg(F.sum("card").alias("card"))


def write_bitmaps(bitmaps: DataFrame, folder: str) -> None:
    in_order(bitmaps).write.partitionBy("version").parquet(f"{folder}/bitmaps")
    cards_of(bitmaps.sparkSession.read.parquet(f"{folder}/bitmaps")).write.parquet(f"{folder}/cards")


def _is(key: Sequence) -> F.Column:
    kind, a, b = key[:3]
    return (F.col("kind") == kind) & (F.col("a") == a) & (F.col("b") == b)


def step_of(count: int) -> int:
    return max(n for n in LEAST if n <= max(count, 1))


def rarest_first(cards: DataFrame, keys: Sequence[tuple[str, str, str, int]]) -> list[tuple[str, str, str, int]]:
    """keys by the length of their lists, which a look-up of as many rows tells; a key without a list is first."""
    asked = None
    for key in keys:
        one = _is(key) & (F.col("least") == step_of(key[3]))
        asked = one if asked is None else asked | one
    known = {(r.kind, r.a, r.b, r.least): r.card for r in cards.where(asked).collect()}
    return sorted(keys, key=lambda k: (known.get((*k[:3], step_of(k[3])), 0), k))


def holding_all(bitmaps: DataFrame, cards: DataFrame, ordinals: DataFrame, postings: DataFrame, keys: Sequence[tuple[str, str, str, int]]) -> DataFrame:
    """(version, container_id) of containers in every key's list (kind, a, b, min_count).

    Buckets without a bit of the rarest list are not read of the others. What is left is ANDed; ordinals whose bit is set are the
    answer, but for counts between two of LEAST, which the postings of these containers decide. Keys that differ in nothing but their
    count are one, with the greatest."""
    merged: dict = {}
    for *key, n in keys:
        merged[tuple(key)] = max(n, merged.get(tuple(key), 1))
    ordered = rarest_first(cards, [(*k, n) for k, n in merged.items()])
    lists = [_is(k) & (F.col("least") == step_of(k[3])) for k in ordered]
    rare = bitmaps.where(lists[0])
    out = rare.select("version", "bucket", "bits")
    if len(lists) > 1:
        any_other = lists[1]
        for one in lists[2:]:
            any_other = any_other | one
        others = bitmaps.where(any_other)
        held = [r.bucket for r in rare.select("bucket").distinct().limit(MOST_BUCKETS + 1).collect()]
        if len(held) <= MOST_BUCKETS:
            others = others.where(F.col("bucket").isin(sorted(held)))
        else:
            low, high = rare.agg(F.min("bucket"), F.max("bucket")).first()
            others = others.where(F.col("bucket").between(low, high)).join(rare.select("version", "bucket"), ["version", "bucket"], "left_semi")
        both = out.unionByName(others.select("version", "bucket", "bits"))
        out = both.groupBy("version", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("lists")).where(F.col("lists") == len(lists))
    out = out.where(F.bitmap_count("bits") > 0)
    at = F.bitmap_bit_position("ord")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    numbered = ordinals.select(*KEY, "ord").withColumn("bucket", F.bitmap_bucket_number("ord"))
    found = numbered.join(out.select("version", "bucket", "bits"), ["version", "bucket"]).where(F.getbit(byte, (at % 8).cast("int")) == 1).select(KEY)
    for key in ordered:
        if step_of(key[3]) != key[3]:
            found = found.join(postings.where(_is(key) & (F.col("count") >= key[3])), KEY, "left_semi")
    return found
