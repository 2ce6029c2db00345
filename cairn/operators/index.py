"""An inverted index as derived tables: ordinals, postings, their catalog, a trigram index of names, and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.places import reach_of
from ..functions.text import ascii_lower, contains_ci
from .ingest import assign_ids
from .search import KEY, quantity_sum

BRANDED = ("weapon", "armour")


def assign_ordinals(keys: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(version, container_id, ord): new keys follow known ones in numeric order of the key; ordinals never move."""
    new = keys.select(KEY).distinct()
    if known is None:
        return assign_ids(new, ["version", F.length("container_id"), "container_id"], "ord")
    top = known.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("top"))
    fresh = assign_ids(new.join(known, KEY, "left_anti"), ["version", F.length("container_id"), "container_id"], "ord")
    return known.unionByName(fresh.crossJoin(F.broadcast(top)).select(*KEY, (F.col("ord") + F.col("top")).alias("ord")))


def build_postings(entries: DataFrame) -> DataFrame:
    """(version, kind, a, b, container_id, reach, count): one pass over entries for item, typed and bare property, and brand keys.

    reach is that of the place without its parent, so portals come last."""
    at = F.when(F.col("cost").isNull(), "floor").otherwise("shop")
    key = lambda kind, a, b: F.struct(F.concat_ws("/", at, F.lit(kind)).alias("kind"), a.alias("a"), b.alias("b"))
    none = F.lit("")
    good = F.array_distinct(F.transform(F.filter("props", lambda p: p["value"] >= 1), lambda p: p["prop"]))
    keys = F.concat(
        F.when(F.col("base_type").isNotNull() & F.col("sub_type").isNotNull(), F.array(key("item", F.col("base_type"), F.col("sub_type")))).otherwise(F.array().cast("array<struct<kind:string,a:string,b:string>>")),
        F.transform(good, lambda p: key("typed", F.coalesce("base_type", none), p)),
        F.transform(good, lambda p: key("prop", none, p)),
        F.when(F.col("base_type").isin(*BRANDED) & F.col("ego").isNotNull(), F.array(key("brand", F.col("base_type"), F.col("ego")))).otherwise(F.array().cast("array<struct<kind:string,a:string,b:string>>")),
    )
    rows = entries.select(*KEY, "quantity", reach_of(F.col("place")).alias("reach"), F.explode(keys).alias("k"))
    return rows.groupBy("version", F.col("k.kind").alias("kind"), F.col("k.a").alias("a"), F.col("k.b").alias("b"), "container_id").agg(F.min("reach").alias("reach"), quantity_sum(F.lit(True)).alias("count"))


def in_order(postings: DataFrame) -> DataFrame:
    """Sorted by key, so that a look-up reads few row groups; a list longer than a task's part goes on in the next."""
    order = ["version", "kind", "a", "b", "container_id"]
    return postings.repartitionByRange(*order).sortWithinPartitions(*order)


def build_criteria(postings: DataFrame) -> DataFrame:
    return postings.groupBy("version", "kind", "a", "b").agg(F.count("*").alias("card"), F.max("count").alias("most"))


def search_indexed(postings: DataFrame, keys: list[tuple[str, str, str, int]]) -> DataFrame:
    """Containers with all keys (kind, a, b, min_count): a sum over the postings of any of them, one shuffle. Of equal keys the
    greatest minimum holds."""
    least: dict[tuple[str, str, str], int] = {}
    for *key, n in keys:
        least[tuple(key)] = max(n, least.get(tuple(key), n))
    match = asked = None
    for i, ((kind, a, b), n) in enumerate(least.items()):
        same = (F.col("kind") == kind) & (F.col("a") == a) & (F.col("b") == b)
        test = same & (F.col("count") >= n)
        match, asked = (F.when(test, 1 << i), same) if match is None else (match.when(test, 1 << i), asked | same)
    hits = postings.where(asked).withColumn("_term", match).where("_term is not null")  # the first filter reaches the scan
    return hits.groupBy(KEY).agg(F.bit_or("_term").alias("n"), F.min("reach").alias("reach")).where(F.col("n") == (1 << len(least)) - 1).drop("n")  # no distinct count, so rows are not expanded


def trigrams(names: DataFrame, column: str = "name") -> DataFrame:
    """(gram, name) of distinct stored names in ASCII lower case."""
    low = names.where(F.length(column) >= 3).select(F.col(column).alias("name"), ascii_lower(F.col(column)).alias("low")).distinct()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - 2), lambda i: F.substr(F.col("low"), i, F.lit(3))))
    return low.select(F.explode(grams).alias("gram"), "name")


def names_like(index: DataFrame, fragment: str) -> DataFrame:
    """Names with the fragment: those that have all its trigrams, then checked as a whole."""
    low = fragment.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    met = index.where(F.col("gram").isin(grams)).groupBy("name").agg(F.count("*").alias("n"))
    return met.where((F.col("n") == len(grams)) & contains_ci(F.col("name"), fragment)).select("name")


class StaleIndexError(RuntimeError):
    """The index is older than the names that it would be asked for."""


def require_current(built: int, now: int) -> None:
    if built < now:
        raise StaleIndexError(f"built at {built}, now {now}")


def is_current(state: DataFrame, counts: DataFrame) -> DataFrame:
    """(version, current): whether as many containers were sampled when the index was built as are now."""
    return counts.join(state.withColumnRenamed("sampled", "built"), "version", "left").select("version", F.coalesce(F.col("built") == F.col("sampled"), F.lit(False)).alias("current"))


def changed(fills: DataFrame, built: DataFrame) -> DataFrame:
    """Containers deeper now than when they were indexed; those never indexed too. Where fills have places and built has built_places,
    also those with more places now."""
    more = " or places > coalesce(built_places, 0)" if "built_places" in built.columns else ""
    return fills.join(built.withColumnRenamed("depth", "built_depth"), KEY, "left").where(f"built_depth is null or depth > built_depth{more}").select(KEY)


def overlay(postings: DataFrame, stale: DataFrame, derived: DataFrame) -> DataFrame:
    """Postings without those of stale containers, and with theirs derived anew: a subtraction, then a union."""
    return postings.join(stale.select(KEY).distinct(), KEY, "left_anti").unionByName(derived.join(stale.select(KEY).distinct(), KEY, "left_semi"))


def index_stats(criteria: DataFrame, block: int = 512) -> DataFrame:
    return criteria.groupBy("version").agg(F.count("*").alias("criteria"), F.sum("card").alias("postings"), F.sum(F.ceil(F.col("card") / block)).cast("long").alias("blocks"))
