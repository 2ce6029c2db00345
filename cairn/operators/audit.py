"""Audits of the data, and figures about the whole population."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import display_name
from ..functions.places import is_portal
from .search import KEY


def audit_summary(entries: DataFrame) -> DataFrame:
    key = F.col("container_id").cast("decimal(20,0)")
    return entries.groupBy("version").agg(F.countDistinct("container_id").alias("containers"), F.count("*").alias("entries"), F.min(key).cast("string").alias("low"), F.max(key).cast("string").alias("high"))


def audit_short(levels: DataFrame, fills: DataFrame) -> DataFrame:
    """Containers with fewer places outside portals than the most of those equally deep."""
    own = levels.where(~is_portal(F.col("place"))).groupBy(KEY).agg(F.count("*").alias("places"), F.array_join(F.array_sort(F.collect_list("place")), ",").alias("held"))
    both = own.join(fills, KEY)
    most = both.groupBy("version", "depth").agg(F.max("places").alias("most"))
    return both.join(most, ["version", "depth"]).where("places < most").select(*KEY, "depth", "places", "most", "held")


def audit_truncated(fills: DataFrame, shallow: int = 8) -> DataFrame:
    return fills.where(F.col("depth") < shallow)


def audit_unfilled(levels: DataFrame, fills: DataFrame) -> DataFrame:
    return levels.select(KEY).distinct().join(fills, KEY, "left_anti")


def audit_counter(counter: DataFrame, recount: DataFrame) -> DataFrame:
    """Versions whose kept count is not the recount."""
    return counter.withColumnRenamed("n", "kept").join(recount.withColumnRenamed("n", "counted"), "version", "full_outer").where(~F.col("kept").eqNullSafe(F.col("counted")))


def audit_range(fills: DataFrame, version: str, low: int, high: int) -> DataFrame:
    """Keys of a closed range (up to 2^64) that are missing, or there only by submission."""
    from .ingest import key_range

    have = fills.where(F.col("version") == version).select("container_id", "origin")
    return key_range(fills.sparkSession, low, high - low + 1).join(have, "container_id", "left").select("container_id", F.when(F.col("origin").isNull(), "missing").when(F.col("origin") == "submit", "submitted").alias("state")).where("state is not null")


def undeclared(observed: DataFrame, declared: DataFrame) -> DataFrame:
    return observed.subtract(declared)


def audit_weights(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """Kinds without a weight of their own or of their base type: they would add nothing, silently."""
    kinds = entries.where("base_type is not null").select("base_type", "sub_type").distinct()
    return kinds.join(weights.where("sub_type = '*'").select("base_type"), "base_type", "left_anti").join(weights, ["base_type", "sub_type"], "left_anti")


def audit_names(entries: DataFrame) -> DataFrame:
    """Rows without a stored name whose columns don't determine one either: nobody can tell what they are. Rows without category are items,
    where they have a base type, or else features."""
    from .ingest import backfill
    from .views import NAMED_BY

    types = ("string", "string", "string", "string", "string", "int", "int", "string", "boolean")
    full = backfill(entries, dict(zip(NAMED_BY, types)))
    category = F.coalesce("category", F.when(F.col("base_type").isNotNull(), "items").when(F.col("feat").isNotNull(), "features"))
    told = display_name(category, *map(F.col, NAMED_BY[1:]))
    return full.where(F.col("name").isNull() & told.isNull()).select(entries.columns)


def _in_slices(log: DataFrame, buckets: int) -> DataFrame:
    span = log.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    width = (F.col("hi") - F.col("lo") + 1) / buckets
    return log.crossJoin(F.broadcast(span)).withColumn("bucket", F.floor((F.col("at") - F.col("lo")) / width).cast("int"))


def rate_curve(log: DataFrame, buckets: int) -> DataFrame:
    """log(at seconds, seeds, secs) in equal slices of time: (bucket, runs, seeds per minute)."""
    return _in_slices(log, buckets).groupBy("bucket").agg(F.count("*").alias("runs"), (F.sum("seeds") * 60 / F.sum("secs")).alias("per_min"))


def rate_drift(log: DataFrame, buckets: int) -> DataFrame:
    """(first, last, percent): seeds per minute in the first and the last slice, and the change; null where a slice has no time."""
    of = lambda b, c: F.sum(F.when(F.col("bucket") == b, F.col(c)))
    rate = lambda b: F.try_divide(of(b, "seeds") * 60, of(b, "secs"))
    ends = _in_slices(log, buckets).agg(rate(0).alias("first"), rate(buckets - 1).alias("last"))
    return ends.withColumn("percent", F.try_divide((F.col("last") - F.col("first")) * 100, F.col("first")))


def exclusion_stats(draws: DataFrame) -> DataFrame:
    """(version, group_name, drawn, containers): how the draws of each group split."""
    return draws.groupBy("version", "group_name", "drawn").agg(F.count("*").alias("containers"))


def exclusion_states(draws: DataFrame) -> DataFrame:
    """(version, containers, conflicts, states): containers that hold two members of a group or more, and distinct vectors of draws."""
    vector = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_name", "drawn"))), lambda x: x["drawn"]), "|")
    each = draws.groupBy(KEY).agg(F.bool_or(F.col("drawn").startswith("conflict")).alias("conflict"), vector.alias("state"))
    return each.groupBy("version").agg(F.count("*").alias("containers"), F.count_if("conflict").alias("conflicts"), F.countDistinct("state").alias("states"))


def richness(entries: DataFrame) -> DataFrame:
    """By version, mean and spread of distinct kinds in a container, and their correlation between early and late places."""
    kind = F.concat_ws(":", "base_type", "sub_type")
    early = F.col("place").isin("D:1", "D:2", "D:3")
    each = entries.groupBy(KEY).agg(F.countDistinct(kind).alias("kinds"), F.countDistinct(F.when(early, kind)).alias("early"), F.countDistinct(F.when(~early, kind)).alias("late"))
    return each.groupBy("version").agg(F.avg("kinds").alias("mean_kinds"), F.max("kinds").alias("most_kinds"), F.corr("early", "late").alias("r"))


def _kind_sets(entries: DataFrame) -> DataFrame:
    return entries.where("base_type is not null").groupBy(KEY).agg(F.array_sort(F.collect_set(F.concat_ws(":", "base_type", "sub_type"))).alias("kinds"))


def _held_together(sets: DataFrame, least: int) -> DataFrame:
    pairs = F.flatten(F.transform("kinds", lambda a, i: F.transform(F.slice("kinds", i + 2, F.size("kinds")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select("version", F.explode(pairs).alias("p")).groupBy("version", "p.a", "p.b").agg(F.count("*").alias("both")).where(F.col("both") >= least)


def lift_by_richness(entries: DataFrame, width: int = 4, least: int = 1) -> DataFrame:
    """(version, a, b, both, expected, lift) of kinds held together, controlled by richness: what is expected is summed over buckets of
    containers with alike many kinds (`width` numbers each), so that rich containers alone lift no pair. Only pairs that are held meet
    the buckets."""
    sets = _kind_sets(entries).withColumn("bucket", F.floor(F.size("kinds") / width))
    sizes = sets.groupBy("version", "bucket").agg(F.count("*").alias("n"))
    single = sets.select("version", "bucket", F.explode("kinds").alias("kind")).groupBy("version", "bucket", "kind").agg(F.count("*").alias("have"))
    a = single.join(sizes, ["version", "bucket"]).select("version", "bucket", F.col("kind").alias("a"), F.col("have").alias("have_a"), "n")
    b = single.select("version", "bucket", F.col("kind").alias("b"), F.col("have").alias("have_b"))
    rated = _held_together(sets, least).join(a, ["version", "a"]).join(b, ["version", "bucket", "b"])
    expected = rated.groupBy("version", "a", "b", "both").agg(F.sum(F.col("have_a") * F.col("have_b") / F.col("n")).alias("expected"))
    return expected.withColumn("lift", F.col("both") / F.col("expected"))


def pair_lift(entries: DataFrame, least: int = 1) -> DataFrame:
    """(version, a, b, both, lift) of kinds held together. Pairs are formed within a container's distinct kinds, of which there are
    as many as the vocabulary at most, and are summed before they are shuffled."""
    sets = _kind_sets(entries)
    total = sets.groupBy("version").agg(F.count("*").alias("n"))
    single = sets.select("version", F.explode("kinds").alias("kind")).groupBy("version", "kind").agg(F.count("*").alias("have"))
    both = _held_together(sets, least)
    a, b = single.select("version", F.col("kind").alias("a"), F.col("have").alias("have_a")), single.select("version", F.col("kind").alias("b"), F.col("have").alias("have_b"))
    return both.join(a, ["version", "a"]).join(b, ["version", "b"]).join(total, "version").select("version", "a", "b", "both", (F.col("both") * F.col("n") / (F.col("have_a") * F.col("have_b"))).alias("lift"))


def cohort_share(entries: DataFrame, fills: DataFrame, base: str, sub: str) -> DataFrame:
    """By version and depth, the share of containers that hold a kind."""
    have = entries.where((F.col("base_type") == base) & (F.col("sub_type") == sub)).select(KEY).distinct().withColumn("has", F.lit(1))
    return fills.join(have, KEY, "left").groupBy("version", "depth").agg(F.avg(F.coalesce("has", F.lit(0))).alias("share"), F.count("*").alias("containers"))


def set_entropy(entries: DataFrame) -> DataFrame:
    """Bits of the distribution of containers over their sets of base types."""
    sets = entries.groupBy(KEY).agg(F.array_join(F.array_sort(F.collect_set("base_type")), ",").alias("s"))
    counts = sets.groupBy("version", "s").agg(F.count("*").alias("n"))
    total = counts.groupBy("version").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return counts.join(total, "version").groupBy("version").agg(F.count("*").alias("sets"), F.sum(-p * F.log2(p)).alias("bits"))


def growth_curve(entries: DataFrame) -> DataFrame:
    """(version, container, kinds): distinct kinds seen in the first containers by key (up to 2^64), at each that brings a new one."""
    kind = F.concat_ws(":", "base_type", "sub_type")
    first = entries.groupBy("version", kind.alias("kind")).agg(F.min(F.col("container_id").cast("decimal(20,0)")).alias("first"))
    new = first.groupBy("version", "first").agg(F.count("*").alias("new"))
    return new.select("version", F.col("first").alias("container"), F.sum("new").over(Window.partitionBy("version").orderBy("first")).alias("kinds"))


def set_growth(sets: DataFrame) -> DataFrame:
    """sets(version, container_id, held) -> (version, containers, sets): how many distinct `held` the first containers have, in numeric
    order of keys (up to 2^64), at each rank that brings a new one. Ranks are numbered by ranges and offsets, twice: containers, and then
    first sights."""
    from .search import ranked_in

    ranked = ranked_in(sets.select("version", F.col("container_id").cast("decimal(20,0)").alias("key"), "held"), "version", ["key"])
    first = ranked.groupBy("version", "held").agg((F.min("rank") + 1).alias("containers"))
    return ranked_in(first.select("version", "containers"), "version", ["containers"]).select("version", "containers", (F.col("rank") + 1).alias("sets"))


def growth_law(curve: DataFrame) -> DataFrame:
    """(version, exponent, sets): the slope of log sets over log containers, 1 where nothing ever repeats and 0 where all has been seen;
    null for less than two points."""
    x, y = F.log("containers"), F.log("sets")
    n, sx, sy, sxx, sxy = F.count("*"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(x * y)
    return curve.groupBy("version").agg(F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx).alias("exponent"), F.max("sets").alias("sets"))


def class_breakdown(entries: DataFrame) -> DataFrame:
    return entries.groupBy("version", "base_type").agg(F.count("*").alias("entries"), F.count_if(F.col("cost").isNotNull()).alias("priced"), F.count_if("artefact").alias("artefacts"))


def places_of_feature(features: DataFrame, feat: str) -> DataFrame:
    """(version, place, n, share): how a feature that each container has once at most is spread over places."""
    counts = features.where(F.col("feat") == feat).groupBy("version", "place").agg(F.count("*").alias("n"))
    total = counts.groupBy("version").agg(F.sum("n").alias("total"))
    return counts.join(total, "version").select("version", "place", "n", (F.col("n") / F.col("total")).alias("share"))


def prefix_extension_diff(shallow: DataFrame, deep: DataFrame) -> DataFrame:
    """Rows that only one of two fills has, with the side."""
    return shallow.exceptAll(deep).withColumn("side", F.lit("shallow")).unionByName(deep.exceptAll(shallow).withColumn("side", F.lit("deep")))
