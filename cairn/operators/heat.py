"""How unusual a container is among its like: tail probabilities, decaying sums of contributions, and percentile bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import UNKNOWN, reach_of, reach_with_parent, within_cap
from .search import KEY, quantity_sum, ranked_in

BOOK = ("book", "#early-spells")
BOOK_WEIGHT, DECAY, EARLY = 20.0, 0.6, 4
#: Percentiles of a band's least score.
CUTS = (("cold", 0.0), ("warm", 0.5), ("hot", 0.8), ("blazing", 0.95))


def cohort(fills: DataFrame, cap: int, submitted: bool = False) -> DataFrame:
    """Containers filled to the cap; submitted: also those that were not drawn."""
    rows = fills.where(F.col("depth") >= cap)
    return (rows if submitted else rows.where("origin = 'fill'")).select(KEY)


def placed(entries: DataFrame, levels: DataFrame, cap: int) -> DataFrame:
    """Unpriced entries of places within the cap, with the reach by their parent."""
    ok = levels.where(within_cap(F.col("place"), F.col("parent"), cap)).withColumn("reach", reach_with_parent(F.col("place"), F.col("parent")))
    return entries.where("cost is null").join(ok.select(*KEY, "place", "reach"), [*KEY, "place"])


def observations(entries: DataFrame, levels: DataFrame, keys: DataFrame, cap: int) -> DataFrame:
    rows = placed(entries, levels, cap).join(keys, KEY, "left_semi").where("base_type is not null and sub_type is not null")
    return rows.groupBy(*KEY, "base_type", "sub_type").agg(quantity_sum(F.lit(True)).alias("count"), F.min("reach").alias("reach"))


def early_spells(entries: DataFrame, levels: DataFrame, keys: DataFrame, spell_levels: DataFrame, cap: int) -> DataFrame:
    """(version, container_id, count) of distinct spells of a low level in books; every key has a row, if of zero."""
    books = placed(entries, levels, cap).where("base_type = 'book'").select(*KEY, F.explode("spells").alias("spell"))
    known = books.join(spell_levels.where(F.col("spell_level") <= EARLY), "spell").groupBy(KEY).agg(F.countDistinct("spell").alias("count"))
    return keys.join(known, KEY, "left").select(*KEY, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def tail_probability(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(version, base_type, sub_type, count, tail_p): the share of the cohort that holds so many or more."""
    kind = ["version", "base_type", "sub_type"]
    each = counts.groupBy(*kind, "count").agg(F.count("*").alias("n"))
    up = Window.partitionBy(kind).orderBy(F.col("count").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("above", F.sum("n").over(up)).join(sizes, "version").select(*kind, "count", (F.col("above") / F.col("cohort")).alias("tail_p"))


def cohort_size(keys: DataFrame) -> DataFrame:
    return keys.groupBy("version").agg(F.count("*").alias("cohort"))


def surprise(entries, levels, fills, spell_levels, cap: int) -> DataFrame:
    keys = cohort(fills, cap)
    items = observations(entries, levels, keys, cap).select(*KEY, "base_type", "sub_type", "count")
    books = early_spells(entries, levels, keys, spell_levels, cap).select(*KEY, F.lit(BOOK[0]).alias("base_type"), F.lit(BOOK[1]).alias("sub_type"), "count")
    return tail_probability(items.unionByName(books), cohort_size(keys))


def with_weight(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """The weight of (base, sub), else of (base, '*'); rows without one go."""
    exact = weights.where("sub_type <> '*'").withColumnRenamed("weight", "_exact")
    wild = weights.where("sub_type = '*'").select("base_type", F.col("weight").alias("_wild"))
    return rows.join(exact, ["base_type", "sub_type"], "left").join(wild, "base_type", "left").withColumn("weight", F.coalesce("_exact", "_wild")).drop("_exact", "_wild").where("weight is not null")


def tail_lookup(rows: DataFrame, table: DataFrame, sizes: DataFrame) -> DataFrame:
    """tail_p of the largest stored count that is not above the row's; none: one container's share. No sort of rows within a kind:
    a kind's stored counts are gathered in an array (counts are few), and looked up by the row."""
    kind = ["version", "base_type", "sub_type"]
    steps = table.groupBy(kind).agg(F.array_sort(F.collect_list(F.struct("count", "tail_p"))).alias("_steps"))
    found = F.element_at(F.filter("_steps", lambda s: s["count"] <= F.col("count")), -1)
    below = F.when(F.exists("_steps", lambda s: s["count"] <= F.col("count")), found["tail_p"])
    return rows.join(steps, kind, "left").join(sizes, "version").withColumn("tail_p", F.coalesce(below, 1 / F.col("cohort"))).drop("_steps")


def contributions(rows: DataFrame, cap: int) -> DataFrame:
    """rows(weight, tail_p, cohort, reach; a null reach has full use) with contribution."""
    use = F.coalesce(0.5 + 0.5 * ((F.lit(float(cap)) - F.col("reach").cast("double") + 1) / float(cap)), F.lit(1.0))
    return rows.withColumn("contribution", F.col("weight") * -F.log10(F.greatest("tail_p", 1 / F.col("cohort"))) * use)


def decay_sum(rows: DataFrame, base: float = DECAY) -> DataFrame:
    """Contributions of each container by size, each counting base times the one before."""
    sized = F.reverse(F.array_sort(F.collect_list("contribution")))
    total = F.aggregate(F.transform(F.col("_c"), lambda c, i: c * F.pow(F.lit(base), i)), F.lit(0.0), lambda a, b: a + b)
    return rows.groupBy(KEY).agg(sized.alias("_c")).select(*KEY, total.alias("score"))


def scores(entries, levels, fills, spell_levels, weights, table: DataFrame, cap: int, keys: DataFrame | None = None) -> DataFrame:
    """(version, container_id, score) of all containers that reach the cap, drawn or submitted, or of the given keys; from a stored
    surprise table, so that a late container scores as it would have with the others."""
    sizes = cohort_size(cohort(fills, cap))
    keys = cohort(fills, cap, submitted=True) if keys is None else keys
    items = with_weight(observations(entries, levels, keys, cap), weights).select(*KEY, "base_type", "sub_type", "count", "reach", "weight")
    books = early_spells(entries, levels, keys, spell_levels, cap).select(*KEY, F.lit(BOOK[0]).alias("base_type"), F.lit(BOOK[1]).alias("sub_type"), "count", F.lit(None).cast("long").alias("reach"), F.lit(BOOK_WEIGHT).alias("weight"))
    return decay_sum(contributions(tail_lookup(items.unionByName(books), table, sizes), cap))


def percentile_cut(rows: DataFrame, shares: dict[str, float], value: str = "score") -> DataFrame:
    """By version, the value at index min(n - 1, trunc(share * n)) of the sorted ones, without interpolation. Ranks are numbered by range."""
    ranked = ranked_in(rows.select("version", value), "version", [value])
    at = lambda p: F.least(F.col("size") - 1, F.floor(F.lit(p) * F.col("size")))
    return ranked.groupBy("version").agg(*[F.min(F.when(F.col("rank") == at(p), F.col(value))).alias(name) for name, p in shares.items()])


def bands(scored: DataFrame, fills: DataFrame, cap: int) -> DataFrame:
    """scored with band: the highest cut that the score reaches, of equal cuts the lowest; cuts are of drawn containers only."""
    cuts = percentile_cut(scored.join(cohort(fills, cap), KEY, "left_semi"), dict(CUTS)).withColumn("cold", F.least("cold", F.lit(0.0)))
    s = F.col("score")
    held = F.greatest(*[F.when(s >= F.col(n), F.col(n)) for n, _ in CUTS], F.lit(float("-inf")))
    band = None
    for name, _ in CUTS:
        test = (F.col(name) == held) & (s >= F.col(name))
        band = F.when(test, name) if band is None else band.when(test, name)
    return scored.join(F.broadcast(cuts), "version").withColumn("band", F.coalesce(band, F.lit("cold"))).select(*KEY, "score", "band")


def marks(keys: DataFrame, banded: DataFrame) -> DataFrame:
    """keys with their band; null: unscored, which is not cold."""
    return keys.join(banded.select(*KEY, "band"), KEY, "left")


def caps(fills: DataFrame) -> DataFrame:
    return fills.select("version", F.col("depth").alias("cap")).distinct()


# ---- all caps at once


def placed_for_caps(entries: DataFrame, levels: DataFrame) -> DataFrame:
    """Unpriced entries with the reach by their place's parent, and from_cap: the least cap that admits the place. What is unknown, of the
    place or its parent, stands in no cap's way."""
    known = lambda r: F.when(r != UNKNOWN, r)
    own, by_parent = reach_of(F.col("place")), reach_with_parent(F.col("place"), F.col("parent"))
    least = F.coalesce(F.greatest(known(own), F.when(F.col("parent").isNotNull(), known(by_parent))), F.lit(-UNKNOWN))
    held = levels.select(*KEY, "place", by_parent.alias("reach"), least.alias("from_cap"))
    return entries.where("cost is null").join(held, [*KEY, "place"])


def observed_for_caps(placed: DataFrame, keys: DataFrame, spell_levels: DataFrame, known_caps: list[int]) -> DataFrame:
    """(version, container_id, cap, base_type, sub_type, count, reach) for keys(version, container_id, depth) at every cap up to their
    depth: items by kind, and distinct early spells (a row of zero where there are none; without reach).

    One scan and one shuffle for any number of caps: kinds and spells are summed together, a sum for each cap."""
    caps_now = sorted(set(known_caps))
    early = {r.spell for r in spell_levels.where(F.col("spell_level") <= EARLY).select("spell").distinct().collect()}  # as many as there are spells in the catalog
    kind = F.when(F.col("base_type").isNotNull() & F.col("sub_type").isNotNull(), F.array(F.struct("base_type", "sub_type", F.coalesce("quantity", F.lit(1)).cast("long").alias("n"), F.lit(False).alias("spell"))))
    none = F.array().cast("array<struct<base_type:string,sub_type:string,n:bigint,spell:boolean>>")
    spells = F.when((F.col("base_type") == BOOK[0]), F.transform(F.filter("spells", lambda x: x.isin(*sorted(early)) if early else F.lit(False)), lambda x: F.struct(F.lit(BOOK[0]).alias("base_type"), x.alias("sub_type"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("spell"))))
    rows = placed.select(*KEY, "reach", "from_cap", F.explode(F.concat(F.coalesce(kind, none), F.coalesce(spells, none))).alias("k"))
    within = lambda cap: F.col("from_cap") <= cap
    sums = rows.groupBy(*KEY, "k.base_type", "k.sub_type", "k.spell").agg(
        F.array(*[F.struct(F.lit(c).cast("long").alias("cap"), F.sum(F.when(within(c), F.col("k.n"))).alias("count"), F.min(F.when(within(c), F.col("reach"))).alias("reach")) for c in caps_now]).alias("by_cap")
    )
    each = sums.join(keys.select(*KEY, "depth"), KEY).select(*KEY, "depth", "base_type", "sub_type", "spell", F.explode(F.filter("by_cap", lambda x: x["count"].isNotNull() & (x["cap"] <= F.col("depth")))).alias("x"))
    each = each.select(*KEY, F.col("x.cap").alias("cap"), "base_type", "sub_type", "spell", F.col("x.count").alias("count"), F.col("x.reach").alias("reach"))
    books = each.where("spell").groupBy(*KEY, "cap").agg(F.count("*").alias("count"))
    asked = keys.select(*KEY, F.explode(F.filter(F.array(*[F.lit(c).cast("long") for c in caps_now]), lambda c: c <= F.col("depth"))).alias("cap"))
    books = asked.join(books, [*KEY, "cap"], "left").select(*KEY, "cap", F.lit(BOOK[0]).alias("base_type"), F.lit(BOOK[1]).alias("sub_type"), F.coalesce("count", F.lit(0)).alias("count"), F.lit(None).cast("long").alias("reach"))
    return each.where("not spell").drop("spell").unionByName(books)


def cohorts(fills: DataFrame, known_caps: list[int]) -> DataFrame:
    """(version, cap, cohort): drawn containers as deep as each cap or deeper; cohorts are nested, and each container is counted once in each."""
    drawn = fills.where("origin = 'fill'").groupBy("version", "depth").agg(F.count("*").alias("n"))
    each = drawn.select("version", "n", F.explode(F.filter(F.array(*[F.lit(c).cast("long") for c in sorted(set(known_caps))]), lambda c: c <= F.col("depth"))).alias("cap"))
    return each.groupBy("version", "cap").agg(F.sum("n").alias("cohort"))


def surprise_for_caps(observed: DataFrame, fills: DataFrame, known_caps: list[int]) -> DataFrame:
    """(version, cap, base_type, sub_type, count, tail_p) of drawn containers: by cap and kind the share that holds so many or more."""
    group = ["version", "cap", "base_type", "sub_type"]
    drawn = observed.join(fills.where("origin = 'fill'").select(KEY), KEY, "left_semi")
    each = drawn.groupBy(*group, "count").agg(F.count("*").alias("n"))
    up = Window.partitionBy(group).orderBy(F.col("count").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("above", F.sum("n").over(up)).join(F.broadcast(cohorts(fills, known_caps)), ["version", "cap"]).select(*group, "count", (F.col("above") / F.col("cohort")).alias("tail_p"))


def scores_for_caps(observed: DataFrame, table: DataFrame, sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """(version, container_id, cap, score): each observed container at each of its caps, from a stored surprise table and cohort sizes, so
    that a late container scores as it would have with the others."""
    own = observed.where(F.col("sub_type") != BOOK[1])
    weighed = with_weight(own, weights).unionByName(observed.where(F.col("sub_type") == BOOK[1]).withColumn("weight", F.lit(BOOK_WEIGHT)))
    group = ["version", "cap", "base_type", "sub_type"]
    steps = table.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("count", "tail_p"))).alias("_steps"))
    below = F.element_at(F.filter("_steps", lambda s: s["count"] <= F.col("count")), -1)
    found = F.when(F.exists("_steps", lambda s: s["count"] <= F.col("count")), below["tail_p"])
    # sizes has a row for each version and cap
    looked = weighed.join(steps, group, "left").join(F.broadcast(sizes), ["version", "cap"]).withColumn("tail_p", F.coalesce(found, 1 / F.col("cohort")))
    cap = F.col("cap").cast("double")
    use = F.coalesce(0.5 + 0.5 * ((cap - F.col("reach").cast("double") + 1) / cap), F.lit(1.0))
    rated = looked.select(*KEY, "cap", (F.col("weight") * -F.log10(F.greatest("tail_p", 1 / F.col("cohort"))) * use).alias("contribution"))
    total = F.aggregate(F.transform(F.col("_c"), lambda c, i: c * F.pow(F.lit(DECAY), i)), F.lit(0.0), lambda a, b: a + b)
    return rated.groupBy(*KEY, "cap").agg(F.reverse(F.array_sort(F.collect_list("contribution"))).alias("_c")).select(*KEY, "cap", total.alias("score"))


def drop_stale_caps(tables: dict[str, DataFrame], fills: DataFrame) -> dict[str, DataFrame]:
    """Tables of scores, bands, cohorts and surprise without the caps that no container of the version is filled to any more."""
    held = F.broadcast(caps(fills))  # a row for each version and depth
    return {name: t.join(held, ["version", "cap"], "left_semi") for name, t in tables.items()}
