"""Searches: which containers hold all of these, how many and how early, with evidence, order and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import reach_of
from .criteria import NameLike, Props, Term

KEY = ["version", "container_id"]
MOST_TERMS = 10


def quantity_sum(condition: Column) -> Column:
    """Items, not rows: a row without quantity is one."""
    return F.sum(F.when(condition, F.coalesce("quantity", F.lit(1))).otherwise(0)).cast("long")


def search(entries: DataFrame, terms: Sequence[Term], version: str | None = None) -> DataFrame:
    """(version, container_id, n1, n2, ...) of containers that hold every term's minimum: one scan and one shuffle for any terms.

    Without terms, every container."""
    if len(terms) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms")
    rows = entries if version is None else entries.where(F.col("version") == version)
    if not terms:
        return rows.select(KEY).distinct()
    tests = [t.column() for t in terms]
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    sums = rows.where(hit).groupBy(KEY).agg(*[quantity_sum(t).alias(f"n{i}") for i, t in enumerate(tests, 1)])
    for i, t in enumerate(terms, 1):
        sums = sums.where(F.col(f"n{i}") >= t.min_count)
    return sums


def containing_all(keys: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    for part in parts:
        keys = keys.join(part.select(KEY), KEY, "left_semi")
    return keys


def for_containers(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the listed containers; how the list is sent around follows from its size."""
    return rows.join(keys.select(KEY).distinct(), KEY, "left_semi")


def exclude_place_pairs(levels: DataFrame, pairs: DataFrame) -> DataFrame:
    """levels without those whose (place, parent) is among pairs; a level without parent is in no pair."""
    return levels.join(pairs.where("parent is not null").select("place", "parent").distinct(), ["place", "parent"], "left_anti").select(levels.columns)


def union_vocab(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.union(other).distinct()


def populated_versions(fills: DataFrame) -> DataFrame:
    return fills.select("version").distinct()


def sample_flagged(flags: DataFrame, version: str, n: int, seed: int) -> DataFrame:
    """n distinct flagged containers of a version in the order of a hash: the same for the same seed."""
    return sample_containers(flags.where(F.col("version") == version).select(KEY).distinct(), n, seed)


def ordinal_page(matches: DataFrame, ordinals: DataFrame, after: tuple[int, int] | None, limit: int) -> DataFrame:
    """matches(version, container_id, reach) in the index' order, by reach and ordinal, after a (reach, ordinal); one more than limit to tell whether there is more."""
    rows = matches.join(ordinals, KEY)
    if after is not None:
        rows = rows.where((F.col("reach") > after[0]) | ((F.col("reach") == after[0]) & (F.col("ord") > after[1])))
    return rows.orderBy("reach", "ord").limit(limit + 1)


def without(keys: DataFrame, others: DataFrame) -> DataFrame:
    return keys.join(others.select(KEY), KEY, "left_anti")


def hide_pending(found: DataFrame, fills: DataFrame, indexed: DataFrame) -> DataFrame:
    """Without containers that were submitted and are not indexed yet."""
    pending = without(fills.where("origin = 'submit'"), indexed)
    return without(found, pending)


def count_ceiling(entries: DataFrame, term: Term) -> DataFrame:
    """By version, the most that a container holds of one term's items."""
    if isinstance(term.criterion, (NameLike, Props)):
        raise ValueError("no ceiling for names and properties: a count of theirs is no count of one kind")
    return entries.where(term.column()).groupBy(KEY).agg(quantity_sum(F.lit(True)).alias("n")).groupBy("version").agg(F.max("n").alias("most"))


def max_ceiling(parts: Sequence[DataFrame]) -> DataFrame:
    """The greatest of several (version, most); versions that only one of them has stay."""
    out = parts[0].select("version", "most")
    for part in parts[1:]:
        out = out.unionByName(part.select("version", "most"))
    return out.groupBy("version").agg(F.max("most").alias("most"))


def explain_count(ceilings: DataFrame, asked: int, versions: DataFrame) -> DataFrame:
    """(version, asked, most, possible): why a count can't be met; most is null where no container holds any."""
    joined = versions.select("version").distinct().join(ceilings, "version", "left")
    return joined.select("version", F.lit(asked).alias("asked"), "most", F.coalesce(F.col("most") >= asked, F.lit(False)).alias("possible"))


def evidence(entries: DataFrame, found: DataFrame, terms: Sequence[Term]) -> DataFrame:
    """(version, container_id, term, total, place, name, reach, names): what each found container holds of each term and where first.

    Of places equally early, the first by text, then by name."""
    kept = entries.join(found.select(KEY), KEY, "left_semi")
    marks = F.array(*[F.when(t.column(), F.lit(i)) for i, t in enumerate(terms, 1)])
    rows = kept.withColumn("term", F.explode(F.filter(marks, lambda x: x.isNotNull()))).withColumn("reach", reach_of(F.col("place")))
    label = F.coalesce("name", F.concat_ws(" ", "base_type", "sub_type"))
    first = F.min(F.struct("reach", "place", label.alias("name"))).alias("first")
    return rows.groupBy(*KEY, "term").agg(quantity_sum(F.lit(True)).alias("total"), first, F.size(F.collect_set(label)).cast("long").alias("names")).select(*KEY, "term", "total", "first.*", "names")


def keyset_page(found: DataFrame, after: str | None, limit: int) -> DataFrame:
    """The next rows by container_id in byte order, one more than limit to tell whether there is more."""
    rows = found if after is None else found.where(F.col("container_id") > after)
    return rows.orderBy("container_id").limit(limit + 1)


def ranked(found: DataFrame, proofs: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Found containers by the earliest reach of what matched, then by key."""
    reach = proofs.groupBy(KEY).agg(F.min("reach").alias("reach"))
    return found.join(reach, KEY).orderBy("reach", "container_id", "version").offset(offset).limit(limit)


def refuse_broad(found: DataFrame, most: int = 5000) -> None:
    """Raises for more matches than can be sorted for a reader."""
    if found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} matches; add a term")


def sample_containers(keys: DataFrame, n: int, seed: int) -> DataFrame:
    """n containers in the order of a hash: the same for the same seed."""
    order = F.xxhash64("version", "container_id", F.lit(seed))
    return keys.withColumn("_o", order).orderBy("_o", *KEY).limit(n).drop("_o")


def distinct_vocab(entries: DataFrame, kind: str) -> DataFrame:
    """(version, word) of one kind; pairs: (version, place, parent) of levels."""
    if kind == "pairs":
        return entries.select("version", "place", "parent").distinct()
    if kind == "items":
        return entries.where("base_type is not null").select("version", F.concat_ws(":", "base_type", "sub_type").alias("word")).distinct()
    if kind == "places":
        return entries.select("version", F.col("place").alias("word")).distinct()
    if kind == "props":
        return entries.select("version", F.explode("props").alias("p")).where("p.value >= 1").select("version", F.col("p.prop").alias("word")).distinct()
    if kind == "egos":
        return entries.where("ego is not null").select("version", F.col("ego").alias("word")).distinct()
    raise ValueError(kind)


def props_long(entries: DataFrame) -> DataFrame:
    """A row for each property of each entry: (version, container_id, place, base_type, cost, quantity, prop, value)."""
    return entries.select(*KEY, "place", "base_type", "cost", "quantity", F.explode("props").alias("_p")).select("*", "_p.prop", "_p.value").drop("_p")


def vocabulary(entries: DataFrame) -> DataFrame:
    out = None
    for kind in ("items", "props", "egos"):
        part = distinct_vocab(entries, kind).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def resolve_words(log: DataFrame, vocab: DataFrame) -> DataFrame:
    """log(word) -> (word, readings, verdict): one reading resolves a typed word, several are to pick from, near ones are suggested.

    Readings are the words of vocab(word) equal but for ASCII case. Near ones differ by one edit: both sides emit their deletions of
    one letter, so that a near pair meets at a key and no pair of all words is formed; what meets is verified.
    """
    from ..functions.text import ascii_lower, within_one_edit

    words = log.select(ascii_lower(F.col("word")).alias("word")).distinct()
    known = vocab.select(ascii_lower(F.col("word")).alias("known")).distinct()

    def keys(c: str) -> Column:
        x = F.col(c)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
        return F.explode(F.array_distinct(F.concat(F.array(x), cut)))

    met = words.withColumn("k", keys("word")).join(known.withColumn("k", keys("known")), "k").select("word", "known").distinct()
    met = met.where(within_one_edit(F.col("word"), F.col("known")))
    counts = met.groupBy("word").agg(F.count_if(F.expr("word = known")).alias("exact"), F.count_if(F.expr("word <> known")).alias("near"))
    all_words = words.join(counts, "word", "left").na.fill(0, ["exact", "near"])
    verdict = F.when(F.col("exact") == 1, "resolved").when(F.col("exact") > 1, "pick").when(F.col("near") > 0, "suggest").otherwise("none")
    return all_words.withColumn("verdict", verdict)


def readings(items: DataFrame, props: DataFrame) -> DataFrame:
    """items(base_type, sub_type), props(prop) -> (word, token, how): what each typed word can mean, in ASCII lower case.

    exact: an item's sub type, base type, token (base:sub) and the tail of a sub type after "of", and a property's name. part: one or
    more whole words of a sub type. Each item has as many rows as its sub type has runs of words.
    """
    from ..functions.text import ascii_lower

    token = F.concat("base_type", F.lit(":"), "sub_type")
    tail = F.when(F.col("sub_type").contains(" of "), F.regexp_replace("sub_type", "^.* of ", ""))
    words = F.split(F.col("sub_type"), " ")
    runs = F.flatten(F.transform(words, lambda _, i: F.transform(F.sequence(F.lit(1), F.size(words) - i), lambda n: F.array_join(F.slice(words, i + 1, n), " "))))
    read = lambda w, how: F.struct(ascii_lower(w).alias("word"), F.lit(how).alias("how"))
    exact = F.array(*[read(w, "exact") for w in (F.col("sub_type"), F.col("base_type"), token, tail)])
    own = items.where("base_type is not null and sub_type is not null").select("base_type", "sub_type").distinct()
    of_items = own.select(token.alias("token"), F.explode(F.concat(exact, F.transform(runs, lambda w: read(w, "part")))).alias("r")).select("r.word", "token", "r.how")
    of_props = props.select("prop").distinct().select(ascii_lower(F.col("prop")).alias("word"), F.concat(F.lit("props:"), "prop").alias("token"), F.lit("exact").alias("how"))
    return of_items.unionByName(of_props).where("word is not null").distinct()


def resolve_readings(log: DataFrame, index: DataFrame) -> DataFrame:
    """log(word) x readings() -> (word, verdict, tokens): one exact reading resolves a word, several are to pick from; without any, items
    that have it among the words of their sub type (three letters or more) or that are one edit away (four or more) are suggested, but
    never run. none: there is nothing near. Near words meet at their one-letter deletions, as in resolve_words()."""
    from ..functions.text import ascii_lower, within_one_edit

    words = log.select(ascii_lower(F.col("word")).alias("word")).where("word is not null").distinct()
    exact = index.where("how = 'exact'").join(words, "word", "left_semi").groupBy("word").agg(F.array_sort(F.collect_set("token")).alias("exact"))
    open_ = words.join(exact, "word", "left_anti")
    part = open_.where(F.length("word") >= 3).join(index.where("how = 'part'"), "word").select("word", "token")

    def keys(c: str) -> Column:
        x = F.col(c)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
        return F.explode(F.array_distinct(F.concat(F.array(x), cut)))

    # properties are only ever meant exactly
    known = index.where("how = 'exact' and not startswith(token, 'props:')").select(F.col("word").alias("known"), "token")
    met = open_.where(F.length("word") >= 4).withColumn("k", keys("word")).join(known.select("known").distinct().withColumn("k", keys("known")), "k").select("word", "known").distinct()
    edit = met.where(within_one_edit(F.col("word"), F.col("known"))).join(known, "known").select("word", "token")
    near = part.unionByName(edit).groupBy("word").agg(F.array_sort(F.collect_set("token")).alias("near"))
    told = words.join(exact, "word", "left").join(near, "word", "left")
    verdict = F.when(F.size("exact") == 1, "resolved").when(F.size("exact") > 1, "pick").when(F.size("near") > 0, "suggest").otherwise("none")
    return told.select("word", verdict.alias("verdict"), F.coalesce("exact", "near", F.array().cast("array<string>")).alias("tokens"))


def search_many(specs: DataFrame, postings: DataFrame) -> DataFrame:
    """specs(query, kind, a, b, min_count) x postings -> (query, version, container_id) holding every criterion of the query."""
    need = specs.groupBy("query").agg(F.count("*").alias("need"))
    hits = postings.join(specs, ["kind", "a", "b"]).where("count >= min_count").groupBy("query", *KEY).agg(F.count("*").alias("got"))
    return hits.join(need, "query").where("got = need").select("query", *KEY)


def diff_answers(a: DataFrame, b: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Rows that only one answer has, or that differ in a value."""
    left, right = a.select(*on, F.struct(*values).alias("left")), b.select(*on, F.struct(*values).alias("right"))
    return left.join(right, on, "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def ordered_summaries(keys: DataFrame, summaries: DataFrame) -> DataFrame:
    """keys(version, container_id, position) in their order, without absent ones."""
    return keys.join(summaries, KEY).orderBy("position")


def key_ranges(keys: DataFrame, k: int) -> DataFrame:
    """k closed ranges of keys of about equal size, by sampled range partitioning: (range, low, high, keys)."""
    dealt = keys.select("container_id").distinct().repartitionByRange(k, "container_id").withColumn("range", F.spark_partition_id())
    return dealt.groupBy("range").agg(F.min("container_id").alias("low"), F.max("container_id").alias("high"), F.count("*").alias("keys"))


def ranked_in(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with rank (from 0, in that order within the group) and size of the group: numbered by range, so that no group meets in one task."""
    from .ingest import assign_ids

    numbered = assign_ids(rows, [group, *order], "_at")
    spans = numbered.groupBy(group).agg(F.min("_at").alias("_first"), F.count("*").alias("size"))
    return numbered.join(spans, group).withColumn("rank", F.col("_at") - F.col("_first")).drop("_at", "_first")


def balanced_key_ranges(keys: DataFrame, k: int) -> DataFrame:
    """Exactly balanced ranges within each version, the first ones longer by one where it doesn't come out even: (version, shard, low, high)."""
    ranked = ranked_in(keys.select(KEY).distinct(), "version", ["container_id"])
    each, over = F.floor(F.col("size") / k), F.col("size") % k
    longer = over * (each + 1)
    shard = F.when(F.col("rank") < longer, F.floor(F.col("rank") / (each + 1))).otherwise(over + F.floor((F.col("rank") - longer) / F.greatest(each, F.lit(1))))
    return ranked.groupBy("version", (shard + 1).cast("int").alias("shard")).agg(F.min("container_id").alias("low"), F.max("container_id").alias("high"))
