"""From raw records to tables: validation, flattening, pruning, keyed replacement and derived columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import ALTARS, altar_bit, is_portal, reach_of
from ..functions.text import keyed_hash

PLACE = ["version", "container_id", "place"]
FORMAT = 4
_ITEM = "kind string, name string, text string, base_type string, sub_type string, quantity int, plus int, cost double, ego string, artefact boolean, branded boolean, feat string, timeout_turns int, shop_type string, toll_note string, unique boolean, native boolean, type_name string, x int, y int, spells array<string>, artprops array<struct<prop:string,value:int>>"
_FIELDS = ",".join(f.strip().replace(" ", ":", 1) for f in _ITEM.split(", "))
ENTRY = f"struct<{_FIELDS},items:array<struct<{_FIELDS}>>>"
RECORD = f"format int, version string, seed string, level string, parent_level string, gold int, cats struct<features:array<{ENTRY}>,items:array<{ENTRY}>,monsters:array<{ENTRY}>,vaults:array<{ENTRY}>>"
CATEGORIES = ("features", "items", "monsters", "vaults")
PREFIX = "RECORD "


def checked_lines(lines: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """lines(value, and any more columns) -> the record fields of each line with the prefix, body and reason (null: a good record), and the
    other columns. Lines without the prefix are noise; a bad line never stops the rest.

    Each line is parsed once: its fields come out of a generator, which filters on them are not pushed below.
    """
    kept = lines.where(F.col("value").startswith(prefix)).withColumn("body", F.substr("value", F.lit(len(prefix) + 1))).drop("value")
    fields = F.transform(F.array(F.from_json("body", _READ, {"mode": "PERMISSIVE"})), _typed)
    parsed = kept.select("*", F.explode(fields).alias("_p"))
    return parsed.select(*kept.columns, "_p.*").withColumn("reason", reject_reason()).drop("ill")


def ingest_lines(lines: DataFrame, prefix: str = PREFIX) -> tuple[DataFrame, DataFrame]:
    """lines(value) -> (records, rejects with reason)."""
    marked = checked_lines(lines.select("value"), prefix)
    return marked.where("reason is null").drop("reason", "body"), marked.where("reason is not null").select("body", "reason")


#: Top fields that are read with whatever JSON type they have, and the type that they must have; a null is a field left out.
_TYPES = {"version": "string", "seed": "string", "level": "string", "parent_level": "string", "gold": "int"}
_READ = RECORD
for _name, _type in _TYPES.items():
    _READ = _READ.replace(f"{_name} {_type},", f"{_name} variant,", 1)


def _typed(read: Column) -> Column:
    """The record's fields of a line as it was read, and ill: the first field whose JSON value has another type than it must have (null: none)."""
    # entries that are no object are read as null, and so are none: only then the line is looked at again
    cats = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col("body")), "$.cats", "variant"))
    ill = F.when(read["cats"].isNull() & ~F.coalesce(cats.rlike("^(OBJECT|VOID)"), F.lit(True)), "cats")
    for field, kind in reversed(_TYPES.items()):
        wrong = ~F.schema_of_variant(read[field]).isin("STRING" if kind == "string" else "BIGINT", "VOID")
        ill = F.when(read[field].isNotNull() & wrong, field).otherwise(ill)
    of_type = lambda n: F.try_variant_get(read[n], "$", _TYPES[n]) if n in _TYPES else read[n]
    return F.struct(ill.alias("ill"), *[of_type(n).alias(n) for n in ("format", "version", "seed", "level", "parent_level", "gold", "cats")])


def reject_reason() -> Column:
    unnamed = lambda cat: F.exists(F.coalesce(F.col(f"cats.{cat}"), F.array().cast(f"array<{ENTRY}>")), lambda e: F.coalesce(e["name"], e["text"]).isNull())
    return (
        F.when(F.col("format").isNull() & F.col("version").isNull() & F.col("seed").isNull(), "not a record")
        .when(F.coalesce(F.col("format") != FORMAT, F.lit(True)), "unknown format")
        .when(F.col("ill").isNotNull(), F.concat(F.lit("ill-typed "), "ill"))
        .when(F.col("version").isNull(), "no version")
        .when(F.col("seed").isNull(), "no container")
        .when(F.col("level").isNull(), "no place")
        .when(is_portal(F.col("level")) & F.col("parent_level").isNull(), "a portal without parent")
        .when(unnamed("features") | unnamed("items") | unnamed("monsters"), "an entry without name")
    )


@dataclass(frozen=True)
class Intake:
    """What a batch of lines gives: levels (place, parent, gold, altar_mask), entries as they are stored, and rejected lines."""

    levels: DataFrame
    entries: DataFrame
    rejects: DataFrame
    folder: str

    def close(self) -> None:
        """Deletes what was read of the lines; the tables can't be asked for any more."""
        from ..sources.tables import delete

        delete(self.levels.sparkSession, self.folder)


def intake(lines: DataFrame, prefix: str = PREFIX, apart: bool = False) -> Intake:
    """lines(value, and arrival where the order of a place's records counts) -> all that is stored of them, in one way: validated, the
    last record of each place, flattened, pruned, altars of temples as masks, names that follow from columns left out.

    apart: no two lines have the same arrival, so the text is kept of rejected lines only.

    Lines are parsed once: what was read is written as compressed columns for as long as the batch is at work. Places meet by key
    and arrival alone; whole records are shuffled only where places with several lines are too many to be sent around.
    """
    from ..sources.tables import fresh_path
    from .views import elide_names

    spark, place = lines.sparkSession, ["version", "seed", "level"]
    folder = fresh_path(spark, "intake")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    arrival = F.col("arrival") if "arrival" in lines.columns else F.lit(0).cast("long")
    text = F.when(F.col("reason").isNotNull(), F.col("body")) if apart else F.col("body")
    checked = checked_lines(lines.select("value", arrival.alias("arrival")), prefix)
    marked = kept(checked.withColumns({"body": text, "_line": F.monotonically_increasing_id()}), "lines")
    # records of a place that arrived together have no order: the greatest text is taken, in every run the same
    order, good = F.col("arrival") if apart else F.struct("arrival", "body"), marked.where("reason is null")
    several = good.groupBy(place).agg(F.max_by("_line", order).alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    # written, so that its size is known before the join: the records stay where they are if there are few
    records = good.join(kept(several, "several"), place, "left").where("_last is null or _last = _line").select(*place, "parent_level", "gold", "cats")
    levels = levels_of_records(records)
    temples, entries = encode_altar_mask(levels.where("place = 'Temple'"), prune_entries(flatten_entries(records)))
    levels = temples.unionByName(levels.where("place <> 'Temple'").withColumn("altar_mask", F.lit(None).cast("int")))
    return Intake(levels, elide_names(entries), marked.where("reason is not null").select("body", "reason"), folder)


def levels_of_records(records: DataFrame) -> DataFrame:
    return records.select("version", F.col("seed").alias("container_id"), F.col("level").alias("place"), F.col("parent_level").alias("parent"), "gold")


def ingest_counts(records: DataFrame, rejects: DataFrame) -> DataFrame:
    return counts_of_lines(records.select("cats").unionByName(rejects.select("reason"), allowMissingColumns=True))


def counts_of_lines(checked: DataFrame) -> DataFrame:
    """(levels, entries, rejected) of checked lines, in one pass: entries are those that flatten_entries() has rows of."""
    good, none = F.col("reason").isNull(), F.array().cast(f"array<{ENTRY}>")
    every = F.concat(*[F.coalesce(F.col(f"cats.{cat}"), none) for cat in CATEGORIES])
    held = F.aggregate(every, F.lit(0).cast("long"), lambda n, e: n + 1 + F.coalesce(F.array_size(e["items"]), F.lit(0)))
    return checked.agg(F.count_if(good).alias("levels"), F.coalesce(F.sum(F.when(good, held)), F.lit(0)).cast("long").alias("entries"), F.count_if(~good).alias("rejected"))


def flatten_entries(records: DataFrame) -> DataFrame:
    """One row per entry; what a carrier holds follows it as rows that name it in carried_by. A missing name is the text."""
    fields = [f.split()[0] for f in _ITEM.split(", ")]
    row = lambda category, entry, item, carrier, e: F.struct(category.alias("category"), entry.alias("entry_order"), item.alias("item_order"), carrier.alias("carried_by"), e.alias("e"))

    def told(cat: str) -> Column:
        def rows(e: Column, i: Column) -> Column:
            name = F.coalesce(e["name"], e["text"])
            own = row(F.lit(cat), i, F.lit(0), F.lit(None).cast("string"), F.struct(*[e[n].alias(n) for n in fields]))
            held = F.transform(F.coalesce(e["items"], F.array().cast(f"array<struct<{_FIELDS}>>")), lambda x, j: row(F.when(name.isNotNull(), "items").otherwise(cat), i, j + 1, name, x))
            return F.concat(F.array(own), held)

        return F.flatten(F.transform(F.coalesce(F.col(f"cats.{cat}"), F.array().cast(f"array<{ENTRY}>")), rows))

    # one pass for all four, and for what carriers hold
    each = records.select("version", F.col("seed").alias("container_id"), F.col("level").alias("place"), F.explode(F.concat(*[told(cat) for cat in CATEGORIES])).alias("t"))
    flat = each.select(*PLACE, "t.category", "t.entry_order", "t.item_order", "t.carried_by", "t.e.*")
    return flat.withColumn("name", F.coalesce("name", "text")).drop("text").withColumnRenamed("artprops", "props")


def prune_entries(entries: DataFrame) -> DataFrame:
    """Without vaults and one kind of door; a spell list that the item's kind spells out is dropped."""
    kept = entries.where("category <> 'vaults' and not (feat <=> 'runed_clear_door')")
    derivable = F.coalesce(F.col("sub_type").startswith("parchment of "), F.lit(False))
    return kept.withColumn("spells", F.when(derivable, F.array().cast("array<string>")).otherwise(F.coalesce("spells", F.array().cast("array<string>"))))


def encode_altar_mask(levels: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels with altar_mask, entries without the rows that it holds): only Temple has a mask, 0 if it has none of the pool."""
    pooled = (F.col("place") == "Temple") & F.coalesce(F.col("feat").isin(*ALTARS), F.lit(False))
    masks = entries.where(pooled).groupBy(PLACE).agg(F.bit_or(F.expr("1").cast("int") * F.pow(F.lit(2), altar_bit(F.col("feat"))).cast("int")).alias("altar_mask"))
    out = levels.join(masks, PLACE, "left").withColumn("altar_mask", F.when(F.col("place") == "Temple", F.coalesce("altar_mask", F.lit(0))))
    return out, entries.where(~pooled)


def extend_dictionary(known: DataFrame, values: DataFrame) -> DataFrame:
    """known(id, val) with ids for the new strings of values(val): known ids never move, new ones follow in order of text."""
    new = values.select("val").where("val is not null").distinct().join(known, "val", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return known.select("id", "val").unionByName(assign_ids(new, ["val"], "id").crossJoin(F.broadcast(top)).select((F.col("id") + F.col("top")).alias("id"), "val"))


def assign_ids(rows: DataFrame, order: list, name: str) -> DataFrame:
    """1, 2, ... in the given order without a single task: rows are dealt by range, and each range starts where the last ended."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    from ..sources.tables import written

    ranged = written(ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order))), "ids")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("size"))
    before = sizes.select("_p", (F.sum("size").over(Window.orderBy("_p")) - F.col("size")).alias("before"))
    return ranged.join(F.broadcast(before), "_p").withColumn(name, (F.col("_n") + F.col("before")).cast("long")).drop("_p", "_n", "before")


def latest_per_place(batch: DataFrame, arrival: str = "arrival", record: str | None = None) -> DataFrame:
    """Of each place's records in a batch, the last. Of records that arrived together, that with the greatest `record`, if rows name theirs."""
    order = F.struct(arrival, record) if record else F.struct(arrival)
    last = batch.groupBy(PLACE).agg(F.max(order).alias("_last"))
    return batch.join(last, PLACE).where(order == F.col("_last")).select(batch.columns)


def upsert_places(target: DataFrame, batch: DataFrame) -> DataFrame:
    """target with all rows of batch's places replaced by batch's."""
    return target.join(batch.select(PLACE).distinct(), PLACE, "left_anti").unionByName(batch, allowMissingColumns=True)


def register_versions(records: DataFrame, at: str = "ingested_at") -> DataFrame:
    return records.groupBy("version").agg(F.min(at).alias("first_seen"))


def sync_fixed_sets(entries: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sets, conflicts) of each version's book kinds: the spells of a kind never differ. strict: a conflict is an error."""
    books = entries.where("base_type = 'book' and size(spells) > 0 and not coalesce(artefact, false) and not sub_type like 'parchment of %'")
    sets = books.select("version", "sub_type", F.array_sort(F.array_distinct("spells")).alias("spells")).distinct()
    counts = sets.groupBy("version", "sub_type").agg(F.count("*").alias("n"), F.min("spells").alias("spells"))
    conflicts = sets.join(counts.where("n > 1").select("version", "sub_type"), ["version", "sub_type"])
    good = counts.where("n = 1").drop("n")
    if strict:
        counts = counts.withColumn("spells", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("spell sets differ: "), "sub_type"))).otherwise(F.col("spells")))
        good = counts.drop("n")
    return good, conflicts


def fill_depth(levels: DataFrame) -> DataFrame:
    """(version, container_id, depth): the latest known reach of its places outside portals; none: 0."""
    reach = reach_of(F.col("place"))
    known = F.when(~is_portal(F.col("place")) & (reach < F.lit(4611686018427387903)), reach)
    return levels.groupBy("version", "container_id").agg(F.coalesce(F.max(known), F.lit(0)).cast("long").alias("depth"))


def merge_origins(fills: DataFrame) -> DataFrame:
    """One row per container: filled, if it was ever filled."""
    return fills.groupBy("version", "container_id").agg(F.max("depth").alias("depth"), F.when(F.bool_or(F.col("origin") == "fill"), "fill").otherwise("submit").alias("origin"))


def sample_counts(fills: DataFrame) -> DataFrame:
    return fills.groupBy("version").agg(F.count_if(F.col("origin") == "fill").alias("sampled"), F.count_if(F.col("origin") == "submit").alias("submitted"))


def drop_containers(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, ["version", "container_id"], "left_anti")


def drop_everywhere(tables: dict[str, DataFrame], state: DataFrame, keys: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the containers, index state without their versions): whatever names a container loses it, and an index that was
    built with it is current no more."""
    gone = keys.select("version", "container_id").distinct()
    return {name: drop_containers(t, gone) for name, t in tables.items()}, state.join(gone.select("version").distinct(), "version", "left_anti")


def backfill(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The table with each missing column as nulls of its type."""
    return table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in table.columns})


def missing_keys(fills: DataFrame, version: str, start: int, n: int) -> DataFrame:
    """Of n keys from start (up to 2^64), those without a fill of the version; submitted ones count as missing."""
    have = fills.where((F.col("version") == version) & (F.col("origin") == "fill")).select("container_id")
    return key_range(fills.sparkSession, start, n).join(have, "container_id", "left_anti")


def key_range(spark, start: int, n: int) -> DataFrame:
    """container_id of n keys from start, as decimal text; keys may be beyond 2^63."""
    return spark.range(n).select((F.col("id").cast("decimal(20,0)") + F.lit(str(start)).cast("decimal(20,0)")).cast("string").alias("container_id"))


def record_flags(flags: DataFrame, key: bytes) -> DataFrame:
    """The first flag of each version, container and session; sessions are kept as keyed hashes, queries cut to 500 characters."""
    hashed = flags.withColumns({"session": keyed_hash(F.col("session"), key), "query": F.substring("query", 1, 500)})
    return hashed.groupBy("version", "container_id", "session").agg(F.min_by(F.struct("query", "at"), F.struct("at", "query")).alias("f")).select("version", "container_id", "session", "f.*")
