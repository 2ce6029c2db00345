"""The driver's tables as a catalog: entries, levels, fills and features (the mapping is data, not a rule of the engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import stored

PLACE = "case when l_suppkey % 10 = 0 then 'Sewer' when l_suppkey % 10 = 1 then concat('Lair:', cast(least(l_linenumber, 5) as string)) when l_suppkey % 10 = 2 then 'Temple' else concat('D:', cast(l_linenumber as string)) end"
#: Of a part's p_type only the first word counts, which raw_entries() has as p_kind.
BASE = "case p_kind when 'MEDIUM' then 'potion' when 'STANDARD' then 'scroll' when 'LARGE' then 'weapon' when 'PROMO' then 'armour' when 'SMALL' then 'book' when 'ECONOMY' then 'miscellaneous' end"
FEAT = "case o_custkey % 5 when 0 then 'altar_trog' when 1 then 'enter_shop' when 2 then 'enter_temple' when 3 then 'enter_sewer' end"
#: Weights of the score by base type; books have none.
WEIGHTS = (("potion", "*", 30.0), ("scroll", "*", 20.0), ("weapon", "*", 15.0), ("armour", "*", 10.0), ("miscellaneous", "*", 8.0), ("potion", "ring", 35.0))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries, stored by version, with each container's rows side by side: scans prune by version, and sums by container are
    mostly done before they are shuffled. The tables' own columns are shuffled and sorted, as they are narrower than what is made of them."""
    by_container = lambda: raw_entries(spark, sf_dir).repartition("l_returnflag", "o_custkey").sortWithinPartitions("l_returnflag", "o_custkey")
    make = lambda: mapped(by_container())
    return stored(spark, sf_dir, "catalog-entries", make, by=("version",))


def mapped_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(raw_entries(spark, sf_dir))


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    joined = lines.join(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey")).join(_table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_brand", "split_part(p_type, ' ', 1) as p_kind", "p_size"), F.expr("l_partkey = p_partkey"))
    return joined.drop("l_orderkey", "o_orderkey", "l_partkey")


def mapped(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "l_returnflag as version",
        "cast(o_custkey as string) as container_id",
        f"{PLACE} as place",
        "case when l_suppkey % 10 = 0 then concat('D:', cast(l_linenumber as string)) end as row_parent",
        f"{BASE} as base_type",
        "split_part(p_name, ' ', 2) as sub_type",
        "case when p_size % 3 = 0 then split_part(p_name, ' ', 1) end as ego",
        "case when cast(l_quantity as int) % 10 <> 0 then cast(l_quantity as int) % 5 + 1 end as quantity",
        "case when l_discount >= 0.08 then l_extendedprice end as cost",
        "p_partkey % 5 = 0 as artefact",
        "case when p_partkey % 5 = 0 then concat(p_name, ' ', p_brand) end as name",
        "case when p_partkey % 5 = 0 then array(named_struct('prop', concat('P', cast(p_partkey % 7 as string)), 'value', cast(p_size % 9 - 4 as int)), named_struct('prop', concat('P', cast((p_partkey + 3) % 7 as string)), 'value', cast(p_size % 5 - 1 as int))) else cast(array() as array<struct<prop:string,value:int>>) end as props",
        f"case when {BASE} = 'book' then array(concat('S', cast(p_size as string))) else cast(array() as array<string>) end as spells",
    )


def levels_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("version", "container_id", "place").agg(F.min("row_parent").alias("parent"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "catalog-levels", lambda: levels_of(entries(spark, sf_dir)), by=("version",))


def fills_of(places: DataFrame) -> DataFrame:
    from ..operators.ingest import fill_depth

    return fill_depth(places).withColumn("origin", F.when(F.col("container_id").cast("long") % 20 == 0, "submit").otherwise("fill"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "catalog-fills", lambda: fills_of(levels(spark, sf_dir)), by=("version",))


def features_of(rows: DataFrame) -> DataFrame:
    keys = rows.select("version", "container_id").distinct().withColumn("o_custkey", F.col("container_id").cast("long"))
    return keys.selectExpr("version", "container_id", "concat('D:', cast(o_custkey % 7 + 1 as string)) as place", f"{FEAT} as feat").where("feat is not null")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features_of(entries(spark, sf_dir))


def place_rows(rows: DataFrame) -> DataFrame:
    """Everything in a place as one table: entries as items, features, two monsters in a third of the containers, and a vault in those
    without a feature."""
    keys = rows.select("version", "container_id").distinct().withColumn("k", F.col("container_id").cast("long"))
    at = ("version", "container_id", "'D:1' as place")
    beasts = keys.where("k % 3 = 0").selectExpr(*at, "'monsters' as category", "explode(array('orc', 'rat')) as name")
    vaults = keys.where("k % 5 = 4").selectExpr(*at, "'vaults' as category", "'a vault' as name")
    out = rows.withColumn("category", F.lit("items"))
    for more in (features_of(rows).withColumn("category", F.lit("features")), beasts, vaults):
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def masked_levels_of(rows: DataFrame) -> DataFrame:
    """levels_of() with a mask of altars for temples."""
    return levels_of(rows).withColumn("altar_mask", F.expr("case when place = 'Temple' then cast(cast(container_id as bigint) % 8 as int) end"))


def spell_levels(spark: SparkSession) -> DataFrame:
    return spark.range(0, 51).selectExpr("concat('S', cast(id as string)) as spell", "cast(id % 9 + 1 as int) as spell_level")


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS), "base_type string, sub_type string, weight double")

