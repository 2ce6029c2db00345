"""Mixing sources to target weights by pivotal rounding in a distributed reduction tree, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, text_or_empty, written

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE, MOST_COPIES = 1.5, 2.0
#: Open documents that meet in one node of the tree, on average.
FAN_IN = 48
SEED = 8
_LOT = 10_000


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, mark): the words of each row's text (a null text has none), and a hash of the text."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("mark"))


def told_apart(rows: DataFrame, like: list[str]) -> DataFrame:
    """rows(*like) with `row`, which tells like rows apart: a hash of them and of their number among their like, the same in every run."""
    counts = rows.groupBy(like).agg(F.count("*").alias("_n"))
    lots = counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _LOT))).alias("_lot"))  # arrays stay small
    each = lots.select(*like, "_lot", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_LOT).cast("long"), F.col("_n") - F.col("_lot") * _LOT))).alias("_k"))
    return each.select(*like, F.xxhash64(*like, "_lot", "_k", F.lit(SEED)).alias("row"))


def _sums_before(rows: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """rows with a column for each of sums: the sum of the named column over all rows before, in that order.

    Rows are dealt out by range, once (they are written); only one row for each range meets the others in one task.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    earlier = ranges.select("_range", *[F.coalesce(F.sum(f"_{name}").over(whole), F.lit(0)).alias(f"_{name}") for name in sums])
    # as many rows as shuffle partitions, at most
    joined = dealt.join(F.broadcast(earlier), "_range")
    return joined.withColumns({name: F.col(f"_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()}).drop("_range", *[f"_{name}" for name in sums])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, docs, target): sources in order of code points, null last, take the weights in turn.

    `share` of all sizes is dealt out by weight; what exceeds `most` times a source's size is dealt out again among the others.
    A source is at its limit if and only if its weight for each word of its limit is great enough, so that sources in the order of
    limit / weight fill up one after the other: running sums over that order give the level at once, without rounds. Sums of whole
    weights and limits are exact, in whatever ranges they are taken.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).withColumn("one", F.lit(1).cast("long"))
    placed = _sums_before(by, [F.col("source").asc_nulls_last()], place="one")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    each = placed.withColumn("weight", weight).withColumn("limit", most * F.col("source_size")).withColumn("at", F.col("limit") / F.col("weight"))
    each = _sums_before(each, [F.col("at").asc(), F.col("source").asc_nulls_last()], filled="limit", lighter="weight")
    words, heavy = (float(x or 0) for x in each.agg(F.sum("source_size"), F.sum("weight")).first())
    each = each.withColumn("level", (share * words - F.col("filled")) / (heavy - F.col("lighter")))
    # the level is that of the first source that it doesn't fill
    level = each.agg(F.min(F.when(F.col("level") < F.col("at"), F.struct("at", F.coalesce("source", F.lit("")), "level")))["level"]).first()[0]
    target = F.col("limit") if level is None else F.least(F.col("limit"), F.col("weight") * level)
    return each.select("source", "source_size", "docs", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def _node(units: Column, level: int) -> Column:
    """Fold of one node's open units: (carry, done). Each unit meets the carried one; words move between the two, by chance either
    way, so that their sum and each one's expectation stay, until one of them is taken or left."""
    unit = "struct<row:bigint,id:bigint,size:bigint,mark:bigint,part:double,whole:bigint,took:bigint>"
    start = F.struct(F.lit(None).cast(unit).alias("carry"), F.array().cast(f"array<{unit}>").alias("done"))

    def settle(u: Column, part: Column) -> Column:
        return F.struct(u["row"].alias("row"), u["id"].alias("id"), u["size"].alias("size"), u["mark"].alias("mark"), part.alias("part"), u["whole"].alias("whole"), (u["whole"] + (part >= 1).cast("bigint")).alias("took"))

    def step(state: Column, b: Column) -> Column:
        a = state["carry"]
        up = F.least(a["size"] * (1 - a["part"]), b["size"] * b["part"])  # words that a can gain from b
        down = F.least(a["size"] * a["part"], b["size"] * (1 - b["part"]))
        gains = _uniform(a["row"], b["row"], F.lit(level), F.lit(SEED)) * (up + down) < down
        a_full, b_void = a["size"] * (1 - a["part"]) <= b["size"] * b["part"], b["size"] * b["part"] <= a["size"] * (1 - a["part"])
        a_void, b_full = a["size"] * a["part"] <= b["size"] * (1 - b["part"]), b["size"] * (1 - b["part"]) <= a["size"] * a["part"]
        inner = lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1 - 1e-12))
        pa = F.when(gains, F.when(a_full, F.lit(1.0)).otherwise(inner(a["part"] + up / a["size"]))).otherwise(F.when(a_void, F.lit(0.0)).otherwise(inner(a["part"] - down / a["size"])))
        pb = F.when(gains, F.when(b_void, F.lit(0.0)).otherwise(inner(b["part"] - up / b["size"]))).otherwise(F.when(b_full, F.lit(1.0)).otherwise(inner(b["part"] + down / b["size"])))

        def result(p: Column) -> Column:
            x, y = settle(a, p["a"]), settle(b, p["b"])
            whole = lambda v: (v <= 0) | (v >= 1)
            carry = F.when(~whole(p["a"]), x).when(~whole(p["b"]), y)
            done = F.concat(state["done"], F.when(whole(p["a"]), F.array(x)).otherwise(F.array().cast(f"array<{unit}>")), F.when(whole(p["b"]), F.array(y)).otherwise(F.array().cast(f"array<{unit}>")))
            return F.struct(carry.cast(unit).alias("carry"), done.cast(f"array<{unit}>").alias("done"))

        met = F.transform(F.array(F.struct(pa.alias("a"), pb.alias("b"))), result)[0]
        return F.when(a.isNull(), F.struct(settle(b, b["part"]).cast(unit).alias("carry"), state["done"].alias("done"))).otherwise(met)

    return F.aggregate(units, start, step)


def rounded(units: DataFrame, most_docs: int, fan_in: int = FAN_IN) -> DataFrame:
    """units(source, docs, row, id, size, mark, part, whole) -> (source, id, size, mark, took): took is whole, or one more for some with part > 0.

    Level by level, each source's open units are dealt into nodes of about fan_in by the hash of their row, which is another for
    each, even where all else is alike; each node leaves one open at most. After
    log(most_docs) levels to the base fan_in, and one with a node for each source, the last open unit is settled by its own chance.
    """
    keep = ["source", "id", "size", "mark", "took"]
    # parts next to 0 or 1, and texts without words, are settled already
    sure = (F.col("part") < 1e-9) | (F.col("part") > 1 - 1e-9) | (F.col("size") == 0)
    done = [units.where(sure).select("source", "id", "size", "mark", (F.col("whole") + (F.col("part") > 0.5).cast("long")).alias("took"))]
    now, left, level = units.where(~sure).withColumn("took", F.lit(0).cast("long")), max(1, most_docs), 0
    while True:
        nodes = F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(float(fan_in) ** (level + 1)))).cast("long")
        spread = F.pmod(F.xxhash64("row", F.lit(level), F.lit(SEED)), nodes)
        unit = F.struct("row", "id", "size", "mark", "part", "whole", "took")
        gathered = now.groupBy("source", "docs", spread.alias("node")).agg(F.sort_array(F.collect_list(unit)).alias("units"))
        folded = written(gathered.select("source", "docs", _node(F.col("units"), level).alias("f")), f"level{level}")
        done.append(folded.select("source", F.explode("f.done").alias("u")).select("source", "u.id", "u.size", "u.mark", "u.took"))
        now = folded.where("f.carry is not null").select("source", "docs", "f.carry.*")
        last = left <= fan_in
        left, level = -(-left // fan_in), level + 1
        if last:
            break
    taken = (_uniform(F.col("row"), F.lit(-1), F.lit(SEED)) < F.col("part")).cast("long")
    done.append(now.select("source", "id", "size", "mark", (F.col("whole") + taken).alias("took")))
    out = done[0].select(keep)
    for part in done[1:]:
        out = out.unionByName(part.select(keep))
    return out


def _rounded_mix(docs: DataFrame, id_col, text_col, source_col, weights=WEIGHTS, share=TOTAL_SHARE, most=MOST_COPIES) -> DataFrame:
    """(id, source, size, mark, source_size, target, took) for each row of docs."""
    sizes = written(sizes_of(docs, id_col, text_col, source_col), "sizes")
    goal = written(targets(sizes, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-9).cast("long")
    part = F.greatest(rate - whole, F.lit(0.0))
    key = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    goal = goal.select(key[0].alias("_s"), key[1].alias("_n"), "source_size", "docs", "target")
    rows = told_apart(sizes, ["source", "id", "size", "mark"])
    joined = rows.withColumns({"_s": key[0], "_n": key[1]}).join(goal, ["_s", "_n"])
    units = joined.select("source", "docs", "row", "id", "size", "mark", part.alias("part"), whole.alias("whole"))
    most_docs = goal.agg(F.max("docs")).first()[0] or 0
    return rounded(written(units, "units"), most_docs).withColumns({"_s": key[0], "_n": key[1]}).join(goal.drop("docs"), ["_s", "_n"]).drop("_s", "_n")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """A row per row of docs: id, source, size, source_size, target, taken (words, repeats counted), copies.

    Every document of a source has the same expected copies, target / source_size; their whole part is certain, and the rest is
    rounded so that the source's words stay, but for one document's. Reruns agree: chance comes from hashes of ids, sizes and texts,
    and of the number among like rows. Null texts and texts without words have size 0 and get no copy beyond the whole part; null
    sources are a source; null ids are allowed; repeated rows are rounded each on its own. A source without words has target 0.
    """
    took = _rounded_mix(docs, id_col, text_col, source_col, **how)
    return took.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * F.col("took")).alias("taken"), F.col("took").alias("copies"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names.

    Rows meet their copies by id, source, size and text; where several are alike in all these, as many of them as the mix says are taken
    once, twice and so on. Only like rows are ever numbered, by ranges and offsets, so that no task holds all rows of one kind.
    """
    keys = ["k_id", "k_source", "k_size", "k_mark", "k_none"]

    def keyed(df: DataFrame, *more) -> DataFrame:
        none = F.col("id").isNull().cast("int") + 2 * F.col("source").isNull().cast("int")
        return df.select(F.coalesce("id", F.lit(0).cast("long")).alias("k_id"), F.coalesce("source", F.lit("")).alias("k_source"), F.col("size").alias("k_size"), F.col("mark").alias("k_mark"), none.alias("k_none"), *more)

    # like rows are taken as often as each other, but for one copy more or less: few steps (copies, rows)
    counted = keyed(_rounded_mix(docs, id_col, text_col, source_col, **how), "took").groupBy(*keys, "took").agg(F.count("*").alias("rows"))
    copies = written(counted.groupBy(keys).agg(F.sum("rows").alias("n"), F.sort_array(F.collect_list(F.struct("took", "rows")), False).alias("steps")), "copies")
    text = F.col("row")[text_col].cast("string")
    row = docs.select(F.struct("*").alias("row"))
    sized = row.select("row", F.col("row")[id_col].cast("long").alias("id"), F.col("row")[source_col].alias("source"), F.coalesce(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))
    out = keyed(sized, "row").join(copies.where("n = 1 and steps[0].took > 0"), keys).select("row", F.col("steps")[0]["took"].alias("times"))
    several = copies.where("n > 1")
    if not several.isEmpty():
        alike = keyed(sized, "row").join(several, keys).withColumns({"one": F.lit(1).cast("long"), "tie": F.monotonically_increasing_id()})
        numbered = written(_sums_before(alike, [*map(F.col, keys), F.col("tie")], before="one"), "alike")
        first = numbered.groupBy(keys).agg(F.min("before").alias("first"))
        k = F.col("before") - F.col("first")
        upto = F.aggregate("steps", F.struct(F.lit(0).cast("long").alias("rows"), F.lit(None).cast("long").alias("took")), lambda s, x: F.when(s["took"].isNotNull(), s).otherwise(F.struct((s["rows"] + x["rows"]).alias("rows"), F.when(k < s["rows"] + x["rows"], x["took"].cast("long")).alias("took"))))
        out = out.unionByName(numbered.join(first, keys).select("row", upto["took"].alias("times")))
    return out.where("times > 0").select("row", F.explode(F.expr("sequence(1, cast(times as int))"))).select("row.*")


def op8_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("source", "copies")
