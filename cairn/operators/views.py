"""What a container holds: sections, shops, altars, entrances, parents, draws, summaries and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import display_name, entry_spells
from ..functions.places import ALTARS, PORTALS, branch_of_feat, is_portal, mask_feats, reach_of, reach_with_parent
from ..functions.text import BOONS, boon, significance, title
from .search import KEY

PLACE = [*KEY, "place"]


def _label() -> Column:
    return F.coalesce("name", "feat", F.concat_ws(" ", "base_type", "sub_type"))


def container_detail(levels: DataFrame, rows: DataFrame) -> DataFrame:
    """Every place with its rows in order of category and name, told with their spells and properties; empty places too."""
    spells = F.when(F.size("spells") > 0, F.concat(F.lit(" ("), F.array_join("spells", ", "), F.lit(")"))).otherwise("")
    props = F.transform("props", lambda p: F.concat(p["prop"], F.lit(" "), p["value"].cast("string")))
    told = F.concat(_label(), spells, F.when(F.size("props") > 0, F.concat(F.lit(" {"), F.array_join(props, ", "), F.lit("}"))).otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct("category", _label().alias("label"), told.alias("told"))))
    held = rows.groupBy(PLACE).agg(F.count("*").alias("entries"), F.array_join(F.transform(ordered, lambda x: x["told"]), "; ").alias("listing"))
    return levels.join(held, PLACE, "left").na.fill(0, ["entries"]).na.fill("", ["listing"])


def with_places(entries: DataFrame, levels: DataFrame) -> DataFrame:
    """Entries with their place's parent and both reaches: of the place itself, and by its parent."""
    from ..functions.places import reach_of

    here = levels.select(*PLACE, "parent", reach_of(F.col("place")).alias("own_reach"), reach_with_parent(F.col("place"), F.col("parent")).alias("reach"))
    return entries.join(here, PLACE)


#: Altars that no temple holds, so that a listing names them.
RARE_ALTARS = ("altar_lugonu", "altar_beogh", "altar_jiyva", "altar_ignis")


def summaries(entries: DataFrame, levels: DataFrame, features: DataFrame, boons=BOONS, rare: tuple[str, ...] = RARE_ALTARS) -> DataFrame:
    """(container, temple, artefacts, a column for each boon, altars, portals): one conditional sum for each table.

    temple: the earliest place with its entrance; artefacts and boons: unpriced ones, boons by quantity; altars: the rare ones, each
    once; portals: as place@parent, where the parent is known.
    """
    of_boon = boon(F.col("base_type"), F.col("sub_type"), F.col("cost"), boons)
    count = F.coalesce("quantity", F.lit(1))
    labels = [label for _, _, label in boons]
    items = entries.where("cost is null").groupBy(KEY).agg(F.count_if("artefact").alias("artefacts"), *[F.sum(F.when(of_boon == x, count)).alias(x) for x in labels])
    portal = F.when(is_portal(F.col("place")) & F.col("parent").isNotNull(), F.concat("place", F.lit("@"), "parent"))
    places = levels.groupBy(KEY).agg(F.array_join(F.array_sort(F.collect_set(portal)), ",").alias("portals"))
    temple = F.min(F.when(F.col("feat") == "enter_temple", F.struct(reach_of(F.col("place")).alias("reach"), "place")))["place"]
    altars = F.array_join(F.array_sort(F.collect_set(F.when(F.col("feat").isin(*rare), F.col("feat")))), ",")
    marks = features.groupBy(KEY).agg(temple.alias("temple"), altars.alias("altars"))
    return places.join(items, KEY, "left").join(marks, KEY, "left").na.fill(0, ["artefacts", *labels]).na.fill("", ["altars"])


def recover_parents(levels: DataFrame, features: DataFrame) -> DataFrame:
    """Portal places without a parent get the earliest place that holds their entrance."""
    from ..functions.places import reach_of

    pairs = F.create_map(*[F.lit(x) for kv in PORTALS.items() for x in kv])
    first = features.groupBy(*KEY, "feat").agg(F.min(F.struct(reach_of(F.col("place")).alias("r"), "place")).alias("f")).select(*KEY, F.col("feat").alias("_feat"), F.col("f.place").alias("found"))
    return levels.withColumn("_feat", pairs[F.col("place")]).join(first, [*KEY, "_feat"], "left").withColumn("parent", F.coalesce("parent", "found")).drop("_feat", "found")


def shops(entries: DataFrame) -> DataFrame:
    """(place, stock, total, artefacts) of priced entries."""
    return entries.where("cost is not null").groupBy(PLACE).agg(F.count("*").alias("stock"), F.sum("cost").alias("total"), F.count_if("artefact").alias("artefacts"))


def shop_stock(entries: DataFrame) -> DataFrame:
    """Priced entries with the shop feature at their spot; spots without coordinates meet each other."""
    shop = entries.where("feat = 'enter_shop'").select(*[F.col(c).alias(f"_{c}") for c in PLACE], F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("shop_type").alias("_type"))
    stock = entries.where("cost is not null")
    on = [F.col(c) == F.col(f"_{c}") for c in PLACE] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("x", "y")]
    return stock.drop("shop_type").join(shop, on, "left").withColumn("shop_type", F.col("_type")).select(*stock.columns)


def shops_by_spot(entries: DataFrame) -> DataFrame:
    """(place, x, y, shop_type, name, nth, goods, total, artefacts, stock) of every shop: what lies on its spot is its stock, dearest
    first, then by name; spots without coordinates are one spot. Shops of one spot list the same goods; nth tells a place's shops apart,
    by spot, type and name. Empty shops have a row, too. A shop's stock, which is what one spot holds, meets in one row."""
    label = F.coalesce("name", F.concat_ws(" ", "base_type", "sub_type"))
    goods = entries.where("cost is not null").groupBy(*PLACE, "x", "y").agg(
        F.count("*").alias("goods"), F.sum("cost").alias("total"), F.count_if(F.coalesce("artefact", F.lit(False))).alias("artefacts"),
        F.array_sort(F.collect_list(F.struct((-F.col("cost")).alias("dear"), label.alias("label")))).alias("stock"),
    )
    nth = F.row_number().over(Window.partitionBy(PLACE).orderBy("x", "y", "shop_type", "name"))
    shop = entries.where("feat = 'enter_shop'").select(*PLACE, "x", "y", "shop_type", "name", nth.alias("nth"))
    on = [shop[c] == goods[c] for c in PLACE] + [shop[c].eqNullSafe(goods[c]) for c in ("x", "y")]
    held = shop.join(goods, on, "left")
    stock = F.transform(F.coalesce(goods["stock"], F.array().cast("array<struct<dear:double,label:string>>")), lambda s: s["label"])
    return held.select(*[shop[c] for c in (*PLACE, "x", "y", "shop_type", "name", "nth")], F.coalesce("goods", F.lit(0)).alias("goods"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("artefacts", F.lit(0)).alias("artefacts"), stock.alias("stock"))


def place_sections(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows with the section that lists them (notable, sundries, monsters, altars, ways_on, features or shops), and a row of altars for
    each bit of a place's mask. Every row is in one section; vaults are among the features, priced items among the shops. rank is the
    significance of an unpriced item."""
    item, feat = F.col("category") == "items", F.col("feat")
    rank = significance(*[F.col(c) for c in ("base_type", "sub_type", "cost")], F.coalesce("artefact", F.lit(False)), F.col("ego"), F.lit(False), F.col("spells"), F.coalesce("name", F.lit("")))
    goods = F.when(F.col("cost").isNotNull(), "shops").when(rank < 3, "notable").otherwise("sundries")
    found = F.when(feat == "enter_shop", "shops").when(feat.startswith("altar_"), "altars").when(feat.startswith("enter_"), "ways_on").otherwise("features")
    section = F.when(item, goods).when(F.col("category") == "monsters", "monsters").otherwise(found)
    masked = levels.where("altar_mask is not null").select(*PLACE, F.lit("features").alias("category"), F.explode(mask_feats(F.col("altar_mask"))).alias("feat"))
    marked = rows.withColumns({"section": section, "rank": F.when(item & F.col("cost").isNull(), rank)})
    return marked.unionByName(masked.withColumn("section", F.lit("altars")), allowMissingColumns=True)


def ordered_sections(sections: DataFrame) -> DataFrame:
    """Rows of place_sections() with their label and position in the section: items by significance, stock dearest first, then by name."""
    labelled = sections.withColumn("label", _label())
    return labelled.withColumn("position", F.row_number().over(Window.partitionBy(*PLACE, "section").orderBy("rank", F.desc_nulls_last("cost"), "label")))


def altars(levels: DataFrame, features: DataFrame) -> DataFrame:
    """Altars of masks and rows together, by place."""
    masked = levels.where("altar_mask is not null").select(*PLACE, F.explode(mask_feats(F.col("altar_mask"))).alias("feat"))
    return masked.unionByName(features.where("feat like 'altar_%'").select(*PLACE, "feat")).distinct()


def entrances(features: DataFrame, levels: DataFrame) -> DataFrame:
    """(container, branch, place, reach, position) of ways in, but for shops, with what features tell of their spot, timeout and toll;
    position is by reach, then branch, within a container."""
    told = [c for c in ("x", "y", "timeout_turns", "toll_note") if c in features.columns]
    ways = features.where("feat like 'enter_%' and feat <> 'enter_shop'").join(levels.select(*PLACE, "parent"), PLACE, "left")
    found = ways.select(*KEY, branch_of_feat(F.col("feat")).alias("branch"), "place", reach_with_parent(F.col("place"), F.col("parent")).alias("reach"), *told)
    return found.withColumn("position", F.row_number().over(Window.partitionBy(KEY).orderBy("reach", "branch", "place")))


# Groups of kinds of which a container draws one at most, with their class.
EXCLUSIONS = (
    ("wand A", "wand", ("charming", "paralysis")),
    ("wand B", "wand", ("iceblast", "roots", "warping")),
    ("wand C", "wand", ("acid", "light", "quicksilver")),
    ("scroll", "scroll", ("butterflies", "summoning")),
    ("evoker A", "miscellaneous", ("condenser vane", "tin of tremorstones")),
    ("evoker B", "miscellaneous", ("Gell's gravitambourine", "phial of floods")),
    ("evoker C", "miscellaneous", ("box of beasts", "sack of spiders")),
)


def exclusion_draws(entries: DataFrame, groups=EXCLUSIONS) -> DataFrame:
    """(container, group_name, drawn) for every container and group: members seen, in order; none: unseen; several: a conflict."""
    keys = entries.select(KEY).distinct()
    table = keys.sparkSession.createDataFrame([(name, base, m) for name, base, ms in groups for m in ms], "group_name string, base_type string, sub_type string")
    seen = entries.join(F.broadcast(table), ["base_type", "sub_type"]).groupBy(*KEY, "group_name").agg(F.array_sort(F.collect_set("sub_type")).alias("m"))
    every = keys.withColumn("group_name", F.explode(F.array(*[F.lit(g[0]) for g in groups])))
    state = F.when(F.col("m").isNull(), "unseen").when(F.size("m") == 1, F.concat(F.lit("drew "), F.col("m")[0])).otherwise(F.concat(F.lit("conflict "), F.array_join("m", ",")))
    return every.join(seen, [*KEY, "group_name"], "left").select(*KEY, "group_name", state.alias("drawn"))


def report_lines(entries: DataFrame) -> DataFrame:
    """Lines of a place's report, equal ones once with their number; artefacts first, then shop, then floor."""
    rank = F.when(F.coalesce("artefact", F.lit(False)), 0).when(F.col("cost").isNotNull(), 1).otherwise(2)
    label = F.coalesce("name", F.concat_ws(" ", "base_type", "sub_type"))
    counted = entries.groupBy(*PLACE, rank.alias("rank"), label.alias("label")).agg(F.count("*").alias("n"))
    return counted.select(*PLACE, "rank", F.when(F.col("n") > 1, F.concat("label", F.lit(" x"), F.col("n").cast("string"))).otherwise(F.col("label")).alias("line"))


def collapse_lines(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """lines(*by, line, pos) -> (*by, line, n, pos of the first, at): equal lines once, numbered in the order in which they first stood."""
    once = lines.groupBy(*by, "line").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return once.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("pos", "line")))


def report_document(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """(version, container_id, band, new_band, place, heading, place_at, line_at, line): a report of each container as an ordered document.

    Places are in order of reach, portals after the others by their parent's; those with nothing to tell are left out. new_band marks the
    first place of a band's run. Lines are items (artefacts, then stock, then what is carried, then the rest, each by name), features
    and monsters; equal lines of a place and section are one with its number, where the first stood. rows are flattened entries with
    category, feat, name, cost, artefact and carried_by; levels have parent. Equal lines are counted before a place's lines meet.
    """
    from ..functions.places import band_label

    art = F.coalesce("artefact", F.lit(False))
    item = F.col("category") == "items"
    named = F.coalesce("name", F.when(item, F.concat_ws(" ", "base_type", "sub_type")), F.lit("?"))
    price = F.when(F.col("cost").isNotNull(), F.concat(F.lit(" — shop, **"), F.format_string("%.2f", "cost"), F.lit("** gold"))).otherwise("")
    carried = F.when(F.col("carried_by").isNotNull(), F.concat(F.lit(" — carried by **"), "carried_by", F.lit("**"))).otherwise("")
    told = F.concat(F.lit("`"), named, F.lit("`"), price, carried, F.when(art, " _(artefact)_").otherwise(""))
    line = F.when(item, told).when(F.col("category") == "features", F.coalesce("name", "feat")).otherwise(F.concat(F.lit("**"), named, F.lit("**")))
    rank = F.when(~item, 0).when(art, 1).when(F.col("cost").isNotNull(), 2).when(F.col("carried_by").isNotNull(), 3).otherwise(4)
    section = F.when(item, 1).when(F.col("category") == "features", 2).otherwise(3)
    lines = rows.where("category in ('items', 'features', 'monsters')").groupBy(*PLACE, section.alias("section"), rank.alias("rank"), F.when(item, named).otherwise(line).alias("by"), line.alias("line")).agg(F.count("*").alias("n"))
    portal = is_portal(F.col("place"))
    heading = F.when(F.col("parent").isNotNull(), F.concat("place", F.lit(" _(from "), "parent", F.lit(")_"))).otherwise(F.col("place"))
    told_places = levels.join(lines.select(PLACE).distinct(), PLACE, "left_semi")
    run = Window.partitionBy(KEY).orderBy(portal, reach_with_parent(F.col("place"), F.col("parent")), "place")
    placed = told_places.select(*PLACE, heading.alias("heading"), band_label(F.col("place")).alias("band"), F.row_number().over(run).alias("place_at"), (~band_label(F.col("place")).eqNullSafe(F.lag(band_label(F.col("place"))).over(run))).alias("new_band"))
    numbered = lines.withColumn("line_at", F.row_number().over(Window.partitionBy(PLACE).orderBy("section", "rank", "by", "line")))
    many = F.when(F.col("n") > 1, F.concat(F.lit(" ×"), F.col("n").cast("string"))).otherwise("")
    return placed.join(numbered, PLACE).select(*KEY, "band", "new_band", "place", "heading", "place_at", "line_at", F.concat("line", many).alias("line"))


def roster_coverage(roster: DataFrame, entries: DataFrame) -> DataFrame:
    """roster(name) x versions: how many entries have each declared name; 0: never seen."""
    seen = entries.where("name is not null").groupBy("version", "name").agg(F.count("*").alias("seen"))
    # versions are few, and are what is sent around; the roster may grow with the data
    return roster.crossJoin(F.broadcast(entries.select("version").distinct())).join(seen, ["version", "name"], "left").na.fill(0, ["seen"]).select("version", *roster.columns, "seen")


def flagged_present(flags: DataFrame, fills: DataFrame, order: str | None = None) -> DataFrame:
    """Flags of containers that are there; order: a column that they come in the order of, as they were given."""
    kept = flags.join(fills.select(KEY), KEY, "left_semi")
    return kept if order is None else kept.orderBy(order)


def reach_order(levels: DataFrame) -> DataFrame:
    """Places with the keys that order a walk: a branch's run by number, portals right after the place they open from, unknown last."""
    from ..functions.places import UNKNOWN, branch_of_place, reach_of

    host = F.when(is_portal(F.col("place")), F.col("parent")).otherwise(F.col("place"))
    at = F.when(host.isNull(), UNKNOWN).otherwise(reach_of(host))
    return levels.select(*PLACE, at.alias("reach"), branch_of_place(F.coalesce(host, F.col("place"))).alias("branch"), is_portal(F.col("place")).cast("int").alias("portal"))


NAMED_BY = ("category", "feat", "shop_type", "base_type", "sub_type", "quantity", "plus", "ego", "artefact")


def elide_names(entries: DataFrame) -> DataFrame:
    """Entries whose name follows from their columns lose it; the others keep what they store."""
    return entries.withColumn("name", F.when(display_name(*map(F.col, NAMED_BY)).isNull(), F.col("name")))


def full_names(entries: DataFrame) -> DataFrame:
    """The inverse of elide_names()."""
    return entries.withColumn("name", F.coalesce(display_name(*map(F.col, NAMED_BY)), F.col("name")))


def with_spells(entries: DataFrame, fixed: DataFrame) -> DataFrame:
    """Entries with the spells of their name, of fixed(version, sub_type, spells) or of their own, in that order of preference."""
    sets = fixed.select("version", "sub_type", F.col("spells").alias("_fixed"))
    held = entries.join(sets, ["version", "sub_type"], "left")
    return held.withColumn("spells", entry_spells(F.col("sub_type"), F.col("_fixed"), F.col("spells"))).select(*entries.columns)


def _counted(n: Column, noun: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s")))


def standing_facts(entries: DataFrame, levels: DataFrame) -> DataFrame:
    """(place, facts): what a report says of a place in phrases; only what is true, so an ordinary place has an empty list.

    entries are flattened rows with category, feat, cost, artefact, name, x, y, entry_order and item_order; levels have altar_mask
    and gold. Goods are a shop's if they lie on its spot (spots without coordinates meet). A place's rows meet in one group.
    """
    item, feat = F.col("category") == "items", F.col("feat")
    art = item & F.coalesce("artefact", F.lit(False))
    altar = F.when(feat.startswith("altar_") & (feat != "altar_ecumenical"), F.struct(feat.isin(*ALTARS).alias("pooled"), title(F.substr(feat, F.lit(7))).alias("god")))
    monster = F.when(F.col("category") == "monsters", F.struct("entry_order", "item_order", "name"))
    spots = entries.groupBy(*PLACE, "x", "y").agg(
        F.count_if(art & F.col("cost").isNull()).alias("floor"),
        F.count_if(art & F.col("cost").isNotNull()).alias("goods"),
        F.count_if(feat == "enter_shop").alias("shops"),
        F.count_if(feat.startswith("enter_") & (feat != "enter_shop")).alias("ways"),
        F.collect_list(altar).alias("altars"),
        F.collect_list(monster).alias("monsters"),
    )
    held = spots.groupBy(PLACE).agg(
        *[F.sum(c).alias(c) for c in ("floor", "shops", "ways")],
        F.sum(F.col("goods") * F.col("shops")).alias("sold"),
        *[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("altars", "monsters")],
    )
    joined = levels.select(*PLACE, "altar_mask", "gold").join(held, PLACE, "left").na.fill(0, ["floor", "shops", "ways", "sold"])
    listed = lambda c, field: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda a: a[field]), ", "))
    where = F.when(F.col("sold") == 0, "").when(F.col("floor") == 0, ", all for sale").otherwise(F.concat(F.lit(", "), F.col("sold").cast("string"), F.lit(" of them for sale")))
    mask = F.bit_count("altar_mask")
    facts = F.array(
        F.concat(_counted(F.col("floor") + F.col("sold"), "artefact"), where),
        F.when(F.col("altar_mask").isNull(), listed(F.col("altars"), "god")),
        listed(F.col("monsters"), "name"),
        _counted(F.col("ways"), "way on"),
        _counted(F.col("shops"), "shop"),
        F.concat(mask.cast("string"), F.when(mask == 1, " altar").otherwise(" altars")),
        F.when(F.col("gold") != 0, F.concat(F.col("gold").cast("string"), F.lit(" floor gold"))),
    )
    return joined.select(*PLACE, F.filter(facts, lambda x: x.isNotNull()).alias("facts"))
