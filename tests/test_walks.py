"""Hand-checked cases of the walk, shops by spot, reports, readings and growth."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import places, text
from cairn.functions.tables import fixed_table
from cairn.operators import audit, heat, ingest, search, views, walk


def order(spark, levels, features=()):
    lv = spark.createDataFrame([("v", "1", p, q) for p, q in levels], "version string, container_id string, place string, parent string")
    ft = spark.createDataFrame([("v", "1", p, f) for p, f in features], "version string, container_id string, place string, feat string")
    return [r.place for r in walk.walk(lv, ft).orderBy("position").collect()]


def flat(*places):
    return [(p, None) for p in places]


def test_branches_by_reach_and_numbers_not_text(spark):
    assert order(spark, flat("D:10", "D:2", "D:1", "Temple")) == ["D:1", "D:2", "D:10", "Temple"]


def test_a_branch_comes_after_the_place_it_opens_from(spark):
    got = order(spark, flat("D:1", "D:2", "D:3", "Lair:1", "Lair:2"), [("D:2", "enter_lair")])
    assert got == ["D:1", "D:2", "Lair:1", "Lair:2", "D:3"]


def test_farther_branches_come_after_their_parent_is_done(spark):
    levels = flat("D:1", "Lair:1", "Lair:2", "Lair:3", "Swamp:1", "Swamp:2", "Snake:1")
    got = order(spark, levels, [("D:1", "enter_lair"), ("Lair:2", "enter_swamp"), ("Lair:1", "enter_snake")])
    assert got == ["D:1", "Lair:1", "Lair:2", "Lair:3", "Snake:1", "Swamp:1", "Swamp:2"]


def test_portals_inline_and_nested(spark):
    levels = [*flat("D:1", "D:2"), ("Sewer", "D:1"), ("Ossuary", "Sewer"), ("Bailey", "D:1")]
    assert order(spark, levels) == ["D:1", "Bailey", "Sewer", "Ossuary", "D:2"]


def test_orphans_circles_and_branches_of_portals_come_last(spark):
    levels = [*flat("D:1", "IceCv"), ("Volcano", "Gauntlet"), ("Gauntlet", "Volcano"), ("Sewer", "D:9"), ("Snake:1", "Shoals:1"), ("Shoals:1", "Snake:1"), ("Orc:1", "Trove"), ("Trove", "D:1")]
    got = order(spark, levels)
    assert got[:2] == ["D:1", "Trove"] and got[2:] == sorted(got[2:]) and len(got) == len(levels)


def test_a_branch_with_its_own_entrance_is_first_level(spark):
    assert order(spark, flat("D:1", "Orc:1", "Orc:2"), [("Orc:1", "enter_orc")]) == ["D:1", "Orc:1", "Orc:2"]


def test_no_places(spark):
    assert order(spark, []) == []


def rows(spark, *given):
    names = "version string, container_id string, place string, category string, feat string, shop_type string, x int, y int, base_type string, sub_type string, name string, cost double, artefact boolean, carried_by string, quantity int"
    cols = [c.split()[0] for c in names.split(", ")]
    return spark.createDataFrame([tuple(({"version": "v", "container_id": "1", "place": "D:1"} | g).get(c) for c in cols) for g in given], names)


def test_two_shops_of_a_place_are_two_rows(spark):
    shop = {"category": "features", "feat": "enter_shop"}
    thing = {"category": "items", "base_type": "potion"}
    got = views.shops_by_spot(rows(spark, shop | {"x": 1, "y": 1, "shop_type": "Book"}, shop | {"x": 2, "y": 1}, shop, thing | {"sub_type": "a", "cost": 5.0, "x": 1, "y": 1}, thing | {"sub_type": "b", "cost": 9.0, "x": 1, "y": 1}, thing | {"sub_type": "c", "cost": 2.0}, thing | {"sub_type": "d"}))
    assert sorted((r.x or 0, r.goods, r.total, r.stock) for r in got.collect()) == [(0, 1, 2.0, ["potion c"]), (1, 2, 14.0, ["potion b", "potion a"]), (2, 0, 0.0, [])]


def test_report_collapses_equal_lines_and_orders_ranks(spark):
    levels = spark.createDataFrame([("v", "1", p, q) for p, q in (("D:1", None), ("D:2", None), ("D:4", None), ("Sewer", "D:1"))], "version string, container_id string, place string, parent string")
    item = {"category": "items", "base_type": "potion", "sub_type": "x"}
    got = views.report_document(rows(spark, item, item | {"cost": 3.0}, item, item | {"name": "Axe", "artefact": True}, item | {"carried_by": "orc"}, {"category": "monsters", "name": "orc"}, {"category": "features", "feat": "altar_xom", "place": "D:4"}, item | {"place": "Sewer"}), levels).orderBy("place_at", "line_at").collect()
    assert [(r.place, r.line) for r in got] == [("D:1", "`Axe` _(artefact)_"), ("D:1", "`potion x` — shop, **3.00** gold"), ("D:1", "`potion x` — carried by **orc**"), ("D:1", "`potion x` ×2"), ("D:1", "**orc**"), ("D:4", "altar_xom"), ("Sewer", "`potion x`")]
    assert [r.new_band for r in got if r.line_at == 1] == [True, True, True] and got[-1].heading == "Sewer _(from D:1)_"


def test_readings(spark):
    items = spark.createDataFrame([("jewellery", "ring of flight"), ("potion", "flight"), ("armour", "broad hat"), ("potion", "haste")], "base_type string, sub_type string")
    index = search.readings(items, spark.createDataFrame([("rF",), ("haste",)], "prop string"))
    log = spark.createDataFrame([(w,) for w in ("FLIGHT", "potion:flight", "broad", "hat", "hatse", "rf", "haste", "armor", "xyz", "ring of", "ha", None)], "word string")
    got = {r.word: (r.verdict, r.tokens) for r in search.resolve_readings(log, index).collect()}
    assert got == {
        "flight": ("pick", ["jewellery:ring of flight", "potion:flight"]), "potion:flight": ("resolved", ["potion:flight"]), "broad": ("suggest", ["armour:broad hat"]), "hat": ("suggest", ["armour:broad hat"]),
        "hatse": ("suggest", ["potion:haste"]), "rf": ("resolved", ["props:rF"]), "haste": ("pick", ["potion:haste", "props:haste"]), "armor": ("suggest", ["armour:broad hat"]), "xyz": ("none", []), "ring of": ("suggest", ["jewellery:ring of flight"]), "ha": ("none", []),
    }


def test_growth_with_keys_beyond_63_bits(spark):
    sets = spark.createDataFrame([("v", k, h) for k, h in (("2", "a"), ("10", "b"), ("18446744073709551615", "c"), ("18446744073709551614", "a"))], "version string, container_id string, held string")
    curve = audit.set_growth(sets)
    assert sorted((r.containers, r.sets) for r in curve.collect()) == [(1, 1), (2, 2), (4, 3)]
    law = audit.growth_law(curve).first()
    assert law.sets == 3 and law.exponent == pytest.approx(0.798, abs=0.01)
    e = spark.createDataFrame([("v", "18446744073709551615", "potion", "x")], "version string, container_id string, base_type string, sub_type string")
    assert str(audit.growth_curve(e).first().container) == "18446744073709551615"


def test_all_caps_are_the_single_ones(spark):
    """Counts, tails and scores of three caps from one scan are those of three scans, one for each."""
    names = "version string, container_id string, place string, base_type string, sub_type string, quantity int, cost double, spells array<string>"
    given = [("v", str(c), p, b, s, q, None, sp) for c in range(12) for p, b, s, q, sp in (("D:2", "potion", "x", c % 4 + 1, []), ("D:8", "potion", "x", 2, []), (f"D:{c % 12 + 1}", "scroll", "y", None, []), ("Sewer", "book", "z", 1, ["S1", "S2"]), ("D:6", "book", "z", 1, ["S2", "S9"]), ("Odd", "potion", "w", c % 3 + 1, []))]
    e = spark.createDataFrame(given, names)
    lv = e.select("version", "container_id", "place").distinct().withColumn("parent", F.when(F.col("place") == "Sewer", F.concat(F.lit("D:"), (F.col("container_id").cast("int") % 10 + 1).cast("string"))))
    fills = spark.createDataFrame([("v", str(c), c + 1, "submit" if c % 5 == 0 else "fill") for c in range(12)], "version string, container_id string, depth long, origin string")
    levels = spark.createDataFrame([("S1", 1), ("S2", 4), ("S9", 9)], "spell string, spell_level int")
    weights = spark.createDataFrame([("potion", "*", 30.0), ("scroll", "y", 20.0)], "base_type string, sub_type string, weight double")
    caps = [3, 7, 9]
    seen = heat.observed_for_caps(heat.placed_for_caps(e, lv), fills, levels, caps)
    table = heat.surprise_for_caps(seen, fills, caps)
    scored = heat.scores_for_caps(seen, table, heat.cohorts(fills, caps), weights)
    told = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for cap in caps:
        one = heat.surprise(e, lv, fills, levels, cap)
        assert told(table.where(F.col("cap") == cap).select(one.columns)) == told(one)
        assert told(scored.where(F.col("cap") == cap).drop("cap")) == told(heat.scores(e, lv, fills, levels, weights, one, cap))
    late = fills.where("container_id = '10'")
    again = heat.scores_for_caps(heat.observed_for_caps(heat.placed_for_caps(e, lv), late, levels, caps), table, heat.cohorts(fills, caps), weights)
    assert told(again) == told(scored.where("container_id = '10'")) and again.count() == 3
    kept = heat.drop_stale_caps({"scores": spark.createDataFrame([("v", 3, 1.0), ("v", 99, 1.0)], "version string, cap long, score double")}, fills)
    assert [r.cap for r in kept["scores"].collect()] == [3]


def test_fixed_tables_and_the_callers_own(spark, tmp_path):
    own = fixed_table(spark, "weights")
    assert own.count() == 186 and own.where("sub_type = '*'").count() > 5 and fixed_table(spark, "spell_levels").count() == 132
    (tmp_path / "w.csv").write_text("base_type,sub_type,weight\n# a remark\npotion,*,3\n")
    assert [tuple(r) for r in fixed_table(spark, "weights", str(tmp_path / "w.csv")).collect()] == [("potion", "*", 3.0)]


def test_lines_are_taken_in_one_way(spark):
    """Ill-typed fields are turned away, the last line of a place counts, vaults go, pooled altars are a mask, plain names are left out."""
    import json

    def line(at, level="D:1", **more):
        return (at, ingest.PREFIX + json.dumps({"format": 4, "version": "v", "seed": "1", "level": level} | more))

    item = {"kind": "item", "name": "potion of haste", "base_type": "potion", "sub_type": "haste", "quantity": 1}
    lines = [line(1, cats={"items": [item, item]}), line(2, cats={"items": [item], "vaults": [{"name": "v"}]}), line(3, "Temple", gold=7, cats={"features": [{"feat": "altar_xom", "text": "an altar"}, {"feat": "altar_lugonu", "text": "an altar"}]}), line(4, "D:2", gold="much"), line(5, 7), line(6, "D:3", cats=[1]), (7, "noise"), (8, ingest.PREFIX + "{broken")]
    taken = ingest.intake(spark.createDataFrame(lines, "arrival long, value string"))
    assert sorted((r.place, r.gold, r.altar_mask) for r in taken.levels.collect()) == [("D:1", None, None), ("Temple", 7, 1 << 19)]
    assert sorted((r.place, r.category, r.name, r.feat) for r in taken.entries.collect()) == [("D:1", "items", None, None), ("Temple", "features", None, "altar_lugonu")]
    assert sorted(r.reason for r in taken.rejects.collect()) == ["ill-typed cats", "ill-typed gold", "ill-typed level", "not a record"]
    taken.close()


def test_a_filter_does_not_parse_lines_again(spark):
    body = '{"format":4,"version":"v","seed":"1","level":"D:1","gold":%s,"cats":%s}'
    rows = [("5", "{}"), ("5", '[{"items":[]}]'), ('"5"', "{}"), ("null", "null"), ("5.5", "{}")]
    checked = ingest.checked_lines(spark.createDataFrame([(ingest.PREFIX + body % r,) for r in rows], "value string").repartition(2))
    for kept in ("reason is null", "reason is not null"):
        plan = checked.where(kept)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.count("parse_json") + plan.count("parseJson") <= 1
    assert sorted(str(r.reason) for r in checked.collect()) == ["None", "None", "ill-typed cats", "ill-typed gold", "ill-typed gold"]
    assert tuple(ingest.counts_of_lines(checked).first()) == (2, 0, 3)


def test_odd_text_is_no_error(spark):
    df = spark.createDataFrame([("Zot:9223372036854775807", "0.99999999999"), ("Zot:99999999999999999999", "0.10"), ("Zot:x", "0.9")], "p string, v string")
    assert [r[0] for r in df.select(places.reach_of(F.col("p"))).collect()] == [places.UNKNOWN] * 3
    assert [r.v for r in df.orderBy(text.release_key(F.col("v"))).collect()] == ["0.9", "0.10", "0.99999999999"]


def test_ill_typed_fields_are_told_by_their_first(spark):
    """Top fields of every type; entries that are null, missing or no object; keys that come twice count by their last value."""
    good = {"version": '"v"', "seed": '"1"', "level": '"D:1"', "parent_level": "null", "gold": "5", "cats": "{}"}
    odd = [{"version": "5"}, {"seed": '{"a":1}'}, {"level": "[1]"}, {"parent_level": "true"}, {"gold": "5.5"}, {"gold": "true"}, {"gold": "3000000000"}, {"cats": "7"}, {"cats": '"{}"'}, {"cats": "null"}, {"cats": '{"items":7}'}, {"gold": '"x"', "version": "1.5"}, {"gold": '5,"gold":"x"'}]
    line = lambda n, more: (n, ingest.PREFIX + '{"format":4,' + ",".join(f'"{k}":{v}' for k, v in (good | more).items()) + "}")
    lines = [line(n, more) for n, more in enumerate(odd)] + [(13, ingest.PREFIX + '{"format":4,"version":"v","seed":"1","level":"D:1"}'), (14, ingest.PREFIX + '{"format":4,"version":"v"')]
    checked = ingest.checked_lines(spark.createDataFrame(lines, "n int, value string"))
    got = [(r.reason, r.version, r.gold) for r in checked.orderBy("n").collect()]
    ill = [f"ill-typed {x}" for x in ("version", "seed", "level", "parent_level", "gold", "gold", None, "cats", "cats", None, None, "version", "gold")]
    assert [g[0] for g in got] == [None if x.endswith("None") else x for x in ill] + [None, "not a record"]
    assert got[0][1] == "5" and got[6] == (None, "v", None) and got[13][1:] == ("v", None)
