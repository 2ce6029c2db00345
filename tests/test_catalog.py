"""Hand-checked cases of the catalog engine, and every query against its SQL on the smallest tables."""

import hashlib
import hmac
import json
import os
from math import isclose, log10

import pytest
from pyspark.sql import functions as F

from cairn.functions import naming, places, text
from cairn.operators import answers, audit, heat, index, ingest, search, views
from cairn.operators.criteria import Brand, Item, NameLike, Props, Term
from cairn.sources.tables import read_catalog_jsonl, write_snapshot
from cairn.streaming import catalog as streaming

DATA = "/root/testdata/sf0.001"
ENTRY = "version string, container_id string, place string, base_type string, sub_type string, quantity int, cost double, name string, ego string, artefact boolean, props array<struct<prop:string,value:int>>, spells array<string>"


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def entry(spark, rows):
    full = [{"version": "v", "props": [], "spells": [], "artefact": False} | r for r in rows]
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in ENTRY.replace("array<struct<prop:string,value:int>>", "x").split(", ")) for r in full], ENTRY)


@pytest.fixture(scope="module")
def corpus(spark):
    haste = {"base_type": "potion", "sub_type": "haste"}
    return entry(
        spark,
        [
            {"container_id": "1", "place": "D:2", **haste},
            {"container_id": "2", "place": "D:5", "quantity": 3, **haste},
            {"container_id": "3", "place": "D:4", "quantity": 2, **haste},
            {"container_id": "3", "place": "D:1", "quantity": 1, "cost": 30.0, **haste},
            {"container_id": "4", "place": "Sewer", "quantity": 3, **haste},
            {"container_id": "5", "place": "D:1", "base_type": "staff", "artefact": True, "name": "the Wyrm staff", "props": [("Conj", 1), ("Alch", 2)]},
            {"container_id": "6", "place": "D:1", "base_type": "staff", "artefact": True, "name": "x", "props": [("Conj", 1)]},
            {"container_id": "6", "place": "D:1", "base_type": "staff", "artefact": True, "name": "y", "props": [("Alch", 1), ("rF", -2)]},
            {"container_id": "7", "place": "D:1", "base_type": "weapon", "sub_type": "dagger", "ego": "venom"},
            {"container_id": "7", "place": "D:1", "base_type": "weapon", "sub_type": "axe"},
        ],
    )


def test_counts_are_items_and_positions_never_add(corpus):
    three = lambda shop: values(search.search(corpus, [Term(Item("potion", "haste", shop), 3)]), "container_id")
    assert three(False) == [("2",), ("4",)] and three(True) == []
    assert values(search.search(corpus, [Term(Item("potion", "haste"))]), "container_id", "n1") == [("1", 1), ("2", 3), ("3", 2), ("4", 3)]


def test_same_item(corpus):
    find = lambda c: [r[0] for r in values(search.search(corpus, [Term(c)]), "container_id")]
    assert find(Props(("Conj", "Alch"), "staff")) == ["5"]
    assert find(Props(("rF",))) == [] and find(Props(())) == ["5", "6"]
    assert find(Brand("weapon", "Venom", "dagger")) == ["7"] and find(Brand("weapon", "venom", "axe")) == []
    assert find(Brand("weapon", "nonsense", codes=(("venom", "venom"),))) == []
    assert find(NameLike("wYRM s")) == ["5"]
    with pytest.raises(ValueError):
        NameLike("wy")


def test_evidence_pages_and_ceilings(corpus, spark):
    terms = [Term(Item("potion", "haste"))]
    found = search.search(corpus, terms)
    proof = search.evidence(corpus, found, terms)
    assert values(proof, "container_id", "total", "place") == [("1", 1, "D:2"), ("2", 3, "D:5"), ("3", 2, "D:4"), ("4", 3, "Sewer")]
    assert [r.container_id for r in search.ranked(found, proof).collect()] == ["1", "3", "2", "4"]  # unknown reach comes last
    assert [r.container_id for r in search.keyset_page(found, "1", 2).collect()] == ["2", "3", "4"]
    assert values(search.count_ceiling(corpus, terms[0]), "most") == [(3,)]
    with pytest.raises(ValueError):
        search.refuse_broad(found, 3)
    with pytest.raises(ValueError):
        search.search(corpus, terms * 11)
    assert search.search(corpus, []).count() == 7


def test_scan_and_index_agree(corpus):
    posts = index.build_postings(corpus)
    shapes = {("2", "3", "4"): [("floor/item", "potion", "haste", 2)], ("5", "6"): [("floor/prop", "", "Conj", 1), ("floor/typed", "staff", "Alch", 1)], ("7",): [("floor/brand", "weapon", "venom", 1)]}
    for want, shape in shapes.items():
        assert {r.container_id for r in index.search_indexed(posts, shape).collect()} == set(want)
    stale = corpus.where("container_id = '2'").select("version", "container_id")
    assert values(index.overlay(posts, stale, posts), *posts.columns) == values(posts, *posts.columns)
    known = index.assign_ordinals(corpus.where("container_id in ('3', '5')"))
    assert values(index.assign_ordinals(corpus, known), "ord", "container_id") == [(1, "3"), (2, "5"), (3, "1"), (4, "2"), (5, "4"), (6, "6"), (7, "7")]
    with pytest.raises(index.StaleIndexError):
        index.require_current(1, 2)


def test_places(spark):
    cases = {"D:3": 3, "Lair:2": 10, "Temple": 4, "Zot:5": 24, "Sewer": places.UNKNOWN, "Nowhere:1": places.UNKNOWN, "D:x": places.UNKNOWN, None: places.UNKNOWN}
    df = spark.createDataFrame([(p, "D:5") for p in cases], "p string, q string")
    assert {r[0]: r[1] for r in df.select("p", places.reach_of(F.col("p"))).collect()} == cases
    deep = df.where("p = 'Sewer'").select(places.reach_with_parent(F.col("p"), F.col("q")), places.within_cap(F.col("p"), F.col("q"), 4), places.within_cap(F.col("p"), F.lit(None).cast("string"), 4)).first()
    assert tuple(deep) == (5, False, True)
    assert [r[0] for r in df.where("p in ('Temple', 'Lair:2', 'Zot:5', 'Sewer')").select(places.band_label(F.col("p"))).collect()] == ["Lair:1-2", "Temple", "Other (Zot)", "Portals"]
    assert spark.range(1).select(places.mask_feats(F.lit(1 + 4)), places.branch_of_feat(F.lit("enter_ice_cave"))).first()[:] == (["altar_ashenzari", "altar_dithmenos"], "Ice_cave")


def test_text(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert get(text.feature_label(lit("altar_the_shining_one"))) == "an altar of The Shining One"
    assert get(text.short_name(lit("3 potions of haste"), lit("potion"), lit("haste"))) == "3 haste"
    assert get(text.keyed_hash(lit("héllo"), b"k" * 70)) == hmac.new(b"k" * 70, "héllo".encode(), hashlib.sha256).hexdigest()
    versions = ["trunk-1", "0.9.1", "0.10.1", "0.10", "0.34.1-rc"]
    df = spark.createDataFrame([(v,) for v in versions], "v string")
    assert [r.v for r in df.orderBy(text.release_key(F.col("v"))).collect()] == ["0.9.1", "0.10", "0.10.1", "0.34.1-rc", "trunk-1"]
    keys = {"0": False, "01": False, "18446744073709551615": True, "18446744073709551616": False, "5": True, "-1": False, "": False}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r[0]: r[1] for r in df.select("k", text.valid_key(F.col("k"))).collect()} == keys
    pairs = {("haste", "Hsate"): True, ("haste", "hast"): True, ("haste", "hasten"): True, ("haste", "hasre"): True, ("haste", "etsah"): False, ("ab", "cd"): False, ("", "a"): True, ("abcd", "badc"): False}
    df = spark.createDataFrame(list(pairs), "a string, b string")
    assert {(r[0], r[1]): r[2] for r in df.select("a", "b", text.within_one_edit(F.col("a"), F.col("b"))).collect()} == pairs


def test_heat_of_three_containers(spark):
    """Counts 1, 3 and 0 of one kind: tails 2/3 and 1/3; no early spells: tail 1."""
    rows = entry(spark, [{"container_id": "1", "place": "D:1", "base_type": "potion", "sub_type": "haste", "quantity": 1}, {"container_id": "2", "place": "D:1", "base_type": "potion", "sub_type": "haste", "quantity": 3}, {"container_id": "3", "place": "D:8", "base_type": "rock", "sub_type": "rock"}])
    levels = spark.createDataFrame([("v", c, p, None) for c in "123" for p in ("D:1", "D:8")], "version string, container_id string, place string, parent string")
    fills = ingest.fill_depth(levels).withColumn("origin", F.lit("fill"))
    spells = spark.createDataFrame([("s", 1)], "spell string, spell_level int")
    weights = spark.createDataFrame([("potion", "*", 30.0)], "base_type string, sub_type string, weight double")
    table = heat.surprise(rows, levels, fills, spells, 8)
    assert [(r.sub_type, r["count"], round(r.tail_p, 6)) for r in table.where("base_type <> 'rock'").orderBy("sub_type", "count").collect()] == [("#early-spells", 0, 1.0), ("haste", 1, round(2 / 3, 6)), ("haste", 3, round(1 / 3, 6))]
    got = heat.scores(rows, levels, fills, spells, weights, table, 8)
    want = {"1": 30 * -log10(2 / 3), "2": 30 * -log10(1 / 3), "3": 0.0}
    assert all(isclose(r.score, want[r.container_id], abs_tol=1e-9) for r in got.collect()) and got.count() == 3
    assert {r.container_id: r.band for r in heat.bands(got, fills, 8).collect()} == {"1": "warm", "2": "hot", "3": "cold"}
    late = heat.scores(rows, levels, fills, spells, weights, table, 8, fills.where("container_id = '2'").select("version", "container_id"))
    assert isclose(late.first().score, want["2"])


def record(**r):
    return ingest.PREFIX + json.dumps({"format": 4, "version": "v", "seed": "1", "level": "D:1", "cats": {}} | r)


def test_ingest(spark):
    potion = {"kind": "item", "name": "2 potions", "base_type": "potion", "sub_type": "haste", "quantity": 2}
    lines = [
        "noise",
        record(cats={"items": [potion], "monsters": [{"kind": "mon", "name": "orc", "items": [potion]}], "vaults": [{"name": "v1"}], "features": [{"text": "altar", "feat": "altar_zin"}, {"name": "d", "feat": "runed_clear_door"}]}),
        record(level="Temple", cats={"features": [{"name": "a", "feat": "altar_zin"}, {"name": "b", "feat": "altar_trog"}, {"name": "c", "feat": "fountain"}]}),
        record(format=3),
        record(level="Sewer"),
        record(level="Sewer", parent_level="D:2"),
        ingest.PREFIX + "{broken",
        record(seed=None),
        record(cats={"items": [{"base_type": "x"}]}),
    ]
    good, bad = ingest.ingest_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert values(bad, "reason") == [("a portal without parent",), ("an entry without name",), ("no container",), ("not a record",), ("unknown format",)]
    flat = ingest.flatten_entries(good)
    assert values(flat.where("carried_by is not null"), "name", "carried_by", "category") == [("2 potions", "orc", "items")]
    kept = ingest.prune_entries(flat)
    assert kept.where("category = 'vaults' or feat = 'runed_clear_door'").count() == 0
    levels = good.selectExpr("version", "seed as container_id", "level as place")
    masked, rest = ingest.encode_altar_mask(levels, kept)
    assert values(masked.where("place = 'Temple'"), "altar_mask") == [((1 << 21) + (1 << 15),)]
    assert rest.where("place = 'Temple'").count() == 1 and rest.where("feat = 'altar_zin'").count() == 1
    assert tuple(ingest.ingest_counts(good, bad).first()) == (3, 9, 5)


def test_keyed_tables(spark):
    known = ingest.extend_dictionary(spark.createDataFrame([(1, "b")], "id long, val string"), spark.createDataFrame([("c",), ("a",), ("b",), (None,)], "val string"))
    assert values(known, "id", "val") == [(1, "b"), (2, "a"), (3, "c")]
    target = spark.createDataFrame([("v", "1", "D:1", "old"), ("v", "1", "D:2", "old")], "version string, container_id string, place string, x string")
    batch = spark.createDataFrame([("v", "1", "D:1", "new")], target.schema)
    assert values(ingest.upsert_places(target, batch), "place", "x") == [("D:1", "new"), ("D:2", "old")]
    assert ingest.backfill(target, {"x": "string", "y": "int"}).columns[-1] == "y"
    sets = entry(spark, [{"container_id": "1", "base_type": "book", "sub_type": "b", "spells": ["x", "y"]}, {"container_id": "2", "base_type": "book", "sub_type": "b", "spells": ["y", "x"]}, {"container_id": "2", "base_type": "book", "sub_type": "c", "spells": ["y"]}, {"container_id": "3", "base_type": "book", "sub_type": "c", "spells": ["z"]}])
    good, conflicts = ingest.sync_fixed_sets(sets)
    assert values(good, "sub_type") == [("b",)] and conflicts.count() == 2
    with pytest.raises(Exception, match="spell sets differ"):
        ingest.sync_fixed_sets(sets, strict=True)[0].collect()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "version string, n int")
    write_snapshot(df, str(tmp_path / "t"))
    write_snapshot(df.where("n = 1").withColumn("n", F.lit(9)), str(tmp_path / "t"))
    assert values(spark.read.parquet(str(tmp_path / "t")), "version", "n") == [("a", 9), ("b", 2)]
    (tmp_path / "x.jsonl").write_text('noise\n {"a": 1}\n{"a": \n{"a": 2}\n')
    assert values(read_catalog_jsonl(spark, str(tmp_path / "x.jsonl"), "a int"), "a") == [(1,), (2,)]


def test_views(spark):
    rows = entry(spark, [{"container_id": "1", "place": "D:1", "base_type": "wand", "sub_type": "acid"}, {"container_id": "1", "place": "D:2", "base_type": "wand", "sub_type": "light"}, {"container_id": "2", "place": "D:2", "base_type": "wand", "sub_type": "light"}])
    draws = views.exclusion_draws(rows, [("C", "wand", ("acid", "light")), ("S", "scroll", ("fog",))])
    assert values(draws, "container_id", "group_name", "drawn") == [("1", "C", "conflict acid,light"), ("1", "S", "unseen"), ("2", "C", "drew light"), ("2", "S", "unseen")]
    shop = spark.createDataFrame([("v", "1", "D:1", "enter_shop", None, 1, 2, "weapon"), ("v", "1", "D:1", None, 5.0, 1, 2, None), ("v", "1", "D:1", None, 6.0, None, 2, None)], "version string, container_id string, place string, feat string, cost double, x int, y int, shop_type string")
    assert values(views.shop_stock(shop), "cost", "shop_type") == [(5.0, "weapon"), (6.0, None)]


def test_streams(spark, tmp_path):
    schema = "version string, container_id string, place string, x string, arrival long"
    source = str(tmp_path / "in")
    for batch in ([("v", "1", "D:1", "a", 1), ("v", "1", "D:1", "b", 2), ("v", "1", "D:2", "c", 1)], [("v", "1", "D:1", "late", 3)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        store = streaming.PlaceStore(spark, str(tmp_path / "store"))  # opened anew, as after a restart
        streaming.stream_ingest(spark.readStream.schema(schema).json(source), store, str(tmp_path / "ck")).awaitTermination()
    store = streaming.PlaceStore(spark, str(tmp_path / "store"))
    assert values(store.current, "place", "x") == [("D:1", "late"), ("D:2", "c")]
    words = str(tmp_path / "words")
    for batch in ([(1, "red ring")], [(1, "red ring"), (2, "blue rod")]):
        spark.createDataFrame(batch, "id long, val string").coalesce(1).write.mode("append").json(words)
        names = streaming.NameIndex(spark, str(tmp_path / "names"))
        streaming.stream_name_index(spark.readStream.schema("id long, val string").json(words), names, str(tmp_path / "ck2")).awaitTermination()
    names = streaming.NameIndex(spark, str(tmp_path / "names"))
    assert names.mark == 2 and values(index.names_like(names.grams, "RED"), "name") == [("red ring",)]
    flags = str(tmp_path / "flags")
    spark.createDataFrame([("v", "1", "s", "q1", "2024-01-01 00:00:00"), ("v", "1", "s", "q2", "2024-01-01 00:00:01"), ("v", "1", "t", "q3", "2024-01-01 00:00:02")], "version string, container_id string, session string, query string, at string").coalesce(1).write.json(flags)
    stream = spark.readStream.schema("version string, container_id string, session string, query string, at timestamp").json(flags)
    for name, mark in (("plain", None), ("marked", "1 hour")):
        streaming.stream_flags(stream, b"key", mark).writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() == 2
    counts = spark.readStream.schema("version string, container_id string, session string").json(flags).withColumn("origin", F.lit("fill"))
    streaming.stream_counts(counts).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counts").first().arrivals == 3


def test_a_batch_sent_again_changes_nothing(spark, tmp_path):
    schema = "version string, container_id string, place string, x string, arrival long, record long"
    send = lambda rows, n: streaming.PlaceStore(spark, str(tmp_path / "s"), record="record").upsert(spark.createDataFrame(rows, schema), n)
    assert streaming.PlaceStore(spark, str(tmp_path / "s")).current is None
    send([("v", str(i), "D:1", "old", 1, i) for i in range(20)], 0)
    late = [("v", "3", "D:1", "lost", 5, 1), ("v", "3", "D:1", "won", 5, 2), ("v", "3", "D:1", "early", 4, 9)]
    for _ in range(2):
        send(late, 1)
    got = {r.container_id: r.x for r in streaming.PlaceStore(spark, str(tmp_path / "s")).current.collect()}
    assert len(got) == 20 and got["3"] == "won" and set(got.values()) == {"old", "won"}


def test_the_way_of_an_answer(corpus, tmp_path):
    fills = corpus.select("version", "container_id").distinct().withColumns({"depth": F.lit(5).cast("long"), "origin": F.lit("fill")})
    answers.write_index(corpus, fills, str(tmp_path / "i"))
    stored = answers.read_index(corpus.sparkSession, str(tmp_path / "i"))
    ask = lambda *terms: (lambda found, how: (sorted(r.container_id for r in found.collect()), how))(*answers.answer(corpus, stored, list(terms)))
    assert ask(Term(Item("potion", "haste"), 2)) == (["2", "3", "4"], "postings")
    assert ask(Term(NameLike("wYRM s"))) == (["5"], "postings")
    assert ask(Term(Props(()))) == (["5", "6"], "scan")
    two = Term(Props(("Conj", "Alch")))
    assert ask(two) == (sorted(r.container_id for r in search.search(corpus, [two]).collect()), "verified")
    assert ask(Term(Brand("weapon", "Venom", "dagger"))) == (["7"], "verified") and ask(Term(Item("potion", "haste")), two)[1] == "verified"
    other = corpus.where("container_id = '2'").withColumn("version", F.lit("new")).unionByName(corpus)
    assert answers.answer(other, stored, [Term(Item("potion", "haste"))])[1].startswith("scan")
    assert answers.ceiling_indexed(corpus, stored, two) is None
    grown = fills.withColumn("depth", F.when(F.col("container_id") == "2", 9).otherwise(F.col("depth")))
    found, how = answers.answer_now(corpus.where("container_id <> '2'"), grown, stored, [Term(Item("potion", "haste"))])
    assert how == "postings" and sorted(r.container_id for r in found.collect()) == ["1", "3", "4"]
    assert answers.answer_now(corpus, grown, stored, [Term(Item("potion", "haste"))], most_changed=0)[1] == "scan"


def test_an_audit_asks_the_lists_however_long_they_are(corpus, tmp_path, monkeypatch):
    answers.write_index(corpus, corpus.selectExpr("version", "container_id", "1L as depth", "'fill' as origin").distinct(), str(tmp_path / "i"))
    stored = answers.read_index(corpus.sparkSession, str(tmp_path / "i"))
    monkeypatch.setattr(answers.fragment_postings, "__defaults__", (0,))
    monkeypatch.setattr(answers.answer, "__defaults__", (0, None))
    named = {"name": [Term(NameLike("Wyrm"))]}
    assert answers.answer(corpus, stored, named["name"])[1] == "scan"
    assert values(answers.audit_equivalence(corpus, stored, named), "query", "way", "found", "differing") == [("name", "postings", 1, 0)]


def test_places_that_do_not_deepen_a_container_are_searched_anew(corpus, spark, tmp_path):
    haste = {"container_id": "1", "base_type": "potion", "sub_type": "haste"}
    fills = corpus.selectExpr("version", "container_id", "9L as depth", "'fill' as origin").distinct()
    answers.write_index(corpus, fills, str(tmp_path / "i"))
    stored = answers.read_index(spark, str(tmp_path / "i"))
    now = corpus.unionByName(entry(spark, [{"place": "Sewer", "quantity": 4, **haste}, {"place": "D:1", **haste, "container_id": "7"}]))
    for levels in (None, now.select("version", "container_id", "place").distinct()):
        found, how = answers.answer_now(now, fills, stored, [Term(Item("potion", "haste"), 3)], levels=levels)
        assert how == "postings" and values(found, "container_id") == [("1",), ("2",), ("4",)]
    assert values(answers.outgrown(stored, fills, now), "container_id") == [("1",)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_names_and_words(spark):
    rows = [
        ("items", None, None, "potion", "haste", 3, None, None, None, "3 potions of haste"),
        ("items", None, None, "scroll", "", 1, None, None, None, None),
        ("items", None, None, "wand", "flame", None, None, None, None, "wand of flame (0)"),
        ("items", None, None, "weapon", "dagger", None, -2, "vamp", False, "-2 vampiric dagger"),
        ("items", None, None, "weapon", "dagger", None, None, "what", False, "+0 dagger"),
        ("items", None, None, "armour", "boots", None, 1, "reflect", None, "+1 pair of boots of reflection"),
        ("items", None, None, "armour", "scarf", None, 1, "Harm", None, "scarf of harm"),
        ("items", None, None, "jewellery", "ring of slaying", None, 4, None, None, "+4 ring of slaying"),
        ("items", None, None, "miscellaneous", "lightning rod", None, None, None, None, "lightning rod (4/4)"),
        ("items", None, None, "weapon", "dagger", None, 1, None, True, None),
        ("items", None, None, None, "dagger", None, 1, None, None, None),
        ("monsters", None, None, "weapon", "dagger", None, 1, None, None, None),
        ("features", "enter_shop", "Antique Weapon", None, None, None, None, None, None, "an Antique Weapon Shop"),
        ("features", "enter_shop", None, None, None, None, None, None, None, "a shop"),
        ("features", "altar_wu_jian", None, None, None, None, None, None, None, "an ornate altar of the Wu Jian Council"),
        ("features", "unknown", None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "category string, feat string, shop_type string, base_type string, sub_type string, quantity int, plus int, ego string, artefact boolean, expected string")
    assert [r for r in df.withColumn("name", naming.display_name(*map(F.col, views.NAMED_BY))).collect() if r.name != r.expected] == []
    stored = df.withColumn("name", F.coalesce("expected", F.lit("own")))
    kept = views.elide_names(stored)
    assert kept.where("name is not null").count() == df.where("expected is null").count()
    assert values(views.full_names(kept), "name") == values(stored, "name")
    for kind, brands in naming.BRANDS.items():
        words = spark.createDataFrame(list(brands.items()), "code string, word string")
        back = words.where(naming.brand_code(F.lit(kind), F.upper("word"), F.lit("0.34.1")) == F.col("code")).where(naming.brand_word(F.lit(kind), F.col("code")) == F.col("word"))
        assert back.count() == len(brands)
    egos = spark.createDataFrame([("0.33.1", "armour", "harm", None), ("0.34.1", "armour", "Harm", None), ("0.34.1", "armour", "harm", None), ("0.34.1", "weapon", "Harm", None)], "version string, base_type string, ego string, cost double")
    assert egos.where(Term(Brand("armour", "HARM", by_release=True)).column()).count() == 2
    assert egos.where(Term(Brand("armour", "unknown", by_release=True)).column()).count() == 0


def test_standing_facts(spark):
    schema = "place string, category string, feat string, artefact boolean, cost double, name string, x int, y int, entry_order int, item_order int"
    rows = [
        ("D:1", "items", None, True, None, "a", 1, 1, 0, 0),
        ("D:1", "items", None, True, 9.0, "b", 2, 2, 1, 0),
        ("D:1", "items", None, True, 9.0, "c", 5, 5, 2, 0),  # on no shop's spot
        ("D:1", "features", "enter_shop", None, None, None, 2, 2, 0, 0),
        ("D:1", "features", "enter_lair", None, None, None, 3, 3, 1, 0),
        ("D:1", "features", "enter_orc", None, None, None, 3, 4, 1, 0),
        ("D:1", "features", "altar_zin", None, None, None, 4, 4, 2, 0),
        ("D:1", "features", "altar_jiyva", None, None, None, 4, 5, 3, 0),
        ("D:1", "features", "altar_ecumenical", None, None, None, 4, 6, 4, 0),
        ("D:1", "monsters", None, None, None, "Sigmund", 6, 6, 1, 0),
        ("D:1", "monsters", None, None, None, "Edmund", 6, 7, 0, 0),
        ("D:2", "items", None, True, 9.0, "d", None, None, 0, 0),
        ("D:2", "features", "enter_shop", None, None, None, None, None, 0, 0),
        ("Temple", "features", "altar_lugonu", None, None, None, 1, 1, 0, 0),
    ]
    entries = spark.createDataFrame(rows, schema).withColumns({"version": F.lit("v"), "container_id": F.lit("1")})
    levels = spark.createDataFrame([("v", "1", "D:1", None, 7), ("v", "1", "D:2", None, 0), ("v", "1", "Temple", 5, None), ("v", "1", "D:3", None, None)], "version string, container_id string, place string, altar_mask int, gold int")
    got = {r.place: r.facts for r in views.standing_facts(entries, levels).collect()}
    assert got == {
        "D:1": ["2 artefacts, 1 of them for sale", "Jiyva, Zin", "Edmund, Sigmund", "2 way ons", "1 shop", "7 floor gold"],
        "D:2": ["1 artefact, all for sale", "1 shop"],
        "Temple": ["2 altars"],
        "D:3": [],
    }


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    import cairn.plans.answers
    import cairn.plans.intake  # noqa: F401
    from cairn.plans import catalog

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")

    def plain(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v

    def table(columns, rows):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(columns), sorted((str([plain(r[i]) for i in order]) for r in rows))

    for name, oracle in catalog.ORACLES.items():
        df = catalog.QUERIES[name](spark, DATA)
        got = con.sql(oracle)
        assert table(df.columns, [tuple(r) for r in df.collect()]) == table(got.columns, got.fetchall()), name


def test_every_row_of_a_place_is_in_one_section(spark):
    row = "version string, container_id string, place string, category string, base_type string, sub_type string, ego string, cost double, artefact boolean, name string, feat string, spells array<string>"
    rows = spark.createDataFrame(
        [
            ("v", "1", "D:1", "items", "weapon", "axe", None, None, True, "the Axe", None, []),
            ("v", "1", "D:1", "items", "weapon", "axe", None, None, None, None, None, None),
            ("v", "1", "D:1", "items", "book", "x", None, None, False, "parchment of Fog", None, ["Fog"]),
            ("v", "1", "D:1", "items", "potion", "y", None, 9.0, False, None, None, []),
            ("v", "1", "D:1", "items", "potion", "z", None, 12.0, False, None, None, []),
            ("v", "1", "D:1", "monsters", None, None, None, None, None, "orc", None, None),
            ("v", "1", "D:1", "vaults", None, None, None, None, None, "a vault", None, None),
            ("v", "1", "D:1", "features", None, None, None, None, None, None, "enter_shop", None),
            ("v", "1", "D:1", "features", None, None, None, None, None, None, "enter_temple", None),
        ],
        row,
    )
    levels = spark.createDataFrame([("v", "1", "D:1", 3), ("v", "1", "D:2", None)], "version string, container_id string, place string, altar_mask int")
    found = values(views.ordered_sections(views.place_sections(rows, levels)), "section", "position", "label")
    assert found == [
        ("altars", 1, places.ALTARS[0]), ("altars", 2, places.ALTARS[1]), ("features", 1, "a vault"), ("monsters", 1, "orc"), ("notable", 1, "the Axe"),
        ("shops", 1, "potion z"), ("shops", 2, "potion y"), ("shops", 3, "enter_shop"), ("sundries", 1, "parchment of Fog"), ("sundries", 2, "weapon axe"), ("ways_on", 1, "enter_temple"),
    ]


def test_lift_by_richness_takes_out_what_rich_containers_share(spark):
    """Half of the containers hold a, b and four more, half c alone: a and b are together twice as often as by chance, but not among equals."""
    rich = [{"container_id": str(i), "place": "D:1", "base_type": "potion", "sub_type": s} for i in range(4) for s in "abwxyz"]
    poor = [{"container_id": str(i), "place": "D:1", "base_type": "potion", "sub_type": "c"} for i in range(4, 8)]
    e = entry(spark, rich + poor)
    assert ("potion:a", "potion:b", 2.0) in values(audit.pair_lift(e), "a", "b", "lift")
    assert ("potion:a", "potion:b", 4, 4.0, 1.0) in values(audit.lift_by_richness(e), "a", "b", "both", "expected", "lift")


def test_rate_drift_and_states(spark):
    log = spark.createDataFrame([(0, 10, 60.0), (5, 1, 1.0), (9, 5, 60.0)], "at long, seeds int, secs double")
    assert values(audit.rate_drift(log, 5), "first", "last", "percent") == [(10.0, 5.0, -50.0)]
    draws = spark.createDataFrame([("v", "1", "A", "drew x"), ("v", "1", "B", "unseen"), ("v", "2", "A", "conflict x,y"), ("v", "2", "B", "unseen"), ("v", "3", "A", "drew x"), ("v", "3", "B", "unseen")], "version string, container_id string, group_name string, drawn string")
    assert values(audit.exclusion_states(draws), "containers", "conflicts", "states") == [(3, 1, 2)]


def test_moments_are_rounded_to_seconds_before_they_are_sliced(spark, tmp_path):
    moments = [0.0, 9.4, 9.6, 10.5, 11.5, 99.0]
    rows = spark.createDataFrame([(float(m),) for m in moments], "at double").selectExpr("timestamp_micros(cast(at * 1000000 as bigint)) as ts", "60D as value")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    import __spark_entry__ as driver

    assert values(driver.queries()["D8_rate_curve"](spark, str(tmp_path)), "bucket", "runs") == [(0, 2), (1, 3), (9, 1)]


def test_stored_tables_are_made_once_and_again_when_gone_or_forgotten(spark, tmp_path):
    import shutil

    from cairn.sources import tables

    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("0.10", 1), ("b", 2)], "version string, n int")

    folder = tmp_path / "in"
    folder.mkdir()
    ask = lambda: values(tables.stored(spark, str(folder), "t", make, by=("version",)), "version", "n")
    assert ask() == ask() == [("0.10", 1), ("b", 2)] and len(made) == 1
    (path, _), = [v for k, v in tables._STORED.items() if k[1] == str(folder) and k[3] == "t"]
    shutil.rmtree(path)
    assert ask() == [("0.10", 1), ("b", 2)] and len(made) == 2
    tables.forget(str(folder))
    assert ask() == [("0.10", 1), ("b", 2)] and len(made) == 3
    (folder / "orders.parquet").write_text("new rows")
    assert ask() == [("0.10", 1), ("b", 2)] and len(made) == 4
