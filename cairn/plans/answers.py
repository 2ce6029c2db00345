"""Queries that a stored index answers, with the same result as SQL over the entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import places, text
from ..operators import answers, heat, index, ingest, search, views
from ..operators.criteria import Brand, Item, NameLike, Props, Term
from ..sources import adapters as A
from ..sources.tables import fresh_path, written
from .catalog import _BANDS, _FOUND, _PROOF, CAP, FLAGSHIP, KEY, POTION, QSUM, _scores, has, query, reach_sql


def indexed(spark, d, shallow: int | None = None):
    """(entries, fills, index): an index stored and read again; shallow: of places up to that reach only."""
    e, f = A.entries(spark, d), A.fills(spark, d)
    seen = e if shallow is None else e.where(places.reach_of(F.col("place")) <= shallow)
    folder = fresh_path(spark, "index")
    answers.write_index(seen, f if shallow is None else A.fills_of(A.levels_of(seen)), folder)
    return e, f, answers.read_index(spark, folder)


_TWO_PROPS = "artefact AND cost IS NULL AND ((prop1 = 'P1' AND value1 >= 1) OR (prop2 = 'P1' AND value2 >= 1)) AND ((prop1 = 'P4' AND value1 >= 1) OR (prop2 = 'P4' AND value2 >= 1))"
_ITEM = "base_type = 'potion' AND sub_type = 'bolt' AND cost IS NULL"
_NAMED = "contains(lower(name), 'ng brand#1') AND cost IS NULL"


def _both(one: str, other: str) -> str:
    return f"SELECT version, container_id FROM ({has(one)}) SEMI JOIN ({has(other)}) USING (version, container_id)"


@query(_both(_TWO_PROPS, _ITEM))
def Q8_verified_candidates(spark, d):
    """Lists of two properties leave candidates; only the entries tell whether one item has both."""
    e, f, stored = indexed(spark, d)
    return answers.answer(e, stored, [Term(Props(("P1", "P4"))), Term(POTION)], fills=f)[0]


@query(_both(_NAMED, _ITEM))
def I10_name_fragment(spark, d):
    e, _, stored = indexed(spark, d)
    return answers.answer(e, stored, [Term(NameLike("Ng brand#1")), Term(POTION)])[0]


@query(f"SELECT version, container_id, 'declined' AS way FROM ({has(_NAMED)})")
def I7_declined_to_scan(spark, d):
    """A fragment with more containers than are looked through: the entries are scanned."""
    e, _, stored = indexed(spark, d)
    term = Term(NameLike("ng brand#1"))
    held = answers.fragment_postings(stored, term, most=3)
    found, how = answers.answer(e, stored, [term], most_named=3)
    return found.withColumn("way", F.lit("declined" if held is None and how == "scan" else how))


@query(f"SELECT version, container_id, max(depth) AS built_depth, max(origin) = 'submit' AS submitted, row_number() OVER (ORDER BY version, length(container_id), container_id) AS ord FROM fills GROUP BY version, container_id")
def I2_mark_built(spark, d):
    return indexed(spark, d)[2].ordinals.drop("built_places")


@query(f"SELECT version, max(n) AS most FROM (SELECT version, container_id, {QSUM} AS n FROM entries WHERE {_ITEM} GROUP BY ALL) GROUP BY version")
def I11_ceiling_indexed(spark, d):
    """From lists of shallow places, and the entries of the containers that have grown since."""
    e, f, stored = indexed(spark, d, shallow=3)
    stale = answers.outgrown(stored, f, A.levels(spark, d))
    return answers.ceiling_indexed(e, stored, Term(POTION), stale)


@query(f"SELECT version, max(n) AS most FROM (SELECT version, container_id, {QSUM} AS n FROM entries WHERE {_ITEM} GROUP BY ALL) GROUP BY version")
def A11_max_ceiling(spark, d):
    """The greatest of the ceilings of two halves of the containers."""
    e, odd = A.entries(spark, d), F.col("container_id").cast("long") % 2 == 1
    return search.max_ceiling([search.count_ceiling(e.where(odd), Term(POTION)), search.count_ceiling(e.where(~odd), Term(POTION))])


@query(f"SELECT v.version, 25 AS asked, c.most, coalesce(c.most >= 25, false) AS possible FROM (SELECT DISTINCT version FROM entries) v LEFT JOIN (SELECT version, max(n) AS most FROM (SELECT version, container_id, {QSUM} AS n FROM entries WHERE {_ITEM} GROUP BY ALL) GROUP BY version) c USING (version)")
def Q4_count_explained(spark, d):
    e = A.entries(spark, d)
    return search.explain_count(search.count_ceiling(e, Term(POTION)), 25, e)


@query(f"SELECT version, container_id FROM ({_FOUND})")
def U4_overlay_answers(spark, d):
    """Lists of shallow places, with the containers that have grown since taken out and searched anew: the same as a scan."""
    e, f, stored = indexed(spark, d, shallow=3)
    return answers.answer_now(e, f, stored, FLAGSHIP, most_changed=10_000_000, levels=A.levels(spark, d))[0]


_AUDITED = {
    "bare property": ([Term(Props(("P1",)))], "((prop1 = 'P1' AND value1 >= 1) OR (prop2 = 'P1' AND value2 >= 1)) AND cost IS NULL", "postings"),
    "brand": ([Term(Brand("weapon", "RED"))], "base_type = 'weapon' AND ego = 'red' AND cost IS NULL", "postings"),
    "brand of a kind": ([Term(Brand("weapon", "red", sub="gear"))], "base_type = 'weapon' AND sub_type = 'gear' AND ego = 'red' AND cost IS NULL", "verified"),
    "in a shop": ([Term(Item("scroll", "gear", shop=True))], "base_type = 'scroll' AND sub_type = 'gear' AND cost IS NOT NULL", "postings"),
    "item": ([Term(POTION)], _ITEM, "postings"),
    "name": ([Term(NameLike("ng brand#1"))], _NAMED, "postings"),
    "artefact": ([Term(Props(()))], "artefact AND cost IS NULL", "scan"),
    "two properties": ([Term(Props(("P1", "P4")))], _TWO_PROPS, "verified"),
    "typed property": ([Term(Props(("P2",), base="armour"))], "base_type = 'armour' AND ((prop1 = 'P2' AND value1 >= 1) OR (prop2 = 'P2' AND value2 >= 1)) AND cost IS NULL", "postings"),
    "nothing": ([Term(Item("potion", "no such kind"))], "false", "postings"),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS query, '{way}' AS way, count(*) AS found, CAST(0 AS BIGINT) AS differing FROM ({has(test)})" for name, (_, test, way) in _AUDITED.items()))
def I12_equivalence_audit(spark, d):
    """Ten searches by the index and by a scan: no container may differ."""
    e, _, stored = indexed(spark, d)
    return answers.audit_equivalence(e, stored, {name: terms for name, (terms, _, _) in _AUDITED.items()})


_ORDERED = ", f AS (SELECT version, container_id, min(reach) AS reach FROM hits GROUP BY ALL), o AS (SELECT version, container_id, row_number() OVER (ORDER BY version, length(container_id), container_id) AS ord FROM (SELECT DISTINCT version, container_id FROM entries))"


@query("SELECT version, container_id, reach, ord FROM f JOIN o USING (version, container_id) WHERE reach > 2 OR (reach = 2 AND ord > 40) ORDER BY reach, ord LIMIT 16", _PROOF + _ORDERED)
def O4_ordinal_page(spark, d):
    e = A.entries(spark, d)
    found = search.evidence(e, search.search(e, FLAGSHIP), FLAGSHIP).groupBy(KEY).agg(F.min("reach").alias("reach"))
    return search.ordinal_page(found, index.assign_ordinals(e), (2, 40), 15)


@query("SELECT version, word FROM (SELECT DISTINCT version, base_type || ':' || sub_type AS word FROM entries WHERE cost IS NULL UNION SELECT version, base_type || ':' || sub_type FROM entries WHERE cost IS NOT NULL)")
def U2_vocabulary_union(spark, d):
    e = A.entries(spark, d)
    return search.union_vocab(search.distinct_vocab(e.where("cost is null"), "items"), search.distinct_vocab(e.where("cost is not null"), "items"))


@query("SELECT DISTINCT version, 'places' AS kind, place AS word FROM entries UNION SELECT version, 'pairs', place || '<' || coalesce(parent, '') FROM levels")
def A6_places_and_pairs(spark, d):
    e = A.entries(spark, d)
    pairs = search.distinct_vocab(A.levels_of(e), "pairs")
    return search.distinct_vocab(e, "places").select("version", F.lit("places").alias("kind"), "word").unionByName(pairs.select("version", F.lit("pairs").alias("kind"), F.concat("place", F.lit("<"), F.coalesce("parent", F.lit(""))).alias("word")))


@query(f"SELECT version, container_id, place, parent FROM levels WHERE parent IS NULL OR {reach_sql('parent')} <= 3")
def J14_place_pairs(spark, d):
    lv = A.levels(spark, d)
    late = lv.where("parent is not null").select("place", "parent").distinct().where(places.reach_of(F.col("parent")) > 3)
    return search.exclude_place_pairs(lv, late).select(*views.PLACE, "parent")


@query("SELECT version, container_id, count(*) AS entries FROM entries SEMI JOIN (SELECT * FROM features WHERE feat = 'altar_trog') USING (version, container_id) GROUP BY ALL")
def P10_for_containers(spark, d):
    keys = A.features(spark, d).where("feat = 'altar_trog'")
    return search.for_containers(A.entries(spark, d), keys).groupBy(KEY).agg(F.count("*").alias("entries"))


@query("SELECT version, container_id, place, CAST(count(*) AS BIGINT) AS here, min(parent) AS parent FROM entries JOIN levels USING (version, container_id, place) GROUP BY ALL")
def J2_with_places(spark, d):
    e = A.entries(spark, d)
    return views.with_places(e, A.levels_of(e)).groupBy(views.PLACE).agg(F.count("*").alias("here"), F.min("parent").alias("parent"))


@query("SELECT coalesce(a.version, b.version) AS version, coalesce(a.container_id, b.container_id) AS container_id, a.n AS left_n, b.n AS right_n FROM (SELECT version, container_id, count(*) AS n FROM entries WHERE cost IS NULL GROUP BY ALL) a FULL JOIN (SELECT version, container_id, count(*) AS n FROM entries WHERE base_type <> 'book' GROUP BY ALL) b ON a.version = b.version AND a.container_id = b.container_id WHERE a.n IS DISTINCT FROM b.n")
def J15_differing_answers(spark, d):
    e = A.entries(spark, d)
    number = lambda rows: rows.groupBy(KEY).agg(F.count("*").alias("n"))
    found = search.diff_answers(number(e.where("cost is null")), number(e.where("base_type <> 'book'")), KEY, ["n"])
    return found.select(*KEY, F.col("left.n").alias("left_n"), F.col("right.n").alias("right_n"))


@query("SELECT DISTINCT version FROM fills")
def V11_populated_versions(spark, d):
    return search.populated_versions(A.fills(spark, d))


@query("SELECT version, count(*) AS entries, count(*) FILTER (WHERE NOT artefact AND cost IS NULL) AS placed, CAST(sum(CASE WHEN NOT artefact AND cost IS NULL THEN quantity + 1 ELSE 0 END) AS BIGINT) AS x FROM entries WHERE quantity IS NOT NULL GROUP BY version")
def F15_stable_xy(spark, d):
    """Artefacts stand for unique monsters and priced entries for carried ones."""
    at = text.stable_xy(F.col("quantity") + 1, F.lit(1), F.col("artefact"), F.when(F.col("cost").isNotNull(), F.lit("a carrier")))
    rows = A.entries(spark, d).where("quantity is not null").withColumn("at", at)
    return rows.groupBy("version").agg(F.count("*").alias("entries"), F.count("at").alias("placed"), F.coalesce(F.sum("at.x"), F.lit(0)).alias("x"))


@query("SELECT base_type, sub_type, name, CASE WHEN k = 0 THEN sub_type WHEN k = 1 THEN '3 ' || sub_type ELSE name END AS short FROM (SELECT DISTINCT base_type, sub_type, k, CASE k WHEN 0 THEN base_type || ' of ' || sub_type WHEN 1 THEN '3 ' || base_type || 's of ' || sub_type ELSE 'a ' || base_type || ' of ' || sub_type END AS name FROM entries, range(3) t(k) WHERE base_type IN ('potion', 'scroll'))")
def F6_short_names(spark, d):
    kinds = A.entries(spark, d).where("base_type in ('potion', 'scroll')").select("base_type", "sub_type").distinct()
    named = kinds.select("*", F.explode(F.expr("array(concat(base_type, ' of ', sub_type), concat('3 ', base_type, 's of ', sub_type), concat('a ', base_type, ' of ', sub_type))")).alias("name"))
    return named.withColumn("short", text.short_name(F.col("name"), F.col("base_type"), F.col("sub_type")))


@query("SELECT version, CASE WHEN base_type = 'potion' AND sub_type = 'gear' THEN 'xp' WHEN base_type = 'scroll' AND sub_type = 'gear' THEN 'acq' END AS boon, count(*) AS n FROM entries WHERE cost IS NULL GROUP BY ALL UNION ALL SELECT version, NULL, count(*) FROM entries WHERE cost IS NOT NULL GROUP BY ALL")
def F17_boons(spark, d):
    e = A.entries(spark, d)
    mark = text.boon(F.col("base_type"), F.col("sub_type"), F.col("cost"), (("potion", "gear", "xp"), ("scroll", "gear", "acq")))
    counted = e.groupBy("version", F.col("cost").isNotNull().alias("priced"), mark.alias("boon")).agg(F.count("*").alias("n"))
    return counted.select("version", "boon", "n")


@query("SELECT spell, spell_level, CASE WHEN spell_level >= 8 THEN 'high' WHEN spell_level >= 5 THEN 'mid' ELSE 'low' END AS tier, count(*) AS books FROM entries WHERE base_type = 'book' GROUP BY ALL")
def F19_spell_tiers(spark, d):
    from ..functions.naming import spell_tier

    books = A.entries(spark, d).where("base_type = 'book'").select(F.explode("spells").alias("spell")).join(A.spell_levels(spark), "spell")
    return books.groupBy("spell", "spell_level", spell_tier(F.col("spell_level")).alias("tier")).agg(F.count("*").alias("books"))


@query("SELECT version, container_id, band FROM (SELECT version, container_id FROM fills WHERE CAST(container_id AS BIGINT) % 10 = 0) LEFT JOIN (SELECT version, container_id, CASE WHEN s >= blazing AND blazing > hot THEN 'blazing' WHEN s >= hot AND hot > warm THEN 'hot' WHEN s >= warm AND warm > cold THEN 'warm' ELSE 'cold' END AS band FROM (SELECT version, container_id, round(score, 6) AS s FROM scores) JOIN cuts USING (version)) USING (version, container_id)", _BANDS)
def H11_marks(spark, d):
    scored, fl = _scores(spark, d)
    banded = heat.bands(scored.withColumn("score", F.round("score", 6)), fl, CAP)
    return heat.marks(fl.where("cast(container_id as long) % 10 = 0").select(KEY), banded)


@query("SELECT version, container_id, position, n FROM (SELECT version, container_id, CAST(container_id AS BIGINT) AS position, count(*) AS n FROM entries GROUP BY ALL) WHERE position % 7 = 0")
def O8_summaries_in_order(spark, d):
    e = A.entries(spark, d)
    held = e.groupBy(KEY).agg(F.count("*").alias("n"))
    keys = e.select(KEY).distinct().withColumn("position", F.col("container_id").cast("long")).where("position % 7 = 0")
    absent = keys.limit(1).select("version", F.lit("absent").alias("container_id"), F.lit(-7).cast("long").alias("position"))
    return search.ordered_summaries(keys.unionByName(absent), held)


@query(f"SELECT version, container_id, n1 FROM ({has(_ITEM)})")
def O3_broad_refused(spark, d):
    """A broad search is refused, so that a narrower one is asked."""
    e = A.entries(spark, d)
    found = search.search(e, [Term(POTION)])
    try:
        search.refuse_broad(search.search(e, []), most=10)
    except ValueError:
        search.refuse_broad(found, most=100_000_000)
        return found
    return found.limit(0)


def _flags(spark, d):
    rows = A._table(spark, d, "events").selectExpr("substr('ANR', cast(event_id % 3 as int) + 1, 1) as version", "cast(user_id as string) as container_id")
    return rows


@query("SELECT count(*) AS n, bool_and(version = 'A') AS of_version, CAST(least(25, max(total)) AS BIGINT) AS expected FROM (SELECT version, total FROM (SELECT 'A' AS version, (SELECT count(DISTINCT user_id) FROM events WHERE event_id % 3 = 0) AS total) , range(25) t(i) WHERE i < total)")
def O6_flagged_sample(spark, d):
    """A sample has no oracle but its size, its version and that it repeats."""
    flags = _flags(spark, d)
    one, two = (search.sample_flagged(flags, "A", 25, 3) for _ in range(2))
    same = one.exceptAll(two).count() == 0 and one.join(flags, KEY, "left_semi").count() == one.count()
    total = flags.where("version = 'A'").select(KEY).distinct().count()
    return one.agg(F.count("*").alias("n"), F.bool_and((F.col("version") == "A") & F.lit(same)).alias("of_version")).withColumn("expected", F.lit(min(25, total)).cast("long"))


@query("SELECT CAST(least(40, count(*)) AS BIGINT) AS n, true AS repeats, CAST(least(40, count(*)) AS BIGINT) AS known FROM (SELECT DISTINCT version, container_id FROM entries)")
def O5_container_sample(spark, d):
    keys = written(A.entries(spark, d).select(KEY).distinct(), "keys")
    one, two = (search.sample_containers(keys, 40, 11) for _ in range(2))
    repeats = one.exceptAll(two).count() == 0
    return one.agg(F.count("*").alias("n")).select("n", F.lit(repeats).alias("repeats"), F.lit(one.join(keys, KEY, "left_semi").count()).cast("long").alias("known"))


@query("SELECT version, container_id, place, base_type, sub_type FROM entries WHERE base_type IS NULL OR (artefact AND base_type = 'book')")
def D10_broken_names(spark, d):
    """Books that are artefacts have lost their names here: each is reported, no other entry is."""
    e = A.entries(spark, d).withColumn("name", F.expr("case when base_type <> 'book' then name end"))
    from ..operators.audit import audit_names

    return audit_names(e).select(*views.PLACE, "base_type", "sub_type")


@query(f"SELECT version, container_id, place, max(l_linenumber) AS last, count(*) AS records FROM (SELECT e.version, e.container_id, e.place, l_linenumber, l_orderkey, max(l_linenumber * 10000000000 + l_orderkey) OVER (PARTITION BY e.version, e.container_id, e.place) AS top FROM (SELECT l_returnflag AS version, CAST(o_custkey AS VARCHAR) AS container_id, CASE WHEN l_suppkey % 10 = 0 THEN 'Sewer' ELSE 'D:1' END AS place, l_linenumber, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) e) WHERE l_linenumber * 10000000000 + l_orderkey = top GROUP BY ALL")
def W5_latest_record(spark, d):
    lines, orders = A._table(spark, d, "lineitem"), A._table(spark, d, "orders")
    rows = lines.join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr("l_returnflag as version", "cast(o_custkey as string) as container_id", "case when l_suppkey % 10 = 0 then 'Sewer' else 'D:1' end as place", "l_linenumber as arrival", "l_orderkey as record")
    latest = ingest.latest_per_place(rows, "arrival", "record")
    return latest.groupBy(views.PLACE).agg(F.max("arrival").alias("last"), F.count("*").alias("records"))
