"""The catalog queries over the driver's tables, each with the same result as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming, places, text
from ..operators import audit, heat, index, ingest, search, views
from ..operators.criteria import Brand, Feature, Item, NameLike, Props, Term, Unique
from ..sources import adapters as A
from ..sources.tables import parse_jsonl, stored
from ..streaming import catalog as stream

KEY = search.KEY
U = places.UNKNOWN
CAP = 9
#: Caps that are scored together.
CAPS = (7, 9, 13)

# ---- SQL of the mapping

_ENTRANCE = "CASE {b} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in places.ENTRANCES.items()) + " END"


def reach_sql(p: str) -> str:
    portals = ", ".join(f"'{x}'" for x in places.PORTALS)
    entrance = _ENTRANCE.format(b=f"split_part({p}, ':', 1)")
    return f"(CASE WHEN {p} IN ({portals}) THEN {U} WHEN contains({p}, ':') THEN coalesce({entrance} + try_cast(split_part({p}, ':', 2) AS BIGINT), {U}) ELSE coalesce({entrance}, {U}) END)"


CTE = f"""
entries AS (
  SELECT l_returnflag AS version, CAST(o_custkey AS VARCHAR) AS container_id,
    CASE WHEN l_suppkey % 10 = 0 THEN 'Sewer' WHEN l_suppkey % 10 = 1 THEN 'Lair:' || CAST(least(l_linenumber, 5) AS VARCHAR)
         WHEN l_suppkey % 10 = 2 THEN 'Temple' ELSE 'D:' || CAST(l_linenumber AS VARCHAR) END AS place,
    CASE WHEN l_suppkey % 10 = 0 THEN 'D:' || CAST(l_linenumber AS VARCHAR) END AS row_parent,
    CASE split_part(p_type, ' ', 1) WHEN 'MEDIUM' THEN 'potion' WHEN 'STANDARD' THEN 'scroll' WHEN 'LARGE' THEN 'weapon'
         WHEN 'PROMO' THEN 'armour' WHEN 'SMALL' THEN 'book' WHEN 'ECONOMY' THEN 'miscellaneous' END AS base_type,
    split_part(p_name, ' ', 2) AS sub_type, CASE WHEN p_size % 3 = 0 THEN split_part(p_name, ' ', 1) END AS ego,
    CASE WHEN CAST(l_quantity AS INTEGER) % 10 <> 0 THEN CAST(l_quantity AS INTEGER) % 5 + 1 END AS quantity,
    CASE WHEN l_discount >= 0.08 THEN l_extendedprice END AS cost, p_partkey % 5 = 0 AS artefact,
    CASE WHEN p_partkey % 5 = 0 THEN p_name || ' ' || p_brand END AS name,
    CASE WHEN p_partkey % 5 = 0 THEN 'P' || CAST(p_partkey % 7 AS VARCHAR) END AS prop1, p_size % 9 - 4 AS value1,
    CASE WHEN p_partkey % 5 = 0 THEN 'P' || CAST((p_partkey + 3) % 7 AS VARCHAR) END AS prop2, p_size % 5 - 1 AS value2,
    'S' || CAST(p_size AS VARCHAR) AS spell, p_size % 9 + 1 AS spell_level
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
props AS (SELECT version, container_id, place, base_type, cost, quantity, prop1 AS prop, value1 AS value FROM entries WHERE prop1 IS NOT NULL
  UNION ALL SELECT version, container_id, place, base_type, cost, quantity, prop2, value2 FROM entries WHERE prop2 IS NOT NULL),
levels AS (SELECT version, container_id, place, min(row_parent) AS parent FROM entries GROUP BY ALL),
fills AS (SELECT version, container_id, coalesce(max(CASE WHEN place <> 'Sewer' AND {reach_sql("place")} < {U} THEN {reach_sql("place")} END), 0) AS depth,
    CASE WHEN CAST(container_id AS BIGINT) % 20 = 0 THEN 'submit' ELSE 'fill' END AS origin FROM levels GROUP BY version, container_id),
features AS (SELECT version, container_id, 'D:' || CAST(k % 7 + 1 AS VARCHAR) AS place,
    CASE k % 5 WHEN 0 THEN 'altar_trog' WHEN 1 THEN 'enter_shop' WHEN 2 THEN 'enter_temple' WHEN 3 THEN 'enter_sewer' END AS feat
  FROM (SELECT DISTINCT version, container_id, CAST(container_id AS BIGINT) AS k FROM entries) WHERE k % 5 <> 4)"""
def heat_sql(cap: int) -> str:
    """What follows from the tables for the score at a cap."""
    return f"""
ok AS (SELECT *, CASE WHEN place = 'Sewer' AND parent IS NOT NULL THEN {reach_sql("parent")} ELSE {reach_sql("place")} END AS reach FROM levels
  WHERE ({reach_sql("place")} <= {cap} OR {reach_sql("place")} = {U}) AND (parent IS NULL OR place <> 'Sewer' OR {reach_sql("parent")} <= {cap} OR {reach_sql("parent")} = {U})),
placed AS (SELECT e.*, ok.reach FROM entries e JOIN ok USING (version, container_id, place) WHERE cost IS NULL),
allkeys AS (SELECT version, container_id, origin FROM fills WHERE depth >= {cap}),
obs AS (SELECT version, container_id, base_type, sub_type, CAST(sum(coalesce(quantity, 1)) AS BIGINT) AS count, min(reach) AS reach
  FROM placed SEMI JOIN allkeys USING (version, container_id) WHERE base_type IS NOT NULL GROUP BY ALL),
book AS (SELECT k.version, k.container_id, count(DISTINCT p.spell) AS count FROM allkeys k LEFT JOIN
  (SELECT * FROM placed WHERE base_type = 'book' AND spell_level <= 4) p USING (version, container_id) GROUP BY ALL),
every AS (SELECT version, container_id, base_type, sub_type, count, reach FROM obs UNION ALL
  SELECT version, container_id, 'book', '#early-spells', count, NULL FROM book),
sizes AS (SELECT version, count(*) AS cohort FROM allkeys WHERE origin = 'fill' GROUP BY version),
drawn AS (SELECT e.* FROM every e SEMI JOIN (SELECT * FROM allkeys WHERE origin = 'fill') k USING (version, container_id)),
tails AS (SELECT version, base_type, sub_type, count, sum(n) OVER (PARTITION BY version, base_type, sub_type ORDER BY count DESC) / cohort AS tail_p
  FROM (SELECT version, base_type, sub_type, count, count(*) AS n FROM drawn GROUP BY ALL) JOIN sizes USING (version)),
weighed AS (SELECT e.*, CASE WHEN sub_type = '#early-spells' THEN 20.0 WHEN base_type = 'potion' AND sub_type = 'ring' THEN 35.0 ELSE CASE base_type
  WHEN 'potion' THEN 30.0 WHEN 'scroll' THEN 20.0 WHEN 'weapon' THEN 15.0 WHEN 'armour' THEN 10.0 WHEN 'miscellaneous' THEN 8.0 END END AS weight FROM every e),
looked AS (SELECT w.version, w.container_id, w.base_type, w.sub_type, w.count, w.reach, w.weight, cohort,
    coalesce(arg_max(t.tail_p, t.count) FILTER (WHERE t.count <= w.count), 1 / max(cohort)) AS tail_p
  FROM weighed w JOIN sizes USING (version) LEFT JOIN tails t ON t.version = w.version AND t.base_type = w.base_type AND t.sub_type = w.sub_type
  WHERE weight IS NOT NULL GROUP BY ALL),
contrib AS (SELECT version, container_id, weight * -log10(greatest(tail_p, 1 / cohort)) * coalesce(0.5 + 0.5 * (({cap} - CAST(reach AS DOUBLE) + 1) / {cap}), 1.0) AS c FROM looked),
scores AS (SELECT version, container_id, sum(c * pow(0.6, r - 1)) AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY version, container_id ORDER BY c DESC) AS r FROM contrib) GROUP BY ALL)"""


HEAT = heat_sql(CAP)


def sql(body: str, more: str = "") -> str:
    return f"WITH {CTE}{',' + more if more else ''}\n{body}"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None, more: str = ""):
    """Registers a query under its function's name, with the SQL of the same result."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle, more)
        return f

    return put


QSUM = "CAST(sum(coalesce(quantity, 1)) AS BIGINT)"
POTION, WEAPON = Item("potion", "bolt"), Item("weapon", "gear")
FLAGSHIP = [Term(POTION, 3), Term(WEAPON)]


def has(term: str, n: int = 1) -> str:
    return f"SELECT version, container_id, {QSUM} AS n1 FROM entries WHERE {term} GROUP BY ALL HAVING n1 >= {n}"


# ---- search

_FOUND = """SELECT version, container_id, n1, n2 FROM (SELECT version, container_id,
    CAST(sum(CASE WHEN base_type = 'potion' AND sub_type = 'bolt' AND cost IS NULL THEN coalesce(quantity, 1) ELSE 0 END) AS BIGINT) AS n1,
    CAST(sum(CASE WHEN base_type = 'weapon' AND sub_type = 'gear' AND cost IS NULL THEN coalesce(quantity, 1) ELSE 0 END) AS BIGINT) AS n2
  FROM entries GROUP BY ALL) WHERE n1 >= 3 AND n2 >= 1"""


@query(_FOUND)
def Q1_conjunctive_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(A.entries(spark, d), FLAGSHIP)


_PROOF = f"""found AS ({_FOUND}), hits AS (SELECT e.*, CASE WHEN base_type = 'potion' THEN 1 ELSE 2 END AS term, {reach_sql("place")} AS reach, coalesce(name, base_type || ' ' || sub_type) AS label
  FROM entries e SEMI JOIN found USING (version, container_id) WHERE cost IS NULL AND ((base_type = 'potion' AND sub_type = 'bolt') OR (base_type = 'weapon' AND sub_type = 'gear'))),
firsts AS (SELECT *, row_number() OVER (PARTITION BY version, container_id, term ORDER BY reach, place, label) AS r FROM hits),
proofs AS (SELECT h.version, h.container_id, h.term, {QSUM} AS total, count(DISTINCT label) AS names FROM hits h GROUP BY ALL)"""


@query("SELECT p.version, p.container_id, p.term, p.total, f.reach, f.place, f.label AS name, p.names FROM proofs p JOIN firsts f USING (version, container_id, term) WHERE r = 1", _PROOF)
def Q2_evidence(spark, d):
    e = A.entries(spark, d)
    return search.evidence(e, search.search(e, FLAGSHIP), FLAGSHIP)


@query("SELECT DISTINCT version, container_id FROM entries")
def Q3_list_containers(spark, d):
    return search.search(A.entries(spark, d), [])


@query(f"SELECT version, max(n) AS most FROM (SELECT version, container_id, {QSUM} AS n FROM entries WHERE base_type = 'potion' AND sub_type = 'bolt' AND cost IS NULL GROUP BY ALL) GROUP BY version")
def Q4_count_ceiling(spark, d):
    return search.count_ceiling(A.entries(spark, d), Term(POTION))


@query("SELECT version, container_id, n1, n2, reach FROM (SELECT f.*, min(reach) AS reach FROM found f JOIN hits USING (version, container_id) GROUP BY ALL) ORDER BY reach, container_id, version LIMIT 20 OFFSET 5", _PROOF)
def O2_ranked_page(spark, d):
    e = A.entries(spark, d)
    found = search.search(e, FLAGSHIP)
    return search.ranked(found, search.evidence(e, found, FLAGSHIP), 5, 20)


@query(f"SELECT container_id, n1, n2 FROM ({_FOUND}) WHERE version = 'A' AND container_id > '3' ORDER BY container_id LIMIT 11")
def O1_keyset_page(spark, d):
    return search.keyset_page(search.search(A.entries(spark, d), FLAGSHIP, "A").drop("version"), "3", 10)


@query("SELECT version, container_id, n1 FROM (" + has("base_type = 'scroll' AND sub_type = 'gear' AND cost IS NOT NULL") + ")")
def P1_item_in_shop(spark, d):
    return search.search(A.entries(spark, d), [Term(Item("scroll", "gear", shop=True))])


@query(has("contains(lower(name), 'red r') AND cost IS NULL"))
def P2_name_like(spark, d):
    return search.search(A.entries(spark, d), [Term(NameLike("ReD r"))])


@query("SELECT version, container_id, count(*) AS n1 FROM features WHERE feat = 'altar_trog' GROUP BY ALL")
def P3_feature(spark, d):
    return search.search(A.features(spark, d).withColumn("quantity", F.lit(None).cast("int")), [Term(Feature("altar_trog"))])


@query(has("artefact AND cost IS NULL AND ((prop1 = 'P1' AND value1 >= 1) OR (prop2 = 'P1' AND value2 >= 1)) AND ((prop1 = 'P4' AND value1 >= 1) OR (prop2 = 'P4' AND value2 >= 1))"))
def P5_two_properties_on_one_item(spark, d):
    return search.search(A.entries(spark, d), [Term(Props(("P1", "P4")))])


@query(has("base_type = 'weapon' AND ego = 'red' AND cost IS NULL"))
def P6_brand(spark, d):
    return search.search(A.entries(spark, d), [Term(Brand("weapon", "RED"))])


@query(f"SELECT version, container_id, n1, n2 FROM ({_FOUND}) ANTI JOIN (SELECT * FROM fills WHERE origin = 'submit' AND CAST(container_id AS BIGINT) % 40 <> 0) USING (version, container_id)")
def P8_hide_pending(spark, d):
    e, f = A.entries(spark, d), A.fills(spark, d)
    return search.hide_pending(search.search(e, FLAGSHIP), f, f.where("cast(container_id as long) % 40 = 0").select(KEY))


@query(f"SELECT e.version, e.place, count(*) AS n FROM entries e JOIN ok USING (version, container_id, place) GROUP BY ALL", HEAT)
def P9_within_cap(spark, d):
    ok = A.levels(spark, d).where(places.within_cap(F.col("place"), F.col("parent"), CAP))
    return A.entries(spark, d).join(ok, views.PLACE, "left_semi").groupBy("version", "place").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT e.version, e.container_id FROM entries e SEMI JOIN (SELECT * FROM entries WHERE base_type = 'potion' AND sub_type = 'bolt' AND cost IS NULL) a USING (version, container_id) SEMI JOIN (SELECT * FROM features WHERE feat = 'enter_shop') f USING (version, container_id)")
def J3_semi_join_conjunction(spark, d):
    e = A.entries(spark, d)
    return search.containing_all(e.select(KEY).distinct(), [e.where(Term(POTION).column()), A.features(spark, d).where("feat = 'enter_shop'")])


@query("SELECT DISTINCT version, container_id FROM entries EXCEPT SELECT version, container_id FROM features WHERE feat = 'altar_trog'")
def J5_anti_join(spark, d):
    return search.without(A.entries(spark, d).select(KEY).distinct(), A.features(spark, d).where("feat = 'altar_trog'"))


@query("SELECT version, prop, count(*) AS rows, CAST(sum(value) AS BIGINT) AS total FROM props GROUP BY ALL")
def J6_properties_long(spark, d):
    return search.props_long(A.entries(spark, d)).groupBy("version", "prop").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))


@query("SELECT DISTINCT version, 'items' AS kind, base_type || ':' || sub_type AS word FROM entries UNION SELECT version, 'props', prop FROM props WHERE value >= 1 UNION SELECT version, 'egos', ego FROM entries WHERE ego IS NOT NULL")
def Q6_vocabulary(spark, d):
    return search.vocabulary(A.entries(spark, d))


_TYPED = "words AS (SELECT DISTINCT lower(word) AS word FROM (SELECT event_type AS word FROM events UNION ALL SELECT substr(split_part(p_name, ' ', 2), 2) FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part)), known AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS known FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part)"


@query("""SELECT word, count(*) FILTER (WHERE word = known) AS exact, count(*) FILTER (WHERE word <> known AND damerau_levenshtein(word, known) <= 1) AS near,
  CASE WHEN exact = 1 THEN 'resolved' WHEN exact > 1 THEN 'pick' WHEN near > 0 THEN 'suggest' ELSE 'none' END AS verdict FROM words, known GROUP BY word""", _TYPED)
def Q7_resolve_words(spark, d):
    part, events = A._table(spark, d, "part"), A._table(spark, d, "events")
    log = events.selectExpr("event_type as word").unionByName(part.selectExpr("substr(split_part(p_name, ' ', 2), 2) as word")).unionByName(part.selectExpr("split_part(p_name, ' ', 1) as word"))
    vocab = part.selectExpr("split_part(p_name, ' ', 1) as word").unionByName(part.selectExpr("split_part(p_name, ' ', 2) as word"))
    return search.resolve_words(log, vocab)


# ---- index

_POST = f"""post AS (SELECT version, CASE WHEN cost IS NULL THEN 'floor/' ELSE 'shop/' END || kind AS kind, a, b, container_id, min(reach) AS reach, {QSUM} AS count FROM (
  SELECT version, container_id, cost, quantity, {reach_sql("place")} AS reach, 'item' AS kind, base_type AS a, sub_type AS b FROM entries UNION ALL
  SELECT version, container_id, cost, quantity, {reach_sql("place")}, 'typed', base_type, prop FROM props WHERE value >= 1 UNION ALL
  SELECT version, container_id, cost, quantity, {reach_sql("place")}, 'prop', '', prop FROM props WHERE value >= 1 UNION ALL
  SELECT version, container_id, cost, quantity, {reach_sql("place")}, 'brand', base_type, ego FROM entries WHERE base_type IN ('weapon', 'armour') AND ego IS NOT NULL)
  GROUP BY ALL)"""


def stored_postings(spark, d):
    """The postings, stored by version, those of a key one after the other."""
    return stored(spark, d, "catalog-postings", lambda: index.in_order(index.build_postings(A.entries(spark, d))), by=("version",))


@query("SELECT version, kind, a, b, container_id, reach, count FROM post", _POST)
def I3_postings(spark, d):
    return stored_postings(spark, d)


@query("SELECT version, kind, a, b, count(*) AS card, max(count) AS most FROM post GROUP BY ALL", _POST)
def I4_criteria(spark, d):
    return index.build_criteria(stored_postings(spark, d))


@query(f"SELECT version, container_id, min(reach) AS reach FROM hits GROUP BY ALL", _PROOF)
def I5_indexed_search(spark, d):
    return index.search_indexed(stored_postings(spark, d), [("floor/item", "potion", "bolt", 3), ("floor/item", "weapon", "gear", 1)])


@query("SELECT DISTINCT name FROM entries WHERE contains(lower(name), 'ng brand#1')")
def I6_trigram_names(spark, d):
    grams = stored(spark, d, "catalog-trigrams", lambda: index.trigrams(A.entries(spark, d).where("name is not null").select("name")).repartition("gram").sortWithinPartitions("gram"))
    return index.names_like(grams, "nG Brand#1")


@query("SELECT version, count(*) AS criteria, CAST(sum(card) AS BIGINT) AS postings, CAST(sum(ceil(card / 512)) AS BIGINT) AS blocks FROM (SELECT version, kind, a, b, count(*) AS card FROM post GROUP BY ALL) GROUP BY version", _POST)
def A13_index_stats(spark, d):
    return index.index_stats(index.build_criteria(stored_postings(spark, d)))


@query("SELECT version, container_id, row_number() OVER (ORDER BY late, version, length(container_id), container_id) AS ord FROM (SELECT DISTINCT version, container_id, CAST(container_id AS BIGINT) % 3 = 0 AS late FROM entries)")
def I1_ordinals(spark, d):
    """Two thirds of the containers first, then all: those known keep their ordinals, the others follow."""
    e = A.entries(spark, d)
    return index.assign_ordinals(e, index.assign_ordinals(e.where("cast(container_id as long) % 3 <> 0")))


@query("SELECT version, kind, a, b, CAST(sum(count) AS BIGINT) AS total FROM post GROUP BY ALL", _POST)
def I9_overlay(spark, d):
    """Built from shallow places only, the stale containers are subtracted and derived anew: the same as built from all."""
    e, f = A.entries(spark, d), A.fills(spark, d)
    shallow = e.where(places.reach_of(F.col("place")) <= 8)
    built = ingest.fill_depth(shallow.select(*KEY, "place").distinct())
    stale = index.changed(f, built).unionByName(e.where(places.reach_of(F.col("place")) > 8).select(KEY)).distinct()
    out = index.overlay(index.build_postings(shallow), stale, index.build_postings(e))
    return out.groupBy("version", "kind", "a", "b").agg(F.sum("count").alias("total"))


@query(f"SELECT q AS query, version, container_id FROM (SELECT 'a' AS q, version, container_id FROM ({_FOUND}) UNION ALL SELECT 'b', version, container_id FROM post WHERE kind = 'floor/prop' AND b = 'P1' AND count >= 2)", _POST)
def Q5_search_many(spark, d):
    specs = spark.createDataFrame([("a", "floor/item", "potion", "bolt", 3), ("a", "floor/item", "weapon", "gear", 1), ("b", "floor/prop", "", "P1", 2)], "query string, kind string, a string, b string, min_count int")
    return search.search_many(F.broadcast(specs), stored_postings(spark, d))


# ---- score


def _heat(spark, d):
    """Entries, places and fills, each stored: the score reads them several times."""
    return A.entries(spark, d), A.levels(spark, d), A.fills(spark, d), A.spell_levels(spark)


@query("SELECT version, base_type, sub_type, count, round(tail_p, 9) AS tail_p FROM tails", HEAT)
def H4_surprise(spark, d):
    return _surprise(spark, d).where(F.col("cap") == CAP).drop("cap").withColumn("tail_p", F.round("tail_p", 9))


@query("SELECT version, container_id, base_type, sub_type, count, reach FROM obs", HEAT)
def H5_observations(spark, d):
    e, lv, fl, _ = _heat(spark, d)
    return heat.observations(e, lv, heat.cohort(fl, CAP, submitted=True), CAP)


@query("SELECT version, container_id, count FROM book", HEAT)
def A8_early_spells(spark, d):
    e, lv, fl, sp = _heat(spark, d)
    return heat.early_spells(e, lv, heat.cohort(fl, CAP, submitted=True), sp, CAP)


def observed(spark, d):
    """What containers hold at each of CAPS, stored: one scan of the entries for all."""
    make = lambda: heat.observed_for_caps(heat.placed_for_caps(A.entries(spark, d), A.levels(spark, d)), A.fills(spark, d), A.spell_levels(spark), list(CAPS))
    return stored(spark, d, "catalog-observed", make, by=("version",))


def _surprise(spark, d):
    return heat.surprise_for_caps(observed(spark, d), A.fills(spark, d), list(CAPS))


def all_scores(spark, d, seen=None):
    """Scores at all CAPS of what is observed, from the stored surprise table."""
    table = stored(spark, d, "catalog-surprise", lambda: _surprise(spark, d))
    seen = observed(spark, d) if seen is None else seen
    return heat.scores_for_caps(seen, table, heat.cohorts(A.fills(spark, d), list(CAPS)), F.broadcast(A.weights(spark)))


def _scores(spark, d):
    seen = observed(spark, d).where(F.col("cap") == CAP)
    return all_scores(spark, d, seen).drop("cap"), A.fills(spark, d)


@query("SELECT version, container_id, round(score, 6) AS score FROM scores", HEAT)
def H7_scores(spark, d):
    return _scores(spark, d)[0].withColumn("score", F.round("score", 6))


_BANDS = HEAT + f""", ranked AS (SELECT s.version, round(score, 6) AS score, row_number() OVER (PARTITION BY s.version ORDER BY round(score, 6)) AS r, count(*) OVER (PARTITION BY s.version) AS n
  FROM scores s SEMI JOIN (SELECT * FROM allkeys WHERE origin = 'fill') k USING (version, container_id)),
cuts AS (SELECT version, least(min(score) FILTER (WHERE r = 1), 0) AS cold, min(score) FILTER (WHERE r = least(n - 1, CAST(floor(0.5::DOUBLE * n) AS BIGINT)) + 1) AS warm,
  min(score) FILTER (WHERE r = least(n - 1, CAST(floor(0.8::DOUBLE * n) AS BIGINT)) + 1) AS hot, min(score) FILTER (WHERE r = least(n - 1, CAST(floor(0.95::DOUBLE * n) AS BIGINT)) + 1) AS blazing FROM ranked GROUP BY version)"""


@query("""SELECT version, container_id, CASE WHEN s >= blazing AND blazing > hot THEN 'blazing' WHEN s >= hot AND hot > warm THEN 'hot' WHEN s >= warm AND warm > cold THEN 'warm' ELSE 'cold' END AS band
  FROM (SELECT version, container_id, round(score, 6) AS s FROM scores) JOIN cuts USING (version)""", _BANDS)
def H8_bands(spark, d):
    scored, fl = _scores(spark, d)
    return heat.bands(scored.withColumn("score", F.round("score", 6)), fl, CAP).drop("score")


@query("SELECT version, cold, warm, hot, blazing FROM cuts", _BANDS)
def W3_percentile_cuts(spark, d):
    scored, fl = _scores(spark, d)
    drawn = scored.withColumn("score", F.round("score", 6)).join(heat.cohort(fl, CAP), KEY, "left_semi")
    return heat.percentile_cut(drawn, dict(heat.CUTS)).withColumn("cold", F.least("cold", F.lit(0.0)))


@query("SELECT version, cohort FROM sizes", HEAT)
def H9_cohort_size(spark, d):
    return heat.cohort_size(heat.cohort(A.fills(spark, d), CAP))


@query("SELECT version, container_id, round(score, 6) AS score FROM scores SEMI JOIN (SELECT * FROM fills WHERE origin = 'submit') USING (version, container_id)", HEAT)
def H10_score_late(spark, d):
    scored, fl = _scores(spark, d)
    return scored.join(fl.where("origin = 'submit'"), KEY, "left_semi").withColumn("score", F.round("score", 6))


_EACH_CAP = " UNION ALL ".join(f"SELECT version, container_id, CAST({cap} AS BIGINT) AS cap, round(score, 6) AS score FROM (WITH {heat_sql(cap)} SELECT * FROM scores)" for cap in CAPS)


@query(_EACH_CAP)
def H10_all_caps(spark, d):
    """Every container at every cap up to its depth, from one scan."""
    return all_scores(spark, d).withColumn("score", F.round("score", 6))


@query(f"SELECT s.* FROM ({_EACH_CAP}) s JOIN fills f USING (version, container_id) WHERE origin = 'submit'")
def H10_late_at_all_caps(spark, d):
    """Containers that came after the table was made: observed alone, scored at each cap from the stored table."""
    e, lv, fl, sp = _heat(spark, d)
    late = fl.where("origin = 'submit'")
    own = e.join(late.select(KEY), KEY, "left_semi")
    return all_scores(spark, d, heat.observed_for_caps(heat.placed_for_caps(own, lv), late, sp, list(CAPS))).withColumn("score", F.round("score", 6))


@query(" UNION ALL ".join(f"SELECT version, CAST({cap} AS BIGINT) AS cap, base_type, sub_type, count, round(tail_p, 9) AS tail_p FROM (WITH {heat_sql(cap)} SELECT * FROM tails)" for cap in CAPS))
def H4_surprise_at_all_caps(spark, d):
    return _surprise(spark, d).withColumn("tail_p", F.round("tail_p", 9))


@query("SELECT 'scores' AS name, version, cap, count(*) AS n FROM (SELECT version, depth AS cap FROM fills) GROUP BY ALL UNION ALL SELECT t.name, version, 13, 1 FROM (SELECT DISTINCT version FROM fills WHERE depth = 13), (VALUES ('bands'), ('cohorts'), ('surprise')) t(name)")
def H1_stale_caps_dropped(spark, d):
    """Tables by cap lose the caps that no container has any more: 100 was held once, 13 still is."""
    f = A.fills(spark, d)
    one = f.select("version").distinct()
    kept = f.where("depth = 13").select("version", F.col("depth").alias("cap")).distinct().unionByName(one.withColumn("cap", F.lit(100).cast("long")))
    scored = f.select("version", F.col("depth").alias("cap")).unionByName(one.withColumn("cap", F.lit(100).cast("long")))
    out = None
    for name, t in heat.drop_stale_caps({"scores": scored, "bands": kept, "cohorts": kept, "surprise": kept}, f).items():
        part = t.groupBy(F.lit(name).alias("name"), "version", "cap").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT DISTINCT version, depth AS cap FROM fills")
def H1_caps(spark, d):
    return heat.caps(A.fills(spark, d))


# ---- functions


@query(f"SELECT place, {reach_sql('place')} AS reach, count(*) AS n FROM entries GROUP BY ALL")
def F1_reach_of_place(spark, d):
    return A.entries(spark, d).groupBy("place", places.reach_of(F.col("place")).alias("reach")).agg(F.count("*").alias("n"))


@query(f"SELECT version, container_id, place, CASE WHEN place = 'Sewer' THEN {reach_sql('parent')} ELSE {reach_sql('place')} END AS reach FROM levels")
def F2_reach_with_parent(spark, d):
    return A.levels(spark, d).select(*views.PLACE, places.reach_with_parent(F.col("place"), F.col("parent")).alias("reach"))


@query("""SELECT place, CASE WHEN place = 'Temple' THEN 'Temple' WHEN place = 'Sewer' THEN 'Portals' WHEN place IN ('D:1', 'D:2', 'D:3') THEN 'D:1-3' WHEN place LIKE 'D:%' THEN 'D:4-7'
  WHEN place IN ('Lair:1', 'Lair:2') THEN 'Lair:1-2' ELSE 'Lair:3-5' END AS band, count(*) AS n FROM entries GROUP BY ALL""")
def F25_band_label(spark, d):
    return A.entries(spark, d).groupBy("place", places.band_label(F.col("place")).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT feat, CASE feat WHEN 'altar_trog' THEN 'an altar of Trog' WHEN 'enter_shop' THEN 'a shop' WHEN 'enter_temple' THEN 'an entrance to temple' ELSE 'an entrance to sewer' END AS label FROM features")
def F8_feature_label(spark, d):
    return A.features(spark, d).select("feat", text.feature_label(F.col("feat")).alias("label")).distinct()


@query("SELECT DISTINCT base_type, sub_type, CASE WHEN base_type IN ('potion', 'scroll', 'wand') THEN base_type || ' of ' || sub_type ELSE sub_type END AS label FROM entries")
def F7_item_label(spark, d):
    return A.entries(spark, d).select("base_type", "sub_type", text.item_label(F.col("base_type"), F.col("sub_type")).alias("label")).distinct()


@query("SELECT version, CASE WHEN artefact THEN 1 WHEN ego IS NOT NULL THEN 2 WHEN base_type = 'book' AND sub_type <> 'ring' THEN 2 ELSE 3 END AS class, count(*) AS n FROM entries GROUP BY ALL")
def F16_significance(spark, d):
    """Books of one kind tell their spell by name."""
    name = F.when(F.col("sub_type") == "ring", F.concat(F.lit("parchment of "), F.get("spells", F.lit(0))))
    c = text.significance(*[F.col(x) for x in ("base_type", "sub_type", "cost", "artefact", "ego")], F.lit(False), F.col("spells"), F.coalesce(name, F.lit("")))
    return A.entries(spark, d).groupBy("version", c.alias("class")).agg(F.count("*").alias("n"))


@query("SELECT v, row_number() OVER (ORDER BY CAST(split_part(v, '.', 1) AS INT), CAST(split_part(v, '.', 2) AS INT)) AS place FROM (SELECT DISTINCT CAST(p_size % 3 AS VARCHAR) || '.' || CAST(p_size AS VARCHAR) AS v FROM part)")
def F10_release_order(spark, d):
    v = A._table(spark, d, "part").selectExpr("concat(cast(p_size % 3 as string), '.', cast(p_size as string)) as v").distinct()
    return ingest.assign_ids(v.withColumn("k", text.release_key(F.col("v"))), ["k", "v"], "place").select("v", "place")


@query("SELECT o_custkey, k AS key, coalesce(try_cast(k AS UHUGEINT) BETWEEN 1 AND 18446744073709551615 AND k = CAST(try_cast(k AS UHUGEINT) AS VARCHAR), false) AS valid FROM (SELECT o_custkey, CASE o_custkey % 5 WHEN 0 THEN '0' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN '-' || CAST(o_custkey AS VARCHAR) WHEN 2 THEN '1844674407370955' || right('0000' || CAST(o_custkey % 10000 AS VARCHAR), 4) WHEN 3 THEN CAST(o_custkey AS VARCHAR) ELSE 'x' END AS k FROM (SELECT DISTINCT o_custkey FROM orders))")
def F11_valid_key(spark, d):
    """Keys with a leading zero, a sign, near the greatest, plain, and no number."""
    key = "case o_custkey % 5 when 0 then concat('0', o_custkey) when 1 then concat('-', o_custkey) when 2 then concat('1844674407370955', right(concat('0000', o_custkey % 10000), 4)) when 3 then cast(o_custkey as string) else 'x' end"
    keys = A._table(spark, d, "orders").select("o_custkey").distinct().withColumn("key", F.expr(key))
    return keys.withColumn("valid", text.valid_key(F.col("key")))


@query("SELECT version, base_type, sub_type, max(CASE WHEN base_type = 'potion' AND sub_type = 'ring' THEN 35.0 ELSE CASE base_type WHEN 'potion' THEN 30.0 WHEN 'scroll' THEN 20.0 WHEN 'weapon' THEN 15.0 WHEN 'armour' THEN 10.0 WHEN 'miscellaneous' THEN 8.0 END END) AS weight FROM entries WHERE base_type <> 'book' GROUP BY ALL")
def F18_weights(spark, d):
    kinds = A.entries(spark, d).select("version", "base_type", "sub_type").distinct()
    return heat.with_weight(kinds, F.broadcast(A.weights(spark))).select("version", "base_type", "sub_type", F.col("weight").cast("decimal(3,1)").alias("weight"))


# ---- ingest and derived tables


@query("SELECT version, container_id, depth, origin FROM fills")
def S14_fill_depth(spark, d):
    return A.fills(spark, d)


@query("SELECT version, container_id, max(depth) AS depth, CASE WHEN bool_or(origin = 'fill') THEN 'fill' ELSE 'submit' END AS origin FROM (SELECT * FROM fills UNION ALL SELECT version, container_id, depth + 1, 'submit' FROM fills) GROUP BY ALL")
def S15_origin_merge(spark, d):
    f = A.fills(spark, d)
    return ingest.merge_origins(f.unionByName(f.withColumn("depth", F.col("depth") + 1).withColumn("origin", F.lit("submit"))))


@query("SELECT version, count(*) FILTER (WHERE origin = 'fill') AS sampled, count(*) FILTER (WHERE origin = 'submit') AS submitted FROM fills GROUP BY version")
def S16_sample_counts(spark, d):
    return ingest.sample_counts(A.fills(spark, d))


@query("SELECT CAST(18446744073709551000::HUGEINT + k AS VARCHAR) AS container_id FROM range(0, 616) t(k) WHERE k % 5 <> 0 OR k % 7 = 0")
def S19_missing_keys_beyond_63_bits(spark, d):
    """The last keys of 64 bits; every fifth is filled, but for those that are there by submission only."""
    shifted = A.fills(spark, d).where("version = 'A'").select("version", F.explode(F.array(*[F.lit(k) for k in range(0, 616, 5)])).alias("k")).distinct()
    keyed = shifted.select("version", (F.col("k").cast("decimal(20,0)") + F.lit("18446744073709551000").cast("decimal(20,0)")).cast("string").alias("container_id"), F.when(F.col("k") % 7 == 0, "submit").otherwise("fill").alias("origin"))
    return ingest.missing_keys(keyed, "A", 18446744073709551000, 616)


@query("SELECT CAST(k AS VARCHAR) AS container_id FROM range(1, 501) t(k) WHERE CAST(k AS VARCHAR) NOT IN (SELECT container_id FROM fills WHERE version = 'A' AND origin = 'fill')")
def S19_missing_keys(spark, d):
    return ingest.missing_keys(A.fills(spark, d), "A", 1, 500)


@query("SELECT version, container_id, place, count(*) AS n, bool_or(replaced) AS replaced FROM (SELECT version, container_id, place, false AS replaced FROM entries WHERE place <> 'Temple' UNION ALL SELECT version, container_id, place, true FROM levels WHERE place = 'Temple') GROUP BY ALL")
def S11_upsert_places(spark, d):
    rows = A.entries(spark, d).select(*views.PLACE, F.lit(False).alias("replaced"))
    batch = A.levels(spark, d).where("place = 'Temple'").select(*views.PLACE, F.lit(True).alias("replaced"))
    return ingest.upsert_places(rows, batch).groupBy(views.PLACE).agg(F.count("*").alias("n"), F.bool_or("replaced").alias("replaced"))


@query("SELECT row_number() OVER (ORDER BY late, val) AS id, val FROM (SELECT p_name AS val, NOT bool_or(p_partkey % 2 = 0) AS late FROM part GROUP BY ALL)")
def S10_dictionary(spark, d):
    """Names of even keys are known: they keep their ids, the others follow."""
    part = A._table(spark, d, "part").select("p_partkey", F.col("p_name").alias("val"))
    known = ingest.extend_dictionary(spark.createDataFrame([], "id long, val string"), part.where("p_partkey % 2 = 0").select("val"))
    return ingest.extend_dictionary(known, part.select("val"))


@query("SELECT count(*) AS entries FROM entries ANTI JOIN (SELECT * FROM fills WHERE origin = 'submit') USING (version, container_id)")
def S17_drop_containers(spark, d):
    return ingest.drop_containers(A.entries(spark, d), A.fills(spark, d).where("origin = 'submit'").select(KEY)).agg(F.count("*").alias("entries"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t} ANTI JOIN (SELECT * FROM fills WHERE origin = 'submit' AND version <> 'R') USING (version, container_id)" for t in ("entries", "levels", "fills", "features")) + " UNION ALL SELECT 'current ' || version, count(*) FROM (SELECT DISTINCT version FROM fills ANTI JOIN (SELECT version FROM fills WHERE origin = 'submit' AND version <> 'R') USING (version)) GROUP BY ALL")
def S17_drop_everywhere(spark, d):
    """Containers go from every table, and the index of their versions is current no more."""
    tables = {"entries": A.entries(spark, d), "levels": A.levels(spark, d), "fills": A.fills(spark, d), "features": A.features(spark, d)}
    keys = A.fills(spark, d).where("origin = 'submit' and version <> 'R'")
    left, state = ingest.drop_everywhere(tables, ingest.sample_counts(A.fills(spark, d)), keys)
    out = state.groupBy(F.concat(F.lit("current "), "version").alias("name")).agg(F.count("*").alias("n"))
    for name, t in left.items():
        out = out.unionByName(t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
    return out


@query("SELECT event_type AS version, CAST(user_id AS VARCHAR) AS container_id, min(ts) AS at FROM events GROUP BY ALL")
def S21_first_flags(spark, d):
    flags = A._table(spark, d, "events").selectExpr("event_type as version", "cast(user_id as string) as container_id", "'s' as session", "props as query", "ts as at")
    return ingest.record_flags(flags, b"key").select("version", "container_id", "at")


@query("SELECT version, sub_type, count(DISTINCT spell) AS sets FROM entries WHERE base_type = 'book' AND NOT artefact GROUP BY ALL HAVING sets > 1")
def S13_fixed_set_conflicts(spark, d):
    _, conflicts = ingest.sync_fixed_sets(A.entries(spark, d))
    return conflicts.groupBy("version", "sub_type").agg(F.count("*").alias("sets"))


# ---- views


_PARCHMENT = "base_type = 'book' AND sub_type = 'ring' AND NOT artefact"
#: Everything in a place; a book of one kind is named by its spell.
_ROWS = """keys AS (SELECT DISTINCT version, container_id, CAST(container_id AS BIGINT) AS k FROM entries),
rows_ AS (SELECT version, container_id, place, 'items' AS category, base_type, sub_type, ego, cost, artefact, NULL AS feat,
    CASE WHEN {parchment} THEN 'parchment of ' || spell ELSE coalesce(name, base_type || ' ' || sub_type) END AS label,
    CASE WHEN base_type = 'book' THEN ' (' || spell || ')' ELSE '' END || CASE WHEN artefact THEN ' {{' || prop1 || ' ' || CAST(value1 AS VARCHAR) || ', ' || prop2 || ' ' || CAST(value2 AS VARCHAR) || '}}' ELSE '' END AS more FROM entries
  UNION ALL SELECT version, container_id, place, 'features', NULL, NULL, NULL, NULL, NULL, feat, feat, '' FROM features
  UNION ALL SELECT version, container_id, 'D:1', 'monsters', NULL, NULL, NULL, NULL, NULL, NULL, beast, '' FROM keys, (VALUES ('orc'), ('rat')) b(beast) WHERE k % 3 = 0
  UNION ALL SELECT version, container_id, 'D:1', 'vaults', NULL, NULL, NULL, NULL, NULL, NULL, 'a vault', '' FROM keys WHERE k % 5 = 4)""".format(parchment=_PARCHMENT)


def _rows(spark, d):
    """(entries, everything in a place)."""
    held = A.entries(spark, d).withColumn("name", F.expr(f"case when {_PARCHMENT} then concat('parchment of ', spells[0]) else name end"))
    return held, A.place_rows(held)


@query("""SELECT l.version, l.container_id, l.place, l.parent, count(e.place) AS entries, coalesce(string_agg(label || more, '; ' ORDER BY category, label, label || more), '') AS listing
  FROM (SELECT * FROM levels UNION ALL SELECT version, container_id, 'Zot:5', NULL FROM keys WHERE k % 2 = 0) l LEFT JOIN rows_ e USING (version, container_id, place) GROUP BY ALL""", _ROWS)
def V1_container_detail(spark, d):
    held, rows = _rows(spark, d)
    empty = held.where("cast(container_id as long) % 2 = 0").select(KEY).distinct().selectExpr("version", "container_id", "'Zot:5' as place", "cast(null as string) as parent")
    return views.container_detail(A.levels_of(held).unionByName(empty), rows)


@query("""SELECT l.version, l.container_id, temple, portals, coalesce(artefacts, 0) AS artefacts, coalesce(xp, 0) AS xp, coalesce(acq, 0) AS acq, coalesce(altars, '') AS altars
  FROM (SELECT version, container_id, coalesce(string_agg(place || '@' || parent, ',') FILTER (WHERE place = 'Sewer' AND parent IS NOT NULL), '') AS portals FROM levels GROUP BY ALL) l
  LEFT JOIN (SELECT version, container_id, count(*) FILTER (WHERE artefact) AS artefacts, CAST(sum(coalesce(quantity, 1)) FILTER (WHERE base_type = 'potion' AND sub_type = 'ring') AS BIGINT) AS xp,
    CAST(sum(coalesce(quantity, 1)) FILTER (WHERE base_type = 'scroll' AND sub_type = 'bolt') AS BIGINT) AS acq FROM entries WHERE cost IS NULL GROUP BY ALL) a USING (version, container_id)
  LEFT JOIN (SELECT version, container_id, min(place) FILTER (WHERE feat = 'enter_temple') AS temple, string_agg(feat, ',') FILTER (WHERE feat = 'altar_trog') AS altars FROM features GROUP BY ALL) f USING (version, container_id)""")
def V2_summaries(spark, d):
    return views.summaries(A.entries(spark, d), A.levels(spark, d), A.features(spark, d), (("potion", "ring", "xp"), ("scroll", "bolt", "acq")), ("altar_trog",))


@query("SELECT version, container_id, place, count(*) AS stock, round(sum(cost), 2) AS total, count(*) FILTER (WHERE artefact) AS artefacts FROM entries WHERE cost IS NOT NULL GROUP BY ALL")
def V4_shops(spark, d):
    return views.shops(A.entries(spark, d)).withColumn("total", F.round("total", 2))


_SECTIONS = _ROWS + f""", sections AS (SELECT *, CASE WHEN category = 'monsters' THEN 'monsters' WHEN category = 'items' AND cost IS NOT NULL OR feat = 'enter_shop' THEN 'shops'
    WHEN category = 'items' THEN CASE WHEN rank < 3 THEN 'notable' ELSE 'sundries' END WHEN feat LIKE 'altar_%' THEN 'altars' WHEN feat LIKE 'enter_%' THEN 'ways_on' ELSE 'features' END AS section
  FROM (SELECT version, container_id, place, category, feat, cost, label, CASE WHEN category = 'items' AND cost IS NULL THEN CASE WHEN artefact THEN 1 WHEN ego IS NOT NULL THEN 2 WHEN base_type = 'book' AND NOT ({_PARCHMENT}) THEN 2 ELSE 3 END END AS rank FROM rows_)
  UNION ALL SELECT version, container_id, place, 'features', feat, NULL, feat, NULL, 'altars' FROM levels, (VALUES (0, '{places.ALTARS[0]}'), (1, '{places.ALTARS[1]}'), (2, '{places.ALTARS[2]}')) b(bit, feat)
    WHERE place = 'Temple' AND (CAST(container_id AS BIGINT) >> bit) % 2 = 1)"""


@query("SELECT version, place, section, count(*) AS n FROM sections GROUP BY ALL", _SECTIONS)
def V3_place_sections(spark, d):
    held, rows = _rows(spark, d)
    return views.place_sections(rows, A.masked_levels_of(held)).groupBy("version", "place", "section").agg(F.count("*").alias("n"))


@query("SELECT version, container_id, place, section, label, CAST(row_number() OVER (PARTITION BY version, container_id, place, section ORDER BY rank NULLS FIRST, cost DESC NULLS LAST, label) AS INTEGER) AS position FROM sections", _SECTIONS)
def O7_ordered_sections(spark, d):
    held, rows = _rows(spark, d)
    return views.ordered_sections(views.place_sections(rows, A.masked_levels_of(held))).select(*views.PLACE, "section", "label", "position")


@query(f"""SELECT version, container_id, CASE feat WHEN 'enter_temple' THEN 'Temple' ELSE 'Sewer' END AS branch, place, {reach_sql('place')} AS reach, CAST(k % 80 AS INTEGER) AS x, CAST(k % 70 AS INTEGER) AS y,
    CASE WHEN feat = 'enter_sewer' THEN CAST(k % 50 * 10 AS INTEGER) END AS timeout_turns, CASE WHEN k % 7 = 0 THEN CAST(k % 90 AS VARCHAR) || ' gold' END AS toll_note,
    CAST(row_number() OVER (PARTITION BY version, container_id ORDER BY {reach_sql('place')}, CASE feat WHEN 'enter_temple' THEN 'Temple' ELSE 'Sewer' END, place) AS INTEGER) AS position
  FROM (SELECT *, CAST(container_id AS BIGINT) AS k FROM features WHERE feat IN ('enter_temple', 'enter_sewer')
    UNION ALL SELECT version, container_id, 'D:' || CAST(k % 4 + 1 AS VARCHAR), 'enter_sewer', k FROM (SELECT DISTINCT version, container_id, CAST(container_id AS BIGINT) AS k FROM entries) WHERE k % 3 = 0)""")
def V7_entrances(spark, d):
    """With a second entrance in each third container."""
    e = A.entries(spark, d)
    second = e.select(KEY).distinct().where("cast(container_id as long) % 3 = 0").selectExpr("version", "container_id", "concat('D:', cast(cast(container_id as long) % 4 + 1 as string)) as place", "'enter_sewer' as feat")
    k = "cast(container_id as long)"
    ways = A.features_of(e).unionByName(second).selectExpr("*", f"cast({k} % 80 as int) as x", f"cast({k} % 70 as int) as y", f"case when feat = 'enter_sewer' then cast({k} % 50 * 10 as int) end as timeout_turns", f"case when {k} % 7 = 0 then concat(cast({k} % 90 as string), ' gold') end as toll_note")
    return views.entrances(ways, A.levels(spark, d))


_GROUPS = [("A", "potion", ("ring", "bolt")), ("B", "weapon", ("gear", "ring")), ("C", "nothing", ("none",))]


@query("""SELECT k.version, k.container_id, group_name, CASE count(DISTINCT sub_type) WHEN 0 THEN 'unseen' WHEN 1 THEN 'drew ' || min(sub_type) ELSE 'conflict ' || string_agg(DISTINCT sub_type, ',' ORDER BY sub_type) END AS drawn
  FROM (SELECT DISTINCT version, container_id FROM entries) k CROSS JOIN (VALUES ('A', 'potion'), ('B', 'weapon'), ('C', 'nothing')) g(group_name, base)
  LEFT JOIN entries e ON e.version = k.version AND e.container_id = k.container_id AND e.base_type = base AND ((group_name = 'A' AND sub_type IN ('ring', 'bolt')) OR (group_name = 'B' AND sub_type IN ('gear', 'ring'))) GROUP BY ALL""")
def V8_exclusion_draws(spark, d):
    return views.exclusion_draws(A.entries(spark, d), _GROUPS)


@query("""SELECT version, container_id, place, rank, label || CASE WHEN count(*) > 1 THEN ' x' || CAST(count(*) AS VARCHAR) ELSE '' END AS line FROM
  (SELECT *, CASE WHEN artefact THEN 0 WHEN cost IS NOT NULL THEN 1 ELSE 2 END AS rank, coalesce(name, base_type || ' ' || sub_type) AS label FROM entries) GROUP BY version, container_id, place, rank, label""")
def V9_report_lines(spark, d):
    return views.report_lines(A.entries(spark, d))


@query("SELECT v.version, r.name, count(e.name) AS seen FROM (SELECT DISTINCT version FROM entries) v CROSS JOIN (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part) r LEFT JOIN entries e ON e.version = v.version AND e.name = r.name GROUP BY ALL")
def V12_roster_coverage(spark, d):
    roster = A._table(spark, d, "part").selectExpr("concat(p_name, ' ', p_brand) as name").distinct()
    return views.roster_coverage(roster, A.entries(spark, d))


@query(f"SELECT version, container_id, place, CASE WHEN place = 'Sewer' THEN {reach_sql('parent')} ELSE {reach_sql('place')} END AS reach, split_part(coalesce(CASE WHEN place = 'Sewer' THEN parent ELSE place END, place), ':', 1) AS branch, CAST(place = 'Sewer' AS INTEGER) AS portal FROM levels")
def O9_reach_order(spark, d):
    return views.reach_order(A.levels(spark, d))


@query(f"""SELECT l.version, l.container_id, l.place, CASE WHEN l.place = 'Sewer' THEN f.place END AS parent FROM levels l LEFT JOIN (SELECT version, container_id, min(place) AS place FROM features WHERE feat = 'enter_sewer' GROUP BY ALL) f USING (version, container_id)""")
def J9_recover_parents(spark, d):
    return views.recover_parents(A.levels(spark, d).withColumn("parent", F.lit(None).cast("string")), A.features(spark, d))


# ---- audits and population


@query("SELECT version, count(DISTINCT container_id) AS containers, count(*) AS entries, CAST(min(CAST(container_id AS BIGINT)) AS VARCHAR) AS low, CAST(max(CAST(container_id AS BIGINT)) AS VARCHAR) AS high FROM entries GROUP BY version")
def D1_summary(spark, d):
    return audit.audit_summary(A.entries(spark, d))


@query("SELECT version, container_id, depth, places, most, held FROM (SELECT o.*, f.depth, max(places) OVER (PARTITION BY version, depth) AS most FROM (SELECT version, container_id, count(*) AS places, string_agg(place, ',' ORDER BY place) AS held FROM levels WHERE place <> 'Sewer' GROUP BY ALL) o JOIN fills f USING (version, container_id)) WHERE places < most")
def D2_short_containers(spark, d):
    return audit.audit_short(A.levels(spark, d), A.fills(spark, d))


@query("SELECT version, container_id, depth, origin FROM fills WHERE depth < 8")
def D3_truncated(spark, d):
    return audit.audit_truncated(A.fills(spark, d))


@query("SELECT DISTINCT version, container_id FROM levels ANTI JOIN (SELECT * FROM fills WHERE depth >= 8) USING (version, container_id)")
def D4_unfilled(spark, d):
    return audit.audit_unfilled(A.levels(spark, d), A.fills(spark, d).where("depth >= 8"))


@query("SELECT CAST(k AS VARCHAR) AS container_id, CASE WHEN origin IS NULL THEN 'missing' ELSE 'submitted' END AS state FROM range(1, 301) t(k) LEFT JOIN (SELECT * FROM fills WHERE version = 'N') f ON container_id = CAST(k AS VARCHAR) WHERE origin IS NULL OR origin = 'submit'")
def D6_range(spark, d):
    return audit.audit_range(A.fills(spark, d), "N", 1, 300)


@query("SELECT DISTINCT prop FROM props WHERE prop NOT IN ('P0', 'P1', 'P2')")
def D7_undeclared(spark, d):
    seen = A.entries(spark, d).select(F.explode("props.prop").alias("prop")).distinct()
    return audit.undeclared(seen, spark.createDataFrame([("P0",), ("P1",), ("P2",)], "prop string"))


#: The nearest second, of two the even one, as the SQL's cast of a moment with a fraction gives it.
_MOMENT = "cast(rint(unix_micros(cast(ts as timestamp)) / 1e6D) as bigint)"


@query("SELECT bucket, count(*) AS runs, round(count(*) * 60 / sum(value), 6) AS per_min FROM (SELECT CAST(floor((moment - lo) / ((hi - lo + 1) / 10)) AS INTEGER) AS bucket, value FROM (SELECT CAST(epoch(ts) AS BIGINT) AS moment, value FROM events), (SELECT min(CAST(epoch(ts) AS BIGINT)) AS lo, max(CAST(epoch(ts) AS BIGINT)) AS hi FROM events)) GROUP BY bucket")
def D8_rate_curve(spark, d):
    log = A._table(spark, d, "events").selectExpr(f"{_MOMENT} as at", "1 as seeds", "value as secs")
    return audit.rate_curve(log, 10).withColumn("per_min", F.round("per_min", 6))


@query("""SELECT round(f, 6) AS first, round(l, 6) AS last, round((l - f) * 100 / f, 6) AS percent FROM (SELECT count(*) FILTER (WHERE bucket = 0) * 60 / sum(value) FILTER (WHERE bucket = 0) AS f, count(*) FILTER (WHERE bucket = 9) * 60 / sum(value) FILTER (WHERE bucket = 9) AS l
  FROM (SELECT CAST(floor((moment - lo) / ((hi - lo + 1) / 10)) AS INTEGER) AS bucket, value FROM (SELECT CAST(epoch(ts) AS BIGINT) AS moment, value FROM events), (SELECT min(CAST(epoch(ts) AS BIGINT)) AS lo, max(CAST(epoch(ts) AS BIGINT)) AS hi FROM events)))""")
def A16_rate_drift(spark, d):
    log = A._table(spark, d, "events").selectExpr(f"{_MOMENT} as at", "1 as seeds", "value as secs")
    return audit.rate_drift(log, 10).select(*[F.round(c, 6).alias(c) for c in ("first", "last", "percent")])


@query("SELECT DISTINCT base_type, sub_type FROM entries WHERE base_type = 'book'")
def D9_unweighted_kinds(spark, d):
    return audit.audit_weights(A.entries(spark, d), F.broadcast(A.weights(spark)))


@query("SELECT version, place, count(*) AS n FROM entries WHERE name IS NULL AND (base_type IS NULL OR artefact) GROUP BY ALL")
def D10_names(spark, d):
    return audit.audit_names(A.entries(spark, d)).groupBy("version", "place").agg(F.count("*").alias("n"))


@query("SELECT version, avg(kinds) AS mean_kinds, max(kinds) AS most_kinds, round(corr(early, late), 9) AS r FROM (SELECT version, container_id, count(DISTINCT base_type || ':' || sub_type) AS kinds, count(DISTINCT CASE WHEN place IN ('D:1', 'D:2', 'D:3') THEN base_type || ':' || sub_type END) AS early, count(DISTINCT CASE WHEN place NOT IN ('D:1', 'D:2', 'D:3') THEN base_type || ':' || sub_type END) AS late FROM entries GROUP BY ALL) GROUP BY version")
def N2_richness(spark, d):
    return audit.richness(A.entries(spark, d)).withColumn("r", F.round("r", 9))


_SETS = "sets AS (SELECT DISTINCT version, container_id, base_type || ':' || sub_type AS kind FROM entries), total AS (SELECT version, count(DISTINCT container_id) AS n FROM sets GROUP BY version), single AS (SELECT version, kind, count(*) AS have FROM sets GROUP BY ALL)"


@query("""SELECT p.version, p.a, p.b, p."both", round(p."both" * n / (x.have * y.have), 9) AS lift FROM (SELECT s.version, s.kind AS a, t.kind AS b, count(*) AS "both" FROM sets s JOIN sets t ON s.version = t.version AND s.container_id = t.container_id AND s.kind < t.kind GROUP BY ALL) p
  JOIN single x ON x.version = p.version AND x.kind = a JOIN single y ON y.version = p.version AND y.kind = b JOIN total ON total.version = p.version""", _SETS)
def N3_pair_lift(spark, d):
    return audit.pair_lift(A.entries(spark, d)).withColumn("lift", F.round("lift", 9))


_RICH = _SETS + """, rich AS (SELECT version, container_id, count(*) // 4 AS bucket FROM sets GROUP BY ALL), sized AS (SELECT version, bucket, count(*) AS n FROM rich GROUP BY ALL),
one AS (SELECT version, bucket, kind, count(*) AS have FROM sets JOIN rich USING (version, container_id) GROUP BY ALL),
pairs AS (SELECT s.version, s.kind AS a, t.kind AS b, count(*) AS "both" FROM sets s JOIN sets t ON s.version = t.version AND s.container_id = t.container_id AND s.kind < t.kind GROUP BY ALL)"""


@query("""SELECT version, a, b, "both", round(e, 6) AS expected, round("both" / e, 6) AS lift FROM (SELECT p.version, p.a, p.b, p."both", sum(x.have * y.have / z.n) AS e FROM pairs p
  JOIN one x ON x.version = p.version AND x.kind = a JOIN one y ON y.version = p.version AND y.kind = b AND y.bucket = x.bucket JOIN sized z ON z.version = p.version AND z.bucket = x.bucket GROUP BY ALL)""", _RICH)
def N3_lift_by_richness(spark, d):
    return audit.lift_by_richness(A.entries(spark, d)).withColumns({c: F.round(c, 6) for c in ("expected", "lift")})


@query("SELECT version, depth, avg(CASE WHEN h.container_id IS NULL THEN 0 ELSE 1 END) AS share, count(*) AS containers FROM fills LEFT JOIN (SELECT DISTINCT version, container_id FROM entries WHERE base_type = 'potion' AND sub_type = 'ring') h USING (version, container_id) GROUP BY ALL")
def N4_cohort_share(spark, d):
    return audit.cohort_share(A.entries(spark, d), A.fills(spark, d), "potion", "ring")


@query("SELECT version, count(*) AS sets, round(sum(-(n / t) * log2(n / t)), 9) AS bits FROM (SELECT version, s, count(*) AS n, sum(count(*)) OVER (PARTITION BY version) AS t FROM (SELECT version, container_id, string_agg(DISTINCT base_type, ',' ORDER BY base_type) AS s FROM entries GROUP BY ALL) GROUP BY version, s) GROUP BY version")
def N5_set_entropy(spark, d):
    return audit.set_entropy(A.entries(spark, d)).withColumn("bits", F.round("bits", 9))


@query("SELECT version, first AS container, CAST(sum(new) OVER (PARTITION BY version ORDER BY first) AS BIGINT) AS kinds FROM (SELECT version, first, count(*) AS new FROM (SELECT version, base_type || ':' || sub_type AS kind, min(CAST(container_id AS BIGINT)) AS first FROM entries GROUP BY ALL) GROUP BY ALL)")
def N5_growth_curve(spark, d):
    return audit.growth_curve(A.entries(spark, d)).withColumn("container", F.col("container").cast("long"))


@query("SELECT version, base_type, count(*) AS entries, count(*) FILTER (WHERE cost IS NOT NULL) AS priced, count(*) FILTER (WHERE artefact) AS artefacts FROM entries GROUP BY ALL")
def N6_class_breakdown(spark, d):
    return audit.class_breakdown(A.entries(spark, d))


@query("SELECT version, place, n, round(n / sum(n) OVER (PARTITION BY version), 9) AS share FROM (SELECT version, place, count(*) AS n FROM features WHERE feat = 'enter_temple' GROUP BY ALL)")
def N6_places_of_feature(spark, d):
    return audit.places_of_feature(A.features(spark, d), "enter_temple").withColumn("share", F.round("share", 9))


@query("SELECT version, container_id, place, 'deep' AS side FROM levels WHERE place LIKE 'Lair%'")
def N7_prefix_extension(spark, d):
    lv = A.levels(spark, d).select(views.PLACE)
    return audit.prefix_extension_diff(lv.where("place not like 'Lair%'"), lv)


@query("SELECT version, shard, min(container_id) AS low, max(container_id) AS high FROM (SELECT version, container_id, CAST(ntile(4) OVER (PARTITION BY version ORDER BY container_id) AS INTEGER) AS shard FROM (SELECT DISTINCT version, container_id FROM entries)) GROUP BY ALL")
def W2_key_ranges(spark, d):
    return search.balanced_key_ranges(A.entries(spark, d), 4)


@query("SELECT version, group_name, drawn, count(*) AS containers FROM (" + ORACLES["V8_exclusion_draws"].split("\n", 1)[1][ORACLES["V8_exclusion_draws"].split("\n", 1)[1].index("SELECT k.version"):] + ") GROUP BY ALL")
def N1_exclusion_stats(spark, d):
    return audit.exclusion_stats(views.exclusion_draws(A.entries(spark, d), _GROUPS))


@query("SELECT version, count(*) AS containers, count(*) FILTER (WHERE conflict) AS conflicts, count(DISTINCT state) AS states FROM (SELECT version, container_id, bool_or(drawn LIKE 'conflict%') AS conflict, string_agg(drawn, '|' ORDER BY group_name) AS state FROM (" + ORACLES["V8_exclusion_draws"].split("\n", 1)[1][ORACLES["V8_exclusion_draws"].split("\n", 1)[1].index("SELECT k.version"):] + ") GROUP BY ALL) GROUP BY version")
def N1_exclusion_states(spark, d):
    return audit.exclusion_states(views.exclusion_draws(A.entries(spark, d), _GROUPS))


# ---- names and words by release

_NAMED = """named AS (SELECT l_returnflag AS version, l_orderkey AS k, l_partkey % 10 AS b, p_size AS s,
    list_value('potion', 'scroll', 'wand', 'staff', 'weapon', 'armour', 'jewellery', 'miscellaneous', 'gold', NULL)[l_partkey % 10 + 1] AS base,
    CASE l_partkey % 10 WHEN 5 THEN list_value('gloves', 'orb', 'robe')[p_size % 3 + 1] WHEN 7 THEN list_value('lightning rod', 'phial of floods')[p_size % 2 + 1] ELSE split_part(p_name, ' ', 2) END AS sub,
    p_size % 4 AS q, p_size % 7 - 3 AS plus, CASE WHEN l_partkey % 10 = 4 THEN list_value('flame', 'vamp', 'holy', 'none such', NULL)[p_size % 5 + 1] ELSE list_value('rF+', 'harm', 'Harm', NULL)[p_size % 4 + 1] END AS ego,
    l_partkey % 11 = 0 AS artefact FROM lineitem JOIN part ON l_partkey = p_partkey),
shown AS (SELECT *, printf('%+d', plus) || ' ' AS sign, CASE WHEN artefact THEN NULL WHEN b <= 1 AND q > 1 THEN CAST(q AS VARCHAR) || ' ' || base || 's of ' || sub WHEN b IN (0, 1, 3) THEN base || ' of ' || sub
    WHEN b = 2 THEN 'wand of ' || sub || ' (' || CAST(plus AS VARCHAR) || ')'
    WHEN b = 4 THEN sign || CASE ego WHEN 'flame' THEN sub || ' of flaming' WHEN 'vamp' THEN 'vampiric ' || sub WHEN 'holy' THEN sub || ' of holy wrath' ELSE sub END
    WHEN b = 5 THEN CASE WHEN sub = 'orb' THEN '' ELSE sign END || CASE WHEN sub = 'gloves' THEN 'pair of gloves' ELSE sub END || CASE WHEN ego = 'rF+' THEN ' of fire resistance' WHEN ego IN ('harm', 'Harm') THEN ' of harm' ELSE '' END
    WHEN b = 6 THEN CASE WHEN plus = 0 THEN '' ELSE sign END || sub WHEN b = 7 THEN sub || CASE WHEN sub = 'lightning rod' THEN ' (4/4)' ELSE '' END END AS name FROM named)"""


def _named(spark, d):
    """Items of every class, with what their names are made of."""
    lines, part = A._table(spark, d, "lineitem").select("l_returnflag", "l_partkey"), A._table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return lines.join(part, F.expr("l_partkey = p_partkey")).selectExpr(
        "l_returnflag as version",
        "'items' as category",
        "cast(null as string) as feat",
        "cast(null as string) as shop_type",
        "array('potion', 'scroll', 'wand', 'staff', 'weapon', 'armour', 'jewellery', 'miscellaneous', 'gold', null)[cast(l_partkey % 10 as int)] as base_type",
        "case l_partkey % 10 when 5 then array('gloves', 'orb', 'robe')[cast(p_size % 3 as int)] when 7 then array('lightning rod', 'phial of floods')[cast(p_size % 2 as int)] else split_part(p_name, ' ', 2) end as sub_type",
        "cast(p_size % 4 as int) as quantity",
        "cast(p_size % 7 - 3 as int) as plus",
        "case when l_partkey % 10 = 4 then array('flame', 'vamp', 'holy', 'none such', null)[cast(p_size % 5 as int)] else array('rF+', 'harm', 'Harm', null)[cast(p_size % 4 as int)] end as ego",
        "l_partkey % 11 = 0 as artefact",
        "p_name as name",
    )


@query("SELECT version, name, count(*) AS n FROM shown GROUP BY ALL", _NAMED)
def F5_display_names(spark, d):
    named = _named(spark, d)
    return named.withColumn("name", naming.display_name(*map(F.col, views.NAMED_BY))).groupBy("version", "name").agg(F.count("*").alias("n"))


_FEATS = ("altar_trog", "enter_shop", "enter_temple", "enter_ice_cave", "unheard_of", "altar_the_shining_one")


@query("""SELECT name, count(*) AS n FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'a bloodstained altar of Trog' WHEN 2 THEN 'a staircase to the Ecumenical Temple' WHEN 3 THEN 'a frozen archway' WHEN 5 THEN 'a glowing golden altar of the Shining One'
  WHEN 1 THEN CASE o_custkey % 4 WHEN 0 THEN 'a shop' WHEN 1 THEN 'a General Store' ELSE CASE WHEN left(split_part(o_orderpriority, '-', 2), 1) IN ('A', 'E', 'I', 'O', 'U') THEN 'an ' ELSE 'a ' END || split_part(o_orderpriority, '-', 2) || ' Shop' END END AS name FROM orders) GROUP BY name""")
def F5_feature_names(spark, d):
    feat = F.array(*map(F.lit, _FEATS))[(F.col("o_orderkey") % 6).cast("int")]
    kind = F.expr("case o_custkey % 4 when 0 then '' when 1 then 'General Store' else case when contains(o_orderpriority, '-') then split_part(o_orderpriority, '-', 2) else '' end end")
    return A._table(spark, d, "orders").select(naming.feature_name(feat, kind).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT version, base AS base_type, count(*) AS n, count(*) FILTER (WHERE name IS NULL) AS stored, count(DISTINCT coalesce(name, '?')) AS names FROM shown GROUP BY ALL", _NAMED)
def S9_elided_names(spark, d):
    """How many entries of each class must store a name, and how many names there are after all are given back ('?' for stored ones)."""
    kept = views.elide_names(_named(spark, d)).withColumn("stored", F.col("name").isNotNull())
    full = views.full_names(kept.withColumn("name", F.when(F.col("stored"), "?")))
    return full.groupBy("version", "base_type").agg(F.count("*").alias("n"), F.count_if("stored").alias("stored"), F.countDistinct("name").alias("names"))


_TYPED_WORDS = """typed AS (SELECT '0.' || CAST(33 + l_linenumber % 2 AS VARCHAR) || '.' || CAST(l_suppkey % 2 AS VARCHAR) AS version, CASE WHEN l_partkey % 2 = 0 THEN 'weapon' ELSE 'armour' END AS base,
    list_value('Harm', 'FIRE Resistance', 'rampaging', 'spirit shield', 'nonsense', 'sundering', 'Reaping')[l_orderkey % 7 + 1] AS word, list_value('alch', 'Alchemy', 'rf', 'BDAM', 'zz', '*slow', 'NUPGR')[l_orderkey % 7 + 1] AS prop FROM lineitem)"""


def _typed(spark, d):
    return A._table(spark, d, "lineitem").selectExpr(
        "concat('0.', cast(33 + l_linenumber % 2 as string), '.', cast(l_suppkey % 2 as string)) as version",
        "case when l_partkey % 2 = 0 then 'weapon' else 'armour' end as base",
        "array('Harm', 'FIRE Resistance', 'rampaging', 'spirit shield', 'nonsense', 'sundering', 'Reaping')[cast(l_orderkey % 7 as int)] as word",
        "array('alch', 'Alchemy', 'rf', 'BDAM', 'zz', '*slow', 'NUPGR')[cast(l_orderkey % 7 as int)] as prop",
    )


@query("""SELECT version, base, word, CASE WHEN base = 'weapon' THEN CASE word WHEN 'sundering' THEN 'sunder' WHEN 'Reaping' THEN 'reap' END ELSE CASE word WHEN 'Harm' THEN CASE WHEN version = '0.34.1' THEN 'Harm' ELSE 'harm' END
    WHEN 'rampaging' THEN CASE WHEN version = '0.34.1' THEN 'Rampage' ELSE 'rampage' END WHEN 'FIRE Resistance' THEN 'rF+' WHEN 'spirit shield' THEN 'Spirit' END END AS code,
  CASE WHEN (base = 'armour' AND word = 'spirit shield') OR (base = 'weapon' AND word = 'Reaping') THEN 'only ever on artefacts' END AS refusal, count(*) AS n FROM typed GROUP BY ALL""", _TYPED_WORDS)
def F12_brand_codes(spark, d):
    base, word = F.col("base"), F.col("word")
    return _typed(spark, d).groupBy("version", "base", "word", naming.brand_code(base, word, F.col("version")).alias("code"), naming.brand_refusal(base, word).alias("refusal")).agg(F.count("*").alias("n"))


@query("""SELECT version, prop, CASE prop WHEN 'alch' THEN CASE WHEN version <> '0.33.0' THEN 'Alch' END WHEN 'Alchemy' THEN CASE WHEN version = '0.33.0' THEN 'Alchemy' END WHEN 'rf' THEN 'rF' WHEN 'BDAM' THEN 'BDam' WHEN '*slow' THEN '*Slow' WHEN 'NUPGR' THEN 'nupgr' END AS name,
  CASE WHEN prop = 'alch' AND version = '0.33.0' THEN 'Alchemy' WHEN prop = 'Alchemy' AND version <> '0.33.0' THEN 'Alch' END AS elsewhere,
  CASE prop WHEN '*slow' THEN 'a drawback' WHEN 'NUPGR' THEN 'an internal flag' END AS refusal, count(*) AS n FROM typed GROUP BY ALL""", _TYPED_WORDS)
def F13_property_names(spark, d):
    prop, version = F.col("prop"), F.col("version")
    name = naming.property_name(prop, version)
    return _typed(spark, d).groupBy("version", "prop", name.alias("name"), naming.property_elsewhere(prop, version).alias("elsewhere"), naming.property_refusal(name).alias("refusal")).agg(F.count("*").alias("n"))


_BOOKS = """books AS (SELECT l_returnflag AS version, p_size AS s, CASE WHEN p_size % 3 = 0 THEN list_value('S' || CAST(p_size AS VARCHAR)) WHEN p_size % 3 = 1 AND l_returnflag <> 'N' THEN list_value('S1', 'S2') ELSE list_value('S' || CAST(p_size AS VARCHAR), 'S9') END AS spells
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("SELECT version, spell, CASE WHEN level >= 8 THEN 'high' WHEN level >= 5 THEN 'mid' ELSE 'low' END AS tier, n FROM (SELECT version, spell, CAST(substr(spell, 2) AS INTEGER) % 9 + 1 AS level, count(*) AS n FROM (SELECT version, unnest(spells) AS spell FROM books) GROUP BY ALL)", _BOOKS)
def J10_entry_spells(spark, d):
    """Spells of parchments, of kinds whose set the release fixes, and of entries that store their own, with the tiers of F19."""
    lines, part = A._table(spark, d, "lineitem").select("l_returnflag", "l_partkey"), A._table(spark, d, "part").select("p_partkey", "p_size")
    books = lines.join(part, F.expr("l_partkey = p_partkey")).selectExpr("l_returnflag as version", "case p_size % 3 when 0 then concat('parchment of S', cast(p_size as string)) when 1 then 'book of A' else 'book of B' end as sub_type", "array(concat('S', cast(p_size as string)), 'S9') as spells")
    fixed = lines.where("l_returnflag <> 'N'").select(F.col("l_returnflag").alias("version")).distinct().selectExpr("version", "'book of A' as sub_type", "array('S1', 'S2') as spells")
    counted = views.with_spells(books, fixed).select("version", F.explode("spells").alias("spell")).groupBy("version", "spell").agg(F.count("*").alias("n"))
    return counted.join(A.spell_levels(spark), "spell").select("version", "spell", naming.spell_tier(F.col("spell_level")).alias("tier"), "n")


@query("""SELECT l.version, l.container_id, l.place, concat_ws('; ',
    CASE WHEN coalesce(a, 0) + sold > 0 THEN CAST(coalesce(a, 0) + sold AS VARCHAR) || ' artefact' || CASE WHEN coalesce(a, 0) + sold = 1 THEN '' ELSE 's' END || CASE WHEN sold = 0 THEN '' WHEN coalesce(a, 0) = 0 THEN ', all for sale' ELSE ', ' || CAST(sold AS VARCHAR) || ' of them for sale' END END,
    CASE WHEN l.place <> 'Temple' AND feat = 'altar_trog' THEN 'Trog' END, CASE WHEN l.place = 'D:1' AND k % 3 = 0 THEN 'orc, rat' END, CASE WHEN feat IN ('enter_temple', 'enter_sewer') THEN '1 way on' END, CASE WHEN feat = 'enter_shop' THEN '1 shop' END,
    CASE WHEN l.place = 'Temple' THEN CAST(bit_count(k % 8) AS VARCHAR) || CASE WHEN bit_count(k % 8) = 1 THEN ' altar' ELSE ' altars' END END, CASE WHEN k % 4 > 0 THEN CAST(k % 4 * 10 AS VARCHAR) || ' floor gold' END) AS facts
  FROM (SELECT l.*, CAST(l.container_id AS BIGINT) AS k, feat, a, CASE WHEN feat = 'enter_shop' THEN coalesce(s, 0) ELSE 0 END AS sold FROM levels l LEFT JOIN features f USING (version, container_id, place)
    LEFT JOIN (SELECT version, container_id, place, count(*) FILTER (WHERE artefact AND cost IS NULL) AS a, count(*) FILTER (WHERE artefact AND cost IS NOT NULL) AS s FROM entries GROUP BY ALL) e USING (version, container_id, place)) l""")
def V6_standing_facts(spark, d):
    held = A.entries(spark, d).select(views.PLACE + ["row_parent", "artefact", "cost"])
    items = held.select(*views.PLACE, F.lit("items").alias("category"), "artefact", "cost")
    keys = held.select(KEY).distinct().withColumn("k", F.col("container_id").cast("long"))
    feats = keys.selectExpr("version", "container_id", "concat('D:', cast(k % 7 + 1 as string)) as place", "'features' as category", f"{A.FEAT.replace('o_custkey', 'k')} as feat")
    beasts = keys.where("k % 3 = 0").selectExpr("version", "container_id", "'D:1' as place", "'monsters' as category", "posexplode(array('orc', 'rat')) as (entry_order, name)")
    rows = items.unionByName(feats.where("feat is not null"), True).unionByName(beasts, True).withColumns({c: F.lit(None).cast("int") for c in ("x", "y", "item_order")})
    levels = A.levels_of(held).withColumns({"altar_mask": F.expr("case when place = 'Temple' then cast(cast(container_id as bigint) % 8 as int) end"), "gold": F.expr("cast(cast(container_id as bigint) % 4 * 10 as int)")})
    return views.standing_facts(rows, levels).select(*views.PLACE, F.array_join("facts", "; ").alias("facts"))


# ---- registry, altars, shops, flags and streams


@query("SELECT l_returnflag AS version, min(l_shipdate) AS first_seen FROM lineitem GROUP BY ALL")
def S12_versions(spark, d):
    return ingest.register_versions(A._table(spark, d, "lineitem").selectExpr("l_returnflag as version", "l_shipdate as ingested_at"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def S20_json_lines(spark, d):
    return parse_jsonl(A._table(spark, d, "events").select(F.col("props").alias("value")), "k long").groupBy("k").agg(F.count("*").alias("n"))


def _altars(spark, d):
    """Levels with masks, and the features left: altars of even containers stand in the Temple."""
    placed = A.features(spark, d).withColumn("place", F.expr("case when feat = 'altar_trog' and cast(container_id as bigint) % 2 = 0 then 'Temple' else place end"))
    return ingest.encode_altar_mask(A.levels(spark, d), placed)


_TROG = "(SELECT version, container_id, place, feat FROM features WHERE feat = 'altar_trog' AND CAST(container_id AS BIGINT) % 2 = {})"


@query(f"SELECT l.version, l.container_id, l.place, l.parent, CASE WHEN l.place = 'Temple' THEN CAST(CASE WHEN f.feat IS NULL THEN 0 ELSE {1 << places.ALTARS.index('altar_trog')} END AS INTEGER) END AS altar_mask FROM levels l LEFT JOIN {_TROG.format(0)} f ON l.version = f.version AND l.container_id = f.container_id")
def S8_altar_masks(spark, d):
    return _altars(spark, d)[0].select(*views.PLACE, "parent", "altar_mask")


@query(f"SELECT l.version, l.container_id, l.place, feat FROM levels l JOIN {_TROG.format(0)} f ON l.version = f.version AND l.container_id = f.container_id WHERE l.place = 'Temple' UNION SELECT * FROM {_TROG.format(1)}")
def V5_altars(spark, d):
    return views.altars(*_altars(spark, d))


@query("SELECT e.version, CASE WHEN f.feat IS NOT NULL THEN 'general' END AS shop_type, count(*) AS stock FROM entries e LEFT JOIN (SELECT *, CASE WHEN CAST(container_id AS BIGINT) % 2 = 0 THEN 1 END AS y FROM features WHERE feat = 'enter_shop') f ON e.version = f.version AND e.container_id = f.container_id AND e.place = f.place AND e.quantity IS NOT DISTINCT FROM f.y WHERE cost IS NOT NULL GROUP BY ALL")
def J8_shop_stock(spark, d):
    """Goods lie at their quantity's spot, some at none; shops at the first or at none."""
    none = {"x": F.lit(None).cast("int"), "shop_type": F.lit(None).cast("string")}
    rows = A.entries(spark, d).select(*views.PLACE, "cost", F.col("quantity").alias("y")).withColumns(none | {"feat": F.lit(None).cast("string")})
    at = F.when(F.col("container_id").cast("long") % 2 == 0, F.lit(1))
    feats = A.features(spark, d).withColumns(none | {"y": at, "cost": F.lit(None).cast("double"), "shop_type": F.lit("general")})
    return views.shop_stock(rows.unionByName(feats)).groupBy("version", "shop_type").agg(F.count("*").alias("stock"))


@query("SELECT DISTINCT place, place = 'Sewer' AS portal, CASE WHEN place = 'Sewer' THEN 'enter_sewer' END AS feat, split_part(place, ':', 1) AS branch FROM levels")
def F3_portals(spark, d):
    p = F.col("place")
    return A.levels(spark, d).select("place", places.is_portal(p).alias("portal"), places.portal_feat(p).alias("feat"), places.branch_of_place(p).alias("branch")).distinct()


@query("SELECT version, container_id, CAST(count(*) AS BIGINT) AS n1 FROM (SELECT * FROM entries WHERE quantity IS NULL AND artefact AND name = (SELECT min(p_name || ' ' || p_brand) FROM part WHERE p_partkey % 5 = 0)) GROUP BY ALL")
def P4_unique(spark, d):
    name = A._table(spark, d, "part").where("p_partkey % 5 = 0").agg(F.min(F.concat("p_name", F.lit(" "), "p_brand"))).first()[0]
    rows = A.entries(spark, d).where("quantity is null").withColumn("unique", F.col("artefact"))
    return search.search(rows, [Term(Unique(name or ""))])


@query("SELECT version, version <> 'R' AS current FROM fills GROUP BY version")
def I8_currency(spark, d):
    counts = ingest.sample_counts(A.fills(spark, d)).select("version", "sampled")
    return index.is_current(counts.where("version <> 'R'"), counts)


@query("SELECT version, count(*) AS kept, count(*) FILTER (WHERE origin = 'fill') AS counted FROM fills GROUP BY version HAVING kept <> counted")
def D5_counter(spark, d):
    f = A.fills(spark, d)
    number = lambda rows: rows.groupBy("version").agg(F.count("*").alias("n"))
    return audit.audit_counter(number(f), number(f.where("origin = 'fill'")))


@query("SELECT DISTINCT version, container_id FROM (SELECT substr('ANR', CAST(event_id % 3 AS INTEGER) + 1, 1) AS version, CAST(user_id AS VARCHAR) AS container_id FROM events) SEMI JOIN fills USING (version, container_id)")
def J16_flagged_present(spark, d):
    flags = A._table(spark, d, "events").selectExpr("substr('ANR', cast(event_id % 3 as int) + 1, 1) as version", "cast(user_id as string) as container_id").distinct()
    return views.flagged_present(flags, A.fills(spark, d))


def _event_stream(spark, d):
    return spark.readStream.schema(A._table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


@query("SELECT event_type AS version, CASE WHEN user_id % 20 = 0 THEN 'submit' ELSE 'fill' END AS origin, count(*) AS arrivals FROM events GROUP BY ALL")
def T4_arrivals(spark, d):
    source = _event_stream(spark, d).selectExpr("event_type as version", "case when user_id % 20 = 0 then 'submit' else 'fill' end as origin")
    return stream.finished(stream.stream_counts(source), "complete")


_SESSIONS = "SELECT event_type AS version, CAST(user_id % 200 AS VARCHAR) AS container_id, event_id % 7 AS s, props AS query, ts AS \"at\" FROM events"
_FLAG = "event_type as version", "cast(user_id % 200 as string) as container_id", "concat('session ', cast(event_id % 7 as string)) as session", "props as query", "ts as at"


@query(f'SELECT version, container_id, substr(query, 1, 500) AS query, "at" FROM (SELECT *, row_number() OVER (PARTITION BY version, container_id, s ORDER BY "at", query) AS r FROM ({_SESSIONS})) WHERE r = 1')
def S21_first_flags_of_sessions(spark, d):
    """Seven sessions flag the same containers again and again: the first flag of each stays, and sessions are told apart by their hashes."""
    flags = ingest.record_flags(A._table(spark, d, "events").selectExpr(*_FLAG), b"key")
    return flags.where(F.col("session").rlike("^[0-9a-f]{64}$")).select("version", "container_id", "query", "at")


@query(f"SELECT version, container_id, count(DISTINCT s) AS sessions FROM ({_SESSIONS}) GROUP BY ALL")
def T5_flag_stream_of_sessions(spark, d):
    first = stream.finished(stream.stream_flags(_event_stream(spark, d).selectExpr(*_FLAG), b"key"))
    return first.groupBy("version", "container_id").agg(F.count("*").alias("sessions"))


@query("SELECT DISTINCT event_type AS version, CAST(user_id AS VARCHAR) AS container_id FROM events")
def T5_flag_stream(spark, d):
    source = _event_stream(spark, d).selectExpr("event_type as version", "cast(user_id as string) as container_id", "'s' as session", "props as query", "ts as at")
    return stream.finished(stream.stream_flags(source, b"key")).select("version", "container_id")
