"""Queries about order: the walk through a container's places, shops by spot, reports as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.naming import spell_tier
from ..functions.tables import fixed_table, rows_of
from ..operators import audit, heat, search, views, walk
from ..sources import adapters as A
from .catalog import query, reach_sql

#: Places beside those of the entries, and features: for containers whose key has the remainder.
_MORE = (("Swamp:1", None, 2, 0), ("Swamp:2", None, 2, 0), ("Slime:1", None, 4, 0), ("Ossuary", "Sewer", 3, 1), ("Bailey", "Ossuary", 6, 1), ("IceCv", None, 7, 3), ("Volcano", "Gauntlet", 11, 5), ("Gauntlet", "Volcano", 11, 5), ("Orc:1", None, 5, 2), ("Elsewhere", "Sewer", 13, 1), ("Snake:1", "Shoals:1", 17, 2), ("Shoals:1", "Snake:1", 17, 2))
_OPEN = (("enter_lair", "D:2", 3, 1), ("enter_lair", "D:3", 3, 2), ("enter_swamp", "Lair:2", 4, 0), ("enter_swamp", "Lair:3", 4, 2), ("enter_slime", "Swamp:2", 4, 0), ("enter_orc", "Orc:1", 5, 2))


def _of_keys(keys, rows, names: tuple[str, str]):
    each = F.array(*[F.struct(F.lit(a).alias(names[0]), F.lit(b).cast("string").alias(names[1]), F.lit(m).alias("m"), F.lit(r).alias("r")) for a, b, m, r in rows])
    k = F.col("container_id").cast("long")
    return keys.select("version", "container_id", F.explode(F.filter(each, lambda x: k % x["m"] == x["r"])).alias("x")).select("version", "container_id", *[f"x.{n}" for n in names])


def _map(spark, d):
    """(levels, features) with places of many branches: portals in portals, circles, openings unknown."""
    lv = A.levels(spark, d).select(*views.PLACE, "parent")
    keys = lv.select("version", "container_id").distinct()
    ways = _of_keys(keys, _OPEN, ("feat", "place")).select(*views.PLACE, "feat")
    return lv.unionByName(_of_keys(keys, _MORE, ("place", "parent"))), A.features(spark, d).select(*views.PLACE, "feat").unionByName(ways)


def _values(rows) -> str:
    return "(VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else repr(b)}, {m}, {r})" for a, b, m, r in rows) + ")"


_PORTAL = "('Sewer', 'Ossuary', 'IceCv', 'Volcano', 'Bailey', 'Gauntlet', 'Bazaar', 'WizLab', 'Desolation', 'Trove')"
_WALK = f"""k AS (SELECT DISTINCT version, container_id, CAST(container_id AS BIGINT) AS k FROM levels),
lv AS (SELECT version, container_id, place, parent FROM levels UNION ALL SELECT version, container_id, a, CAST(b AS VARCHAR) FROM k, {_values(_MORE)} t(a, b, m, r) WHERE k.k % m = r),
ft AS (SELECT version, container_id, feat, place FROM features UNION ALL SELECT version, container_id, a, b FROM k, {_values(_OPEN)} t(a, b, m, r) WHERE k.k % m = r),
holds AS (SELECT version, container_id, feat, min(place) AS holder FROM ft GROUP BY ALL),
op AS (SELECT l.*, split_part(place, ':', 1) AS branch, place IN {_PORTAL} AS portal, {reach_sql("place")} AS reach, coalesce(parent, CASE WHEN holder <> place THEN holder END) AS up
  FROM lv l LEFT JOIN holds h ON h.version = l.version AND h.container_id = l.container_id AND h.feat = CASE l.place WHEN 'IceCv' THEN 'enter_ice_cave' ELSE 'enter_' || lower(split_part(l.place, ':', 1)) END),
fl AS (SELECT *, CAST(row_number() OVER (PARTITION BY version, container_id, branch ORDER BY reach, place) AS INTEGER) AS n FROM op WHERE NOT portal),
br AS (SELECT f.version, f.container_id, f.branch, f.reach, p.place AS floor FROM fl f LEFT JOIN lv p ON p.version = f.version AND p.container_id = f.container_id AND p.place = f.up AND split_part(p.place, ':', 1) <> f.branch WHERE n = 1),
bk AS (WITH RECURSIVE w AS (SELECT version, container_id, branch, true AS root, [(0, 0, reach, branch)] AS key FROM br WHERE floor IS NULL
  UNION ALL SELECT b.version, b.container_id, b.branch, false, CASE WHEN w.root THEN w.key || [(0, f.n, CAST(0 AS BIGINT), ''), (1, 0, b.reach, b.branch)] ELSE w.key || [(1, f.n, b.reach, b.branch)] END
  FROM w JOIN fl f ON f.version = w.version AND f.container_id = w.container_id AND f.branch = w.branch JOIN br b ON b.version = w.version AND b.container_id = w.container_id AND b.floor = f.place) SELECT * FROM w),
pk AS (WITH RECURSIVE w AS (SELECT f.version, f.container_id, f.place, bk.key || [(0, f.n, CAST(0 AS BIGINT), '')] AS key FROM fl f JOIN bk USING (version, container_id, branch)
  UNION ALL SELECT p.version, p.container_id, p.place, w.key || [(0, 0, CAST(0 AS BIGINT), p.place)] FROM w JOIN op p ON p.portal AND p.version = w.version AND p.container_id = w.container_id AND p.up = w.place) SELECT * FROM w)"""


@query("SELECT version, container_id, lv.place AS place, CAST(row_number() OVER (PARTITION BY version, container_id ORDER BY coalesce(key, [(9, 0, CAST(0 AS BIGINT), lv.place)])) AS INTEGER) AS position FROM lv LEFT JOIN pk USING (version, container_id, place)", _WALK)
def O9_walk(spark, d):
    """Places of each container numbered as they are walked, portals and sub-branches where they open, circles and orphans last."""
    return walk.walk(*_map(spark, d))


_STALLS = "(VALUES (NULL, 'General Store'), (2, 'Book'), (3, 'Weapon'), (9, 'Antique Armour'))"


@query(
    f"SELECT s.version, s.container_id, s.place, s.x, s.shop_type, CAST(row_number() OVER (PARTITION BY s.version, s.container_id, s.place ORDER BY s.x NULLS FIRST) AS INTEGER) AS nth, count(e.cost) AS goods, round(coalesce(sum(e.cost), 0), 2) AS total, count(*) FILTER (WHERE artefact) AS artefacts, "
    "coalesce(string_agg(coalesce(name, base_type || ' ' || sub_type), ';' ORDER BY e.cost DESC, coalesce(name, base_type || ' ' || sub_type)) FILTER (WHERE e.cost IS NOT NULL), '') AS stock "
    f"FROM (SELECT version, container_id, place, x, shop_type FROM (SELECT DISTINCT version, container_id, place FROM levels), {_STALLS} t(x, shop_type)) s LEFT JOIN (SELECT * FROM entries WHERE cost IS NOT NULL) e ON e.version = s.version AND e.container_id = s.container_id AND e.place = s.place AND e.quantity IS NOT DISTINCT FROM s.x GROUP BY s.version, s.container_id, s.place, s.x, s.shop_type"
)
def V4_shops_by_spot(spark, d):
    """Four shops in every place, one of them nowhere in particular and one without goods: stock lies on its shop's spot."""
    e = A.entries(spark, d).withColumns({"x": F.col("quantity"), "y": F.when(F.col("quantity").isNotNull(), 1)})
    stalls = F.array(*[F.struct(F.lit(x).cast("int").alias("x"), F.lit(t).alias("shop_type")) for x, t in ((None, "General Store"), (2, "Book"), (3, "Weapon"), (9, "Antique Armour"))])
    shops = A.levels(spark, d).select(*views.PLACE, F.explode(stalls).alias("s")).select(*views.PLACE, "s.*", F.when(F.col("s.x").isNotNull(), 1).alias("y"), F.lit("enter_shop").alias("feat"))
    rows = views.shops_by_spot(e.unionByName(shops, allowMissingColumns=True))
    return rows.select(*views.PLACE, "x", "shop_type", "nth", "goods", F.round("total", 2).alias("total"), "artefacts", F.array_join("stock", ";").alias("stock"))


_DOC = f"""doc AS (SELECT version, container_id, place, 1 AS section, CASE WHEN artefact THEN 1 WHEN cost IS NOT NULL THEN 2 WHEN quantity = 3 THEN 3 ELSE 4 END AS rank, coalesce(name, base_type || ' ' || sub_type) AS name,
  '`' || coalesce(name, base_type || ' ' || sub_type) || '`' || CASE WHEN cost IS NOT NULL THEN ' — shop, **' || printf('%.2f', cost) || '** gold' ELSE '' END || CASE WHEN quantity = 3 AND cost IS NULL THEN ' — carried by **a keeper**' ELSE '' END || CASE WHEN artefact THEN ' _(artefact)_' ELSE '' END AS line FROM entries
  UNION ALL SELECT version, container_id, place, 2, 0, feat, feat FROM features
  UNION ALL SELECT version, container_id, 'D:1', 3, 0, m, '**' || m || '**' FROM (SELECT DISTINCT version, container_id FROM entries WHERE CAST(container_id AS BIGINT) % 3 = 0), (VALUES ('orc'), ('rat')) t(m)),
lines AS (SELECT version, container_id, place, section, rank, name, line || CASE WHEN count(*) > 1 THEN ' ×' || count(*) ELSE '' END AS line, row_number() OVER (PARTITION BY version, container_id, place ORDER BY section, rank, name, line) AS line_at FROM doc GROUP BY version, container_id, place, section, rank, name, line),
pl AS (SELECT *, CASE WHEN place = 'Temple' THEN 'Temple' WHEN place = 'Sewer' THEN 'Portals' WHEN place LIKE 'D:_' AND CAST(substr(place, 3) AS INTEGER) <= 3 THEN 'D:1-3' WHEN place LIKE 'D:%' THEN 'D:4-7' WHEN place IN ('Lair:1', 'Lair:2') THEN 'Lair:1-2' ELSE 'Lair:3-5' END AS band,
  row_number() OVER (PARTITION BY version, container_id ORDER BY place = 'Sewer', CASE WHEN place = 'Sewer' THEN {reach_sql("parent")} ELSE {reach_sql("place")} END, place) AS place_at
  FROM levels SEMI JOIN lines USING (version, container_id, place)),
banded AS (SELECT *, band IS DISTINCT FROM lag(band) OVER (PARTITION BY version, container_id ORDER BY place_at) AS new_band FROM pl)"""


@query("SELECT version, container_id, band, new_band, place, CASE WHEN parent IS NULL THEN place ELSE place || ' _(from ' || parent || ')_' END AS heading, CAST(place_at AS INTEGER) AS place_at, CAST(line_at AS INTEGER) AS line_at, line FROM banded JOIN lines USING (version, container_id, place)", _DOC)
def V9_report_document(spark, d):
    """Reports with bands, headings and collapsed lines, every line with its place in the document."""
    rows = A.place_rows(A.entries(spark, d)).withColumn("carried_by", F.expr("case when quantity = 3 and cost is null then 'a keeper' end"))
    return views.report_document(rows, A.levels(spark, d))


_SETS = "sets AS (SELECT version, container_id, row_number() OVER (PARTITION BY version ORDER BY CAST(container_id AS UBIGINT)) AS r, s FROM (SELECT version, container_id, string_agg(DISTINCT base_type || ':' || sub_type, ',' ORDER BY base_type || ':' || sub_type) AS s FROM entries WHERE place IN ('D:1', 'D:2') GROUP BY ALL)), curve AS (SELECT version, first AS containers, row_number() OVER (PARTITION BY version ORDER BY first) AS sets FROM (SELECT version, s, min(r) AS first FROM sets GROUP BY ALL))"


def _sets(spark, d):
    kind = F.concat_ws(":", "base_type", "sub_type")
    return A.entries(spark, d).where("place in ('D:1', 'D:2')").groupBy("version", "container_id").agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("held"))


@query("SELECT * FROM curve", _SETS)
def N5_set_growth(spark, d):
    """Distinct sets of early kinds by the rank of the container that first has them."""
    return audit.set_growth(_sets(spark, d))


@query("SELECT version, round(regr_slope(ln(sets), ln(containers)), 6) AS exponent, max(sets) AS sets FROM curve GROUP BY version", _SETS)
def N5_growth_law(spark, d):
    return audit.growth_law(audit.set_growth(_sets(spark, d))).withColumn("exponent", F.round("exponent", 6))


#: Typed words: of part names as they are, with a letter less, two letters swapped, after "of", whole tokens, base types and properties.
_TYPED = "SELECT DISTINCT unnest([split_part(p_name, ' ', 2), upper(split_part(p_name, ' ', 2)), substr(split_part(p_name, ' ', 2), 2), split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) || 'x', 'potion:' || split_part(p_name, ' ', 2), 'P' || (p_partkey % 9), 'Of ' || split_part(p_name, ' ', 2), substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 1), 3), 'potions', split_part(p_name, ' ', 1) || ' charm']) AS word FROM part"
_READ = f"""kinds AS (SELECT DISTINCT base_type, sub_type FROM entries UNION SELECT DISTINCT 'jewellery', ego || ' charm of ' || sub_type FROM entries WHERE ego IS NOT NULL),
tok AS (SELECT *, base_type || ':' || sub_type AS token, CASE WHEN contains(sub_type, ' of ') THEN regexp_replace(sub_type, '^.* of ', '') END AS tail FROM kinds),
ex AS (SELECT DISTINCT lower(unnest([sub_type, base_type, token, tail])) AS w, token FROM tok UNION SELECT DISTINCT lower(prop), 'props:' || prop FROM props),
typed AS (SELECT DISTINCT lower(word) AS word FROM ({_TYPED})),
hit AS (SELECT word, list_sort(list(DISTINCT token)) AS tokens FROM typed JOIN ex ON w = word GROUP BY word),
near AS (SELECT word, list_sort(list(DISTINCT token)) AS tokens FROM (
  SELECT word, token FROM typed ANTI JOIN hit USING (word), tok WHERE length(word) >= 3 AND contains(' ' || lower(sub_type) || ' ', ' ' || word || ' ')
  UNION SELECT word, token FROM typed ANTI JOIN hit USING (word), ex WHERE length(word) >= 4 AND NOT starts_with(token, 'props:') AND damerau_levenshtein(word, w) <= 1) GROUP BY word)"""


@query("SELECT word, CASE WHEN len(h.tokens) = 1 THEN 'resolved' WHEN len(h.tokens) > 1 THEN 'pick' WHEN n.word IS NOT NULL THEN 'suggest' ELSE 'none' END AS verdict, array_to_string(coalesce(h.tokens, n.tokens, []), ' ') AS tokens FROM typed LEFT JOIN hit h USING (word) LEFT JOIN near n USING (word)", _READ)
def Q7_readings(spark, d):
    """Words that can mean a kind, a class, a tail or a property: one meaning resolves, several are to pick from, near ones are offered."""
    e = A.entries(spark, d)
    charms = e.where("ego is not null").select(F.lit("jewellery").alias("base_type"), F.concat("ego", F.lit(" charm of "), "sub_type").alias("sub_type"))
    index = search.readings(e.select("base_type", "sub_type").unionByName(charms), e.select(F.explode("props.prop").alias("prop")))
    colour, noun = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
    typed = f"array({noun}, upper({noun}), substr({noun}, 2), {colour}, concat({colour}, 'x'), concat('potion:', {noun}), concat('P', cast(p_partkey % 9 as string)), concat('Of ', {noun}), concat(substr(p_name, 2, 1), substr(p_name, 1, 1), substr({colour}, 3)), 'potions', concat({colour}, ' charm'))"
    log = A._table(spark, d, "part").select(F.explode(F.expr(typed)).alias("word"))
    return search.resolve_readings(log, index).withColumn("tokens", F.array_join("tokens", " "))


@query("SELECT version, CASE WHEN feat = 'altar_trog' THEN 'strange_device' ELSE 'no name' END AS feat, count(*) AS n FROM features WHERE feat = 'altar_trog' OR feat = 'enter_shop' GROUP BY ALL")
def D10_unknown_features(spark, d):
    """Features whose kind tells their name are sound; kinds that nobody knows, and entries without any kind, are reported."""
    f = A.features(spark, d)
    rows = f.withColumn("feat", F.expr("case when feat = 'altar_trog' then 'strange_device' when feat <> 'enter_shop' then feat end")).withColumn("category", F.lit("features")).withColumn("name", F.lit(None).cast("string"))
    return audit.audit_names(rows).groupBy("version", F.coalesce("feat", F.lit("no name")).alias("feat")).agg(F.count("*").alias("n"))


_KIND = [(b, s) for b, s, _ in rows_of("weights")]
_WEIGHTS = "(VALUES " + ", ".join("('{}', '{}', {})".format(b, s.replace("'", "''"), w) for b, s, w in rows_of("weights")) + ")"
_KINDS = f"kinds AS (SELECT base, CASE WHEN p_partkey % 3 = 0 AND sub <> '*' THEN sub WHEN sub = '*' THEN 'something' ELSE sub || ' of old' END AS sub FROM part JOIN (SELECT *, row_number() OVER () - 1 AS i FROM {_WEIGHTS} w(base, sub, weight)) w ON p_partkey % {len(_KIND)} = i)"


@query(f"SELECT k.base AS base_type, k.sub AS sub_type, coalesce(e.weight, w.weight)::DOUBLE AS weight, count(*) AS n FROM kinds k LEFT JOIN {_WEIGHTS} e(base, sub, weight) USING (base, sub) LEFT JOIN (SELECT * FROM {_WEIGHTS} t(base, sub, weight) WHERE sub = '*') w ON w.base = k.base WHERE coalesce(e.weight, w.weight) IS NOT NULL GROUP BY ALL", _KINDS)
def F18_all_kinds(spark, d):
    """Every kind of the table of weights, and kinds that only its class has a weight for."""
    table = F.array(*[F.struct(F.lit(b).alias("base"), F.lit(s).alias("sub")) for b, s in _KIND])
    of = A._table(spark, d, "part").select("p_partkey", table[(F.col("p_partkey") % len(_KIND)).cast("int")].alias("k"))
    sub = F.when((F.col("p_partkey") % 3 == 0) & (F.col("k.sub") != "*"), F.col("k.sub")).when(F.col("k.sub") == "*", "something").otherwise(F.concat("k.sub", F.lit(" of old")))
    kinds = of.select(F.col("k.base").alias("base_type"), sub.alias("sub_type")).groupBy("base_type", "sub_type").agg(F.count("*").alias("n"))
    return heat.with_weight(kinds, F.broadcast(fixed_table(spark, "weights")))


_SPELLS = "(VALUES " + ", ".join("({}, '{}', {})".format(i, s.replace("'", "''"), n) for i, (s, n) in enumerate(rows_of("spell_levels"))) + ")"


@query(f"SELECT spell, l AS spell_level, CASE WHEN l >= 8 THEN 'high' WHEN l >= 5 THEN 'mid' ELSE 'low' END AS tier, count(*) AS parts FROM part JOIN {_SPELLS} t(i, spell, l) ON p_partkey % {len(rows_of('spell_levels'))} = i GROUP BY ALL")
def F19_all_spells(spark, d):
    names = F.array(*[F.lit(s) for s, _ in rows_of("spell_levels")])
    of = A._table(spark, d, "part").select(names[(F.col("p_partkey") % len(rows_of("spell_levels"))).cast("int")].alias("spell"))
    known = of.join(F.broadcast(fixed_table(spark, "spell_levels")), "spell")
    return known.groupBy("spell", "spell_level", spell_tier(F.col("spell_level")).alias("tier")).agg(F.count("*").alias("parts"))


_MEMBER = [(g, b, m) for g, b, ms in views.EXCLUSIONS for m in ms]
_GROUP_VALUES = "(VALUES " + ", ".join("({}, '{}', '{}', '{}')".format(i, g, b, m.replace("'", "''")) for i, (g, b, m) in enumerate(_MEMBER)) + ")"


@query(
    f"SELECT k.version, k.container_id, g AS group_name, CASE count(DISTINCT m) WHEN 0 THEN 'unseen' WHEN 1 THEN 'drew ' || min(m) ELSE 'conflict ' || string_agg(DISTINCT m, ',' ORDER BY m) END AS drawn FROM (SELECT DISTINCT version, container_id FROM drawn) k CROSS JOIN (SELECT DISTINCT g FROM {_GROUP_VALUES} t(i, g, b, m)) LEFT JOIN drawn USING (version, container_id, g) GROUP BY ALL",
    f"drawn AS (SELECT l_returnflag AS version, CAST(l_orderkey AS VARCHAR) AS container_id, g, m FROM lineitem LEFT JOIN {_GROUP_VALUES} t(i, g, b, m) ON l_partkey % 40 = i)",
)
def V8_default_groups(spark, d):
    """The seven groups that come with the package: what each container drew, of some nothing, of some two at once."""
    table = F.array(*[F.struct(F.lit(b).alias("base"), F.lit(m).alias("sub")) for _, b, m in _MEMBER])
    i = (F.col("l_partkey") % 40).cast("int")
    rows = A._table(spark, d, "lineitem").select(F.col("l_returnflag").alias("version"), F.col("l_orderkey").cast("string").alias("container_id"), F.when(i < len(_MEMBER), F.get(table, i)).alias("k"))
    return views.exclusion_draws(rows.select("version", "container_id", F.col("k.base").alias("base_type"), F.col("k.sub").alias("sub_type")))


@query("SELECT kind, line, n, pos, CAST(row_number() OVER (PARTITION BY kind ORDER BY pos, line) AS INTEGER) AS at FROM (SELECT p_type AS kind, split_part(p_name, ' ', 2) AS line, count(*) AS n, min(p_partkey) AS pos FROM part GROUP BY ALL)".replace(" AS at ", ' AS "at" '))
def A14_collapsed_lines(spark, d):
    """Equal lines of a kind once, with their number, where the first of them stood."""
    lines = A._table(spark, d, "part").selectExpr("p_type as kind", "split_part(p_name, ' ', 2) as line", "p_partkey as pos")
    return views.collapse_lines(lines, ("kind",))
