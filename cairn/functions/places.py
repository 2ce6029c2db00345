"""Places and how early they are reached."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reach of a place that nothing is known of: later than every other.
UNKNOWN = 4611686018427387903
# The reach of each branch's entrance, and the entrance feature of each portal place.
ENTRANCES = {"D": 0, "Temple": 4, "Orc": 9, "Lair": 8, "Vaults": 8, "Depths": 15, "Elf": 11, "Crypt": 10, "Snake": 10, "Spider": 10, "Shoals": 10, "Swamp": 10, "Slime": 12, "Zot": 19}
PORTALS = {"Sewer": "enter_sewer", "Ossuary": "enter_ossuary", "IceCv": "enter_ice_cave", "Volcano": "enter_volcano", "Bailey": "enter_bailey", "Gauntlet": "enter_gauntlet", "Bazaar": "enter_bazaar", "WizLab": "enter_wizlab", "Desolation": "enter_desolation", "Trove": "enter_trove"}
# Altars in order of their bits.
ALTARS = (
    "altar_ashenzari", "altar_cheibriados", "altar_dithmenos", "altar_elyvilon", "altar_fedhas", "altar_gozag", "altar_hepliaklqana", "altar_kikubaaqudgha",
    "altar_makhleb", "altar_nemelex_xobeh", "altar_okawaru", "altar_qazlal", "altar_ru", "altar_sif_muna", "altar_the_shining_one", "altar_trog", "altar_uskayaw",
    "altar_vehumet", "altar_wu_jian", "altar_xom", "altar_yredelemnul", "altar_zin",
)


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])[key]


def is_portal(place: Column) -> Column:
    return F.coalesce(place.isin(*PORTALS), F.lit(False))


def portal_feat(place: Column) -> Column:
    return _lookup(PORTALS, place)


def branch_of_place(place: Column) -> Column:
    return F.substring_index(place, ":", 1)


def branch_of_feat(feat: Column) -> Column:
    """enter_x as X; other features: null."""
    rest = F.substr(feat, F.lit(7))
    return F.when(feat.startswith("enter_"), F.concat(F.upper(F.substring(rest, 1, 1)), F.substr(rest, F.lit(2))))


def reach_of(place: Column) -> Column:
    """B:n is n places past its branch's entrance, a bare branch its entrance; portals and anything else are unknown."""
    entrance = _lookup({k: v for k, v in ENTRANCES.items()}, branch_of_place(place)).cast("long")
    n = F.substring_index(place, ":", -1).try_cast("long")
    numbered = F.when(place.contains(":"), F.try_add(entrance, n)).otherwise(entrance)
    return F.when(is_portal(place), F.lit(UNKNOWN)).otherwise(F.coalesce(numbered, F.lit(UNKNOWN)))


def reach_with_parent(place: Column, parent: Column) -> Column:
    """A portal is reached where its parent is."""
    return F.when(is_portal(place) & parent.isNotNull(), reach_of(parent)).otherwise(reach_of(place))


def within_cap(place: Column, parent: Column, cap: int) -> Column:
    """Unknown reaches are admitted; with a parent, the place must do both by itself and by its parent."""
    fits = lambda r: (r <= cap) | (r == UNKNOWN)
    return fits(reach_of(place)) & (parent.isNull() | fits(reach_with_parent(place, parent)))


#: Bands of places for reports: first and last number of the branch.
BANDS = (("D:1-3", "D", 1, 3), ("D:4-7", "D", 4, 7), ("Lair:1-2", "Lair", 1, 2), ("Lair:3-5", "Lair", 3, 5))


def band_label(place: Column) -> Column:
    branch, n = branch_of_place(place), F.substring_index(place, ":", -1).try_cast("long")
    out = F.when(place == "Temple", "Temple").when(is_portal(place), "Portals")
    for name, b, lo, hi in BANDS:
        out = out.when(place.contains(":") & (branch == b) & n.between(lo, hi), name)
    word = F.regexp_extract(place, "^([A-Za-z]+)", 1)
    return out.otherwise(F.concat(F.lit("Other ("), F.when(word == "", "misc").otherwise(word), F.lit(")")))


def altar_bit(feat: Column) -> Column:
    return _lookup({a: i for i, a in enumerate(ALTARS)}, feat)


def mask_feats(mask: Column) -> Column:
    """The features of a mask, in order of their bits."""
    named = F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(a).alias("feat")) for i, a in enumerate(ALTARS)])
    return F.transform(F.filter(named, lambda x: F.getbit(mask.cast("long"), x["bit"]) == 1), lambda x: x["feat"])
