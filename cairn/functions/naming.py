"""Names that follow from an entry's columns, and the words of brands, properties and spells as each release spells them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, release_key

# The words below are the catalog's own vocabulary.
FEATURES = {
    "altar_ashenzari": "a broken altar of Ashenzari",
    "altar_beogh": "a roughly hewn altar of Beogh",
    "altar_cheibriados": "a snail-covered altar of Cheibriados",
    "altar_dithmenos": "a shadowy altar of Dithmenos",
    "altar_ecumenical": "a faded altar of an unknown god",
    "altar_elyvilon": "a white marble altar of Elyvilon",
    "altar_fedhas": "a blossoming altar of Fedhas",
    "altar_gozag": "an opulent altar of Gozag",
    "altar_hepliaklqana": "a hazy altar of Hepliaklqana",
    "altar_ignis": "a candlelit altar of Ignis",
    "altar_jiyva": "a viscous altar of Jiyva",
    "altar_kikubaaqudgha": "an ancient bone altar of Kikubaaqudgha",
    "altar_lugonu": "a corrupted altar of Lugonu",
    "altar_makhleb": "a burning altar of Makhleb",
    "altar_nemelex_xobeh": "a sparkling altar of Nemelex Xobeh",
    "altar_okawaru": "an iron altar of Okawaru",
    "altar_qazlal": "a stormy altar of Qazlal",
    "altar_ru": "a sacrificial altar of Ru",
    "altar_sif_muna": "a shimmering blue altar of Sif Muna",
    "altar_the_shining_one": "a glowing golden altar of the Shining One",
    "altar_trog": "a bloodstained altar of Trog",
    "altar_uskayaw": "a hide-covered altar of Uskayaw",
    "altar_vehumet": "a radiant altar of Vehumet",
    "altar_wu_jian": "an ornate altar of the Wu Jian Council",
    "altar_xom": "a shimmering altar of Xom",
    "altar_yredelemnul": "a basalt altar of Yredelemnul",
    "altar_zin": "a glowing silver altar of Zin",
    "enter_abyss": "a one-way gate to the infinite horrors of the Abyss",
    "enter_bailey": "a flagged portal",
    "enter_bazaar": "a flickering gateway to a bazaar",
    "enter_depths": "a staircase to the Depths",
    "enter_elven_halls": "a staircase to the Elven Halls",
    "enter_gauntlet": "a gate leading to a gauntlet",
    "enter_hell": "a gateway to Hell",
    "enter_ice_cave": "a frozen archway",
    "enter_lair": "a staircase to the Lair",
    "enter_necropolis": "a phantasmal passage",
    "enter_orcish_mines": "a staircase to the Orcish Mines",
    "enter_ossuary": "a sand-covered staircase",
    "enter_pandemonium": "a one-way gate leading to the halls of Pandemonium",
    "enter_sewer": "a glowing drain",
    "enter_shoals": "a staircase to the Shoals",
    "enter_slime_pits": "a staircase to the Slime Pits",
    "enter_snake_pit": "a staircase to the Snake Pit",
    "enter_spider_nest": "a hole to the Spider Nest",
    "enter_swamp": "a staircase to the Swamp",
    "enter_temple": "a staircase to the Ecumenical Temple",
    "enter_trove": "a portal to a secret trove of treasure",
    "enter_vaults": "a gate to the Vaults",
    "enter_volcano": "a dark tunnel",
    "transporter": "a transporter",
}
#: Shops whose type is their whole name.
NAMED_SHOPS = ("General Store", "Distillery")
#: Stored code and word; the words of WEAPONS_BEFORE stand before the base, those of WEAPONS_AFTER behind "of".
WEAPONS_BEFORE = {"antimagic": "antimagic", "devious": "devious", "heavy": "heavy", "spect": "spectral", "vamp": "vampiric"}
WEAPONS_AFTER = {
    "chaos": "chaos", "concuss": "concussion", "distort": "distortion", "drain": "draining", "elec": "electrocution", "entangle": "entangling",
    "flame": "flaming", "freeze": "freezing", "holy": "holy wrath", "pain": "pain", "protect": "protection", "rebuke": "rebuke", "speed": "speed",
    "sunder": "sundering", "valour": "valour", "venom": "venom",
}
ARMOUR = {
    "+Inv": "invisibility", "AC+3": "protection", "Air": "air", "Archery": "archery", "Attunement": "attunement", "Command": "command", "Death": "death",
    "Dex+3": "dexterity", "Earth": "earth", "Energy": "energy", "Fire": "fire", "Fly": "flying", "Glass": "glass", "Guile": "guile", "Harm": "harm",
    "Hurl": "hurling", "Ice": "ice", "Infuse": "infusion", "Int+3": "intelligence", "Light": "light", "Mayhem": "mayhem", "Mesmerism": "mesmerism",
    "Parrying": "parrying", "Ponderous": "ponderousness", "Pyromania": "pyromania", "Rampage": "rampaging", "Reflect": "reflection",
    "Repulsion": "repulsion", "Resonance": "resonance", "SInv": "see invisible", "Shadows": "shadows", "Snipe": "sniping", "Stardust": "stardust",
    "Stlth+": "stealth", "Str+3": "strength", "Will+": "willpower", "rC+": "cold resistance", "rC+ rF+": "resistance",
    "rCorr": "corrosion resistance", "rF+": "fire resistance", "rN+": "positive energy", "rPois": "poison resistance",
}
#: Brands that only artefacts have: they can be read, but are refused in a search.
ARTEFACT_ONLY = {
    "weapon": {"penet": "penetration", "reap": "reaping", "acid": "acid", "foul flame": "foul flame"},
    "armour": {"Spirit": "spirit shield", "Archmagi": "the Archmagi"},
}
#: Armour codes that began with a small letter before this release.
CAPITALISED_SINCE = "0.34.1"
CAPITALISED = ("Guile", "Harm", "Hurl", "Infuse", "Light", "Mayhem", "Ponderous", "Rampage", "Reflect", "Repulsion", "Shadows")
# Properties that a name may show.
PROPERTIES = (
    "*Corrode", "*Noise", "*Rage", "*Silence", "*Slow", "+Blink", "+Inv", "-Cast", "-Tele", "AC", "Air", "Alch", "Archmagi", "BAcc", "BDam", "Bane", "Clar", "Conj",
    "Delay", "Dex", "EV", "Earth", "Fire", "Fly", "Forge", "HP", "Harm", "Hexes", "Ice", "Int", "MP", "Necro", "RMsl", "Rampage", "Regen", "RegenMP", "SH", "SInv",
    "Slay", "Stlth", "Str", "Summ", "Tloc", "Will", "^Contam", "^Drain", "^Fragile", "nupgr", "rC", "rCorr", "rElec", "rF", "rMut", "rN", "rPois",
)
#: (spelling, first release that has it, spelling before).
RENAMED_PROPERTIES = (("Alch", "0.33.1", "Alchemy"),)
DRAWBACKS = ("*Corrode", "*Noise", "*Silence", "*Slow", "^Contam", "^Drain", "^Fragile", "-Cast", "-Tele", "Bane")
INTERNAL = ("nupgr",)
EVOKER_CHARGES = {"Gell's gravitambourine": 2, "lightning rod": 4, "tin of tremorstones": 2}
PAIRED = ("gloves", "boots")
UNENCHANTED = ("orb", "scarf")
PARCHMENT = "parchment of "

BRANDS = {"weapon": WEAPONS_BEFORE | WEAPONS_AFTER | ARTEFACT_ONLY["weapon"], "armour": ARMOUR | ARTEFACT_ONLY["armour"]}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])[key]


def _before(version: Column, release: str) -> Column:
    return release_key(version) < release_key(F.lit(release))


def _signed(n: Column) -> Column:
    return F.format_string("%+d", F.coalesce(n, F.lit(0)).cast("int"))


# ---- names (F5)


def shop_name(shop_type: Column) -> Column:
    article = F.when(F.upper(F.substring(shop_type, 1, 1)).isin(*"AEIOU"), "an ").otherwise("a ")
    named = F.when(shop_type.isin(*NAMED_SHOPS), F.concat(F.lit("a "), shop_type)).otherwise(F.concat(article, shop_type, F.lit(" Shop")))
    return F.when(F.coalesce(shop_type, F.lit("")) == "", "a shop").otherwise(named)


def feature_name(feat: Column, shop_type: Column) -> Column:
    return F.when(feat == "enter_shop", shop_name(shop_type)).otherwise(_lookup(FEATURES, feat))


def weapon_name(sub: Column, plus: Column, ego: Column) -> Column:
    """Always with its enchantment; codes without a word say nothing."""
    before, after = F.concat(_lookup(WEAPONS_BEFORE, ego), F.lit(" "), sub), F.concat(sub, F.lit(" of "), _lookup(WEAPONS_AFTER, ego))
    return F.concat(_signed(plus), F.lit(" "), F.coalesce(before, after, sub))


def armour_name(sub: Column, plus: Column, ego: Column) -> Column:
    """Codes of either spelling give the same word."""
    words = ARMOUR | {code.lower(): ARMOUR[code] for code in CAPITALISED}
    base = F.when(sub.isin(*PAIRED), F.concat(F.lit("pair of "), sub)).otherwise(sub)
    named = F.concat_ws(" of ", base, _lookup(words, ego))
    return F.when(sub.isin(*UNENCHANTED), named).otherwise(F.concat(_signed(plus), F.lit(" "), named))


def item_name(base: Column, sub: Column, quantity: Column, plus: Column, ego: Column) -> Column:
    """Null where base or sub is null, where base is of no known class, and for consumables of an empty kind."""
    of = F.concat(base, F.lit(" of "), sub)
    many = F.concat(quantity.cast("string"), F.lit(" "), base, F.lit("s of "), sub)
    charges = _lookup(EVOKER_CHARGES, sub).cast("string")
    return F.when(sub.isNotNull(), (
        F.when(base.isin("potion", "scroll") & (sub != ""), F.when(quantity > 1, many).otherwise(of))
        .when(base == "wand", F.concat(of, F.lit(" ("), F.coalesce(plus, F.lit(0)).cast("string"), F.lit(")")))
        .when(base == "staff", of)
        .when(base == "weapon", weapon_name(sub, plus, ego))
        .when(base == "armour", armour_name(sub, plus, ego))
        .when(base == "jewellery", F.when(plus != 0, F.concat(_signed(plus), F.lit(" "), sub)).otherwise(sub))
        .when(base.isin("book", "talisman"), sub)
        .when(base == "miscellaneous", F.coalesce(F.concat(sub, F.lit(" ("), charges, F.lit("/"), charges, F.lit(")")), sub))
    ))


def display_name(category: Column, feat: Column, shop_type: Column, base: Column, sub: Column, quantity: Column, plus: Column, ego: Column, artefact: Column) -> Column:
    """The name that an entry's columns determine; null for monsters, vaults, artefacts and whatever they don't determine."""
    item = F.when(~F.coalesce(artefact, F.lit(False)), item_name(base, sub, quantity, plus, ego))
    return F.when(category == "features", feature_name(feat, shop_type)).when(category == "items", item)


# ---- brands (F12)


def brand_code(base: Column, word: Column, version: Column) -> Column:
    """The code that a release stores for a brand's word, ASCII case aside; null for unknown words and bases without brands."""
    by_word = lambda kind: _lookup({w.lower(): c for c, w in BRANDS[kind].items()}, ascii_lower(word))
    armour = by_word("armour")
    small = armour.isin(*CAPITALISED) & _before(version, CAPITALISED_SINCE)
    return F.when(base == "weapon", by_word("weapon")).when(base == "armour", F.when(small, F.lower(armour)).otherwise(armour))


def brand_word(base: Column, code: Column) -> Column:
    """The word of a stored code of today's spelling."""
    return F.when(base == "weapon", _lookup(BRANDS["weapon"], code)).when(base == "armour", _lookup(BRANDS["armour"], code))


def brand_refusal(base: Column, word: Column) -> Column:
    only = F.lit(False)
    for kind, brands in ARTEFACT_ONLY.items():
        only = only | ((base == kind) & ascii_lower(word).isin(*[w.lower() for w in brands.values()]))
    return F.when(only, "only ever on artefacts")


# ---- properties (F13)


def property_name(prop: Column, version: Column) -> Column:
    """A property as a release spells it, ASCII case aside; null if that release knows no such spelling."""
    key = ascii_lower(prop)
    out = _lookup({p.lower(): p for p in PROPERTIES}, key)
    for now, since, before in RENAMED_PROPERTIES:
        out = F.when(key == now.lower(), F.when(~_before(version, since), now)).when(key == before.lower(), F.when(_before(version, since), before)).otherwise(out)
    return out


def property_elsewhere(prop: Column, version: Column) -> Column:
    """How this release spells a property that was typed as another release spells it; else null."""
    out = F.lit(None).cast("string")
    for now, since, before in RENAMED_PROPERTIES:
        here = F.when(_before(version, since), before).otherwise(now)
        out = F.when(ascii_lower(prop).isin(now.lower(), before.lower()), F.when(ascii_lower(prop) != ascii_lower(here), here)).otherwise(out)
    return out


def property_refusal(prop: Column) -> Column:
    """Why a property (as spelt today) can't be searched; null if it can."""
    return F.when(prop.isin(*INTERNAL), "an internal flag").when(prop.isin(*DRAWBACKS), "a drawback")


# ---- spells (F19, F20)


def spell_tier(level: Column) -> Column:
    return F.when(level >= 8, "high").when(level >= 5, "mid").when(level.isNotNull(), "low")


def parchment_spell(sub: Column) -> Column:
    return F.when(sub.startswith(PARCHMENT), F.substr(sub, F.lit(len(PARCHMENT) + 1)))


def entry_spells(sub: Column, fixed: Column, stored: Column) -> Column:
    """A parchment's spell is its name's; other kinds have the release's fixed set, else what the entry stores, else none."""
    none = F.array().cast("array<string>")
    return F.when(parchment_spell(sub).isNotNull(), F.array(parchment_spell(sub))).otherwise(F.coalesce(fixed, stored, none))
