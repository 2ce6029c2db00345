"""Names, labels, versions and keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def contains_ci(c: Column, fragment: str) -> Column:
    """A literal part, whatever the case of its ASCII letters; a null name holds nothing."""
    return F.coalesce(ascii_lower(c).contains(fragment.translate(str.maketrans(UPPER, LOWER))), F.lit(False))


def title(c: Column) -> Column:
    """First letters in upper case, the rest as they are."""
    return F.array_join(F.transform(F.split(F.replace(c, F.lit("_"), F.lit(" ")), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def feature_label(feat: Column) -> Column:
    plain = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    rest = F.regexp_replace(feat, "^[^_]*_", "")
    return (
        F.when(feat.startswith("altar_"), F.concat(F.lit("an altar of "), title(rest)))
        .when(feat == "enter_shop", "a shop")
        .when(feat.startswith("enter_"), F.concat(F.lit("an entrance to "), plain(rest)))
        .when(feat.startswith("exit_"), F.concat(F.lit("an exit from "), plain(rest)))
        .otherwise(plain(feat))
    )


def item_label(base: Column, sub: Column) -> Column:
    return F.when(base.isin("potion", "scroll", "wand"), F.concat_ws(" of ", base, sub)).otherwise(sub)


def short_name(name: Column, base: Column, sub: Column) -> Column:
    """A consumable's name without its class, if the name is just what class and kind give; else the name."""
    one, many = F.concat_ws(" of ", base, sub), F.concat(base, F.lit("s of "), sub)
    count = F.substring_index(name, " ", 1)
    plural = count.rlike("^[0-9]+$") & (name == F.concat(count, F.lit(" "), many))
    return F.when(base.isin("potion", "scroll") & (name == one), sub).when(base.isin("potion", "scroll") & plural, F.concat(count, F.lit(" "), sub)).otherwise(name)


def release_key(version: Column) -> Column:
    """Sorts as releases do: by dotted numbers of any length, and what has none after all that have, by text."""
    prefix = F.regexp_extract(version, "^[0-9.]*", 0)
    numbers = F.when(prefix.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.transform(F.split(prefix, r"\."), lambda x: F.struct(F.length(F.ltrim(x, F.lit("0"))).alias("digits"), F.ltrim(x, F.lit("0")).alias("number"))))
    return F.struct(numbers.isNull().alias("unreleased"), F.coalesce(numbers, F.array().cast("array<struct<digits:int,number:string>>")).alias("numbers"), F.when(numbers.isNull(), version).otherwise("").alias("text"))


def is_released(version: Column) -> Column:
    return version.rlike(r"^[0-9]") & version.contains(".")


def valid_version(version: Column) -> Column:
    return version.rlike(r"^[A-Za-z0-9._-]{1,64}$")


def valid_key(key: Column) -> Column:
    """Decimal text of 1 to 2^64 - 1 without sign or leading zero."""
    most = "18446744073709551615"
    return key.rlike("^[1-9][0-9]{0,19}$") & ((F.length(key) < 20) | (key <= most))


def within_one_edit(a: Column, b: Column) -> Column:
    """Equal but for one letter put in, taken out or replaced, or two neighbours swapped; ASCII case aside."""
    a, b = ascii_lower(a), ascii_lower(b)
    d = F.levenshtein(a, b)
    at = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))) + 1
    swapped = F.concat(F.substr(a, F.lit(1), at - 1), F.substr(a, at + 1, F.lit(1)), F.substr(a, at, F.lit(1)), F.substr(a, at + 2))
    return (d <= 1) | ((d == 2) & (F.length(a) == F.length(b)) & (swapped == b))


def keyed_hash(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal; the key's pads are made on the driver."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def significance(base: Column, sub: Column, cost: Column, artefact: Column, ego: Column, branded: Column, spells: Column, name: Column) -> Column:
    """0: a boon, 1: an artefact, 2: enchanted, or a book whose name doesn't tell its spells, 3: the rest."""
    one = F.coalesce(F.size(spells) == 1, F.lit(False)) & F.coalesce(name.endswith(spells[0]), F.lit(False))
    telling = F.coalesce(F.size(spells) == 0, F.lit(True)) | one
    return F.when(boon(base, sub, cost).isNotNull(), 0).when(artefact, 1).when(ego.isNotNull() | F.coalesce(branded, F.lit(False)) | ~telling, 2).otherwise(3)


#: Kinds that help a run most, and their labels.
BOONS = (("potion", "experience", "xp"), ("scroll", "acquirement", "acq"))


def boon(base: Column, sub: Column, cost: Column, kinds=BOONS) -> Column:
    """The label of an unpriced item of a kind that helps a run most."""
    out = None
    for b, s, label in kinds:
        test = cost.isNull() & (base == b) & (sub == s)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def stable_xy(x: Column, y: Column, unique: Column, carried_by: Column) -> Column:
    """Where an entry stands, if it stays put: not for a unique monster, nor for what is carried."""
    moves = F.coalesce(unique, F.lit(False)) | carried_by.isNotNull()
    return F.when(~moves & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
