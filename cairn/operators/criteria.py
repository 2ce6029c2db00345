"""Criteria: one predicate over an entry row each. Position always takes part: an entry is priced (shop) or not (floor)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.naming import brand_code
from ..functions.text import ascii_lower, contains_ci

MIN_FRAGMENT = 3


def position(shop: bool) -> Column:
    return F.col("cost").isNotNull() if shop else F.col("cost").isNull()


@dataclass(frozen=True)
class Item:
    base: str
    sub: str
    shop: bool = False

    def column(self) -> Column:
        return (F.col("base_type") == self.base) & (F.col("sub_type") == self.sub) & position(self.shop)


@dataclass(frozen=True)
class NameLike:
    """A literal part of a stored name, ASCII case aside; entries whose name follows from their kind have no stored name."""

    fragment: str
    shop: bool = False

    def __post_init__(self):
        if len(self.fragment) < MIN_FRAGMENT:
            raise ValueError(f"a fragment has {MIN_FRAGMENT} characters or more")

    def column(self) -> Column:
        return contains_ci(F.col("name"), self.fragment) & position(self.shop)


@dataclass(frozen=True)
class Feature:
    feat: str

    def column(self) -> Column:
        return F.col("feat") == self.feat


@dataclass(frozen=True)
class Unique:
    name: str

    def column(self) -> Column:
        return F.coalesce(F.col("unique"), F.lit(False)) & (F.col("name") == self.name)


@dataclass(frozen=True)
class Props:
    """All properties on one entry, each of 1 or more; none named: an artefact."""

    props: tuple[str, ...]
    base: str | None = None
    shop: bool = False

    def column(self) -> Column:
        out = F.coalesce(F.col("artefact"), F.lit(False)) if not self.props else F.lit(True)
        for p in self.props:
            out = out & _has(p)
        if self.base is not None:
            out = out & (F.col("base_type") == self.base)
        return out & position(self.shop)


def _has(prop: str) -> Column:
    return F.coalesce(F.exists("props", lambda x: (x["prop"] == prop) & (x["value"] >= 1)), F.lit(False))


@dataclass(frozen=True)
class Brand:
    """An ego on the same item. codes: stored code of each word; an unknown word matches nothing.

    by_release: the word is one of the catalog's brands, stored as the entry's release spells it.
    """

    base: str
    word: str
    sub: str | None = None
    shop: bool = False
    codes: tuple[tuple[str, str], ...] = ()
    by_release: bool = False

    def column(self) -> Column:
        if self.by_release:
            out = (F.col("base_type") == self.base) & (F.col("ego") == brand_code(F.lit(self.base), F.lit(self.word), F.col("version")))
            return (out & (F.col("sub_type") == self.sub) if self.sub is not None else out) & position(self.shop)
        code = dict(self.codes).get(self.word.lower(), self.word if not self.codes else None)
        if code is None:
            return F.lit(False)
        out = (F.col("base_type") == self.base) & (ascii_lower(F.col("ego")) == code.lower())
        return (out & (F.col("sub_type") == self.sub) if self.sub is not None else out) & position(self.shop)


@dataclass(frozen=True)
class Term:
    criterion: object
    min_count: int = 1

    def column(self) -> Column:
        return F.coalesce(self.criterion.column(), F.lit(False))
