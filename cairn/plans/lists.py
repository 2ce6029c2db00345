"""Queries over stored lists: bitmaps with the rarest first, pages by key windows, samples by seeks, audits page by page."""

from __future__ import annotations

import random

from ..operators import answers, bitmaps, index, pages
from ..operators.criteria import Term
from ..sources import adapters as A
from ..sources.tables import stored
from .answers import _AUDITED, _ITEM, indexed
from .catalog import _FOUND, FLAGSHIP, POTION, has, query, stored_postings


def _bitmaps(spark, d):
    """(bitmaps, cards, ordinals, postings), each stored once."""
    postings = stored_postings(spark, d)
    ordinals = stored(spark, d, "catalog-ordinals", lambda: index.assign_ordinals(A.entries(spark, d)))
    maps = stored(spark, d, "catalog-bitmaps", lambda: bitmaps.in_order(bitmaps.build_bitmaps(postings, ordinals)), by=("version",))
    return maps, stored(spark, d, "catalog-cards", lambda: bitmaps.cards_of(maps)), ordinals, postings


_GEAR = "base_type = 'weapon' AND sub_type = 'gear' AND cost IS NULL"
_RED = "base_type = 'weapon' AND ego = 'red' AND cost IS NULL"


@query(f"SELECT version, container_id FROM (SELECT version, container_id FROM entries GROUP BY ALL HAVING sum(CASE WHEN {_ITEM} THEN coalesce(quantity, 1) ELSE 0 END) >= 5 AND sum(CASE WHEN {_GEAR} THEN coalesce(quantity, 1) ELSE 0 END) >= 2 AND sum(CASE WHEN {_RED} THEN 1 ELSE 0 END) >= 1)")
def J7_rarest_first(spark, d):
    """Three lists ANDed bucket by bucket; five of a kind lies between the counts that have bitmaps, so postings decide it."""
    keys = [("floor/item", "potion", "bolt", 5), ("floor/item", "weapon", "gear", 2), ("floor/brand", "weapon", "red", 1), ("floor/item", "potion", "bolt", 3)]
    return bitmaps.holding_all(*_bitmaps(spark, d), keys)


def _windowed(spark, d):
    e = A.entries(spark, d)
    rows = stored(spark, d, "catalog-windows", lambda: pages.in_windows(e, 24), by=("window",))
    return pages.Windowed(rows, stored(spark, d, "catalog-spans", lambda: pages.spans_of(rows)))


@query(f"SELECT version, container_id, n1, n2 FROM ({_FOUND}) WHERE version = 'R' AND container_id > '3' ORDER BY container_id LIMIT 16")
def O1_page_of_windows(spark, d):
    """A page beyond a cursor, from as many windows of keys as it takes."""
    return pages.search_page(_windowed(spark, d), "R", FLAGSHIP, "3", 15)[0]


@query(f"SELECT version, container_id, n1 FROM ({has(_ITEM)}) WHERE version = 'A' ORDER BY container_id LIMIT 201")
def O1_page_over_windows(spark, d):
    """A first page that one window doesn't fill."""
    return pages.search_page(_windowed(spark, d), "A", [Term(POTION)], None, 200)[0]


_DRAWS = ", ".join(f"('{random_cursor}')" for draw in [random.Random(11)] for random_cursor in [draw.randrange(100_000_000, 1_000_000_000) for _ in range(40)])


@query(f"SELECT DISTINCT version, coalesce((SELECT min(container_id) FROM entries e WHERE version = 'N' AND container_id > c), (SELECT min(container_id) FROM entries WHERE version = 'N')) AS container_id FROM (SELECT DISTINCT version FROM entries WHERE version = 'N'), (VALUES {_DRAWS}) t(c)")
def O5_sample_by_seeks(spark, d):
    """The first container beyond each of forty random cursors; nothing is sorted, and only the cursors' windows are read."""
    return pages.sample_by_seeks(_windowed(spark, d), "N", 40, 11)[0]


_WALKED = ("item", "two properties", "name", "nothing")


@query("SELECT query, unnest(['sets', 'evidence', 'reaches', 'repeats', 'fill']) AS check, true AS ok FROM (VALUES " + ", ".join(f"('{q}')" for q in _WALKED) + ") t(query)")
def I12_walks(spark, d):
    """Both ways of an answer walked in pages to the end, by key and by reach."""
    e, _, lists = indexed(spark, d)
    return answers.audit_walks(e, lists, {name: _AUDITED[name][0] for name in _WALKED}, limit=100)
