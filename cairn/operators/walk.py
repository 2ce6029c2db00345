"""The order in which a container's places are walked: a forest of branches and portals laid out in one line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import branch_of_place, is_portal, portal_feat, reach_of
from .search import KEY

_STEP = "struct<section:int,n:int,reach:bigint,name:string>"


def _step(section, n, reach, name) -> Column:
    return F.array(F.struct(F.lit(section).cast("int").alias("section"), F.lit(n).cast("int").alias("n"), F.lit(reach).cast("long").alias("reach"), F.lit(name).alias("name")))


def with_openings(levels: DataFrame, features: DataFrame) -> DataFrame:
    """levels with `opens_from`: the recorded parent, else the place that holds the entrance (of several the first by name), but never
    the place itself."""
    first = features.where("feat like 'enter_%'").groupBy(*KEY, "feat").agg(F.min("place").alias("_holder"))
    feat = F.coalesce(portal_feat(F.col("place")), F.concat(F.lit("enter_"), F.lower(branch_of_place(F.col("place")))))
    held = levels.withColumn("feat", feat).join(first, [*KEY, "feat"], "left")
    return held.select(*levels.columns, F.coalesce("parent", F.when(F.col("_holder") != F.col("place"), F.col("_holder"))).alias("opens_from"))


def walk(levels: DataFrame, features: DataFrame) -> DataFrame:
    """(version, container_id, place, position from 1): the order in which a container's places are walked.

    The unit is a branch, not a place: a branch's places follow each other by reach. Portals come right after the place they open from,
    portals within portals too. Branches that open from a first-level branch come after the place they open from; those farther down after
    all places of their parent. First-level branches, and branches that open from one place, are in order of reach, then name. What opens
    from nowhere known comes first-level if it is a branch, and last if it is a portal; so do, by name, places that open from each other
    in a circle, and branches that open from a portal. levels(version, container_id, place, parent) has a place once; each container's
    places meet in one row (there are as many as its map has), and each place's path to the root is an array that sorts as the walk goes.
    """
    placed = with_openings(levels.select(*KEY, "place", "parent"), features).withColumns({"branch": branch_of_place(F.col("place")), "portal": is_portal(F.col("place")), "reach": reach_of(F.col("place"))})
    run = Window.partitionBy(*KEY, "portal", "branch").orderBy("reach", "place")
    marked = placed.withColumns({"n": F.row_number().over(run), "head_from": F.first("opens_from").over(run), "head_reach": F.first("reach").over(run)})
    each = F.struct("place", "branch", "portal", "n", "opens_from", "head_from", "head_reach")
    whole = marked.groupBy(KEY).agg(F.collect_list(each).alias("all"))
    names = F.transform("all", lambda p: p["place"])
    floors = F.filter("all", lambda p: ~p["portal"])
    # a floor's number in its branch, a portal's opening, and where each branch hangs: on a floor of another branch, or nowhere
    whole = whole.withColumns({
        "number": F.map_from_entries(F.transform(floors, lambda p: F.struct(p["place"], p["n"]))),
        "opening": F.map_from_entries(F.transform(F.filter("all", lambda p: p["portal"] & F.array_contains(names, p["opens_from"])), lambda p: F.struct(p["place"], p["opens_from"]))),
        "hangs": F.map_from_entries(F.transform(F.filter(floors, lambda p: p["n"] == 1), lambda p: F.struct(p["branch"], F.struct(F.when(F.array_contains(names, p["head_from"]) & (branch_of_place(p["head_from"]) != p["branch"]), p["head_from"]).alias("floor"), p["head_reach"].alias("reach"))))),
    })
    steps = lambda m: F.sequence(F.lit(0), F.size(m))

    def out_of_portals(place: Column) -> Column:
        """(at, path): the floor that a place's portals open from in the end (a portal: nowhere), and the portals on the way in."""
        start = F.struct(place.alias("at"), F.array().cast(f"array<{_STEP}>").alias("path"))
        return F.aggregate(steps("opening"), start, lambda s, _: F.when(F.col("opening")[s["at"]].isNotNull(), F.struct(F.col("opening")[s["at"]].alias("at"), F.concat(_step(0, 0, 0, s["at"]), s["path"]).alias("path"))).otherwise(s))

    def branch_path(floor: Column) -> Column:
        """The path of a floor through branches, from the first level; null: it leads to no first-level branch.

        Climbing keeps the last hop apart: it is only known at the next whether it was a hop from the first level."""
        start = F.struct(branch_of_place(floor).alias("branch"), F.array().cast("array<struct<n:int,reach:bigint,name:string>>").alias("hops"))

        def up(s, _):
            on = F.col("hangs")[s["branch"]]
            hop = F.struct(F.col("number")[on["floor"]].alias("n"), on["reach"].alias("reach"), s["branch"].alias("name"))
            return F.when(on["floor"].isNotNull() & F.col("number")[on["floor"]].isNotNull(), F.struct(branch_of_place(on["floor"]).alias("branch"), F.concat(F.array(hop), s["hops"]).alias("hops"))).otherwise(s)

        def laid(s):
            top = F.col("hangs")[s["branch"]]
            first = s["hops"][0]
            rest = F.transform(F.slice(s["hops"], 2, F.greatest(F.size(s["hops"]) - 1, F.lit(0))), lambda h: F.struct(F.lit(1).alias("section"), h["n"].alias("n"), h["reach"].alias("reach"), h["name"].alias("name")))
            below = F.when(F.size(s["hops"]) == 0, F.array().cast(f"array<{_STEP}>")).otherwise(F.concat(_step(0, first["n"], 0, ""), _step(1, 0, first["reach"], first["name"]), rest))
            return F.when(top["floor"].isNull(), F.concat(_step(0, 0, top["reach"], s["branch"]), below, _step(0, F.col("number")[floor], 0, "")))

        return F.transform(F.array(F.aggregate(steps("hangs"), start, up)), laid)[0]

    def path(p):
        whole_way = lambda o: F.when(F.col("number")[o["at"]].isNotNull(), F.concat(branch_path(o["at"]), o["path"]))
        known = F.transform(F.array(out_of_portals(p["place"])), whole_way)[0]
        return F.struct(F.coalesce(known, _step(9, 0, 0, p["place"])).alias("path"), p["place"].alias("place"))

    ordered = F.array_sort(F.transform("all", path))
    return whole.select(*KEY, F.posexplode(ordered).alias("i", "p")).select(*KEY, F.col("p.place").alias("place"), (F.col("i") + 1).alias("position"))
