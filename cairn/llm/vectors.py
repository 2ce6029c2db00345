"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards, with range-expanding greedy search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import connected_components

COSINE = 0.9
#: Distinct vectors that the centroids are fitted on, at most, and centroids for each so many vectors, up to a 16th of the sample.
SAMPLE, PER_SHARD = 16_384, 1200
#: Vectors in one piece. Larger shards are split into cells around pivots, one for each PER_SHARD of their vectors; cells of which even
#: so more vectors are left, as they are all alike, into pieces by hash, which their queries search all.
PIECE = 2500
#: Shards that a vector is indexed in, those that it searches at first, and the cells of each.
OVERLAP, PROBES, CELLS = 2, 4, 2
NEAR, FAR, ALPHA, BEAM = 12, 4, 1.2, 12
#: Members of a group inside which a piece's vectors look for their candidates; each is in two.
GROUP = 128
#: Planted queries: as many, at this cosine to a vector of the table, which they must find; and vectors drawn for the audit over all, of
#: which those with a true link count.
PLANTED, PLANTED_COSINE, AUDIT_ALL = 256, 0.95, 2048
#: Queries held against brute force in each piece. Below these mean recalls the search is widened: in a piece, of true links over all
#: vectors, and of planted queries, for which it is what the operator promises at least.
AUDIT_PIECE, RECALL_PIECE, RECALL_ALL, RECALL_PLANTED = 32, 0.97, 0.97, 0.9


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def robust_prune(x: np.ndarray, candidates: np.ndarray, sims: np.ndarray, keep: int, at: int = 0) -> np.ndarray:
    """For each row of x from `at` on, up to `keep` of its candidates (nearest first, -1: none): one falls if a kept one is ALPHA times nearer to it than the row is."""
    n, m = candidates.shape
    out = np.full((n, keep), -1, np.int64)
    count = np.zeros(n, np.int64)
    alive = candidates >= 0
    own = np.sqrt(np.maximum(2 - 2 * sims, 0))
    rows = np.arange(n)
    for j in range(m):
        take = alive[:, j] & (count < keep)
        r = rows[take]
        if not len(r):
            continue
        out[r, count[r]] = candidates[r, j]
        count[r] += 1
        if j + 1 < m:
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("rcd,rd->rc", x[candidates[r, j + 1 :]], x[candidates[r, j]]), 0))
            alive[r, j + 1 :] &= ~(ALPHA * between <= own[r, j + 1 :])
    return out


def candidates_of(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, similarities), nearest first, -1 and -2 where there are fewer: for each vector its nearest in the two groups around
    drawn vectors that it lies next to, and some drawn from the whole piece. Nothing is compared with everything."""
    n, c = len(x), 2 * NEAR
    drawn = x[rng.permutation(n)[: max(1, n // GROUP)]]
    order = np.argsort(-(x @ drawn.T), axis=1, kind="stable")[:, :2]
    near, sims = np.full((n, 2 * c), -1, np.int64), np.full((n, 2 * c), -2.0)
    for side in range(order.shape[1]):
        for g in range(len(drawn)):
            mine = np.flatnonzero((order == g).any(1))
            asks = np.flatnonzero(order[:, side] == g)
            if len(mine) < 2 or not len(asks):
                continue
            for at in range(0, len(asks), 512):
                rows = asks[at : at + 512]
                for low in range(0, len(mine), 1024):  # a group of alike vectors may be as long as the piece
                    part = mine[low : low + 1024]
                    s = x[rows] @ x[part].T
                    s[rows[:, None] == part[None, :]] = -2
                    k = min(c, len(part))
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    held = slice(side * c, side * c + c)
                    ids, value = np.concatenate((near[rows, held], part[top]), 1), np.concatenate((sims[rows, held], np.take_along_axis(s, top, 1)), 1)
                    best = np.argsort(-value, axis=1, kind="stable")[:, :c]
                    near[rows, held], sims[rows, held] = np.take_along_axis(ids, best, 1), np.take_along_axis(value, best, 1)
    far = rng.integers(0, n, (n, FAR))
    near = np.concatenate((near, far), 1)
    sims = np.concatenate((sims, np.einsum("nfd,nd->nf", x[far], x)), 1)
    sims[(near < 0) | (near == np.arange(n)[:, None])] = -2
    order = np.argsort(near, axis=1, kind="stable")  # the same vector from two groups counts once
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    sims[:, 1:][near[:, 1:] == near[:, :-1]] = -2
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(sims > -2, near, -1), sims


def build(x: np.ndarray, seed: int) -> np.ndarray:
    """Adjacency of one piece (-1: none): candidates, robustly pruned, and as many reverse edges at most."""
    n, keep = len(x), NEAR + FAR
    rng = np.random.default_rng(seed)
    near, sims = candidates_of(x, rng)
    forward = np.concatenate([robust_prune(x, near[at : at + 500], sims[at : at + 500], keep, at) for at in range(0, n, 500)])
    source, target = np.repeat(np.arange(n), keep), forward.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = rng.permutation(len(source))
    order = order[np.argsort(target[order], kind="stable")]
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    fits = place < keep
    back = np.full((n, keep), -1, np.int64)
    back[target[fits], place[fits]] = source[fits]
    return np.concatenate((forward, back), axis=1)


def medoids_of(x: np.ndarray) -> np.ndarray:
    """The vector next to the mean, and three that are far from it and from each other."""
    medoids = [int((x @ x.mean(0)).argmax())]
    while len(medoids) < min(4, len(x)):
        medoids.append(int((x @ x[medoids].T).max(1).argmin()))
    return np.array(medoids)


def mean_recall(found: np.ndarray, true: np.ndarray) -> float:
    """The mean share found, over queries with a true link; none: not a number, as nothing was measured."""
    asked = true > 0
    return float((np.minimum(found, true)[asked] / true[asked]).mean()) if asked.any() else float("nan")


def search(x: np.ndarray, graph: np.ndarray, medoids: np.ndarray, q: np.ndarray, beam: int, cosine: float = COSINE) -> tuple[np.ndarray, int]:
    """(in_range[query, node], nodes visited): greedy search from the medoids, then every node in range is expanded until no new one comes.

    The way is found in single precision; what is in range, by a hair less than cosine, is decided in double at last."""
    n, m = len(q), len(x)
    beam, rough = min(beam, m), cosine - 1e-4
    xs, qs = x.astype(np.float32), q.astype(np.float32)
    seen, inside = np.zeros((n, m), bool), np.zeros((n, m), bool)

    def visit(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Similarities of rows[i] with the nodes at[i] (none twice in a row; -1: none); -2 for those seen before."""
        r = np.broadcast_to(rows[:, None], at.shape)
        new = (at >= 0) & ~seen[r, at]
        i, j = np.nonzero(new)
        pair_rows, pair_nodes = rows[i], at[i, j]
        seen[pair_rows, pair_nodes] = True
        s = np.full(at.shape, -2, np.float32)
        for k in range(0, len(i), 50_000):
            part = slice(k, k + 50_000)
            s[i[part], j[part]] = np.einsum("pd,pd->p", qs[pair_rows[part]], xs[pair_nodes[part]])
        hit = s[i, j] >= rough
        inside[pair_rows[hit], pair_nodes[hit]] = True
        return s

    nodes = np.broadcast_to(medoids, (n, len(medoids))).copy()
    sims = visit(np.arange(n), nodes)
    open_ = np.ones(nodes.shape, bool)
    while len(rows := np.flatnonzero(open_.any(1))):
        pick = np.where(open_[rows], sims[rows], -np.inf).argmax(1)
        open_[rows, pick] = False
        at = graph[nodes[rows, pick]]
        s = visit(rows, at)
        all_nodes, all_sims = np.concatenate((nodes[rows], at), 1), np.concatenate((sims[rows], s), 1)
        all_open = np.concatenate((open_[rows], s > -2), 1)
        if all_nodes.shape[1] > beam:
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            all_nodes, all_sims, all_open = (np.take_along_axis(a, best, 1) for a in (all_nodes, all_sims, all_open))
        if nodes.shape[1] < all_nodes.shape[1]:
            wide = all_nodes.shape[1] - nodes.shape[1]
            nodes, sims, open_ = np.pad(nodes, ((0, 0), (0, wide))), np.pad(sims, ((0, 0), (0, wide)), constant_values=-2), np.pad(open_, ((0, 0), (0, wide)))
        nodes[rows], sims[rows], open_[rows] = all_nodes, all_sims, all_open & (all_sims > -2)
    done = np.zeros((n, m), bool)
    while True:
        r, c = np.nonzero(inside & ~done)
        if not len(r):
            break
        done[r, c] = True
        for k in range(0, len(r), 20_000):  # one node of a query at a time, so that no pair comes twice in a visit
            part_r, part_c = r[k : k + 20_000], c[k : k + 20_000]
            pair = np.unique((part_r[:, None] * m + graph[part_c])[graph[part_c] >= 0])
            pair = pair[~seen.ravel()[pair]]
            visit(pair // m, (pair % m)[:, None])
    r, c = np.nonzero(inside)
    for k in range(0, len(r), 50_000):
        part = slice(k, k + 50_000)
        inside[r[part], c[part]] = np.einsum("pd,pd->p", q[r[part]], x[c[part]]) >= cosine
    return inside, int(seen.sum())


def audited(x: np.ndarray, graph: np.ndarray, q: np.ndarray, own: np.ndarray, seed: int = 0, cosine: float = COSINE) -> tuple[object, float, bool]:
    """(a function from queries to in_range over one piece, its mean recall, whether the graph does). own: each query's own place in x, or -1.

    Asked are AUDIT_PIECE of q, and as many planted: vectors of x turned to PLANTED_COSINE, whose own vector must be found, so that there
    are links to find in every piece. The beam is doubled until the recall of each will do, and at last the piece is compared as a whole."""
    medoids, rows = medoids_of(x), np.linspace(0, len(q) - 1, min(AUDIT_PIECE, len(q))).astype(int)
    at = np.linspace(0, len(x) - 1, min(AUDIT_PIECE, len(x))).astype(int)
    asked = np.concatenate((q[rows], turned(x[at], seed, max(cosine, PLANTED_COSINE))))
    mine = np.concatenate((own[rows], np.full(len(at), -1)))
    truth = (asked @ x.T >= cosine) & (mine[:, None] != np.arange(len(x))[None, :])
    for beam in (BEAM, 2 * BEAM, 4 * BEAM):
        found = (search(x, graph, medoids, asked, beam, cosine)[0] & truth).sum(1)
        recall = np.nanmin([mean_recall(found[: len(rows)], truth[: len(rows)].sum(1)), mean_recall(found[len(rows) :], truth[len(rows) :].sum(1)), 1.0])
        if recall >= RECALL_PIECE:
            return (lambda part, beam=beam: search(x, graph, medoids, part, beam, cosine)[0]), float(recall), True
    return (lambda part: part @ x.T >= cosine), 1.0, False


def turned(x: np.ndarray, seed: int, cosine: float) -> np.ndarray:
    """Each unit vector turned in a drawn direction, so that it has this cosine with what it was. Of one component: itself."""
    noise = np.random.default_rng(seed).standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    return np.where(size > 1e-9, cosine * x + np.sqrt(1 - cosine**2) * noise / np.maximum(size, 1e-9), x)


_PLACED = "rep long, copies long, embedding array<double>, shard int, home boolean"
_CELL = ["shard", "cell"]


def _edges(frame: pd.DataFrame) -> pd.DataFrame:
    """The adjacency lists of one piece, by id."""
    index = frame.drop_duplicates("rep").sort_values("rep")
    ids = index.rep.to_numpy()
    graph = build(unit(np.stack(index.embedding.to_list())), int(ids[0]) % (1 << 31))
    return pd.DataFrame({"rep": ids, "near": [ids[row[row >= 0]] for row in graph]})


def _piece(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """One piece with the queries sent to it: pairs (u, v) of a query and a vector at home in the piece that are in range, and a row without
    u and v that tells the recall of the piece, of how many queries, and whether the graph was used."""
    index = frame[frame.node].drop_duplicates("rep").sort_values("rep").reset_index(drop=True)
    queries = frame[~frame.node].drop_duplicates("rep").reset_index(drop=True)
    empty = np.zeros(0, np.int64)
    if not len(index) or not len(queries):
        return pd.DataFrame({"u": empty, "v": empty, "recall": empty.astype(float), "asked": empty, "graph": empty.astype(bool)})
    x, q = unit(np.stack(index.embedding.to_list())), unit(np.stack(queries.embedding.to_list()))
    reps, asked = index.rep.to_numpy(), queries.rep.to_numpy()
    # the united lists, as far as they stay in this piece
    owner, near = np.repeat(np.arange(len(reps)), index.near.map(len)), np.concatenate(index.near.to_list()).astype(np.int64)
    at = np.minimum(np.searchsorted(reps, near), len(reps) - 1)
    owner, at = owner[reps[at] == near], at[reps[at] == near]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    graph = np.full((len(reps), int(place.max(initial=0)) + 1), -1, np.int64)
    graph[owner, place] = at
    own = np.minimum(np.searchsorted(reps, asked), len(reps) - 1)
    own = np.where(reps[own] == asked, own, -1)
    look, recall, by_graph = audited(x, graph, q, own, int(reps[0]) % (1 << 31), cosine)
    home, pairs = index.home.to_numpy(), []
    for k in range(0, len(q), 500):
        r, c = np.nonzero(look(q[k : k + 500]) & home[None, :])
        unlike = asked[k + r] != reps[c]
        pairs.append(np.stack((asked[k + r[unlike]], reps[c[unlike]]), 1))
    u, v = np.concatenate(pairs).T
    told = pd.DataFrame({"u": [None], "v": [None], "recall": [recall], "asked": [len(q)], "graph": [by_graph]}).astype({"u": "Int64", "v": "Int64"})
    found = pd.DataFrame({"u": u, "v": v}).astype("Int64").assign(recall=np.nan, asked=0, graph=by_graph)
    return pd.concat([found, told]) if len(found) else told


def _homes(frame: pd.DataFrame, c: np.ndarray, k: int) -> pd.DataFrame:
    """Each vector once for each of its k nearest centroids; home: the nearest."""
    frame = frame.reset_index(drop=True)
    if not len(frame):
        return frame.assign(shard=0, home=True)[["rep", "copies", "embedding", "shard", "home"]]
    sims = unit(np.stack(frame.embedding.to_list())) @ c.T
    near = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    out = frame.loc[np.repeat(np.arange(len(frame)), near.shape[1])].reset_index(drop=True)
    return out.assign(shard=near.ravel(), home=np.tile(np.arange(near.shape[1]) == 0, len(frame)))[["rep", "copies", "embedding", "shard", "home"]]


def _around_pivots(rows: pd.DataFrame, pivots: pd.DataFrame, k: int) -> pd.DataFrame:
    """Vectors of one shard, once for each of their k nearest pivots."""
    if not len(rows) or not len(pivots):
        return rows.assign(cell=0)[[*_NAMES, "cell"]]
    rows = rows.reset_index(drop=True)
    p, near = unit(np.stack(pivots.embedding.to_list())), []
    for at in range(0, len(rows), 1000):
        sims = unit(np.stack(rows.embedding[at : at + 1000].to_list())) @ p.T
        near.append(np.argsort(-sims, axis=1, kind="stable")[:, :k])
    near = np.concatenate(near)
    out = rows.loc[np.repeat(np.arange(len(rows)), near.shape[1])].reset_index(drop=True)
    return out.assign(cell=pivots["number"].to_numpy()[near.ravel()])[[*_NAMES, "cell"]]


_NAMES = ["rep", "copies", "embedding", "shard", "home"]


def _into_cells(placed: DataFrame, pivots: DataFrame | None, k: int) -> DataFrame:
    """placed with cell: 0 in shards without pivots; else vectors meet their shard's pivots in groups of bounded size, whatever the shard's."""
    if pivots is None:
        return placed.withColumn("cell", F.lit(0))
    held = pivots.select("shard").distinct()  # as many as centroids at most, so the numbers of groups are literals
    loads = placed.join(F.broadcast(held), "shard").groupBy("shard").agg(F.ceil(F.count("*") / F.lit(4 * PIECE)).cast("int")).collect()
    if not loads:
        return placed.withColumn("cell", F.lit(0))
    salts = F.create_map(*[F.lit(x) for r in loads for x in r])[F.col("shard")]
    large = placed.where(salts.isNotNull()).select("*", F.pmod(F.xxhash64("rep", F.lit(1)), salts.cast("long")).cast("int").alias("salt"))
    every = pivots.where(salts.isNotNull()).select("*", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    split = large.groupBy("shard", "salt").cogroup(every.groupBy("shard", "salt")).applyInPandas(lambda a, b: _around_pivots(a, b, k), f"{_PLACED}, cell int")
    return placed.where(salts.isNull()).select(*_NAMES, F.lit(0).alias("cell")).unionByName(split)


def _one_length(reps: DataFrame, cosine: float) -> tuple[DataFrame, dict]:
    """(links u < v, audit) among distinct vectors of one length: columns rep, copies, embedding."""
    n = reps.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) < F.lit(1_000_003 * share)).orderBy("rep").limit(2 * SAMPLE)
    rows = np.stack([np.array(r[0], np.float64) for r in sample.select("embedding").collect()] or [np.array(reps.first().embedding)])
    x = unit(rows)
    c = centroids(x, max(1, min(-(-n // PER_SHARD), len(x) // 16)))
    placed = written(reps.mapInPandas(lambda frames: (_homes(f, c, OVERLAP) for f in frames), _PLACED), "shards")
    sizes = {r[0]: r[1] for r in placed.groupBy("shard").count().where(F.col("count") > PIECE).collect()}  # as many as centroids at most
    pivots = None
    if sizes:
        chance = F.create_map(*[F.lit(v) for shard, size in sizes.items() for v in (shard, min(1.0, 1.0 / PER_SHARD))])[F.col("shard")]
        drawn = placed.where(F.pmod(F.xxhash64("rep", "shard", F.lit(2)), F.lit(1_000_003)) < 1_000_003 * chance)
        pivots = written(drawn.select("shard", F.hash("rep").alias("number"), "embedding"), "pivots")
    cells = written(_into_cells(placed, pivots, 1), "cells")
    counts = cells.groupBy(_CELL).agg(F.ceil(F.count("*") / F.lit(PIECE)).cast("int").alias("pieces"))
    counts = written(counts, "pieces")
    hashed = F.pmod(F.xxhash64("rep"), F.col("pieces").cast("long")).cast("int")
    index = cells.join(counts, _CELL).withColumn("piece", hashed)
    lists = index.groupBy(*_CELL, "piece").applyInPandas(_edges, "rep long, near array<long>")
    # one graph: each vector's lists from all shards that it is in, of which there are OVERLAP at most
    united = written(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    index = written(index.join(united, "rep").select(*_CELL, "piece", "rep", "copies", "embedding", "home", "near", F.lit(True).alias("node")), "index")
    planted = _planted(reps, cosine)
    everyone = reps.unionByName(planted.select("rep", F.lit(0).cast("long").alias("copies"), "embedding"))
    for probes in sorted({min(p, len(c)) for p in (PROBES, 2 * PROBES, 4 * PROBES, len(c))}):
        asked = everyone.mapInPandas(lambda frames, p=probes: (_homes(f, c, p) for f in frames), _PLACED)
        asked = written(_into_cells(asked, pivots, CELLS * probes // min(PROBES, len(c))), "asked")
        loads = asked.groupBy(_CELL).agg(F.ceil(F.count("*") / F.lit(2 * PIECE)).cast("int").alias("parts")).join(counts, _CELL)
        queries = asked.join(loads, _CELL).select(*_CELL, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int").alias("part"), "rep", "copies", "embedding", "home", F.array().cast("array<long>").alias("near"), F.lit(False).alias("node"))
        nodes = index.join(loads.drop("pieces"), _CELL).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        both = written(nodes.unionByName(queries).groupBy(*_CELL, "piece", "part").applyInPandas(lambda f: _piece(f, cosine), "u long, v long, recall double, asked long, graph boolean"), "found")
        found, audit = measured(reps, both.where("u is not null").select("u", "v"), planted, cosine)
        if (audit["recall"] is None or audit["recall"] >= RECALL_ALL) and (audit["planted_recall"] or 0.0) >= RECALL_PLANTED:
            break
    by_graph, asked_all = both.where("u is null").agg(F.sum(F.when(F.col("graph"), F.col("asked"))), F.sum("asked")).first()
    return found, audit | {"by_graph": (by_graph or 0) / asked_all if asked_all else None}


def _planted(reps: DataFrame, cosine: float) -> DataFrame:
    """(rep, embedding, source) of at most PLANTED queries that are no vectors of the table: vectors drawn by hash, turned."""
    drawn = reps.orderBy(F.xxhash64("rep", F.lit(5))).limit(PLANTED).select("rep", "embedding").collect()
    x = turned(unit(np.stack([np.array(r.embedding) for r in drawn])), 7, max(cosine, PLANTED_COSINE))
    rows = [(r.rep, v.tolist()) for r, v in zip(drawn, x)]
    out = reps.sparkSession.createDataFrame(rows, "source long, embedding array<double>").select(F.xxhash64("source", "embedding").alias("rep"), "embedding", "source")
    return out.join(reps.select("rep"), "rep", "left_anti")


def measured(reps: DataFrame, pairs: DataFrame, planted: DataFrame, cosine: float) -> tuple[DataFrame, dict]:
    """(links u < v of vectors, each once, {recall, linked, planted_recall}) of the pairs that searches have found.

    A link that one of its ends has found counts for both. recall: the mean share of true links found over vectors that have one, of
    AUDIT_ALL drawn by hash and held against all vectors in blocks; null where none of them has a link, and linked is how many have.
    planted_recall: the share of planted queries that have found the vector that they were made of."""
    marks = F.broadcast(planted.select(F.col("rep").alias("u"), "source"))  # PLANTED rows at most
    links = written(pairs.join(marks, "u", "left_anti").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    made = planted.count()
    met = pairs.join(marks, "u").where("v = source").select("u").distinct().count()
    asked = reps.orderBy(F.xxhash64("rep", F.lit(3))).limit(AUDIT_ALL).select("rep", "embedding").collect()
    q, ids = unit(np.stack([np.array(r.embedding) for r in asked])), np.array([r.rep for r in asked])

    def run(frames):
        total = np.zeros(len(ids), np.int64)
        for f in frames:
            for at in range(0, len(f), 1000):
                part = f.iloc[at : at + 1000]
                inside = q @ unit(np.stack(part.embedding.to_list())).T >= cosine
                total += (inside & (ids[:, None] != part.rep.to_numpy()[None, :])).sum(1)
        yield pd.DataFrame({"rep": ids, "n": total})

    true = {r[0]: r[1] for r in reps.mapInPandas(run, "rep long, n long").groupBy("rep").agg(F.sum("n")).collect()}
    drawn = F.broadcast(reps.sparkSession.createDataFrame([(int(i),) for i in ids], "rep long"))  # AUDIT_ALL rows at most
    ends = links.select(F.col("u").alias("rep")).unionByName(links.select(F.col("v").alias("rep")))
    got = {r[0]: r[1] for r in ends.join(drawn, "rep", "left_semi").groupBy("rep").count().collect()}
    of = np.array([true.get(int(i), 0) for i in ids])
    recall = mean_recall(np.array([got.get(int(i), 0) for i in ids]), of)
    return links, {"recall": None if np.isnan(recall) else recall, "linked": int((of > 0).sum()), "planted_recall": met / made if made else None}


def _classes(kept: DataFrame) -> DataFrame:
    """(embedding, first, copies, rep) of distinct vectors; rep is a hash under a salt for which no two of them have the same."""
    grouped = kept.where("embedding is not null").groupBy("embedding").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    for salt in range(8):
        classes = written(grouped.select("*", F.xxhash64("embedding", F.lit(salt)).alias("rep")), "vectors")
        if classes.groupBy("rep").count().where("count > 1").isEmpty():
            return classes
    raise RuntimeError("no salt without a collision of hashes")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """A row per row of vectors: id, n_links (other rows at `cosine` or more), component_id (least id reachable), kept, and of the audit:
    recall, linked, planted_recall (see measured()) and by_graph, the share of searches that went through the graph, not through a whole
    piece. Of several lengths the least recalls and the sum of linked.

    Null, empty and zero vectors and those with null or non-finite components link with nothing; neither do vectors of unlike length, each
    of which is searched in a job of its own. Equal vectors are searched once and count as many links as there are copies. Null ids take
    part and are never a component's id unless all its ids are null. Other columns are not read. Whole similarities are computed in double
    precision, so no link found is below `cosine`; a link counts for both its ends. Where an audited recall is low, in a piece or over all
    vectors, the search is widened, at last to all comparisons.
    """
    x = F.col(vector_col).cast("array<double>")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), x).alias("embedding"))
    classes = _classes(kept)
    links, audits = None, []
    for (length,) in classes.select(F.size("embedding")).distinct().collect():
        found, audit = _one_length(classes.where(F.size("embedding") == length).select("rep", "copies", "embedding"), cosine)
        audits.append(audit)
        links = found if links is None else links.unionByName(found)
    least = lambda name: F.lit(min((a[name] for a in audits if a[name] is not None), default=None)).cast("double").alias(name)
    told = [least("recall"), F.lit(sum(a["linked"] for a in audits)).cast("long").alias("linked"), least("planted_recall"), least("by_graph")]
    if links is None:
        return kept.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"), *told)
    joined = connected_components(links).withColumnRenamed("node", "rep")
    rooted = classes.join(joined, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("least"))
    ends = links.select(F.col("u").alias("rep"), F.col("v").alias("other")).unionByName(links.select(F.col("v").alias("rep"), F.col("u").alias("other")))
    degree = ends.join(classes.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("found"))
    of = rooted.join(lowest, "root").join(degree, "rep", "left").select("embedding", "least", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = kept.join(of, "embedding", "left").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    return out.select("*", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"), *told)


def op2_graph_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
