import numpy as np

from cairn.llm import vectors


def plain(rows, cosine=0.9):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [k for k, (_, v) in enumerate(rows) if ok(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float32(rows[a][1]).astype(float), np.float32(rows[b][1]).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    n[a] += 1
                    n[b] += 1
                    root[find(a)] = find(b)
    ids = [min(rows[j][0] for j in range(len(rows)) if find(j) == find(k)) for k in range(len(rows))]
    return sorted(zip((r[0] for r in rows), n, ids))


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    near = x[:40].repeat(5, 0) + rng.normal(size=(200, 16)) * 0.15
    chain = np.array([[np.cos(a), np.sin(a)] + [0] * 14 for a in np.arange(0, 1.6, 0.3)])
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *near, *chain, *x[:3], *x[:3]])]
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0, None] * 8), (9004, []), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (9007, [float("inf")] * 16), (9008, [-0.0, 1.0]), (9009, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rep", "2 as copies", "3 as id")
    got = vectors.near_vectors(df.repartition(4)).collect()
    want = plain(rows)
    assert sorted((r.vec_id, r.component_id) for r in got) == sorted((i, c) for i, _, c in want)
    assert sorted((r.vec_id, r.n_links) for r in got) == sorted((i, n) for i, n, _ in want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_search_recall_and_fallback():
    rng = np.random.default_rng(4)
    x = vectors.unit(np.concatenate((rng.normal(size=(800, 24)), rng.normal(size=(1, 24)) + rng.normal(size=(150, 24)) * 0.1)))
    graph, medoids = vectors.build(x, 1), vectors.medoids_of(x)
    assert ((graph[:, : vectors.NEAR + vectors.FAR] >= 0).sum(1) <= vectors.NEAR + vectors.FAR).all() and not (graph == np.arange(len(x))[:, None]).any()
    truth = x @ x.T >= 0.9
    got, visited = vectors.search(x, graph, medoids, x, vectors.BEAM)
    assert not (got & ~truth).any() and (got & truth).sum() / truth.sum() > 0.97
    others = np.arange(len(x)) < 800
    assert vectors.search(x, graph, medoids, x[others], vectors.BEAM)[1] < 0.3 * others.sum() * len(x)  # far fewer than the piece has
    look, recall, by_graph = vectors.audited(x, graph, x, np.arange(len(x)))
    assert recall >= vectors.RECALL_PIECE if by_graph else (look(x) == truth).all()


def test_candidates_without_the_whole_matrix():
    x = vectors.unit(np.random.default_rng(6).normal(size=(600, 16)))
    near, sims = vectors.candidates_of(x, np.random.default_rng(1))
    rows = np.arange(len(x))[:, None]
    assert (near != rows).all() and (np.diff(sims, axis=1) <= 0).all()
    assert np.allclose(np.where(near >= 0, (x[rows] * x[near]).sum(2), -2), np.where(near >= 0, sims, -2))
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in near)


def test_turned_vectors_have_the_cosine():
    x = vectors.unit(np.random.default_rng(6).normal(size=(50, 9)))
    y = vectors.turned(x, 1, 0.93)
    assert np.allclose((x * y).sum(1), 0.93) and np.allclose((y * y).sum(1), 1)
    assert np.allclose(vectors.turned(np.ones((2, 1)), 1, 0.93), 1)


def test_a_broken_search_is_told_where_links_are_rare(spark):
    """Links in 1 of 1000 vectors: a search that finds nothing, or half, is seen in the planted queries, and in true links where drawn."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 32))
    x[1] = x[0] + rng.normal(size=32) * 0.1
    x[7] = x[2000] + rng.normal(size=32) * 0.1
    reps = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.tolist())], "rep long, copies long, embedding array<double>")
    planted = vectors.written(vectors._planted(reps, 0.9), "planted")
    made = [(r.rep, r.source) for r in planted.collect()]
    true = [(0, 1), (2000, 7)]
    table = lambda pairs: spark.createDataFrame(pairs, "u long, v long")
    links, audit = vectors.measured(reps, table(true + made), planted, 0.9)
    assert sorted((r.u, r.v) for r in links.collect()) == [(0, 1), (7, 2000)] and audit["planted_recall"] == 1 and audit["recall"] in (None, 1.0)
    links, audit = vectors.measured(reps, table(made[: len(made) // 2]), planted, 0.9)
    assert links.count() == 0 and audit["planted_recall"] == 0.5 and audit["recall"] in (None, 0.0) and (audit["recall"] is None) == (audit["linked"] == 0)
    assert vectors.measured(reps, table([]), planted, 0.9)[1]["planted_recall"] == 0


def test_links_are_symmetric(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_SHARD", 60)
    monkeypatch.setattr(vectors, "PIECE", 50)
    rng = np.random.default_rng(18)
    x = rng.normal(size=(200, 10))
    rows = list(enumerate(np.concatenate((x, x[:150] + rng.normal(size=(150, 10)) * 0.25, x[:3], x[:3])).tolist()))
    got = sorted((r.vec_id, r.n_links) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    u = vectors.unit(np.array([v for _, v in rows]))
    degree = (u @ u.T >= 0.9).sum(1) - 1
    assert all(n <= d for (_, n), d in zip(got, degree)) and sum(n for _, n in got) % 2 == 0
    assert sum(n for _, n in got) >= 0.97 * degree.sum()


def test_more_shards_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_SHARD", 60)
    monkeypatch.setattr(vectors, "PIECE", 50)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((x, x + rng.normal(size=x.shape) * 0.1)))]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    want = plain(rows)
    assert sum(min(a[1], b[1]) for a, b in zip(got, want)) >= 0.97 * sum(b[1] for b in want)


def test_planted_links_among_many(spark, monkeypatch):
    """Small groups beside a large one, over many shards, some of which are split around pivots: mean recall counts small groups as much."""
    monkeypatch.setattr(vectors, "SAMPLE", 400)
    monkeypatch.setattr(vectors, "PER_SHARD", 150)
    monkeypatch.setattr(vectors, "PIECE", 300)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5000, 24))
    small = x[:300].repeat(2, 0) + rng.normal(size=(600, 24)) * 0.15
    hot = x[300] + rng.normal(size=(700, 24)) * 0.15
    x = np.concatenate((x, small, hot))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.recall, r.planted_recall) for r in vectors.near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect())
    u = vectors.unit(x)
    true = (u @ u.T >= 0.9).sum(1) - 1
    found = np.array([g[1] for g in got])
    assert (found <= true).all() and vectors.mean_recall(found, true) >= 0.98
    assert vectors.mean_recall(found[:900], true[:900]) >= 0.97  # those in small groups
    assert vectors.RECALL_ALL <= got[0][3] <= 1 and vectors.RECALL_PLANTED <= got[0][4] <= 1


def test_recall_counts_queries_not_links():
    assert vectors.mean_recall(np.array([1000, 0, 0]), np.array([1000, 2, 0])) == 0.5 and np.isnan(vectors.mean_recall(np.array([0]), np.array([0])))


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = vectors.near_vectors(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in one) == [(1, 0, 1, True), (2, 0, 2, True)]
