import hashlib
import math

import pytest
from pyspark.sql import functions as F

from cairn.llm import lloyd


def plain(rows, dims, k, rounds, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [e for _, e in order[:k]]
    near = lambda e: min((sum((a - b) ** 2 for a, b in zip(e, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, e in kept:
            groups.setdefault(near(e)[1], []).append(e)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    most = lloyd.MOST
    found = [(i, *near(e)) for i, e in kept]
    total = sum(d for _, d, _ in found)
    return sorted(((i, j, min(d, most), min(sum(x for _, x, y in found if y == j), most), min(total, most), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_like_plain_rounds(spark, rng, monkeypatch):
    monkeypatch.setattr(lloyd, "CHUNK", 16)
    rows = [(i, [rng.gauss(c, 0.3) for _ in range(64)]) for i, c in enumerate(rng.choice([-1, 0, 1, 2]) for _ in range(150))]
    df = lloyd.lloyd(table(spark, rows).repartition(5), rounds=6)
    assert got(df) == plain(rows, 64, 8, 6)


def test_odd_rows(spark):
    good = [0.5] * 64
    rows = [(1, good), (1, good), (2, None), (3, good[:-1]), (4, good[:-1] + [None]), (5, good[:-1] + [math.nan]), (6, good[:-1] + [math.inf]), (None, [-0.001] * 64), (7, []), (8, [1e30] + [0.0] * 63), (9, [0.0] * 64)]
    df = table(spark, rows).withColumns({"cluster": F.lit("x"), "distance": F.lit(1), "id": F.lit(2), "label": F.lit(None).cast("int")})
    found = got(lloyd.lloyd(df, k=4))
    assert found == plain(rows, 64, 4, 10)  # whole numbers beyond 64 bits too
    assert [r[0] for r in found].count(1) == 2


def test_fewer_than_k_and_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    assert got(lloyd.lloyd(table(spark, rows), dimensions=2, k=8)) == plain(rows, 2, 8, 10)
    empty = lloyd.lloyd(table(spark, []))
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and empty.count() == 0


@pytest.mark.parametrize("dims", [1, 33, 70])
def test_blocks_of_any_number(spark, rng, dims):
    rows = [(i, [rng.uniform(-3, 3) for _ in range(dims)]) for i in range(40)]
    assert got(lloyd.lloyd(table(spark, rows), dimensions=dims, k=5, rounds=3)) == plain(rows, dims, 5, 3)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [1.0, 1.0]) for i in range(20)]
    found = got(lloyd.lloyd(table(spark, rows), dimensions=2, k=3))
    assert {r[1] for r in found} == {0} and found == plain(rows, 2, 3, 10)
