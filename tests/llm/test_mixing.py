import re
from collections import Counter

import pytest

from cairn.llm import mixing

from .conftest import words


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > most * sizes[s]]
        if not over:
            return {**{s: most * sizes[s] for s in full}, **t}
        full |= set(over)


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 300, "Z": 5, "é": 700, None: 50, "": 1}
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "id long, source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_targets_over_many_ranges(spark, rng):
    sizes = {f"s{k}": rng.choice([0, 1, 7, 50, 900, 20_000]) for k in range(700)} | {None: 3}
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "id long, source string, size long")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = {r.source: r.target for r in mixing.targets(df).collect()}
    finally:
        spark.conf.unset(coalesce)
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_is_near_its_targets(docs, rng):
    rows = [(i, words(rng, rng.choice([0, 3, 40, 200])), "en", rng.choice(["a", "a", "a", "a", "b", "c", None]), 0) for i in range(2500)]
    rows += [(1, "p q", "en", "a", 0)] * 3 + [(None, "n one", "en", "b", 0), (7777, None, "en", "c", 0), (7778, "w " * 3000, "en", "d", 0)]
    df = docs(rows, extra=True)
    first, again = (sorted(tuple(map(str, r)) for r in mixing.mixed(d).collect()) for d in (df, df.repartition(7)))
    assert first == again
    got = mixing.mixed(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for _, t, _, s, _ in rows:
        sums[s] = sums.get(s, 0) + size(t)
    goal = plain_targets(sums)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, *_ in rows)
    taken = dict.fromkeys(sums, 0)
    for r in got:
        assert r.source_size == sums[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    largest = {s: max(size(t) for _, t, _, x, _ in rows if x == s) for s in sums}
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sums)


def test_repeated_rows(docs, rng):
    rows = [(i, words(rng, 20), "en", "ab"[i % 2], 0) for i in range(60)] + [(3, "same", "en", "a", 0)] * 4 + [(None, "nobody's", "en", None, 0)]
    df = docs(rows, extra=True)
    mix = mixing.repeated(df)
    assert mix.columns == df.columns
    assert mix.selectExpr("sum(size(split(text, ' ')))").first()[0] == mixing.mixed(df).agg({"taken": "sum"}).first()[0]


def test_like_rows_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_LOT", 7)
    rows = [(None, "a", 5, 1)] * 50 + [(1, "a", 5, 1)] * 15 + [(2, None, 0, 3)]
    got = mixing.told_apart(spark.createDataFrame(rows, "id long, source string, size long, mark long"), ["source", "id", "size", "mark"]).collect()
    assert sorted(map(str, ((r.id, r.source, r.size, r.mark) for r in got))) == sorted(map(str, rows)) and len({r.row for r in got}) == len(rows)


def test_rows_without_ids_are_mixed_as_others(docs):
    rows = [(None, "same words here", "en", "a", 0)] * 400 + [(None, f"other words {i}", "en", "a", 0) for i in range(400)] + [(1, "x " * 50, "en", "b", 0)]
    got = mixing.mixed(docs(rows)).collect()
    of_a = [r for r in got if r.source == "a"]
    assert len(got) == len(rows) and abs(sum(r.taken for r in of_a) - of_a[0].target) <= 3


def test_columns_of_any_name_are_kept(docs):
    from pyspark.sql import functions as F

    df = docs([(1, "é " * 200_000, "en", "a", 0), (2, "x y", "en", "a", 0)]).withColumns({c: F.lit(c) for c in ("_id", "_size", "_k", "_copies", "_each", "size", "row", "k_id", "times", "mark")})
    mix = mixing.repeated(df, weights=(1.0,), share=2.0)
    assert mix.columns == df.columns
    assert sorted((r.doc_id, len(r.text), r._k, r.size) for r in mix.collect()) == [(1, 400_000, "_k", "size")] * 2 + [(2, 3, "_k", "size")] * 2


def test_empty(docs):
    assert mixing.mixed(docs([])).count() == 0
    assert mixing.repeated(docs([])).count() == 0
    (one,) = mixing.mixed(docs([(1, "")])).collect()
    assert (one.size, one.target, one.taken) == (0, 0.0, 0)


def test_like_rows_are_repeated_as_often_as_the_mix_says(docs):
    """A third of all rows alike, but for columns that the mix doesn't read: their copies are those of mixed(), whichever row has them."""
    rows = [(7, "five words of this text", "en" if i % 2 else "de", "a", None) for i in range(400)] + [(i, "w " * (i % 9), "en", "ab"[i % 2], None) for i in range(600)]
    df = docs(rows, extra=True).repartition(6)
    count = lambda found: sorted(Counter(found).items(), key=str)
    want = Counter()
    for r in mixing.mixed(df).collect():
        want[(r.doc_id, r.source)] += r.copies
    got = mixing.repeated(df)
    assert got.columns == df.columns
    assert count((r.doc_id, r.source) for r in got.collect()) == sorted(((k, v) for k, v in want.items() if v), key=str)
