import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import kernels
from tests.llm.conftest import words


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(rng, n):
    """Texts of n documents, and whether they are good: every third repeats words, shouts or is full of signs."""
    out = []
    for i in range(n):
        text = words(rng, rng.randrange(5, 200))
        if i % 3 == 0:
            text = [lambda t: " ".join(w for w in t.split() for _ in range(6)), lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | ")][i // 3 % 3](text)
        out.append((i, text, int(i % 3 != 0)))
    return out


def auc(scores, labels):
    scores, labels = np.array(scores), np.array(labels)
    a, b = scores[labels == 1], scores[labels == 0]
    return float(np.mean((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :])))


def test_held_out_accuracy_and_columns(spark, docs, rng):
    made = corpus(rng, 600)
    table = docs([(i, t) for i, t, _ in made], extra=True).withColumns({"score": F.lit(1), "y": F.lit(0), "again": F.lit("x"), "fold": F.lit(2)})
    out = kernels.scored(table.repartition(5), labelled(spark, [(i, q, 0) for i, _, q in made]))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(made) and all(got[i].held_out == held_out(i) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.7) for i in got)
    out_rows = [(got[i].score, q) for i, _, q in made if held_out(i)]
    assert auc(*zip(*out_rows)) > 0.97
    assert np.mean([got[i].predicted == q for i, _, q in made if held_out(i)]) > 0.93


def test_held_out_labels_are_not_read(spark, docs, rng):
    made = corpus(rng, 200)
    table = docs([(i, t) for i, t, _ in made])
    one = kernels.scored(table, labelled(spark, [(i, q, 0) for i, _, q in made])).collect()
    other = kernels.scored(table, labelled(spark, [(i, 1 - q if held_out(i) else q, 0) for i, _, q in made])).collect()
    near = {r.doc_id: r.score for r in other}
    assert all(math.isclose(r.score, near[r.doc_id], abs_tol=1e-6) for r in one)


def test_sums_by_partition_are_the_plain_regression(spark, rng):
    gen = np.random.default_rng(3)
    x = gen.normal(size=(300, len(kernels.STATISTICS)))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(float)
    rows = [(i % kernels.FOLDS, float(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y))]
    schema = "fold int, y double, " + ", ".join(f"{s} double" for s in kernels.STATISTICS)
    model = kernels.fit(spark.createDataFrame(rows, schema).repartition(7))
    z = model.features(x)
    best = None
    for s in kernels.STRENGTHS:  # folds left out one by one, from the rows themselves
        error, fold_weights = 0.0, []
        for k in range(kernels.FOLDS):
            inside = np.arange(len(x)) % kernels.FOLDS == k
            w = kernels._solve(z[~inside].T @ z[~inside], z[~inside].T @ y[~inside], (~inside).sum(), s)
            error += ((y[inside] - z[inside] @ w) ** 2).sum()
        best = min(best or (error, s), (error, s))
    w = kernels._solve(z.T @ z, z.T @ y, len(x), best[1])
    assert np.allclose(model.weights, w, atol=1e-6)
    assert model.knots[0] == sorted(model.knots[0]) and model.knots[1] == sorted(model.knots[1])


def test_features_approximate_the_kernel():
    d = len(kernels.STATISTICS)
    model = kernels.KernelRidge(np.zeros(d), np.ones(d), np.zeros(kernels.FEATURES + 1), [])
    x = np.random.default_rng(1).normal(size=(60, d))
    z = model.features(x)[:, :-1]
    true = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * d))
    assert np.abs(z @ z.T - true).mean() < 0.06


def test_isotonic_is_the_least_squares_fit():
    assert kernels.isotonic([1.0, 3.0, 2.0, 4.0], [1, 1, 1, 1]) == [(0, 0, 1.0), (1, 2, 2.5), (3, 3, 4.0)]
    assert kernels.isotonic([3.0, 1.0], [1, 3]) == [(0, 1, 1.5)]
    assert kernels.isotonic([], []) == []


def test_statistics_of_long_texts_by_pieces(rng, monkeypatch):
    text = "\n".join(words(rng, rng.randrange(0, 30)) for _ in range(400)).encode() + b" " + b"x" * 5000
    whole = kernels.statistics(text)
    monkeypatch.setattr(kernels, "PIECE", 37)
    assert np.allclose(kernels.statistics(text), whole)
    assert kernels.statistics(b"") == kernels.statistics(b" \n\t ") == [0.0] * len(kernels.STATISTICS)
    again = dict(zip(kernels.STATISTICS, kernels.statistics(b"a a b b b c")))
    assert again["again"] == 0.5 and again["distinct"] == 0.5 and again["short_words"] == 1


def test_odd_tables(spark, docs):
    rows = [(None, None), (1, None), (1, ""), (2, "word " * 300_000), (3, "ein Wort"), (3, "ein Wort")]
    none = kernels.scored(docs(rows), labelled(spark, []))
    assert [r.score for r in none.collect()] == [0.5] * len(rows)
    one = kernels.scored(docs(rows), labelled(spark, [(1, 1, 0), (3, 1, None), (None, 0, 0), (2, 7, 0), (99, 0, 1), (3, None, 0)]))
    assert one.count() == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in one.collect())
    assert kernels.scored(docs([]), labelled(spark, [(1, 1, 0)])).count() == 0
