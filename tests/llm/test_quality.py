import math
import re

from cairn.llm import quality

from .conftest import words


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = [i for i, g in enumerate(grams) if grams.count(g) > 1] if len(grams) < 400 else []
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len({j for i in twice for j in range(i, i + 3)})


def test_statistics(docs, rng):
    texts = [words(rng, rng.randrange(80)) for _ in range(30)] + ["a b c a b c a b", "a a a a a", "x y z\nx y z\n \n \nx y z", None, "", " \t\n\x0b", "#*$%& |<> é日本", "a\x0cb\x0dc d", "a b c d", "\u00a0 \u2003"]
    rows = list(enumerate(texts)) + [(None, "p q r"), (0, texts[0])]
    got = quality.statistics(docs(rows, extra=True)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(i), *plain(t)) for i, t in rows)
    (long,) = quality.statistics(docs([(1, "q r s " * 40_000)])).collect()
    assert (long.n_words, long.n_repeat_words) == (120_000, 120_000)


def test_list_is_learned_and_applied(spark, docs, rng):
    good = [(i, words(rng, 120)) for i in range(300)]
    bad = [(1000 + i, " ".join(f"{w}###" if k % 2 else w for k, w in enumerate(words(rng, 120).split()))) for i in range(100)]
    rest = [(5000, words(rng, 120)), (5001, bad[0][1] + " more"), (5002, "too short"), (5003, None), (None, words(rng, 90))]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(99999, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.judged(docs(good + bad + rest, extra=True), labels).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 405
    assert all(got[i].kept for i, _ in good) and not any(got[i].kept for i, _ in bad)
    assert got[5000].kept and not got[5001].kept and not got[5002].kept and got[5002].base_failed and not got[5003].kept and got[None].kept
    stats = quality.statistics(docs(good + bad)).join(labels, "doc_id").selectExpr("*", "if(quality = 0, 1, 0) as low", "doc_id % 3 <> 0 as grow")
    rules = quality.learn(stats)
    assert rules and "symbols >" in str(rules[0])


def test_no_labels_and_no_rows(spark, docs, rng):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in quality.judged(docs([(1, words(rng, 60))]), none).collect()] == [True]
    assert quality.judged(docs([]), none).count() == 0
    one = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.judged(docs([(1, words(rng, 60))]), one).count() == 1


def plain_list(rows):
    """Sequential covering in plain Python over rows of (measures by name, low, grow)."""
    names = list(quality.MEASURES)
    at = lambda xs, q: sorted(xs)[max(math.ceil(q * len(xs)), 1) - 1]
    shares = [(i + 1) / (quality.CUTS + 1) for i in range(quality.CUTS)]
    cuts = {m: sorted({at([x[m] for x, low, _ in rows if low in which], q) for which in ((0, 1), (1,)) for q in shares}) for m in names}
    tests = [(m, above, c) for m in names for c in cuts[m] for above in (True, False)]
    holds = lambda x, t: (x[t[0]] > t[2]) == t[1]
    count = lambda some: (sum(low for _, low, _ in some), sum(1 - low for _, low, _ in some))
    bits = lambda p, n: math.log2((p + 1e-9) / (p + n + 2e-9)) if p + n else -60.0
    found, failed = [], 0
    while len(found) < quality.MAX_RULES and failed < quality.MAX_RULES:
        growing, chosen = [r for r in rows if r[2]], []
        while len(chosen) < quality.MAX_CONDITIONS and all(count(growing)):
            now = bits(*count(growing))
            gains = []
            for t in tests:
                p, n = count([r for r in growing if holds(r[0], t)])
                gains.append(p * (bits(p, n) - now))
            if max(gains) <= 1e-9:
                break
            chosen.append(tests[gains.index(max(gains))])
            growing = [r for r in growing if holds(r[0], chosen[-1])]
        if not chosen:
            break
        pruning = [count([r for r in rows if not r[2] and all(holds(r[0], t) for t in chosen[: k + 1])]) for k in range(len(chosen))]
        value = [(p - n) / (p + n) if p + n else -1.0 for p, n in pruning]
        k = value.index(max(value))
        p, n = pruning[k]
        if not p or p / (p + n) < quality.PRECISION or quality.lower_bound(p, n) < quality.SUPPORTED:
            tests.remove(chosen[0])
            failed += 1
            continue
        found.append((chosen[: k + 1], p + n))
        rows = [r for r in rows if not all(holds(r[0], t) for t in chosen[: k + 1])]
    return found


def test_lists_agree_with_plain_covering(spark, rng, monkeypatch):
    monkeypatch.setattr(quality, "CUTS", 5)
    monkeypatch.setattr(quality, "MAX_RULES", 3)
    lengths = set()
    for noise in (0.0, 0.1):
        rows = []
        for i in range(600):
            n = rng.randrange(60, 400)
            symbols, lines = rng.randrange(n // 2), rng.randrange(20)
            low = (symbols * 5 > n and lines > 8) or n < 90
            rows.append((i, n, n * rng.randrange(3, 8), symbols, lines, rng.randrange(n // 3), int(low != (rng.random() < noise)), rng.random() < 0.67))
        df = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, low int, grow boolean")
        got = quality.learn(df)
        point = [({"n_words": float(n), "mean_chars": c / n, "symbols": s / n, "dup_lines": 10 * d / n, "repeated": w / n}, low, grow) for _, n, c, s, d, w, low, grow in rows]
        assert [([(c.measure, c.above, c.threshold) for c in r.conditions], r.covered) for r in got] == plain_list(point)
        lengths |= {len(r.conditions) for r in got}
    assert max(lengths) > 1  # a conjunction was learned


def test_few_rows_are_no_support():
    assert quality.lower_bound(0, 0) == 0 and quality.lower_bound(4, 0) < quality.SUPPORTED <= quality.lower_bound(6, 0)
    assert quality.lower_bound(900, 100) > 0.88 and quality.lower_bound(9, 1) < 0.75
