import re

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from cairn.llm import simhash
from cairn.llm.common import written
from cairn.llm.components import connected_components

from .conftest import words


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_fingerprints_and_components(spark, docs, rng):
    base = words(rng, 300)
    rows = [(i, base + (f" extra{i}" if i % 3 else "")) for i in range(12)]
    rows += [(20, ""), (21, None), (22, "  \n\t"), (23, "One"), (24, "ONE"), (25, "a b"), (26, "x " * 30000), (27, "A\u00a0b c d e"), (None, base), (3, base), (3, base)]
    rows += [(100 + i, words(rng, 40)) for i in range(30)]
    got = simhash.near_duplicates(docs(rows, extra=True)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([str(i) for i, _ in rows], [f"{f:016x}" for f in fps], map(str, plain_components(fps, [i for i, _ in rows]))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("limit", [2, 16, 10_000])
def test_links_join_what_brute_force_joins(spark, limit):
    rng = np.random.default_rng(3)
    centers = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = set(centers.tolist())
    for c in centers[:10].tolist():
        for _ in range(25):
            bits = rng.choice(64, 2, replace=False)
            v = c & (2**64 - 1)
            for b in bits:
                v ^= 1 << int(b)
            fps.add(v - 2**64 if v >= 2**63 else v)
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), limit)
    found = sorted((r.u, r.v) for r in edges.collect())  # each pair once, by whatever lists
    assert found == [(u, v) for i, u in enumerate(fps) for v in fps[i + 1 :] if bin((u ^ v) & (2**64 - 1)).count("1") <= 2]
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = plain_components([f & (2**64 - 1) for f in fps], fps)
    assert [got.get(f, f) for f in fps] == want


def test_tallies_tell_shared_positions(spark):
    """A pair meets in 3 lists or more if and only if it is equal at 6 of the 8 byte positions or more."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, 8)
    rows = {tuple(np.where(rng.random(8) < 0.6, base, rng.integers(0, 256, 8)).tolist()) for _ in range(120)}
    fps = sorted(int.from_bytes(bytes(r), "little", signed=True) for r in rows)
    index = simhash.postings(spark.createDataFrame([(f,) for f in fps], "fp long")).withColumn("unlike", F.array().cast("array<int>"))
    got = {(r.u, r.v): r.n for r in simhash.tallied(index).collect()}
    equal = lambda a, b: sum(x == y for x, y in zip(a.to_bytes(8, "little", signed=True), b.to_bytes(8, "little", signed=True)))
    for i, u in enumerate(fps):
        for v in fps[i + 1 :]:
            n = got.get((u, v), 0)
            assert (n >= simhash.MATCHES) == (equal(u, v) >= 6) and n == {6: 3, 7: 7}.get(equal(u, v), n)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 3), (3, 7), (3, 9), (None, 4)]
    df = spark.createDataFrame(chain, "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 9: 3}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each(docs, rng):
    a, b = words(rng, 100), words(rng, 100)
    kept = simhash.one_of_each(docs([(4, a), (2, a), (2, a), (9, b), (None, "only null"), (None, "only null")], extra=True)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("2", a), ("9", b), ("None", "only null")])


def plain_copies(rows, k=5, similarity=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().encode().split()
        sets.append({b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) > 0]
    root = list(range(len(rows)))
    for i, j in near:
        a, b = root[i], root[j]
        root = [b if r == a else r for r in root]
    return [min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]


def test_near_copies_are_found_by_similarity(spark, docs, rng):
    """Copies with changed words, far more than 2 bits apart; a chain of copies; a large group with outliers."""
    rows = []
    for base in range(12):
        w = words(rng, 200).split()
        rows.append((100 * base, " ".join(w)))
        for copy in range(1, 5):  # each word changed takes 5 shingles: similarities around 0.8
            changed = list(w)
            for at in rng.sample(range(200), copy):
                changed[at] = f"changed{copy}"
            rows.append((100 * base + copy, " ".join(changed) + " tail" * (base % 2)))
    w = words(rng, 120).split()
    for n in range(80):
        changed = list(w)
        changed[rng.randrange(120)] = f"n{n}"
        if n % 20 == 0:
            changed[:25] = words(rng, 25).split()
        rows.append((5000 + n, " ".join(changed)))
    rows += [(9000, ""), (9001, None), (9002, "One two"), (9003, "ONE  two"), (9004, "one two three"), (None, rows[0][1]), (3, rows[0][1]), (3, rows[0][1])]
    got = simhash.near_copies(docs(rows, extra=True)).collect()
    want = plain_copies(rows)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(i), str(c)) for (i, _), c in zip(rows, want))
    kept = simhash.one_of_each(docs(rows), shingle_words=5, similarity=0.8).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, set(want)))
    far = sum(bin(plain_fingerprint(t) ^ plain_fingerprint(rows[0][1])).count("1") > 2 for (_, t), c in zip(rows, want) if c == 0)
    assert far > 0 and simhash.near_copies(docs([])).count() == 0


@pytest.mark.parametrize("gathered", [4, 16])
def test_long_lists_are_split(spark, docs, rng, monkeypatch, gathered):
    """Texts around a passage that all share: most are unlike, some near enough to be compared, few alike; lists are far longer than what
    is compared in one row, some of them even after they are split by single minimum hashes."""
    monkeypatch.setattr(simhash, "GATHERED", gathered)
    passage = words(rng, 60)
    rows = [(i, passage + " " + words(rng, rng.choice([40, 60, 200]))) for i in range(60)]
    near = words(rng, 90).split()
    for i in range(60):  # similarities of 0.6 to 0.85 with each other
        changed = list(near)
        for at in rng.sample(range(90), rng.choice([1, 2, 2, 3])):
            changed[at] = f"c{i}"
        rows.append((1000 + i, " ".join(changed)))
    got = simhash.near_copies(docs(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, c) for (i, _), c in zip(rows, plain_copies(rows)))


def test_many_fingerprints_of_one_list(spark):
    """Thousands of fingerprints that are equal at six bytes, so that bytes alone don't split their lists."""
    fps = [0x0102030405060000 + x for x in range(0, 65536, 13)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    near = set(fps)
    masks = [1 << a for a in range(16)] + [(1 << a) | (1 << b) for a in range(16) for b in range(a)]
    assert sorted((r.u, r.v) for r in edges.collect()) == sorted((f, f ^ m) for f in fps for m in masks if f ^ m in near and f < f ^ m)


def test_bitmaps_lose_no_pair():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 900, np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base[:n], int(n * 0.93), replace=False), base[n : n + 3]))) for n in (10, 60, 890) for _ in range(50)]
    bits = np.frombuffer(b"".join(map(simhash._bits, sets)), np.uint64).reshape(len(sets), -1)
    got = set(map(tuple, simhash.possible_pairs(np.arange(len(sets)), np.array(list(map(len, sets))), bits, 0.8).tolist()))
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if both(i, j) >= 0.8 * (len(sets[i]) + len(sets[j]) - both(i, j))}
    assert want and want <= got


def test_columns_of_any_name_are_kept(docs, rng):
    from pyspark.sql import functions as F

    a = words(rng, 60)
    df = docs([(1, a), (2, a), (3, words(rng, 60))]).withColumns({c: F.lit(c) for c in ("key", "none", "KEY_", "_key", "_none", "fp", "kept", "component_id")})
    for how in ({}, {"shingle_words": 5, "similarity": 0.8}):
        kept = simhash.one_of_each(df, **how)
        assert kept.columns == df.columns and sorted((r.doc_id, r.none, r.kept) for r in kept.collect()) == [(1, "none", "kept"), (3, "none", "kept")]


def test_pipeline_drops_near_copies(spark, docs, rng):
    import corpus_pipeline

    w = words(rng, 200).split()
    rows = [(1, " ".join(w)), (2, " ".join(w[:100] + ["other", "words"] + w[102:])), (3, words(rng, 200))]
    assert bin(plain_fingerprint(rows[0][1]) ^ plain_fingerprint(rows[1][1])).count("1") > 2
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(rows), "").collect()) == [1, 3]


def test_near_copies_come_through_the_index_of_fingerprints(spark, docs, rng, monkeypatch):
    """Fingerprints of the shingle sets reach the index, and pairs that it gives are links where the sets are alike, and only there."""
    rows, seen, links = [], [], simhash.links
    for base in range(20):
        w = words(rng, 400)
        rows += [(10 * base, w), (10 * base + 1, w + " tail"), (10 * base + 2, words(rng, 400))]
    rows.append((999, "a b c"))
    prints = [simhash.folded(simhash.shingle_set(t, 5)) for _, t in rows]
    assert prints[-1] == xxhash.xxh64_intdigest(b"a b c", 42) and simhash.folded(simhash.shingle_set("", 5)) == 0

    def spied(fps):
        found = written(links(fps), "links")
        seen.append((sorted(r.fp % (1 << 64) for r in fps.collect()), {(r.u % (1 << 64), r.v % (1 << 64)) for r in found.collect()}))
        return found

    monkeypatch.setattr(simhash, "links", spied)
    got = simhash.near_copies(docs(rows)).collect()
    ((given, pairs),) = seen
    assert given == sorted(set(prints))
    near = {frozenset((a, b)) for a in given for b in given if 0 < (a ^ b).bit_count() <= 2}
    assert {frozenset(p) for p in pairs} == near and near
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, c) for (i, _), c in zip(rows, plain_copies(rows)))


def test_empty(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.one_of_each(docs([])).count() == 0


def test_written_keeps_rows(spark):
    assert written(spark.range(5), "t").count() == 5
