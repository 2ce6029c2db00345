import hashlib
import zlib

from pyspark.sql import functions as F

from cairn.llm import prefixes


def plain(rows):
    tid = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16]
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), tid(role, text), role, text))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(c - 5 * int(c / 5)), [])[:h] + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, cs in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return sorted(((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], sha([c for c in cs if built[c] == p])) for p, cs in nodes.items()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(rng, convs, longest, texts):
    return [(c, t, rng.choice(["user", "assistant", "système"]), rng.choice(texts)) for c in convs for t in range(rng.randrange(1, longest))]


def test_like_a_plain_trie(spark, rng):
    rows = made(rng, rng.sample(range(-40, 160), 90), 13, ["a", "bé", "日本"])
    assert got(prefixes.prefix_trie(table(spark, rows).repartition(6), shard=7, window=3)) == plain(rows)


def test_copies_of_long_conversations_over_shards(spark):
    """Prefixes that most share, long chains over many windows, and lists of ends over several shards."""
    rows = [(c, t, "u", f"turn {t}") for c in range(40) for t in range(60)] + [(100, t, "u", f"alone {t}") for t in range(400)]
    assert got(prefixes.prefix_trie(table(spark, rows), shard=5, window=8)) == plain(rows)


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(1, None, None, None), (1, 0, "u", None), (1, 0, "u", None), (1, 0, None, "x"), (None, 1, "u", "lost"), (2, 5, "u", "b"), (2, 5, "u", "a"), (7, 0, "", ""), (10, 1, "u", "z" * 100_000), (10, 2, "1:", "u"), (11, 1, "1", ":u")]
    df = table(spark, rows).withColumns({c: F.lit("x") for c in ("key", "pos", "shard", "depth", "window", "span", "n")})
    assert got(prefixes.prefix_trie(df)) == plain(rows)


def test_one_turn_repeated_many_times(spark):
    rows = [(3, 1, "u", "again")] * 500 + [(4, 1, "u", "again")] * 3
    assert got(prefixes.prefix_trie(table(spark, rows), window=16)) == plain(rows)


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(1, 200) if zlib_h(c) > 3 and c % 5)
    rows = [(c, 0, "u", "only")]
    found = got(prefixes.prefix_trie(table(spark, rows)))
    assert found == plain(rows) and len(found) == 1 and found[0][1] == 0


def zlib_h(c):
    import zlib

    return zlib.crc32(str(c).encode()) % 9


def test_empty(spark):
    assert prefixes.prefix_trie(table(spark, [])).count() == 0
