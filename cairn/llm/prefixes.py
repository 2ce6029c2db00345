"""The prefix trie of conversations by vertical bitmaps: bitsets of conversations by (position, turn), intersected depth first."""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

#: Conversations of a shard, and positions of a window: together they bound what one group holds.
SHARD, WINDOW = 4096, 64
#: Turns that a conversation takes from the first of its five are fewer than this.
HEAD = 9
ROOT = b"\0" * 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEAD


def _numbered(batches, size: int):
    """Sorted (conv_id, tid, bytes) of one range -> with range, pos in the range's part of the conversation, and the shard in the range."""
    from pyspark import TaskContext

    at, conv, pos, convs = TaskContext.get().partitionId(), None, 0, -1
    for f in batches:
        ids = f.conv_id.to_numpy()
        if not len(ids):
            continue
        begins = np.flatnonzero(np.r_[ids[0] != conv, ids[1:] != ids[:-1]])
        starts = np.zeros(len(ids), np.int64)
        starts[begins] = 1
        nth = np.cumsum(starts) + convs
        base = np.full(len(ids), -pos, np.int64)
        for b, e in zip(begins, [*begins[1:], len(ids)]):
            base[b:e] = b
        place = np.arange(len(ids)) - base + 1
        conv, pos, convs = ids[-1], int(place[-1]), int(nth[-1])
        yield f.assign(span=np.int32(at), pos=place, shard=(np.int64(at) << 32) + nth // size)


def numbered_turns(turns: DataFrame, size: int = SHARD) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, pos from 1, tid, bytes, shard): in order of turn, null first, like ones by a hash of
    role and text. tid stands for (role, text), 16 bytes of its SHA-256; shard is a range of at most `size` conversations.

    Rows are dealt by range, so that a conversation of any length lies in several tasks, repeated rows too; one small row for each range
    tells where the conversation that it begins with goes on."""
    role, text = text_or_empty("role"), text_or_empty("text")
    tid = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256), 1, 32))
    bare = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", tid.alias("tid"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tid"), F.monotonically_increasing_id()]
    dealt = bare.repartitionByRange(*order).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "tid").select("conv_id", "tid", "bytes")
    rows = written(dealt.mapInPandas(lambda batches: _numbered(batches, size), "conv_id long, tid binary, bytes long, span int, pos long, shard long"), "turns")
    # only a range's first and last conversations can lie in others too: two small rows a range
    edges = rows.groupBy("span").agg(F.array(F.min("conv_id"), F.max("conv_id")).alias("at")).select("span", F.explode(F.array_distinct("at")).alias("conv_id"))
    shares = rows.join(F.broadcast(edges), ["span", "conv_id"]).groupBy("span", "conv_id").agg(F.count("*").alias("n"), F.min("shard").alias("shard"))
    parts = shares.withColumn("begun", F.count("*").over(Window.partitionBy("conv_id"))).where("begun > 1")
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.select("span", "conv_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.min("shard").over(Window.partitionBy("conv_id")).alias("first"))
    joined = rows.join(F.broadcast(moved), ["span", "conv_id"], "left")
    return joined.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "tid", "bytes", F.coalesce("first", "shard").alias("shard"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, shard, length), (conv_id, pos, tid, bytes, shard)): each conversation c begins with the first h turns of conversation
    c - c % 5 (all if fewer, none if absent) and goes on with its own after the first h; h = crc32 of c in decimal, modulo HEAD."""
    base = F.col("conv_id") - F.col("conv_id") % 5
    sizes = rows.groupBy("conv_id").agg(F.max("pos").alias("n"), F.min("shard").alias("shard"))
    known = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.withColumns({"base": base, "h": head_length(F.col("conv_id"))}).join(known, "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")
    convs = written(convs.select("conv_id", "base", "h", taken, "shard", (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    heads = rows.where((F.col("pos") < HEAD) & (F.col("conv_id") % 5 == 0)).select(F.col("conv_id").alias("base"), "pos", "tid", "bytes")
    heads = heads.join(convs.select("conv_id", "base", "h", "shard"), "base").where("pos <= h").select("conv_id", "pos", "tid", "bytes", "shard")
    shifts = convs.where("taken < h").select("conv_id", (F.col("taken") - F.col("h")).alias("shift"))
    own = rows.where(F.col("pos") > head_length(F.col("conv_id"))).join(shifts, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "tid", "bytes", "shard")
    return convs.select("conv_id", "shard", "length"), written(heads.unionByName(own), "rebuilt")


def _plus(key: bytes, window: int, chain: bytes) -> bytes:
    """The key of a prefix: that at the window's begin, plus what the window and its turns so far add, modulo 2**128."""
    more = hashlib.sha256(struct.pack(">q", window) + chain).digest()[:16]
    return ((int.from_bytes(key, "big") + int.from_bytes(more, "big")) % (1 << 128)).to_bytes(16, "big")


NODES = "depth long, key binary, parent binary, bytes long, n long, least long, shard long, ends string"


def _trie(f: pd.DataFrame, width: int) -> pd.DataFrame:
    """The nodes of one shard and window of positions, with the shard's members and ends of each.

    Rows (conv_id, pos, tid, bytes, length, window, key) hold the turns; key is that of the conversation's prefix at the window's begin, and
    at least one row of each conversation tells its length.
    """
    window, shard = int(f.window.iloc[0]), int(f.shard.iloc[0])
    start = window * width
    ids, local = np.unique(f.conv_id.to_numpy(), return_inverse=True)
    told = f.length.notna().to_numpy()
    lengths = np.zeros(len(ids), np.int64)
    lengths[local[told]] = f.length.to_numpy()[told].astype(np.int64)
    turn_of: list[dict] = [{} for _ in ids]  # by conversation: position -> (tid, bytes)
    postings: dict = defaultdict(int)
    tops: dict = defaultdict(int)
    for c, pos, tid, size, key in zip(local.tolist(), f.pos.tolist(), f.tid, f.bytes.tolist(), f.key):
        if pos > start:
            turn_of[c][pos] = (tid, size)
            postings[pos, tid] |= 1 << c
        tops[key] |= 1 << c
    ended: dict = defaultdict(int)
    for c, n in enumerate(lengths.tolist()):
        ended[n] |= 1 << c
    out = []

    def members(bits):
        found = np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(len(ids) // 8 + 1, "little"), np.uint8), bitorder="little"))
        return ids[found]

    def node(depth, key, parent, size, bits):
        over = bits & ended[depth] if depth in ended else 0
        least = int(ids[(bits & -bits).bit_length() - 1])
        out.append((depth, key, parent, size, bits.bit_count(), least, shard, ",".join(map(str, members(over).tolist())) if over else None))

    stack = []
    for key, bits in tops.items():
        if not window:
            node(0, ROOT, None, 0, bits)
        stack.append((start, key, hashlib.sha256(), bits, key))
    while stack:
        depth, key, chain, bits, top = stack.pop()
        rest, pos = bits & ~ended.get(depth, 0), depth + 1
        if pos > start + width:
            continue
        while rest:
            tid, size = turn_of[(rest & -rest).bit_length() - 1][pos]
            both = rest & postings[pos, tid]
            rest &= ~both
            longer = chain.copy()
            longer.update(tid)
            below = _plus(top, window, longer.digest())
            node(pos, below, key, size, both)
            stack.append((pos, below, longer, both, top))
    return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])


def _ends(batches):
    """(key, ends) sorted by key and shard -> (key, ends_sha256): each list goes through the hash as it comes."""
    key = sha = None
    for f in batches:
        done = []
        for k, text in zip(f.key, f.ends):
            k = bytes(k)
            if k != key:
                if sha is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        if done:
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if sha is not None:
        yield pd.DataFrame([(key, sha.hexdigest())], columns=["key", "ends_sha256"])


def _windowed(convs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Turns with their window and their prefix' key at its begin. Lengths come with a conversation's row at position 0, which each has,
    and with all turns beyond the first window; keys of these need sums over windows, for conversations that are so long."""
    rows = rows.withColumn("window", F.floor((F.col("pos") - 1) / width))
    none = F.lit(0).cast("long")
    roots = convs.select("conv_id", none.alias("pos"), F.lit(b"").alias("tid"), none.alias("bytes"), "shard", none.alias("window"), "length")
    early = rows.where("window = 0").withColumn("length", F.lit(None).cast("long")).unionByName(roots).withColumn("key", F.lit(ROOT))
    late = rows.join(convs.where(F.col("length") > width).select("conv_id", "length"), "conv_id")

    def chained(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos")
        chain = hashlib.sha256(b"".join(f.tid)).digest()
        more = _plus(ROOT, int(f.window.iloc[0]), chain)
        return pd.DataFrame({"conv_id": [f.conv_id.iloc[0]], "window": [f.window.iloc[0]], "hi": [more[:8]], "lo": [more[8:]]})

    added = late.groupBy("conv_id", "window").applyInPandas(chained, "conv_id long, window long, hi binary, lo binary")
    # sums modulo 2**128, in decimals of 20 digits a half
    number = lambda c: F.conv(F.hex(c), 16, 10).cast("decimal(20,0)")
    before = Window.partitionBy("conv_id").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    two64 = F.lit(str(2**64)).cast("decimal(20,0)")
    low, high = F.sum(number("lo")).over(before), F.sum(number("hi")).over(before)
    sums = added.select("conv_id", "window", low.alias("low"), high.alias("high")).where("low is not null")
    carry = F.floor(F.col("low") / two64)
    half = lambda c: F.unhex(F.lpad(F.conv(c.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0"))
    keys = sums.select("conv_id", "window", F.concat(half((F.col("high") + carry) % two64), half(F.col("low") % two64)).alias("key"))
    return early.unionByName(late.where("window > 0").join(keys, ["conv_id", "window"]))


def _subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """nodes(key, parent, leaves, saved) -> (key, n_leaves, saved_tokens), each summed over the subtree.

    Sums climb by doubling: after k rounds a node has what lies less than 2**k below it, and knows the ancestor that far above.
    """
    now = nodes.select("key", F.col("parent").alias("up"), "leaves", "saved")
    reach = 1
    while reach <= deepest:
        given = now.where("up is not null").groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        farther = now.select(F.col("key").alias("up"), F.col("up").alias("beyond"))
        moved = now.join(given.withColumnRenamed("up", "key"), "key", "left").join(farther, "up", "left")
        now = written(moved.select("key", F.col("beyond").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "climbed")
        reach *= 2
    return now.select("key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, shard: int = SHARD, window: int = WINDOW) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> a row per node of the trie of rebuilt conversations: conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Null roles and texts are empty ones; rows without conv_id belong to no conversation. Turns of one number are ordered by a hash of
    role and text, repeated rows stay. An empty table has no node, not even a root. Other columns are not read. Turns are told apart by
    128 bits of SHA-256 of role and text, prefixes by 128 bits made from these.

    Conversations are split into shards of at most `shard` by ranges of conv_id, positions into windows of `window`; a shard's window holds bitsets of its conversations
    by (position, turn), and each node's children are its bitset's intersections with these, one for each child. Shards give popcounts,
    least members and lists of those that end; they are summed by prefix, so that a prefix that very many begin with is a row a shard.
    The list behind ends_sha256 is hashed as it is read, in order of shards.
    """
    convs, rows = rebuilt(numbered_turns(conversations, shard))
    turns = _windowed(convs, rows, window)
    local = written(turns.groupBy("shard", "window").applyInPandas(lambda f: _trie(f, window), NODES), "trie")
    merged = local.groupBy("key").agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("least").alias("least"))
    merged = written(merged, "nodes")
    lists = local.where("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    ends = lists.mapInPandas(_ends, "key binary, ends_sha256 string")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    told = merged.join(children, "key", "left").na.fill(0, ["n_children"])
    told = written(told.withColumns({"leaf": F.expr("if(n_children = 0, 1L, 0L)"), "own": (F.col("n") - 1) * F.col("bytes")}), "told")
    # where a single conversation goes on alone nothing is saved and one leaf follows: only shared prefixes need sums over what lies below
    alone = told.where("n = 1 and depth > 0")
    shared = told.where("n > 1 or depth = 0")
    hung = alone.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("hung"))  # summed before it is dealt out, for a parent of very many
    trunk = written(shared.join(hung, "key", "left").select("key", "parent", (F.col("leaf") + F.coalesce("hung", F.lit(0))).alias("leaves"), F.col("own").alias("saved"), "depth"), "trunk")
    deepest = trunk.agg(F.max("depth")).first()[0] or 0
    sums = _subtree_sums(trunk, deepest)
    above = told.select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"))
    out = told.join(sums, "key", "left").join(ends, "key", "left").join(above, "parent", "left")
    return out.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


#: crc32 bit by bit: each byte is mixed in, and then shifted out (-1) eight times.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"
OP13_SQL = f"""WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS b, CAST({_CRC.format(c='c')} AS BIGINT) % {HEAD} AS h FROM (SELECT DISTINCT c FROM own)),
long AS (SELECT v.c, o.p AS place, role, text FROM convs v JOIN own o ON o.c = v.b WHERE o.p <= h UNION ALL SELECT v.c, o.p + 100, role, text FROM convs v JOIN own o ON o.c = v.c WHERE o.p > h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY place) AS d, strlen(text) AS bytes, sha256(length(role) || ':' || role || text) AS t FROM long),
paths AS (SELECT c, d, bytes, list(t) OVER (PARTITION BY c ORDER BY d) AS path FROM turns UNION ALL SELECT c, 0, 0, [] FROM convs),
ended AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
nodes AS (SELECT d, path, max(bytes) AS bytes, min(c) AS least, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE e.d IS NOT NULL), '') AS ends FROM paths LEFT JOIN ended e USING (c, d) GROUP BY d, path),
kids AS (SELECT path[:d - 1] AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
told AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids USING (path)),
below AS (SELECT list_slice(path, 1, i) AS path, sum((n - 1) * bytes) AS saved, count(*) FILTER (WHERE k = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM told) GROUP BY 1)
SELECT t.least AS conv_id, t.d AS depth, p.least AS parent_conv_id, t.n AS n_convs, t.k AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM told t JOIN below USING (path) LEFT JOIN nodes p ON p.path = t.path[:t.d - 1] AND t.d > 0"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
