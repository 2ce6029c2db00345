"""SimHash near-duplicates: 64-bit fingerprints, a byte-position inverted index with count filtering, exact verification."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from .common import own_names, small_batches, table, text_or_empty, written
from .components import connected_components

SEED = 42
#: The index' slots: the 14 sets of four byte positions whose numbers cancel out under exclusive or. Any three positions are in
#: one slot together, so that two fingerprints equal at 8, 7 or 6 positions share 14, 7 or 3 slots, and at fewer one at most.
SLOTS = tuple(c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0)
#: Slots that a pair within 2 bits shares at least, as it is equal at 6 byte positions or more.
MATCHES = 3
#: Lists of more fingerprints are split by a further position each, until they are as short or SPLITS positions have been added: two
#: bytes, then two nibbles of the last two bytes, after which 8 bits are free, so that no list has more than 256.
LIST_LIMIT, SPLITS = 16, 4
_CHUNK = 1 << 16
#: Lists that a shingle set stands in for near_copies(), and the minimum hashes that two sets share to meet in one.
LISTS, TOGETHER = 24, 4
#: Single minimum hashes that split a long list, and the members of a list, or of a block of one, that are compared in one row: a row of
#: two blocks has 2 MB, and its pairs take a second.
FINE, GATHERED = 16, 4096
#: Bits of a set's bitmap, by which pairs are told that can't have the similarity.
BITS = 1024


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer; no word: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


@arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """fingerprint() of each text, as the signed long with the same bits."""
    return pa.array(np.array([fingerprint(t) if t else 0 for t in texts.to_pylist()], np.uint64).astype(np.int64), pa.int64())


def _byte(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))


def postings(fps: DataFrame) -> DataFrame:
    """(slot, bytes, fp): the inverted index, whose keys are a slot and the four bytes at its positions."""
    key = lambda slot: sum((_byte(F.col("fp"), k) * (1 << 8 * n) for n, k in enumerate(slot)), F.lit(0).cast("long"))
    keys = [F.struct(F.lit(n).alias("slot"), key(slot).alias("bytes")) for n, slot in enumerate(SLOTS)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.slot", "k.bytes", "fp")


def _unit(fp: Column, q: Column) -> Column:
    """The bits of fp at a position: 0 to 7 are its bytes, 8 to 23 its nibbles."""
    shift, mask = F.when(q < 8, q * 8).otherwise((q - 8) * 4), F.when(q < 8, 255).otherwise(15)
    return F.call_function("shiftrightunsigned", fp, shift.cast("int")).bitwiseAND(mask.cast("long"))


def tallied(lists: DataFrame) -> DataFrame:
    """(u, v, n), u < v: in how many slots two fingerprints of lists(slot, bytes, unlike, fp) meet. A list gives only pairs that differ at
    its positions `unlike`: those that are equal there meet in another list of the slot, so that a slot counts once."""
    held = lists.groupBy("slot", "bytes", "unlike").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda x, k: F.transform(F.slice("fps", k + 2, F.size("fps")), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    met = held.select("unlike", F.explode(pairs).alias("p")).where(F.forall("unlike", lambda q: _unit(F.col("p.u"), q) != _unit(F.col("p.v"), q)))
    return met.groupBy("p.u", "p.v").agg(F.count("*").alias("n"))


def split(lists: DataFrame, step: int) -> DataFrame:
    """Each list(slot, bytes, left, unlike, fp) by one position more. A pair within 2 bits differs at 2 positions at most, so of any three
    positions left it is equal at one: three lists for each fingerprint, and a pair meets in that of the first at which it is equal."""
    each = lists.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("q", F.col("left")[F.col("i")])
    left = F.filter("left", lambda x: x != F.col("q"))
    if step == 1:  # two bytes are left: their nibbles
        left = F.flatten(F.transform(left, lambda p: F.array(8 + 2 * p, 9 + 2 * p)))
    return each.select("slot", F.xxhash64("bytes", "q", _unit(F.col("fp"), F.col("q"))).alias("bytes"), left.alias("left"), F.concat("unlike", F.slice("left", F.lit(1), F.col("i"))).alias("unlike"), "fp")


def links(fps: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (u, v), u < v, of all distinct fingerprints (column fp, no repeats) at 1 or 2 differing bits.

    Shared slots of the index are counted by pair, pairs with MATCHES or more are retained and verified bit by bit. Lists of more than
    list_limit are first split by further positions; the slots that a pair shares stay the same.
    """
    rest = F.array(*[F.array(*[F.lit(k) for k in range(8) if k not in slot]) for slot in SLOTS])
    now = postings(fps).select("slot", "bytes", rest[F.col("slot")].alias("left"), F.array().cast("array<int>").alias("unlike"), "fp")
    parts, key = [], ["slot", "bytes", "unlike"]
    for step in range(SPLITS + 1):
        sizes = now.groupBy(key).count().where("count > 1")
        if step == SPLITS:
            parts.append(now.join(sizes, key, "left_semi"))
            break
        sizes = written(sizes, "sizes")
        parts.append(now.join(sizes.where(F.col("count") <= list_limit), key, "left_semi"))
        long = sizes.where(F.col("count") > list_limit)
        if long.isEmpty():
            break
        now = split(written(now.join(long, key, "left_semi"), "long"), step)
    lists = parts[0]
    for part in parts[1:]:
        lists = lists.unionByName(part)
    return tallied(lists).where(F.col("n") >= MATCHES).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hexadecimal digits), component_id (least id reachable), kept.

    Null texts count as empty; texts without words have fingerprint zero and link like any other. Rows with a null id take part;
    a component of such rows only has a null component_id. Repeated rows give repeated rows. Other columns of docs are ignored.
    kept: the row's id is its component's.
    """
    small_batches(docs.sparkSession)
    hashed = written(docs.select(F.col(id_col).alias("id"), fingerprints(text_or_empty(text_col)).alias("fp")), "fingerprints")
    classes = written(hashed.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    found = connected_components(links(classes.select("fp")))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = rooted.where("component is not null").groupBy("root").agg(F.min("first").alias("least"))
    of = rooted.join(least, "root", "left").select("fp", F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return hashed.join(of, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def shingle_set(text: str, shingle_words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    k = min(shingle_words, len(words))
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)] if words else [], np.uint64))


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of a shingle set; none: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _positions(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """A key for each of LISTS positions: TOGETHER minimum hashes of the set. Sets of similarity s agree at one with chance s ** TOGETHER.
    And the first FINE minimum hashes one by one."""
    draw = np.random.default_rng(SEED).integers(0, 1 << 63, (2, LISTS * TOGETHER), np.uint64)
    least = np.full(LISTS * TOGETHER, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048, None] * (2 * draw[0] + 1) + draw[1]).min(0))
    if not len(hashes):
        return [], []
    return [xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(least.reshape(LISTS, TOGETHER))], least[:FINE].tolist()


def _signed(values) -> list[int]:
    return np.array(values, np.uint64).astype(np.int64).tolist()


def _sets(shingle_words: int):
    @arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(shingle_set(t, shingle_words)) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return sets


def _signatures(shingle_words: int):
    @arrow_udf("digest long, fp long, size int, keys array<long>, fine array<long>, bits binary")
    def signatures(texts: pa.Array) -> pa.Array:
        found = [shingle_set(t, shingle_words) for t in texts.to_pylist()]
        digests = pa.array(_signed([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found]), pa.int64())
        keys, fine = (pa.array([_signed(x) for x in each], pa.list_(pa.int64())) for each in (zip(*map(_positions, found)) if found else ([], [])))
        bits = pa.array([_bits(h) for h in found], pa.binary())
        return pa.StructArray.from_arrays([digests, pa.array(_signed([folded(h) for h in found]), pa.int64()), pa.array([len(h) for h in found], pa.int32()), keys, fine, bits], names=["digest", "fp", "size", "keys", "fine", "bits"])

    return signatures


def _bits(hashes: np.ndarray) -> bytes:
    """A bitmap of BITS in which each hash sets one."""
    flags = np.zeros(BITS, bool)
    flags[(hashes % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def possible_pairs(part: np.ndarray, size: np.ndarray, bits: np.ndarray, similarity: float) -> np.ndarray:
    """Rows (i, j), i < j, of unlike parts whose sets may have the similarity: a bit that only one set has is a shingle that the other lacks."""
    found = []
    for at in range(0, len(part), 32):
        a = slice(at, at + 32)
        shared = np.bitwise_count(bits[a, None, :] & bits[None, at:, :]).sum(2, dtype=np.int64)
        own = np.bitwise_count(bits[at:]).sum(1, dtype=np.int64)
        most = np.minimum((size[a] - own[: len(size[a])])[:, None], (size[at:] - own)[None, :]) + shared
        most = np.minimum(most, np.minimum(size[a][:, None], size[at:][None, :]))
        total = size[a][:, None] + size[at:][None, :]
        i, j = np.nonzero((part[a][:, None] != part[at:][None, :]) & (most >= similarity * (total - most)))
        found.append(np.stack((i, j), 1)[i < j] + at)
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _pairs(similarity: float):
    """Of a row's members the pairs of unlike parts that may have the similarity, in one row only of all those that a pair meets in: that
    of the first list that it shares, and in a list that is split that of the first minimum hash. Of two blocks only pairs between them;
    of a block with the members of lesser parts (other -1), pairs of these only in block 0."""

    @arrow_udf("array<struct<u:long,v:long>>")
    def pairs(lists: pa.Array) -> pa.Array:
        out = []
        for row in lists:
            members, number, at, block, other = (row[k] for k in ("members", "list", "at", "block", "other"))
            m, number, at, block, other = members.values, number.as_py(), at.as_py(), block.as_py(), other.as_py()
            digest, part, size, side = (m.field(k).to_numpy(zero_copy_only=False) for k in ("digest", "part", "size", "side"))
            bits = np.frombuffer(b"".join(m.field("bits").to_pylist()), np.uint64).reshape(len(digest), -1)
            keys = m.field("keys").flatten().to_numpy(zero_copy_only=False).reshape(len(digest), -1)
            i, j = possible_pairs(part, size.astype(np.int64), bits, similarity).T
            keep = (keys[i] == keys[j]).argmax(1) == number
            if at >= 0:
                fine = m.field("fine").flatten().to_numpy(zero_copy_only=False).reshape(len(digest), -1)
                keep &= ((fine[i] == fine[j]) & (np.arange(FINE) // TOGETHER != number)).argmax(1) == at
            if other < 0:
                keep &= (side[i] >= 0) | (side[j] >= 0) | (block == 0)
            elif block != other:
                keep &= side[i] != side[j]
            ends = digest[np.stack((i[keep], j[keep]), 1)]
            out.append([{"u": u, "v": v} for u, v in zip(ends.min(1).tolist(), ends.max(1).tolist())])
        return pa.array(out, pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int64())])))

    return pairs


def _mixed(rows: DataFrame) -> DataFrame:
    """Members (key, part, ...) of lists that hold several parts, with the list's length n, its largest part, and how many are of others."""
    counts = rows.groupBy("key", "part").agg(F.count("*").alias("c"))
    lists = counts.groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("parts"), F.max(F.struct("c", "part")).alias("top")).where("parts > 1")
    return written(rows.join(lists.select("key", "n", F.col("top.part").alias("major"), (F.col("n") - F.col("top.c")).alias("minors")), "key"), "mixed")


_MEMBER = ("key", "list", "at", "block", "other", "side", "digest", "part", "size")


def _in_rows(mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members as they are compared in rows, members of lists that are still too long): lists of at most GATHERED in one row; of longer ones
    with at most so many apart from the largest part, a block of this part and all the others in each row."""
    none = F.lit(0)
    short = mixed.where(F.col("n") <= GATHERED).withColumns({"block": none, "other": none, "side": none}).select(*_MEMBER)
    led = mixed.where((F.col("n") > GATHERED) & (F.col("minors") <= GATHERED)).withColumn("blocks", F.ceil(F.col("n") / F.lit(GATHERED)).cast("int"))
    major = F.col("part") == F.col("major")
    own = F.array(F.pmod(F.xxhash64("digest", "key"), F.col("blocks").cast("long")).cast("int"))
    dealt = led.withColumns({"side": F.when(major, 0).otherwise(-1), "other": F.lit(-1), "block": F.explode(F.when(major, own).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))})
    return short.unionByName(dealt.select(*_MEMBER)), mixed.where((F.col("n") > GATHERED) & (F.col("minors") > GATHERED))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: id_col, component_id, kept, as near_duplicates(), linked by the Jaccard similarity of their shingles.

    Fingerprints come first, as in near_duplicates(): sets whose fingerprints are equal or within 2 bits, by the index and its counts of
    shared slots, are verified on whole sets. But at 0.8 fingerprints of 64 bits lie up to 18 bits apart and more, where no guaranteed
    minimum of shared positions remains. So sets also meet in lists of positional minimum hashes (at 0.8, 3 pairs in a million meet in none), and every link is verified on whole sets.
    Each fingerprint's sets are compared with one of them, and these with each other; each list's members with one of them, another in each list; then, where a list still holds several
    components, pairs between them, of which bitmaps leave those that can be alike. So a large group of near copies is joined in
    proportion to its size. Of lists with more than GATHERED members the largest component is dealt into blocks, each of which meets the
    few others. Where these are more than GATHERED too, as for a passage that very many unlike texts share, the list is split by 12 or
    more single minimum hashes apart from its own (a pair at 0.8 agrees at none with a chance of 4 in a billion); what even these don't
    split is compared in pairs of blocks, so that no row holds a list. A pair is compared in the first list that it meets in only.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    signed = written(texts.select("id", F.xxhash64("text").alias("source"), _signatures(shingle_words)("text").alias("s")).select("id", "source", "s.*"), "signatures")
    classes = written(signed.groupBy("digest").agg(F.min("id").alias("first"), F.min("source").alias("source"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("fine").alias("fine"), F.first("bits").alias("bits")), "classes")
    every = classes.select("digest", "source", "size", F.posexplode("keys").alias("list", "key"))
    lists = every.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("digest", "key").alias("draw"), "digest", "size")).alias("lead")).where("n > 1")
    index = written(every.join(lists, "key").select("key", "list", "digest", "source", "size", "lead"), "index")
    fits = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b)
    heads = written(classes.groupBy("fp").agg(F.min(F.struct("digest", "source", "size")).alias("head")), "heads")
    same = classes.join(heads, "fp").where("digest <> head.digest").select(F.struct("digest", "source", "size").alias("a"), F.col("head").alias("b"))
    apart = links(heads.select("fp")).join(heads.toDF("u", "a"), "u").join(heads.toDF("v", "b"), "v").select("a", "b")
    close = written(same.unionByName(apart).where(fits(F.col("a.size"), F.col("b.size"))), "close")
    asked = index.select("digest", "source").unionByName(close.select("a.digest", "a.source")).unionByName(close.select("b.digest", "b.source")).distinct()
    wanted = asked.select("source").distinct()
    shown = texts.withColumn("source", F.xxhash64("text")).join(wanted, "source", "left_semi").select("source", _sets(shingle_words)("text").alias("hashes"))
    shown = shown.groupBy("source").agg(F.first("hashes").alias("hashes"))
    sets = written(asked.join(shown, "source").select("digest", "hashes"), "sets")

    def alike(pairs: DataFrame) -> DataFrame:
        """Of pairs (u, v) of digests: edges at `similarity` or more."""
        both = pairs.distinct().join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v").withColumn("both", F.size(F.array_intersect("a", "b")))
        return both.where(F.col("both") >= similarity * (F.size("a") + F.size("b") - F.col("both"))).select("u", "v")

    led = index.where("digest <> lead.digest").where(fits(F.col("size"), F.col("lead.size"))).select(F.least("digest", "lead.digest").alias("u"), F.greatest("digest", "lead.digest").alias("v"))
    met = close.select(F.least("a.digest", "b.digest").alias("u"), F.greatest("a.digest", "b.digest").alias("v"))
    first = written(alike(met.unionByName(led)), "links")
    joined = connected_components(first)
    parts = index.select("key", "list", "digest", "size").join(joined.withColumnRenamed("node", "digest"), "digest", "left").select("key", "list", "digest", "size", F.coalesce("component", "digest").alias("part"))
    whole = _mixed(written(parts.withColumn("at", F.lit(-1)), "parts"))
    rows, long = _in_rows(whole)
    fine = long.join(classes.select("digest", "fine"), "digest").select("key", "list", "digest", "size", "part", F.posexplode("fine").alias("at", "least")).where(F.floor(F.col("at") / TOGETHER) != F.col("list"))
    more, long = _in_rows(_mixed(fine.select(F.xxhash64("key", "at", "least").alias("key"), "list", "at", "digest", "size", "part")))
    # members of a list that is still long lie in blocks by hash; each goes to the pairs of its block with all
    own = long.withColumn("blocks", F.ceil(F.col("n") / F.lit(GATHERED)).cast("int")).withColumn("side", F.pmod(F.xxhash64("digest", "key"), F.col("blocks").cast("long")).cast("int"))
    paired = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"block": F.least("side", "with"), "other": F.greatest("side", "with")})
    members = rows.unionByName(more).unionByName(paired.select(*_MEMBER)).join(classes.select("digest", "bits", "keys", "fine"), "digest")
    # 31 bits of each key tell whether a pair met in an earlier list: at the 24 keys of a pair they err once in 90 million
    low = lambda c: F.transform(c, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    members = members.withColumns({"keys": low("keys"), "fine": F.when(F.col("at") >= 0, low("fine"))})
    held = members.groupBy("key", "list", "at", "block", "other").agg(F.collect_list(F.struct("digest", "part", "size", "side", "bits", "keys", "fine")).alias("members"))
    held = held.select(F.struct("members", "list", "at", "block", "other").alias("row"))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)  # of rows that hold lists
    second = written(alike(held.select(F.explode(_pairs(similarity)("row")).alias("p")).select("p.u", "p.v")), "second")
    small_batches(docs.sparkSession)
    found = connected_components(first.unionByName(second)).withColumnRenamed("node", "digest")
    rooted = classes.select("digest", "first").join(found, "digest", "left").withColumn("root", F.coalesce("component", "digest"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select("digest", "component_id")
    return signed.join(of, "digest").select(F.col("id").alias(id_col), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component: that with the component's id. Repeated ids of that value keep one row.

    Components are those of near_duplicates(), with a similarity those of near_copies().
    """
    rows = near_duplicates(docs, id_col, text_col) if similarity is None else near_copies(docs, id_col, text_col, shingle_words, similarity)
    names = own_names(docs, "key", "none")
    keys = lambda: [F.coalesce(id_col, F.lit(-1)).alias(names[0]), F.col(id_col).isNull().alias(names[1])]
    keep = rows.where("kept").select(*keys()).distinct()
    return docs.select("*", *keys()).join(keep, names, "left_semi").dropDuplicates(names).drop(*names)
