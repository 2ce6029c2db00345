"""Personal data: patterns of four kinds, and identifiers found by bootstrapped contexts; by DataFrame functions only.

Seeds are the base entities and strings of a shape that tells keys: long hexadecimal ones. The words and marks around them are
lexical patterns; patterns and identifier-like strings form a bipartite graph, whose edges say that a string was seen in a pattern.
Scores go from seeds to patterns and from patterns to strings, in turn, until no string is added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_names, table, text_or_empty, written

KINDS = ("email", "ip", "card", "phone", "id")
#: The base patterns, with possessive repeats and a look behind where these can't change a match: every text takes linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Candidates: strings of letters, digits, _ and - with 4 digits or more, and groups of digits that follow after one blank, dot or slash.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?:[A-Za-z_-]*+[0-9]){4}[A-Za-z0-9_-]*+(?:[\x20./][0-9]{2,}+(?![A-Za-z_]))*+"
#: Candidates of this shape are seeds, as base entities are.
KEY = r"^(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"
#: What patterns are made of: words, and single marks; and the characters to either side of a span in which they are looked for.
UNIT, CONTEXT = r"[\p{L}\p{N}_]++|[^\s\p{L}\p{N}_]", 64
#: A pattern counts if so many of the distinct strings in it are seeds or found, and this share (of one more, as a bound for small numbers); a string if its patterns make it so sure.
PATTERN_SUPPORT, PATTERN_SHARE, SURE = 5, 0.75, 0.9
_CHUNK = 256
_BLOCK = 4096
_OCCURRENCE = "struct<start:bigint,kind:int,end:bigint,word:string,left:string,around:string>"


def _with(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is not evaluated again for each element."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, add: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each element, the sum of those before it, or what else `add` makes of them and 0. Lists are taken in chunks, so that the work stays near to linear."""
    none = F.array().cast("array<bigint>")

    def run(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.struct(start.cast("bigint").alias("t"), none.alias("l")), lambda s, v: F.struct(add(s["t"], v).alias("t"), F.concat(s["l"], F.array(s["t"])).alias("l")))["l"]

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda c: F.slice(values, c * _CHUNK + 1, _CHUNK))

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), add))
        return F.flatten(F.zip_with(parts, run(sums, F.lit(0)), run))

    return _with(chunks, joined)


def _patterns(before: Column, after: Column) -> Column:
    """(left, around): the last two words before a span, or the last three words and marks where it follows a mark; and the last
    word, or the last two where it follows a mark, with the first word or mark after. Empty where there are too few."""
    units = lambda text: F.regexp_extract_all(F.lower(text), F.lit(UNIT), F.lit(0))

    def build(w: Column, right: Column) -> Column:
        marked = F.coalesce(F.try_element_at(w, F.lit(-1)).rlike(r"^[^\p{L}\p{N}_]"), F.lit(False)).cast("int")
        last = lambda n: F.when(F.size(w) >= n, F.array_join(F.slice(w, -n, n), " ")).otherwise("")
        near = last(1 + marked)
        around = F.when((near != "") & (F.size(right) > 0), F.concat(near, F.lit(" _ "), F.try_element_at(right, F.lit(1))))
        return F.struct(last(2 + marked).alias("left"), F.coalesce(around, F.lit("")).alias("around"))

    return _with(units(F.substring(before, -CONTEXT, CONTEXT)), lambda w: _with(units(F.substring(after, 1, CONTEXT)), lambda right: build(w, right)))


def _spans(text: Column, pattern: str, kind: int, fits: Callable[[Column], Column]) -> Column:
    """All matches that fit, with start and end in code points, and the patterns that they stand in."""

    def build(hits: Column, pieces: Column) -> Column:
        lengths = F.zip_with(hits, F.slice(pieces, 1, F.size(hits)), lambda h, p: (F.length(h) + F.length(p)).cast("bigint"))

        def one(h: Column, i: Column, before: Column) -> Column:
            start = before[i] + F.length(pieces[i])
            return _with(_patterns(pieces[i], pieces[i + 1]), lambda p: F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(h)).alias("end"), h.alias("word"), p["left"].alias("left"), p["around"].alias("around")))

        every = _with(_before(lengths), lambda before: F.transform(hits, lambda h, i: F.when(fits(h), one(h, i, before))))
        return F.filter(every, lambda s: s.isNotNull())

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{_OCCURRENCE}>")
    return _with(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(_with(F.split(text, pattern, -1), lambda p: build(h, p)).cast(f"array<{_OCCURRENCE}>")))


def base_spans(text: Column) -> Column:
    """The base entities, ordered by start, then kind."""
    digits = lambda h: F.regexp_replace(h, "[^0-9]+", "")
    between = lambda h, a, b: F.length(digits(h)).between(a, b)
    found = F.concat(
        _spans(text, EMAIL, 0, lambda h: F.lit(True)),
        _spans(text, IP, 1, lambda h: h.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        _spans(text, CARD, 2, lambda h: between(h, 12, 19) & F.call_function("luhn_check", digits(h))),
        _spans(text, PHONE, 3, lambda h: between(h, 9, 15)),
    )
    return F.sort_array(found)


def _alone(base: Column, candidates: Column) -> Column:
    """Candidates that no base span touches: none before reaches into them, and the next one in the order of both begins after."""
    both = F.sort_array(F.concat(base, candidates))

    def free(every: Column, reach: Column) -> Column:
        def test(s: Column, i: Column) -> Column:
            after = F.try_element_at(every, i + 2)
            met = F.coalesce((after["kind"] != 4) & (after["start"] < s["end"]), F.lit(False))
            return (s["kind"] == 4) & (reach[i] <= s["start"]) & ~met

        return F.filter(every, test)

    reach = lambda every: _before(F.transform(every, lambda s: F.when(s["kind"] == 4, F.lit(0).cast("bigint")).otherwise(s["end"])), lambda a, b: F.greatest(a, b))
    return F.when(F.size(candidates) == 0, candidates).otherwise(_with(both, lambda every: _with(reach(every), lambda r: free(every, r))))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, base, others): each row's base spans and candidates. key: hash of id and text, the same for like rows only."""
    text = docs.select(F.col(id_col), F.xxhash64(F.col(id_col), text_or_empty(text_col)).alias("key"), text_or_empty(text_col).alias("_text"))
    found = text.select(id_col, "key", F.struct(base_spans(F.col("_text")).alias("base"), _spans(F.col("_text"), CANDIDATE, 4, lambda h: F.lit(True)).alias("c")).alias("f"))
    return found.select(id_col, "key", _with(F.col("f"), lambda f: F.struct(f["base"].alias("base"), _alone(f["base"], f["c"]).alias("others"))).alias("f")).select(id_col, "key", "f.base", "f.others")


def discovered(found: DataFrame) -> DataFrame:
    """(key, start, end) of candidates that stand in high-confidence patterns, from occurrences().

    In each round a pattern's confidence is the share of its distinct strings that are seeds or were found with SURE or more; a
    string's is 1 - product of (1 - confidence) over its patterns that have PATTERN_SHARE and PATTERN_SUPPORT. Confidences only
    grow, so the rounds end when no string is added. Sums and joins are over distinct (pattern, string) edges. Seeds by their shape
    are no spans by that alone: they, too, must stand in such patterns.
    """
    seen = found.select("key", F.explode(F.concat("base", "others")).alias("o")).select("key", "o.*")
    patterns = F.filter(F.array(F.when(F.col("left") != "", F.concat(F.lit("L "), "left")), F.when(F.col("around") != "", F.concat(F.lit("A "), "around"))), lambda p: p.isNotNull())
    seed = ((F.col("kind") < 4) | F.col("word").rlike(KEY)).cast("int")
    edges = written(seen.select(F.explode(patterns).alias("pattern"), "word", (F.col("kind") == 4).cast("int").alias("open"), seed.alias("seed")).groupBy("pattern", "word").agg(F.max("seed").alias("seed"), F.max("open").alias("open")), "edges")
    sure, strings = None, -1
    while True:
        good = F.col("seed").cast("double")
        scored = edges.withColumn("good", good)
        if sure is not None:
            scored = edges.join(sure.withColumn("f", F.lit(1.0)), "word", "left").withColumn("good", F.greatest(good, F.coalesce("f", F.lit(0.0))))
        kept = scored.groupBy("pattern").agg(F.sum("good").alias("support"), F.count("*").alias("strings")).withColumn("confidence", F.col("support") / (F.col("strings") + 1))
        kept = kept.where((F.col("support") >= PATTERN_SUPPORT) & (F.col("confidence") >= PATTERN_SHARE)).select("pattern", "confidence")
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))))
        sure = written(edges.where("open = 1").join(kept, "pattern").groupBy("word").agg((1 - F.exp(doubt)).alias("score")).where(F.col("score") >= SURE).select("word"), "sure")
        last, strings = strings, sure.count()
        if strings <= max(last, 0):
            return seen.where("kind = 4").join(sure, "word", "left_semi").select("key", "start", "end").distinct()


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(name[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _added(found: DataFrame) -> DataFrame:
    return discovered(found).groupBy("key").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("added"))


def extracted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    spans: kind:start:end of all spans, by start, then kind; kind id marks what the contexts added. Null texts are empty: no spans,
    and the hash of the empty string. Rows alike in id and text have the same spans. Contexts are learned from all rows.
    """
    found = written(occurrences(docs, id_col, text_col), "occurrences")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    rows = found.join(_added(found), "key", "left").withColumn("added", F.coalesce("added", none)).withColumn("base", _bare(F.col("base")))
    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [number(k) for k in range(4)]
    return rows.select(id_col, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def _blanked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; spans that overlap are one. Works block by block."""
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    one = "struct<start:bigint,kind:int,end:bigint>"
    none = F.array().cast(f"array<{one}>")

    def merge(state: Column, s: Column) -> Column:
        last = F.element_at(state, -1)
        wider = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end")).cast(one)
        overlap = (F.size(state) > 0) & F.coalesce(F.try_element_at(state, F.lit(-1))["end"] > s["start"], F.lit(False))
        return F.when(overlap, F.concat(F.slice(state, 1, F.greatest(F.size(state) - 1, F.lit(0))), F.array(F.coalesce(wider, s.cast(one))))).otherwise(F.concat(state, F.array(s.cast(one))))

    def block(piece: Column, j: Column, merged: Column) -> Column:
        lo = (j * _BLOCK).cast("bigint")
        inside = F.filter(merged, lambda s: (s["start"] < lo + _BLOCK) & (s["end"] > lo))

        def cut(own: Column) -> Column:
            def part(s: Column, i: Column) -> Column:
                begin = F.when(i > 0, own[F.greatest(i - 1, F.lit(0))]["end"]).otherwise(lo)
                text = F.substr(piece, (begin - lo + 1).cast("int"), F.greatest(s["start"] - begin, F.lit(0)).cast("int"))
                return F.concat(text, F.when(s["start"] >= lo, label[s["kind"]]).otherwise(""))

            rest = F.substr(piece, (F.element_at(own, -1)["end"] - lo + 1).cast("int"))
            return F.concat(F.array_join(F.transform(own, part), ""), rest)

        return _with(inside, lambda own: F.when(F.size(own) == 0, piece).otherwise(cut(own)))

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    done = _with(F.aggregate(spans, none, merge), lambda m: F.array_join(F.transform(blocks, lambda p, j: block(p, j, m)), ""))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with all spans of extracted() replaced by [EMAIL], [IP], [CARD], [PHONE] or [ID], and the number of characters adjusted.

    Texts are not shuffled for it, unless so much was added that it can't be broadcast. Null texts stay null.
    """
    found = written(occurrences(docs, id_col, text_col), "occurrences")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    key, added, changed = own_names(docs, "key", "added", "changed")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), text_or_empty(text_col)))
    rows = keyed.join(_added(found).toDF(key, added), key, "left")
    spans = F.sort_array(F.concat(_bare(base_spans(F.col(text_col))), F.coalesce(added, none)))
    out = rows.withColumn(changed, F.when(F.col(text_col).isNotNull(), _with(spans, lambda s: _blanked(F.col(text_col), s))))
    values = {text_col: F.col(changed)}
    if chars_col in docs.columns:
        values[chars_col] = F.when(F.col(text_col).isNotNull(), F.length(changed)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType)
    return out.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "documents"))
