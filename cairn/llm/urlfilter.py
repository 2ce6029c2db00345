"""URL filter: host and path rules first, then a weighted vocabulary whose terms an Aho-Corasick automaton counts."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import own_names, table

#: (verdict, host, path): a rule fits its host and all subdomains of it, for paths that start with its path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: The vocabulary where a caller names none: one of these blocks.
STRICT = ("bestiality", "camgirls", "casino", "cheap-pills", "escort", "hardcore", "hentai", "malware", "phishing", "porn", "spam-farm", "viagra", "warez", "xxx")
#: Distinct terms of these block when their weights add up to SOFT_LIMIT.
SOFT = (("adult", 2), ("bet", 1), ("bonus", 1), ("cheap", 1), ("crack", 1), ("dating", 1), ("free", 1), ("hot", 1), ("keygen", 2), ("loan", 1), ("nude", 2), ("pills", 2), ("poker", 2), ("prize", 1), ("replica", 1), ("sexy", 2), ("slots", 2), ("spam", 2), ("torrent", 1), ("win", 1))
SOFT_LIMIT = 3


@lru_cache(8)
def _automaton(strict: tuple, soft: tuple):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in [*((t, 0) for t in strict), *soft]:
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def hits(url: str | None, strict: tuple, soft: tuple) -> tuple[int, int, int]:
    """Of the lower-cased URL: strict hits, distinct soft terms, their summed weights. A hit has no ASCII letter or digit beside it."""
    if not url:
        return 0, 0, 0
    text = url.translate(_LOWER)
    n, seen = 0, {}
    for end, (term, weight) in _automaton(strict, soft).iter(text):
        start = end - len(term)
        if (start >= 0 and text[start] in _ALNUM) or (end + 1 < len(text) and text[end + 1] in _ALNUM):
            continue
        if weight:
            seen[term] = weight
        else:
            n += 1
    return n, len(seen), sum(seen.values())


_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {c: c + 32 for c in range(65, 91)}


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): empty both for null and where there is no "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


#: Terms of a vocabulary table, which all tasks get: its size is checked.
MOST_TERMS = 200_000


def vocabulary(terms: DataFrame) -> tuple[tuple, tuple]:
    """(strict, soft) of a table (term, weight): weight 0 is strict, as is null; of a term given twice the strict or heavier one holds.
    Terms are lower-cased (A-Z); null and empty ones, and those below 0, are left out. More than MOST_TERMS are an error."""
    low = F.translate(F.trim(F.col("term").cast("string")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    weight = F.coalesce(F.col("weight").cast("int"), F.lit(0))
    known = terms.select(low.alias("term"), weight.alias("weight")).where("term <> '' and weight >= 0").groupBy("term").agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
    rows = known.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    rows.sort()
    return tuple(r.term for r in rows if r.low == 0), tuple((r.term, r.high) for r in rows if r.low > 0)


def read_vocabulary(spark: SparkSession, path: str) -> tuple[tuple, tuple]:
    """vocabulary() of a CSV file with the header term,weight, at a path that Spark reads."""
    return vocabulary(spark.read.csv(path, schema="term string, weight int", header=True, comment="#"))


def judged(pages: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, limit: int = SOFT_LIMIT) -> DataFrame:
    """pages with host, path, rule (null: none fits), strict_hits, soft_hits, soft_weight and verdict (allow or block).

    The longest rule that fits decides; else one strict hit or soft terms of `limit` weight together block. A null URL fits no
    rule, has no hits and is allowed. Own columns of these names are replaced. Rows are judged one by one, without a shuffle. strict and
    soft are those of read_vocabulary() or the ones above.
    """
    terms = pages.sparkSession.sparkContext.broadcast((tuple(strict), tuple(map(tuple, soft))))  # once to each executor; see MOST_TERMS

    @arrow_udf("strict int, soft int, weight int")
    def counted(urls: pa.Array) -> pa.Array:
        rows = [hits(u, *terms.value) for u in urls.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in range(3)], names=["strict", "soft", "weight"])

    host, path = parts(F.col(url_col))
    (found,) = own_names(pages, "hits")
    out = pages.withColumns({"host": host, "path": path, found: counted(F.col(url_col).cast("string"))})
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    own = F.when((F.col(found)["strict"] > 0) | (F.col(found)["weight"] >= limit), "block").otherwise("allow")
    out = out.withColumns({"rule": rule if rule is not None else F.lit(None).cast("string"), "verdict": verdict.otherwise(own) if verdict is not None else own})
    return out.withColumns({"strict_hits": F.col(found)["strict"], "soft_hits": F.col(found)["soft"], "soft_weight": F.col(found)["weight"]}).drop(found)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["page_id", "host", "path", "rule", "verdict", "soft_hits", "soft_weight"]
    return judged(table(spark, sf_dir, "pages")).select(columns)


def _sql() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bound = "(^|[^a-z0-9])({})([^a-z0-9]|$)"
    terms = [f"CAST(regexp_matches(low, '{bound.format(t)}') AS INTEGER)" for t, _ in SOFT]
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return f"""
WITH a AS (SELECT page_id, {low} AS low, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     b AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
     c AS (SELECT *, regexp_matches(low, '{bound.format("|".join(STRICT))}') AS strict_hit, CAST({" + ".join(terms)} AS INTEGER) AS soft_hits,
                  CAST({" + ".join(f"{w} * {t}" for (_, w), t in zip(SOFT, terms))} AS INTEGER) AS soft_weight FROM b)
SELECT page_id, host, path, CASE {" ".join(f"{f} '{h + p}'" for f, (_, h, p) in zip(fits, ranked))} END AS rule,
       CASE {" ".join(f"{f} '{k}'" for f, (k, _, _) in zip(fits, ranked))} WHEN strict_hit OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       soft_hits, soft_weight
FROM c
"""


OP7_SQL = _sql()
