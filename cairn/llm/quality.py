"""Quality rules: text statistics and a learned decision list, by DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, text_or_empty, written

MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: Thresholds tried for each measure, from the labelled rows' quantiles.
CUTS = 16
#: A list has at most so many rules of at most so many conditions. On rows it was not grown on a rule needs this precision, and the
#: lower end of the precision's Wilson interval (80 %, both sides) must reach SUPPORTED, so that a handful of rows is not enough.
MAX_RULES, MAX_CONDITIONS, PRECISION, SUPPORTED, Z = 6, 3, 0.9, 0.75, 1.28
MEASURES = ("n_words", "mean_chars", "symbols", "dup_lines", "repeated")


def _with(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is not evaluated again for each element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more: windows are sorted by hash and place, then by place; each adds the words that it doesn't share with the next."""
    n = F.size(words)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda x, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == x["h"]))
        return F.transform(F.filter(s, same), lambda x: x["i"])

    def covered(p: Column) -> Column:
        last = F.size(p) - 1
        steps = F.transform(p, lambda i, k: F.when(k < last, F.least(F.lit(3), p[F.least(k + 1, last)] - i)).otherwise(3))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def counted(w: Column) -> Column:
        return _with(windows(w), lambda s: F.when(F.size(F.array_distinct(F.transform(s, lambda x: x["h"]))) == F.size(s), F.lit(0)).otherwise(_with(F.sort_array(s), lambda t: _with(F.sort_array(repeated(t)), covered))))

    return F.when(n < 4, F.lit(0)).otherwise(_with(words, counted))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each row; a null text has none of each."""
    text = text_or_empty(text_col)
    found = docs.select(F.col(id_col), text.alias("_text")).select(
        id_col,
        _with(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r"))).alias("_w"),
        F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _with(F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return found.select(id_col, F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.r").alias("n_repeat_words"))


def measures() -> dict[str, Column]:
    """What rules are about: numbers that do not grow with the text, but for its length."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"n_words": F.col("n_words").cast("double"), "mean_chars": F.col("word_chars") / words, "symbols": F.col("n_symbols") / words, "dup_lines": 10 * F.col("n_dup_lines") / words, "repeated": F.col("n_repeat_words") / words}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = measures()[self.measure]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _counts(rows: DataFrame, conditions: list[Column]) -> list[tuple[float, float]]:
    """For each condition, (low rows, good rows) that fulfil it: one sum over the labelled rows' histogram."""
    sums = [F.sum(F.when(c & (F.col("low") == low), F.col("n")).otherwise(0)) for c in conditions for low in (1, 0)]
    row = rows.agg(*sums).first()
    return [(float(row[2 * i] or 0), float(row[2 * i + 1] or 0)) for i in range(len(conditions))]


def _by_condition(rows: DataFrame, tests: list[tuple[str, bool, int]]) -> list[tuple[float, float]]:
    """(low rows, good rows) that fulfil each test (measure, above, bin): one sum by measure and bin, in one job, and cumulative sums of
    these few numbers (there are no more bins than cuts)."""
    each = rows.select("low", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bin")) for m in MEASURES])).alias("x"))
    sums = {(r.measure, r.bin): (float(r.low or 0), float(r.good or 0)) for r in each.groupBy("x.measure", "x.bin").agg(F.sum(F.when(F.col("low") == 1, F.col("n"))).alias("low"), F.sum(F.when(F.col("low") == 0, F.col("n"))).alias("good")).collect()}
    out = []
    for measure, above, k in tests:
        held = [v for (m, b), v in sums.items() if m == measure and (b > k) == above]
        out.append((sum(v[0] for v in held), sum(v[1] for v in held)))
    return out


def _bits(p: float, n: float) -> float:
    from math import log2

    return log2((p + 1e-9) / (p + n + 2e-9)) if p + n else -60.0


def lower_bound(p: float, n: float) -> float:
    """The lower end of the Wilson interval for p of p + n rows."""
    total = p + n
    if not total:
        return 0.0
    share, z2 = p / total, Z * Z
    return (share + z2 / (2 * total) - Z * ((share * (1 - share) + z2 / (4 * total)) / total) ** 0.5) / (1 + z2 / total)


def learn(labelled: DataFrame) -> list[Rule]:
    """A decision list by sequential covering from rows with the statistics, `low` (1 or 0) and `grow` (boolean).

    A rule grows by the condition of most FOIL gain on the growing rows, then loses from its end what doesn't help on the pruning
    rows; it is kept if it holds there for PRECISION and SUPPORTED, and the rows that it covers leave. Labelled rows are summed by the bins of
    their measures first; every step is a sum over these. No labels, or labels of one kind: no rules.
    """
    names = list(MEASURES)
    point = measures()
    shares = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    q = labelled.agg(*[F.percentile_approx(point[m], shares, 2000).alias(m) for m in names], *[F.percentile_approx(F.when(F.col("low") == 1, point[m]), shares, 2000).alias(f"low_{m}") for m in names]).first()
    cuts = {m: sorted({*(q[m] or []), *(q[f"low_{m}"] or [])}) for m in names}
    if not any(cuts.values()):
        return []
    bin_of = {m: sum((F.when(point[m] > c, 1).otherwise(0) for c in cuts[m]), F.lit(0)) for m in names}
    rows = written(labelled.groupBy(*[bin_of[m].alias(m) for m in names], "low", "grow").agg(F.count("*").alias("n")).where("low is not null"), "bins")
    # a value is above cut k if and only if its bin is above k
    tests = [(m, above, k) for m in names for k in range(len(cuts[m])) for above in (True, False)]
    column = lambda t: F.col(t[0]) > t[2] if t[1] else F.col(t[0]) <= t[2]
    rules: list[Rule] = []
    failed = 0
    while len(rules) < MAX_RULES and failed < MAX_RULES:
        growing, chosen = rows.where("grow"), []
        everything = (MEASURES[0], True, -1)
        found = _by_condition(growing, [everything, *tests])
        p, n = found.pop(0)
        while len(chosen) < MAX_CONDITIONS and p and n:
            if chosen:
                found = _by_condition(growing, tests)
            if not found:
                break
            gain, best = max(((a * (_bits(a, b) - _bits(p, n)), i) for i, (a, b) in enumerate(found)), key=lambda x: (x[0], -x[1]))
            if gain <= 1e-9:
                break
            chosen.append(tests[best])
            growing = growing.where(column(tests[best]))
            p, n = found[best]
        if not chosen:
            break
        prefixes, both = [], F.lit(True)
        for t in chosen:
            both = both & column(t)
            prefixes.append(both)
        held = _counts(rows.where("not grow"), prefixes)
        value = [((a - b) / (a + b) if a + b else -1.0, -i) for i, (a, b) in enumerate(held)]
        k = -max(value)[1]
        a, b = held[k]
        if not a or a / (a + b) < PRECISION or lower_bound(a, b) < SUPPORTED:
            tests.remove(chosen[0])  # rules that begin with it are set aside, and others tried
            failed += 1
            continue
        rules.append(Rule(tuple(Condition(m, above, float(cuts[m][i])) for m, above, i in chosen[: k + 1]), a / (a + b), int(a + b)))
        rows = rows.where(~F.coalesce(prefixes[k], F.lit(False)))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; none: 0, the text is good."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(), i) if out is None else out.when(rule.column(), i)
    return out.otherwise(0) if out is not None else F.lit(0)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, the five statistics, base_failed, rule (of the list; 0: none) and kept.

    Labels are rows (id, quality): 0 low, 1 good; others are left out, as are ids without a document. An id labelled twice counts
    twice. Other columns of docs and labels are not read. Rows with a null id are judged, but never labelled. A third of the labelled rows, by hash of the id, prune; the others grow.
    """
    stats = written(statistics(docs, id_col, text_col), "statistics")
    marked = labels.select(F.col(id_col), F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("low")).where("low is not null")
    labelled = stats.join(marked, id_col).withColumn("grow", F.pmod(F.xxhash64(id_col), F.lit(3)) != 0)
    # what base_failed rejects is not for the list to learn
    rules = learn(labelled.where(~base_failed()))
    out = stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op5_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
