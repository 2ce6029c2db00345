"""Language of documents by Bayesian fusion of text likelihoods, declared language and hierarchical host priors."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import small_batches, table, text_or_empty, written

#: Labelled documents of each language that the text model is fitted on (as many as expected of a hash of the id); all its text counts.
SAMPLE_DOCS = 2000
#: A declared language is a class from so many documents on, however many others there are; rarer ones are one class together.
#: Languages are tags of two or three letters, so the model's table of BINS floats a class stays under 100 MB for 700 languages.
CLASS_DOCS, OTHER = 5, "other"
BINS = 1 << 15
#: A text's trigrams count as so many independent ones at most: they depend on each other.
INDEPENDENT = 60
#: Pseudo-counts with which a host leans on its suffix, a suffix on all documents, and a declaration on chance.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 20.0, 100.0, 5.0
#: Less sure documents are rejected.
CONFIDENCE = 0.5
_SEGMENT = 1 << 21

_FOLD = np.array([c + 32 if 65 <= c <= 90 else 32 if c < 128 and not 97 <= c <= 122 else c for c in range(256)], np.uint8)


def trigram_bins(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each byte trigram within words, where each segment's begin). Bin 0: a trigram with a blank in its midst, which tells nothing."""
    buffer = _FOLD[np.frombuffer(b" " + b"  ".join(segments) + b"   ", np.uint8)].astype(np.uint32)
    bins = (buffer[:-2] * 7919 + buffer[1:-1] * 31337 + buffer[2:] * 1299709) >> 5
    bins = bins % (BINS - 1) + 1
    bins[buffer[1:-1] == 32] = 0
    return bins, np.cumsum([0, *(len(s) + 2 for s in segments)])[:-1]


def _segments(texts: list[str]):
    """Lists of (numbers of texts, pieces of them) of bounded size."""
    owner, pieces, held = [], [], 0
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        for at in range(0, len(raw) or 1, _SEGMENT):
            owner.append(k), pieces.append(raw[at : at + _SEGMENT])
            held += len(pieces[-1])
            if held >= _SEGMENT:
                yield np.array(owner), pieces
                owner, pieces, held = [], [], 0
    if pieces:
        yield np.array(owner), pieces


def scores(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """For each text: number of trigrams, then the log-likelihood of each class, tempered to INDEPENDENT trigrams."""
    out = np.zeros((len(texts), 1 + logs.shape[1]))
    for owner, pieces in _segments(texts):
        bins, starts = trigram_bins(pieces)
        np.add.at(out[:, 0], owner, np.add.reduceat(bins > 0, starts, dtype=np.int64))
        np.add.at(out[:, 1:], owner, np.add.reduceat(logs[bins], starts, axis=0))
    out[:, 1:] *= (INDEPENDENT / np.maximum(out[:, :1], INDEPENDENT))
    return out


def host_of(address: Column) -> Column:
    """The host of a URL, or a plain name, in lower case; none: empty."""
    text = F.lower(F.coalesce(address.cast("string"), F.lit("")))
    return F.when(F.locate("://", text) > 0, F.regexp_extract(text, r"://([^/?#:]*)", 1)).otherwise(text)


def suffix_of(host: Column) -> Column:
    return F.when(F.locate(".", host) > 0, F.substring_index(host, ".", -1)).otherwise("")


def declared_in_markup(html: Column) -> Column:
    """The primary subtag of the lang attribute of an html element, in lower case; none: null."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def language_tag(declared: Column) -> Column:
    """The primary subtag of a declared language in lower case, if it has two or three letters; else null."""
    found = F.regexp_extract(F.lower(F.trim(declared.cast("string"))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(found != "", found)


def text_of_markup(html: Column) -> Column:
    """What is left of markup without its tags."""
    return F.regexp_replace(html, r"<[^<>]*+>", " ")


def _shares(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


class LanguageModel:
    """fit() it on documents; rows() tells the languages of the same documents, accepted() keeps those of any table with their columns."""

    def __init__(self, id_cols=("doc_id",), text_col="text", declared_col="lang", address_col="source", sample_docs=SAMPLE_DOCS):
        self.id_cols, self.text_col, self.declared_col, self.address_col, self.sample_docs = list(id_cols), text_col, declared_col, address_col, sample_docs

    def _plain(self, docs: DataFrame) -> DataFrame:
        """The row itself, and beside it its declared language, host and text."""
        return docs.select(F.struct("*").alias("row"), language_tag(F.col(self.declared_col)).alias("declared"), host_of(F.col(self.address_col)).alias("host"), text_or_empty(self.text_col).alias("text"))

    def fit(self, docs: DataFrame) -> LanguageModel:
        small_batches(docs.sparkSession)
        plain = self._plain(docs).select(*[F.col("row")[c].alias(f"id{k}") for k, c in enumerate(self.id_cols)], F.col("row")[self.declared_col].cast("string").alias("said"), "declared", "host", "text")
        ids = [f"id{k}" for k in range(len(self.id_cols))]
        sizes = {r[0]: r[1] for r in plain.where("declared is not null").groupBy("declared").count().collect()}
        rare = {c for c, n in sizes.items() if n < CLASS_DOCS}
        self.named = {c: OTHER if c in rare else c for c in sizes}
        if sum(sizes[c] for c in rare) < CLASS_DOCS:  # too few for a class: their declarations are one more value
            self.named = {c: c for c in sizes if c not in rare}
        self.classes = sorted(set(self.named.values()))
        if not self.classes:
            return self
        counts = dict.fromkeys(self.classes, 0)
        for c, name in self.named.items():
            counts[name] += sizes[c]
        share = F.create_map(*[F.lit(x) for c, name in self.named.items() for x in (c, min(1.0, self.sample_docs / counts[name]))])
        drawn = F.pmod(F.xxhash64(*ids, "text"), F.lit(1_000_003)) < 1_000_003 * share[F.col("declared")]
        self.logs = self._text_model(plain.where(F.col("declared").isin(list(self.named))).where(drawn).select("declared", "text"))
        self.prior = np.log(np.array([counts[c] for c in self.classes]) / sum(counts.values()))
        self.scored = written(plain.select(*ids, "said", "declared", "host", self._score()(F.col("text")).alias("scores")), "scores")
        self._priors(self.scored.withColumn("p", self._softmax()("scores")))
        return self

    def _text_model(self, sample: DataFrame) -> np.ndarray:
        """Log-shares of trigram bins by class. Each task and then each class has its counts in one row."""
        named = self.named

        def run(batches):
            total = {}
            for batch in batches:
                for declared, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    counts = total.setdefault(named[declared], np.zeros(BINS, np.int64))
                    for _, pieces in _segments([text]):
                        counts += np.bincount(trigram_bins(pieces)[0], minlength=BINS)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([zlib.compress(c.tobytes(), 1) for c in total.values()], pa.binary())], names=["name", "counts"])

        def added(table: pa.Table) -> pa.Table:
            counts = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in table.column("counts").to_pylist())
            return pa.table({"name": table.column("name").slice(0, 1), "counts": pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())})

        counts = np.zeros((BINS, len(self.classes)))
        summed = sample.repartition(16).mapInArrow(run, "name string, counts binary").groupBy("name").applyInArrow(added, "name string, counts binary")
        for r in summed.toLocalIterator():
            counts[:, self.classes.index(r.name)] = np.frombuffer(zlib.decompress(r.counts), np.int64)
        counts[0] = 0
        logs = np.log((counts + 0.5) / (counts + 0.5).sum(0))
        logs[0] = 0
        return logs.astype(np.float32)

    def _score(self):
        logs = self.logs

        @arrow_udf("array<double>")
        def score(texts: pa.Array) -> pa.Array:
            found = scores(texts.to_pylist(), logs)
            return pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel()))

        return score

    def _softmax(self):
        prior, k = self.prior, len(self.classes) + 1

        @arrow_udf("array<double>")
        def softmax(found: pa.Array) -> pa.Array:
            p = _shares(found.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)[:, 1:] + prior)
            return pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * (k - 1), pa.array(p.ravel()))

        return softmax

    def _priors(self, rows: DataFrame) -> None:
        """Sums of the text's class shares by host, suffix and declaration; hosts and suffixes stay tables."""
        n = len(self.classes)
        sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]
        hosts = rows.groupBy("host").agg(*sums)
        hosts = written(hosts.select("host", suffix_of(F.col("host")).alias("suffix"), F.array(*[f"s{i}" for i in range(n)]).alias("of_host")), "hosts")
        up = hosts.groupBy("suffix").agg(*[F.sum(F.col("of_host")[i]).alias(f"s{i}") for i in range(n)])
        self.hosts = hosts.join(up.select("suffix", F.array(*[f"s{i}" for i in range(n)]).alias("of_suffix")), "suffix").drop("suffix")
        said = F.when(F.col("declared").isNull(), "-").when(F.col("declared").isin(list(self.named)), F.create_map(*[F.lit(x) for pair in self.named.items() for x in pair])[F.col("declared")]).otherwise("+")
        confusion = np.zeros((n + 2, n))
        place = {c: k for k, c in enumerate(self.classes)} | {"-": n, "+": n + 1}
        for r in rows.groupBy(said.alias("said")).agg(*sums).collect():
            confusion[place[r[0]]] = [r[i + 1] for i in range(n)]
        self.total = confusion.sum(0)
        lift = confusion + DECLARED_WEIGHT * confusion.sum(1, keepdims=True) / max(confusion.sum(), 1)
        self.declared = np.log(np.maximum(lift, 1e-9) / np.maximum(lift.sum(0), 1e-9))
        self.declared[n] = 0  # nothing declared tells nothing

    def _fuse(self):
        classes, named, prior, declared, total = self.classes, self.named, self.prior, self.declared, self.total / max(self.total.sum(), 1e-9)
        n = len(classes)

        @arrow_udf("language string, confidence double, n_trigrams long")
        def fuse(found: pa.Array, of_host: pa.Array, of_suffix: pa.Array, said: pa.Array) -> pa.Array:
            flat = lambda a, k: a.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            x, host, suffix = flat(found, n + 1), flat(of_host, n), flat(of_suffix, n)
            own = _shares(x[:, 1:] + prior)  # left out, so that a text doesn't confirm itself
            host, suffix = np.maximum(host - own, 0), np.maximum(suffix - own, 0)
            up = (suffix + SUFFIX_WEIGHT * total) / (suffix.sum(1, keepdims=True) + SUFFIX_WEIGHT)
            down = (host + HOST_WEIGHT * up) / (host.sum(1, keepdims=True) + HOST_WEIGHT)
            place = {c: classes.index(name) for c, name in named.items()}
            rows = np.array([n if s is None else place.get(s, n + 1) for s in said.to_pylist()], np.int64)
            p = _shares(x[:, 1:] + np.log(np.maximum(down, 1e-12)) + declared[rows])
            best = p.argmax(1)
            return pa.StructArray.from_arrays([pa.array([classes[b] for b in best], pa.string()), pa.array(p.max(1)), pa.array(x[:, 0].astype(np.int64))], names=["language", "confidence", "n_trigrams"])

        return fuse

    def _fused(self, rows: DataFrame) -> DataFrame:
        """rows(declared, host, scores and others) with the column found."""
        if not self.classes:
            return rows.withColumn("found", F.struct(F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("n_trigrams")))
        none = F.array(*[F.lit(0.0)] * len(self.classes))
        return rows.join(self.hosts, "host", "left").withColumn("found", self._fuse()("scores", F.coalesce("of_host", none), F.coalesce("of_suffix", none), "declared"))

    @staticmethod
    def _kept() -> Column:
        return (F.col("found.confidence") >= CONFIDENCE) & (F.col("found.n_trigrams") > 0)

    def rows(self, docs: DataFrame) -> DataFrame:
        if self.classes:
            rows = self.scored
        else:
            rows = docs.select(*[F.col(c).alias(f"id{k}") for k, c in enumerate(self.id_cols)], F.col(self.declared_col).cast("string").alias("said"))
        return self._fused(rows).select(*[F.col(f"id{k}").alias(c) for k, c in enumerate(self.id_cols)], F.col("said").alias("declared"), "found.*", self._kept().alias("kept"))

    def accepted(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that are not rejected, with their own columns, whatever their names; texts are scored anew, not joined."""
        plain = self._plain(docs)
        if self.classes:
            plain = plain.withColumn("scores", self._score()("text"))
        return self._fused(plain.drop("text")).where(self._kept()).select("row.*")


def identified(docs: DataFrame, **columns) -> DataFrame:
    """A row per row of docs: the id columns, declared, language, confidence, n_trigrams, kept.

    Classes are the languages that CLASS_DOCS documents declare, and "other" for all rarer ones together if they are as many.
    A text without letters has no trigrams and is rejected; so are texts whose fused confidence is under CONFIDENCE. Null texts are
    empty, a null declaration (or one that is no tag) tells nothing, a language without a class is one more value, null addresses
    share an empty host. Where nothing is declared, the language is "und" and nothing is kept.
    """
    return LanguageModel(**columns).fit(docs).rows(docs)


def texts_and_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, text, lang, source): documents with their declared language and source, and pages with their markup's and their URL."""
    none = F.lit(None).cast("long")
    both = docs.select("doc_id", none.alias("page_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return both.unionByName(pages.select(none.alias("doc_id"), "page_id", text_of_markup(F.col("html")).alias("text"), declared_in_markup(F.col("html")).alias("lang"), F.col("url").alias("source")))


def op1_bayes_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages by one model; page_id is null for documents and doc_id for pages."""
    both = texts_and_pages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
    return identified(both, id_cols=("doc_id", "page_id"))
