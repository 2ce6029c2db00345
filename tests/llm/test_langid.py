import pytest

from cairn.llm import langid

VOCABULARY = {"en": "the of and to in is that was for with this from are".split(), "de": "der die und das ist nicht mit ein auf für sich den".split(), "fr": "le la les des une est dans que pour qui sur pas".split()}


def text(rng, lang, n=60):
    return " ".join(rng.choice(VOCABULARY[lang]) for _ in range(n))


def corpus(rng):
    rows = [(i, text(rng, lang), lang, host, 0) for i, (lang, host) in enumerate([("en", "a.com"), ("de", "b.de"), ("fr", "http://www.c.fr/x")] * 40)]
    wrong = [(1000 + i, text(rng, "de"), "en", "b.de", 0) for i in range(4)]
    short = [(2000, "ja", None, "b.de", 0), (2001, "oui", None, "www.c.fr", 0)]
    none = [(3000, "", "en", "a.com", 0), (3001, None, None, None, 0), (3002, "123 456 !!", "de", "b.de", 0)]
    odd = [(3003, text(rng, "en"), "zz", None, 0), (None, text(rng, "fr"), "FR", "", 0), (1, text(rng, "de"), "de", "b.de", 0)]
    return rows, wrong, short, none, odd


def test_evidence_is_fused(docs, rng):
    rows, wrong, short, none, odd = corpus(rng)
    df = docs(rows + wrong + short + none + odd, extra=True)
    out = langid.identified(df).collect()
    assert len(out) == df.count()
    got = {r.doc_id: r for r in out}
    assert all(got[i].language == lang and got[i].kept for i, _, lang, _, _ in rows if i != 1)
    assert all(got[i].language == "de" for i, *_ in wrong)
    assert got[2000].language == "de" and got[2001].language == "fr"  # the host tells what two letters can't
    assert not any(got[i].kept for i, *_ in none)
    assert got[3003].language == "en" and got[None].language == "fr"
    model = langid.LanguageModel().fit(df)
    kept = model.accepted(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in out if r.kept)


def plain_bayes(model, rows):
    """language and confidence of rows (text, declared, address) by loops, from the text model's likelihoods."""
    import numpy as np

    share = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    n, classes = len(model.classes), model.classes
    x = langid.scores([t or "" for t, *_ in rows], model.logs)[:, 1:]
    own = np.array([share(v + model.prior) for v in x])
    host = [(a or "").lower().split("://")[-1].split("/")[0] for *_, a in rows]
    top = [h.rpartition(".")[2] if "." in h else "" for h in host]
    said = [classes.index(model.named[d]) if d in model.named else n if d is None else n + 1 for _, d, _ in rows]
    total, confusion = own.sum(0), np.zeros((n + 2, n))
    for k, d in enumerate(said):
        confusion[d] += own[k]
    lift = confusion + langid.DECLARED_WEIGHT * confusion.sum(1, keepdims=True) / confusion.sum()
    out = []
    for k in range(len(rows)):
        at_host = sum((own[j] for j in range(len(rows)) if host[j] == host[k] and j != k), np.zeros(n))
        at_top = sum((own[j] for j in range(len(rows)) if top[j] == top[k] and j != k), np.zeros(n))
        up = (at_top + langid.SUFFIX_WEIGHT * total / total.sum()) / (at_top.sum() + langid.SUFFIX_WEIGHT)
        down = (at_host + langid.HOST_WEIGHT * up) / (at_host.sum() + langid.HOST_WEIGHT)
        p = share(x[k] + np.log(down) + (0 if said[k] == n else np.log(lift[said[k]] / lift.sum(0))))
        out.append((classes[p.argmax()], p.max()))
    return out


def evidence(rng):
    """Texts of three languages at hosts of their own under two suffixes, and rows that only one kind of evidence can decide."""
    rows = [(i, text(rng, lang), lang, host) for i, (lang, host) in enumerate([("en", "http://a.com/x"), ("de", "https://b.de"), ("fr", "c.fr")] * 60)]
    rows += [(500 + i, text(rng, "de"), "de", f"http://h{i}.de/{i}") for i in range(60)]
    rows += [(900, text(rng, "fr"), None, None)]  # the text
    rows += [(901, "xq", "de", None), (902, "xq", "fr", None)]  # what is declared
    rows += [(903, "xq", None, "http://unseen.de/"), (904, "xq", None, "b.de")]  # the suffix, the host
    rows += [(905, "xq", None, "http://c.fr/y"), (906, "xq", None, "a.com"), (907, None, None, None)]
    return rows


def test_each_kind_of_evidence_decides_alone(docs, rng):
    rows = evidence(rng)
    df = docs([(*r, 0) for r in rows])
    model = langid.LanguageModel().fit(df)
    got = {r.doc_id: r for r in model.rows(df).collect()}
    want = plain_bayes(model, [r[1:] for r in rows])
    for (i, *_), (language, confidence) in zip(rows, want):
        assert got[i].language == language and abs(got[i].confidence - confidence) < 1e-6, i
    assert [got[i].language for i in range(900, 907)] == ["fr", "de", "fr", "de", "de", "fr", "en"]
    assert not got[907].kept


def test_pages_bring_markup_and_suffixes(spark, docs, rng):
    page = lambda lang, said=None: f"<html{f' lang={said}' if said else ''}><p>{text(rng, lang)}</p></html>"
    pages = [(i, f"http://s{i}.{lang}/", page(lang, lang)) for i, lang in enumerate(["de", "fr"] * 80)]
    pages += [(800, "http://new.fr/", "<html><b>xq</b></html>"), (801, "http://none", "<html lang='fr-CA'>xq</html>"), (802, None, None)]
    both = langid.texts_and_pages(docs([(1, text(rng, "de"), "de", "s", 0)]), spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {(r.doc_id, r.page_id): r for r in langid.identified(both, id_cols=("doc_id", "page_id")).collect()}
    assert len(got) == len(pages) + 1 and got[1, None].language == "de"
    assert got[None, 800].language == "fr" and got[None, 801].language == "fr" and got[None, 801].declared == "fr" and not got[None, 802].kept


def test_a_small_language_is_a_class_beside_a_large_one(docs, rng):
    rows = [(i, text(rng, "en"), "en", "a", 0) for i in range(1500)] + [(5000 + i, text(rng, "fr"), "fr", "a", 0) for i in range(6)]
    rare = [(6000 + k, text(rng, "de"), tag, "b", 0) for k, tag in enumerate(["de", "nl", "gsw", "de-AT", "nl", "de"])]
    got = {r.doc_id: r.language for r in langid.identified(docs(rows + rare)).collect()}
    assert {got[i] for i in range(5000, 5006)} == {"fr"} and {got[i] for i in range(6000, 6006)} == {langid.OTHER}


def test_columns_of_any_name_are_kept(docs, rng):
    from pyspark.sql import functions as F

    df = docs([(i, text(rng, "en"), "en", "a.com", 0) for i in range(8)]).withColumns({c: F.lit(c) for c in ("host", "_host", "declared", "scores", "found", "of_host", "row", "id0")})
    kept = langid.LanguageModel().fit(df).accepted(df)
    assert kept.columns == df.columns and {(r.host, r.row, r.found) for r in kept.collect()} == {("host", "row", "found")}


def test_nothing_declared_and_no_rows(docs):
    assert {(r.language, r.kept) for r in langid.identified(docs([(1, "some text", None, None, 0)])).collect()} == {("und", False)}
    assert langid.identified(docs([])).count() == 0


def test_scores_of_long_texts_are_those_of_their_parts(rng, monkeypatch):
    import numpy as np

    logs = np.random.default_rng(1).normal(size=(langid.BINS, 3)).astype("float32")
    logs[0] = 0
    long = text(rng, "fr", 400)
    alone = langid.scores([long], logs)
    assert np.allclose(langid.scores(["", long, "x"], logs)[1], alone)
    monkeypatch.setattr(langid, "_SEGMENT", 101)
    assert abs(langid.scores([long], logs)[0, 0] - alone[0, 0]) <= 2 * len(long.encode()) / 101 + 2


def test_markup(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('<!DOCTYPE html><html class="x" lang="fr-CA">',), ("<HTML LANG=de>",), ("<p lang='en'>",), (None,)], "html string")
    assert [r[0] for r in df.select(langid.declared_in_markup(F.col("html"))).collect()] == ["fr", "de", None, None]


def test_held_out_accuracy(spark):
    """On the documents themselves, without their declarations."""
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no data")
    from pyspark.sql import functions as F

    df = spark.read.parquet(path)
    half = df.withColumn("said", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = {r.doc_id: r.language for r in langid.identified(half).collect()}
    rest = [(r.doc_id, r.said) for r in half.where("doc_id % 2 = 1 and length(text) > 50").collect()]
    assert sum(got[i] == said for i, said in rest) / len(rest) > 0.97
