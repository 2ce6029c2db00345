from cairn.llm import urlfilter


def test_hits_have_bounds():
    f = lambda u: urlfilter.hits(u, urlfilter.STRICT, urlfilter.SOFT)
    assert f("http://www.CASINO.example") == (1, 0, 0)
    assert f("http://casinos.example/xcasino") == (0, 0, 0)
    assert f("http://free-bet.example/free/win_bonus") == (0, 4, 4)
    assert f(None) == f("") == (0, 0, 0)


def test_rules_and_verdicts(spark):
    cases = {
        "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "https://A.Example.COM/en/7x?casino": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://b.example.net/de/8": ("b.example.net", "/de/8", "example.net/de/8", "block"),
        "http://b.example.net/de/9": ("b.example.net", "/de/9", "net/de/", "allow"),
        "http://xcom/en/": ("xcom", "/en/", None, "allow"),
        "http://h?q=/en/": ("h", "", None, "allow"),
        "x://porn.example.org/es": ("porn.example.org", "/es", None, "block"),
        "no scheme casino": ("", "", None, "block"),
        "http://x.test/poker#win": ("x.test", "/poker", None, "block"),
        "http://x.test/cheap-pills": ("x.test", "/cheap-pills", None, "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(df).collect()}
    assert got == cases
    assert urlfilter.judged(df.limit(0)).count() == 0
    assert {r.verdict for r in urlfilter.judged(df, rules=()).where("url like '%/en/8'").collect()} == {"allow"}


def test_long_urls_repeats_and_columns_of_any_name(spark):
    far = "http://x.test/" + "a/" * 200_000
    cases = {far + "poker/win": "block", far: "allow", "http://x.test/" + "win/" * 1000: "allow", "http://x.test/win/bonus/free": "block", "http://x.test/winwin/unfree": "allow"}
    df = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(cases)], "page_id long, url string, hits string, _hits string")
    rows = urlfilter.judged(df).collect()
    assert {r.url: r.verdict for r in rows} == cases and {(r.hits, r._hits) for r in rows} == {("own", "own")}


def test_vocabulary_from_a_table(spark, tmp_path):
    (tmp_path / "terms.csv").write_text("term,weight\n# a remark\nBadWord,0\nsoft-one,2\nsoft-one,1\nother,1\nboth,3\nboth,\n,5\nnever,-1\n")
    strict, soft = urlfilter.read_vocabulary(spark, str(tmp_path / "terms.csv"))
    assert strict == ("badword", "both") and soft == (("other", 1), ("soft-one", 2))
    urls = ["http://a/badword", "http://a/badwords", "http://a/Other.SOFT-ONE", "http://a/other/other", "http://casino/", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: (r.verdict, r.strict_hits, r.soft_weight) for r in urlfilter.judged(df, strict=strict, soft=soft).collect()}
    assert [got[u] for u in urls] == [("block", 1, 0), ("allow", 0, 0), ("block", 0, 3), ("allow", 0, 1), ("allow", 0, 0), ("allow", 0, 0)]


def test_a_vocabulary_too_large_is_refused(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(urlfilter, "MOST_TERMS", 2)
    with pytest.raises(ValueError):
        urlfilter.vocabulary(spark.createDataFrame([("a", 1), ("b", 1), ("c", 0)], "term string, weight int"))
