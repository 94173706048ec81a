from lattica.llm import url_filter as u

CASES = {
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "example.com/en/7": ("", "", None, "allow"),
    "http://Example.COM/en/7x?q#f": ("example.com", "/en/7x", "example.com/en/7", "allow"),
    "http://a.example.com/en/8": ("a.example.com", "/en/8", "com/en/", "block"),
    "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
    "http://x.example.net/de/8/adult": ("x.example.net", "/de/8/adult", "example.net/de/8", "block"),
    "http://casino.net/de/1": ("casino.net", "/de/1", "net/de/", "allow"),
    "http://net?x": ("net", "", None, "allow"),
    "http://h.io#a/b": ("h.io", "", None, "allow"),
    "http://my-casino-win.io/": ("my-casino-win.io", "/", None, "block"),
    "http://casinos.io/": ("casinos.io", "/", None, "allow"),
    "http://cheap.io/cheap": ("cheap.io", "/cheap", None, "allow"),
    "http://cheap.io/a?win=1": ("cheap.io", "/a", None, "block"),
    "HTTP://CHEAP.io/PILLS": ("cheap.io", "/PILLS", None, "block"),
    "x://a.org/es/http://b.com/en/": ("a.org", "/es/http://b.com/en/", "org/es/", "block"),
}


def test_cases(spark):
    pages = spark.createDataFrame([(i, url, "h", "v") for i, url in enumerate([*CASES, *CASES])], "page_id long, url string, host string, verdict string")
    rows = u.judge_urls(pages).collect()
    assert len(rows) == 2 * len(CASES)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["url"]], r["url"]


def test_empty_and_without_terms(spark):
    pages = spark.createDataFrame([(1, "http://casino.io")], "page_id long, url string")
    assert u.judge_urls(pages.limit(0)).count() == 0
    assert u.judge_urls(pages, strict=(), soft={}).first()["verdict"] == "allow"


def test_overlapping_terms_and_boundaries():
    machine = u.automaton(["ads", "ads-track", "track"])
    assert u.bounded_hits(machine, "http://ads-track.io") == {"ads", "ads-track", "track"}
    assert u.bounded_hits(machine, "http://badads.io/tracks") == set()


def test_weights_from_a_table(spark):
    terms = spark.createDataFrame([("Casino", None), ("light", 0.5), ("heavy", 1.6), ("heavy", 1.0), ("lone", 9.0), ("", 1.0), (None, None)], "term string, weight double")
    strict, soft = u.vocabulary(terms)
    assert strict == ["casino"] and soft == {"heavy": 1.6, "light": 0.5, "lone": 9.0}
    urls = ["a://casino.io", "a://light.heavy.io", "a://lone.io", "a://light.io/light", "a://heavy.io/lone"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["soft_weight"]) for r in u.judge_urls(pages, strict=strict, soft=soft).collect()}
    assert got == {0: ("block", 0.0), 1: ("block", 2.1), 2: ("allow", 9.0), 3: ("allow", 0.5), 4: ("block", 10.6)}
