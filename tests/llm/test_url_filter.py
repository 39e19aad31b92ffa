from pyspark.sql import functions as F

from ledgerline.llm import url_filter
from ledgerline.llm.queries import QUERIES
from ledgerline.llm.url_filter import bloom_words, canonical, filter_urls, host_of, path_of
from tests.conftest import same_rows


def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck):
    same_rows(QUERIES["op6_url_bloom"](spark, sf_dir), duck, url_filter.ORACLE_SQL)


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("*", F.lit("x").alias("host"), F.lit("x").alias("word"), F.lit("<p>").alias("html"))


def listed(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "canonical string")


def test_rules_and_list(spark):
    urls = [
        "http://A.example.COM/en/5", "https://example.com/en/77", "http://notexample.com/en/7", "http://x.net/de/9?q", "http://m.example.net/de/81", "http://a.org/es/", "http://a.org/e", "ftp://b.org", "no url", None, "",
        "https://www.bad.io/page.html", "http://bad.io/page/#x", "http://bad.io/other", "http://com/en/x", "a://b://c/d", "http://h?x=/en/7", "HTTP://ÄB.example.COM/en/7\nx",
    ]
    found = [tuple(r)[1:] for r in sorted(filter_urls(pages(spark, urls), listed(spark, ["bad.io/page", None, "bad.io/page", "nowhere.io/x"])).collect())]
    assert found == [
        ("a.example.com", "/en/5", "com/en/", "block"), ("example.com", "/en/77", "example.com/en/7", "allow"), ("notexample.com", "/en/7", "com/en/", "block"), ("x.net", "/de/9", "net/de/", "allow"),
        ("m.example.net", "/de/81", "example.net/de/8", "block"), ("a.org", "/es/", "org/es/", "block"), ("a.org", "/e", None, "allow"), ("b.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("www.bad.io", "/page.html", None, "block"), ("bad.io", "/page/", None, "block"), ("bad.io", "/other", None, "allow"), ("com", "/en/x", "com/en/", "block"), ("b:", "//c/d", None, "allow"), ("h", "", None, "allow"),
        ("Äb.example.com", "/en/7\nx", "example.com/en/7", "allow"),
    ]


def test_the_filter_misses_nothing_and_passes_little(spark):
    rows = spark.range(3000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("canonical"))
    bloom = bloom_words(rows.where("canonical like '%1'"), 256)
    probe = rows.join(bloom, url_filter._word(F.col("canonical"), 256) == F.col("word"), "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(url_filter._bits(F.col("canonical"))) == url_filter._bits(F.col("canonical")), F.lit(False))
    found = probe.select(F.col("canonical").like("%1").alias("is_listed"), hit.alias("hit")).groupBy("is_listed").agg(F.avg(F.col("hit").cast("int")).alias("share")).collect()
    share = {r["is_listed"]: r["share"] for r in found}
    assert share[True] == 1.0 and share[False] < 0.05


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op6_url_bloom"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_odd_tables(spark):
    assert filter_urls(pages(spark, ["http://a/b"]).limit(0), listed(spark, ["a/b"])).count() == 0
    assert filter_urls(pages(spark, ["http://a/b"] * 3), listed(spark, ["x"]).limit(0)).count() == 3
    one = spark.range(1).select(canonical(host_of(F.lit("http://m.a.b/c.htm//")), path_of(F.lit("http://m.a.b/c.htm//"))).alias("c")).first()["c"]
    assert one == "a.b/c.htm"


def test_a_list_beyond_the_broadcast_gives_the_same(spark, monkeypatch):
    urls = [f"http://h{i % 7}.io/p{i}" for i in range(60)] + [None, "x", "http://a.com/en/9"]
    bad = listed(spark, [f"h{i % 7}.io/p{i}" for i in range(0, 60, 3)])
    found = []
    for size in (1 << 20, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", size)
        monkeypatch.setattr(url_filter, "BROADCAST_WORDS", size)
        found.append(sorted(map(repr, filter_urls(pages(spark, urls), bad).collect())))
    assert found[0] == found[1] and sum("'block'" in x for x in found[0]) == 21


def test_pages_without_an_id_and_very_long_urls(spark):
    rows = [(None, "http://bad.io/page"), (None, "http://bad.io/page"), (1, "http://bad.io/" + "x" * 100_000)]
    found = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), listed(spark, ["bad.io/page"])).collect()
    assert sorted((r["page_id"] or 0, len(r["path"]), r["verdict"]) for r in found) == [(0, 5, "block"), (0, 5, "block"), (1, 100_001, "allow")]
