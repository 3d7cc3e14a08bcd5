"""URL filter against SQL, literal rules, and trees whose templates are known."""

import pytest
from pyspark.sql import functions as F

from aeolia.llm import url_rules
from tests.comparing import of_duckdb, of_spark, tables

FOLDER = "/root/testdata/sf0.001"
URLS = {
    None: ("", "", None), "": ("", "", None), "no scheme/en": ("", "", None), "http://": ("", "", None), "http://A.B.ORG": ("a.b.org", "", None),
    "http://ORG/": ("org", "/", "org/"), "x://example.org/es/1?q=/de/": ("example.org", "/es/1", "example.org/es/"), "x://Www.Example.org/en/12#t": ("www.example.org", "/en/12", "example.org/en/1"),
    "x://myexample.org/en/12": ("myexample.org", "/en/12", "org/"), "x://example.org/EN/1": ("example.org", "/EN/1", "org/"), "x://a.com/fr": ("a.com", "/fr", None), "x://a.com/fr/": ("a.com", "/fr/", "com/fr/"),
    "x://a.com?x=/de/": ("a.com", "", None), "x://a.com#/de/": ("a.com", "", None), "x://a.com:80/de/": ("a.com:80", "/de/", None), "a://b.com/de/x://c.org/": ("b.com", "/de/x://c.org/", "com/de/"),
    "x://É.COM/de/é/%20/\n/x": ("É.com", "/de/é/%20/\n/x", "com/de/"), "x://y.net/" + "a/" * 5000: ("y.net", "/" + "a/" * 5000, None), "x://y.net/" + "b" * 50000: ("y.net", "/" + "b" * 50000, None), "x://y.net//a//b/": ("y.net", "//a//b/", None),
}


def test_hosts_paths_and_rules(spark):
    rows = [(k if k % 3 else None, u) for k, u in enumerate(URLS)] + [(1, "x://org/")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "segments": F.lit("x"), "n": F.lit(None).cast("int"), "template": F.lit(2)})
    got = url_rules.judged(pages).collect()
    want = [(i, *URLS.get(u, ("org", "/", "org/"))) for i, u in rows]
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(want, key=str)
    said = {d + p: v for v, d, p in url_rules.RULES}
    assert all(r.verdict == said[r.rule] for r in got if r.rule)
    assert url_rules.judged(pages.where("false")).count() == 0


def test_forms(spark):
    path = "/12/2024-01-31/0123456789abcdef0/123e4567-e89b-12d3-a456-426614174000/x"
    row = spark.createDataFrame([(path,), ("/1.html/" + "y" * 65 + "/About.php",), ("",)], "p string").select(url_rules.typed(F.col("p"))).collect()
    assert [r[0] for r in row] == [["{num}", "{date}", "{hex}", "{uuid}", "{deeper}"], ["{num}.html", "{long}", "About.php"], []]


def test_templates_are_generalised_merged_and_rejected(spark):
    rows = []
    for k in range(400):
        rows += [(f"x://shop.net/buy/item-{k}x/go", 0 if k % 2 else None), (f"x://shop.net/docs/page-{k}x/go", 1 if k % 2 else None), (f"x://shop.net/help/topic-{k}x/go", 1 if k % 2 else None)]
        rows += [(f"x://shop.net/rare{k}z", None)] if k < 30 else []
        rows += [(f"x://other.net/buy/item-{k}x/go", None)]
    rows += [("x://shop.net/buy/new-one/go", None)]
    pages = spark.createDataFrame(rows, "url string, seen int").withColumn("page_id", F.monotonically_increasing_id()).repartition(5)
    got = {(r.host, r.path): r for r in url_rules.judged(pages, rules=(), label=F.col("seen")).collect()}
    assert len(got) == len({r[0] for r in rows})
    new = got["shop.net", "/buy/new-one/go"]
    assert (new.template, new.verdict, new.rule) == ("/buy/*/go", "block", None) and new.purity < 0.05
    # /docs and /help have alike children and labels; /buy has other labels.
    assert got["shop.net", "/docs/page-0x/go"].template == got["shop.net", "/help/topic-0x/go"].template == "/docs|help/*/go"
    assert {r.template for (h, p), r in got.items() if p.startswith("/rare")} == {"/*"}
    assert {r.verdict for (h, p), r in got.items() if h == "other.net" or not p.startswith("/buy")} == {"allow"}


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_same_as_sql(spark, folder):
    assert of_spark(url_rules.op11_urls(spark, folder)) == of_duckdb(tables(folder), url_rules.OP11_SQL)
