from pyspark.sql import functions as F

from tessera.llm import urls
from tessera.llm.queries import URL_RULES

SCHEMA = "page_id bigint, url string, html string"


def judged(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("x")).withColumn("node", F.lit(1)).withColumn("rule", F.lit("q"))
    return {r["page_id"]: tuple(r)[1:] for r in urls.judge_urls(frame, URL_RULES, **more).collect()}


def test_rules_hosts_and_paths(spark):
    rows = [(1, "http://a.net/x", None), (2, "http://example.net/en/1", None), (3, "https://WWW.Example.NET/en/1?q#f", None),
            (4, "http://a.example.net/fr/", None), (5, "http://example.com/de/x", None), (6, "http://example.com/en/x", None),
            (7, "http://b.org/fr/2", None), (8, None, None), (9, "no scheme", "<link rel=canonical href=http://a.net/>"), (10, "http://a.net", None),
            (11, "http://notexample.com/de/", None), (12, "x://net/?a", None), (13, "http://a.net:80/", None), (14, "http://É.NET/a\nb", None), (15, "", None),
            (16, "a://b://net/", None)]
    got = judged(spark, rows)
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[3] == ("www.example.net", "/en/1", "example.net/en/", "allow") and got[4] == ("a.example.net", "/fr/", "net/", "block")
    assert got[5][2:] == ("example.com/de/", "block") and got[6][2:] == (None, "allow") and got[7][2:] == ("org/fr/", "allow")
    assert got[8] == got[9] == got[15] == ("", "", None, "allow") and got[10] == ("a.net", "", None, "allow")
    assert got[11][2:] == (None, "allow") and got[12] == ("net", "/", "net/", "block") and got[13][2:] == (None, "allow")
    assert got[14] == ("É.net", "/a\nb", "net/", "block") and got[16][:3] == ("b:", "//net/", None)


def test_blocks_reach_aliases_but_not_over_an_allow(spark):
    link = '<LINK href="{}" data-x="1" REL=canonical>'.format
    move = "<meta content='0; URL={}' http-equiv=refresh>".format
    rows = [(1, "http://one.example.com/a", link("http://bad.net/x")), (2, "http://two.example.com/a#top", link("/b?x=1&amp;y=2")),
            (3, "http://two.example.com/b?x=1&y=2", move("//one.example.com/a")), (4, "http://bad.net/x", None),
            (5, "http://c.org/en/", link("http://c.org/fr/1")), (6, "http://c.org/q", link("en/")), (7, "http://d.com/z/", link("sub") + link("http://bad.net/x")),
            (8, "http://d.com/z/sub", None), (9, "http://c.org/en/", "<p>"), (10, "http://e.net/en/", link("http://c.org/fr/1")), (11, "http://lone.com/", link("#x"))]
    got = {k: v[3] for k, v in judged(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "block", 11: "allow"}
    known = spark.createDataFrame([("http://lone.com/", "http://hop.com/1"), ("http://hop.com/1", "http://bad.net/y#z"), (None, "http://q.com/")], "a string, b string")
    assert judged(spark, rows, links=known)[11][3] == "block"


def test_empty_and_repeated_rows(spark):
    assert judged(spark, []) == {}
    frame = spark.createDataFrame([(1, "http://a.net/", None)] * 3, SCHEMA)
    assert urls.judge_urls(frame, URL_RULES).count() == 3


def test_case_of_hosts_and_usual_ports_make_no_other_node(spark):
    link = '<link rel=canonical href="{}">'.format
    rows = [(1, "http://one.com/a", link("http://Two.com/b")), (2, "http://two.com/b", link("HTTP://bad.NET:80/x")), (3, "http://bad.net/x", None),
            (4, "https://three.com:443/C", link("http://bad.net/x")), (5, "https://THREE.com/C", None), (6, "https://three.com/c", None), (7, "https://three.com:80/C", None)]
    assert {k: v[3] for k, v in judged(spark, rows).items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow"}


def test_very_long_urls_and_pages(spark):
    far = "http://far.com/" + "x/" * 50_000
    rows = [(1, far, "<p>" * 200_000 + '<link rel=canonical href="http://bad.net/">'), (2, "http://bad.net/", None)]
    assert {k: v[3] for k, v in judged(spark, rows).items()} == {1: "block", 2: "block"}
