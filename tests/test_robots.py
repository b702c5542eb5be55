"""Robots rules by hand."""

from tidemark.sources import robots

TEXT = """# all
User-agent: *
Disallow: /private   # no
Allow: /private/open
Crawl-delay: 2
Sitemap: https://x/s.xml

User-agent: other
User-agent: TideReader
Disallow: /*.pdf$
Disallow: /a
Allow: /a/b
Disallow: /a/b
Disallow: /q+(x)
Disallow:
Crawl-delay: x
Crawl-delay: 5
"""
PATHS = ["", "/", "/private/x", "/a/c", "/a/b/c", "/d/e.pdf", "/d/e.pdf?x=1", "/d/e.pdfs", "/q+(x)/1", "/q", "/z#/a"]


def answers(spark, agent, text=TEXT):
    pages = spark.createDataFrame([(k, "https://x" + p) for k, p in enumerate(PATHS)] + [(99, "https://y/a")], "page_id long, url string")
    rules = robots.robots_rules(spark.createDataFrame([("https://x", text)], "origin string, content string"), agent)
    return {r.page_id: r for r in robots.allowed_pages(pages, rules).collect()}


def test_longest_rule_wins(spark):
    got = answers(spark, "TideReader/1.0")
    assert {PATHS[k] for k, r in got.items() if k < 99 and not r.allowed} == {"/a/c", "/d/e.pdf", "/d/e.pdf?x=1", "/q+(x)/1"}
    assert got[4].rule == "allow: /a/b" and got[0].rule is None and got[0].delay == 5 and got[99].allowed and got[99].delay == 0


def test_other_agents_take_the_general_group(spark):
    got = answers(spark, "nobody")
    assert [PATHS[k] for k, r in got.items() if k < 99 and not r.allowed] == ["/private/x"] and got[0].delay == 2
    assert all(r.allowed for r in answers(spark, "nobody", "User-agent: other\nDisallow: /").values())
