"""Queries over web pages: structured data, the way from an index to its details, robots rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog_flow import pick
from tidemark.plans import analogue as A
from tidemark.sources import files, pages, robots

#: The given pages have no structured data, so each gets some by its number: single, in arrays, in graphs, broken, hidden in CDATA.
BLOCKS = (
    '<script type="application/ld+json">{"@type": "House", "sku": "p#", "name": " Huis # ", "offers": {"price": #000}}</script>',
    "<SCRIPT async type='application/ld+json'>[{\"@type\": \"Person\"}, {\"@type\": [\"Thing\", \"APARTMENT\"], \"identifier\": #, \"offers\": [{\"price\": \"€ #.500\"}, {\"price\": 1}]}]</SCRIPT>",
    '<script type="application/ld+json">{"@graph": [[{"@type": "Product", "name": "g#", "price": #.25}], {"@graph": [{"@type": "House", "sku": "no"}]}]}</script>',
    '<script type="application/ld+json">{"@type": "House"</script><script type="application/ld+json">{"@type": "Residence", "offers": {"lowPrice": "1.#,75"}}</script>',
    "",
    '<script type="application/ld+json"><![CDATA[[[[{"@type": "Offer", "@id": "o#", "price": true}]]]]]></script>',
)
JSON_SQL = (
    "p AS (SELECT page_id, url, html || replace(([" + ", ".join("'" + b.replace("'", "''") + "'" for b in BLOCKS) + "])[page_id % 6 + 1], '#', page_id::VARCHAR) AS html FROM pages), "
    + r"""t AS (SELECT page_id, url, unnest(m) AS t, generate_subscripts(m, 1) AS nr FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<script[^>]+type\s*=\s*["'']application/ld\+json["''][^>]*>(.*?)</script>', 1) AS m FROM p)),
    x AS (SELECT page_id, url, nr, regexp_replace(regexp_replace(t, '^\s*<!\[CDATA\[', ''), '\]\]>\s*$', '') AS t FROM t),
    n AS (SELECT page_id, url, [nr] AS path, t::JSON AS v FROM x WHERE json_valid(t)
      UNION ALL SELECT page_id, url, list_append(path, k), items[k] FROM (SELECT page_id, url, path, items, unnest(range(1, len(items) + 1)) AS k FROM (SELECT *, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') WHEN json_type(v, '$."@graph"') = 'ARRAY' THEN json_extract(v, '$."@graph"[*]') END AS items FROM n))),
    leaf AS (SELECT *, CASE WHEN json_type(v, '$.offers') = 'ARRAY' THEN v -> '$.offers[0]' ELSE v -> '$.offers' END AS o FROM n WHERE json_type(v) = 'OBJECT' AND coalesce(json_type(v, '$."@graph"'), '') <> 'ARRAY'),
    w AS (SELECT * FROM leaf WHERE len(list_intersect(list_transform(CASE WHEN json_type(v, '$."@type"') = 'ARRAY' THEN json_extract_string(v, '$."@type"[*]') ELSE [v ->> '$."@type"'] END, lambda s: lower(s)), ['realestatelisting', 'product', 'offer', 'residence', 'house', 'apartment', 'singlefamilyresidence'])) > 0
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY path) = 1),
    c AS (SELECT *, list_filter([o -> '$.price', v -> '$.price', o -> '$.lowPrice'], lambda j: json_type(j) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR'))[1] AS j FROM w)"""
)


@query(
    f"""WITH RECURSIVE {JSON_SQL} SELECT page_id, url, coalesce(nullif(trim(v ->> '$.sku'), ''), nullif(trim(v ->> '$.identifier'), ''), nullif(trim(v ->> '$."@id"'), ''), nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+/(.*/)?([^/]+)/*$', 2), '')) AS listing_id, nullif(trim(v ->> '$.name'), '') AS title,
    CASE WHEN json_type(j) <> 'VARCHAR' THEN (j ->> '$')::DOUBLE WHEN contains(j ->> '$', ',') THEN replace(replace(regexp_replace(j ->> '$', '[^0-9,.-]', '', 'g'), '.', ''), ',', '.')::DOUBLE ELSE replace(regexp_replace(j ->> '$', '[^0-9,.-]', '', 'g'), '.', '')::DOUBLE END AS price FROM c"""
)
def page_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first listing in each page's structured data, however it's nested."""
    block = F.replace(pick(F.col("page_id"), *BLOCKS), F.lit("#"), F.col("page_id").cast("string"))
    rows = A.read(spark, sf_dir, "pages").withColumn("html", F.concat("html", block))
    return pages.listings_of_pages(rows).select("page_id", "url", "listing_id", "title", "price")


#: The given pages don't link to each other, so each gets an address by its number and links to others of its host, back and forth.
SITE_SQL = """s AS (SELECT page_id, 'https://Site' || (page_id % 3) || '.example/p/' || page_id || CASE WHEN page_id % 2 = 0 THEN '#top' ELSE '' END AS url,
    html || '<a href="/p/' || (page_id + 3 * (page_id % 5 + 1)) || '#x">a</a><a href="/p/' || (4 * page_id) || '">b</a><a href="/p/' || (page_id - 3) || '">c</a><a href="https://elsewhere.example/p/1">d</a>' AS html FROM pages)"""


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    anchor = lambda to, text: F.concat(F.lit('<a href="'), to, F.lit(f'">{text}</a>'))
    links = (anchor(F.concat(F.lit("/p/"), key + 3 * (key % 5 + 1), F.lit("#x")), "a"), anchor(F.concat(F.lit("/p/"), 4 * key), "b"), anchor(F.concat(F.lit("/p/"), key - 3), "c"), anchor(F.lit("https://elsewhere.example/p/1"), "d"))
    url = F.concat(F.lit("https://Site"), key % 3, F.lit(".example/p/"), key, F.when(key % 2 == 0, F.lit("#top")).otherwise(F.lit("")))
    return A.read(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.concat("html", *links).alias("html"))


@query(
    f"""WITH RECURSIVE {SITE_SQL}, h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM s),
    l AS (SELECT DISTINCT page_id, replace(regexp_replace(CASE WHEN h LIKE '/%' THEN o || h ELSE h END, '#.*$', ''), 'Site', 'site') AS link FROM h WHERE h LIKE '/%' OR starts_with(h, o || '/')),
    c AS (SELECT page_id, replace(regexp_replace(url, '#.*$', ''), 'Site', 'site') AS place FROM s), e AS (SELECT l.page_id AS a, c.page_id AS b FROM l JOIN c ON place = link),
    r AS (SELECT page_id, 0 AS depth FROM s WHERE page_id < 3 UNION SELECT b, depth + 1 FROM r JOIN e ON a = page_id WHERE depth < 6)
    SELECT page_id, min(depth)::INTEGER AS depth FROM r GROUP BY 1"""
)
def page_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From three index pages to their details, six links deep at most."""
    rows = site(spark, sf_dir)
    return pages.reached(rows, files.extract_links(rows), rows.where("page_id < 3"), depth=6)


#: Rules of the hosts whose name has an even length, and of the others; the agent has a group of its own in the first.
ROBOTS = (
    "User-agent: *\nDisallow: /\n\nUser-agent: tidereader # ours\nUser-agent: other\nDisallow: /en\nAllow: /en/1\nDisallow: /*.html$\nAllow: /en/*5\nCrawl-delay: 3",
    "User-agent: *\nDisallow: /fr/\nDisallow: /de/*9\nAllow: /fr/2\nDisallow:\n",
)
RULES_SQL = "ru(v, type, path, pattern) AS (VALUES (0, 'disallow', '/en', '^/en'), (0, 'allow', '/en/1', '^/en/1'), (0, 'disallow', '/*.html$', '^/.*\\.html$'), (0, 'allow', '/en/*5', '^/en/.*5'), (1, 'disallow', '/fr/', '^/fr/'), (1, 'disallow', '/de/*9', '^/de/.*9'), (1, 'allow', '/fr/2', '^/fr/2'))"


@query(
    f"""WITH {RULES_SQL}, u AS (SELECT page_id, len(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) % 2 AS v, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '[?#].*$', '') AS p FROM pages),
    m AS (SELECT page_id, type, path FROM u JOIN ru ON ru.v = u.v AND regexp_matches(CASE WHEN p LIKE '/%' THEN p ELSE '/' || p END, pattern) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY len(path) DESC, type, path DESC) = 1)
    SELECT page_id, coalesce(type, 'allow') = 'allow' AS allowed, type || ': ' || path AS rule, CASE WHEN v = 0 THEN 3 ELSE 0 END::DOUBLE AS delay FROM u LEFT JOIN m USING (page_id)"""
)
def page_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages their hosts' rules allow, by the longest rule."""
    rows = A.read(spark, sf_dir, "pages")
    origins = rows.select(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1).alias("origin")).distinct()
    content = F.when(F.length("origin") % 2 == 0, ROBOTS[0]).otherwise(ROBOTS[1])
    return robots.allowed_pages(rows, robots.robots_rules(origins.select("origin", content.alias("content")), "TideReader/2"))
