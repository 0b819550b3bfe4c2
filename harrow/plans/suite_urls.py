"""Registered queries: URL jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions.dictionaries import PLATFORMS, POSTING_PLATFORMS
from harrow.operators import urls as U
from harrow.plans.fixtures import derived, with_views
from harrow.plans.registry import register
from harrow.plans.sqltext import canonical_cte, host_sql
from harrow.sources.tables import read_table

COMPANY_DOMAINS = ("example.com", "example.org", "careers.acme.com")


@register("p1_canonicalize_urls", f"WITH {canonical_cte('pages', 'page_id, url')} SELECT * FROM canon")
def p1(spark, sf):
    return U.canonicalize_urls(read_table(spark, sf, "pages").select("page_id", "url"))


@register("p2_duplicate_urls", f"""WITH {canonical_cte('pages', 'page_id, url')}
SELECT canonical_url, count(*) AS n_variants, min(page_id) AS first_page_id, count(DISTINCT url) AS n_distinct_urls
FROM canon GROUP BY canonical_url""")
def p2(spark, sf):
    return U.duplicate_urls(read_table(spark, sf, "pages"))


@register("p1b_canonicalize_posting_urls", with_views(
    f"WITH {canonical_cte('d_postings', 'ord, url')} SELECT * FROM canon", "d_postings"))
def p1b(spark, sf):
    return U.canonicalize_urls(derived(spark, sf, "d_postings").select("ord", "url"))


@register("p3_url_hosts", f"SELECT page_id, {host_sql('url')} AS host FROM pages")
def p3(spark, sf):
    return U.url_hosts(read_table(spark, sf, "pages").select("page_id", "url")).select("page_id", "host")


_ALLOW = ", ".join("'" + d + "'" for d in [p[2] for p in PLATFORMS] + ["example.com"])


@register("p4_filter_crawlable", f"""
WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme, {host_sql('url')} AS host FROM pages)
SELECT page_id, url,
  CASE WHEN scheme NOT IN ('http', 'https') THEN 'disallowed scheme: ''' || scheme || ''''
       WHEN host = '' THEN 'missing host'
       WHEN NOT list_bool_or(list_transform([{_ALLOW}], lambda d: host = d OR suffix(host, '.' || d))) THEN 'host not on allowlist: ' || host
  END AS reason,
  reason IS NULL AS allowed
FROM h""")
def p4(spark, sf):
    return U.filter_crawlable(read_table(spark, sf, "pages").select("page_id", "url"), extra_domains=("example.com",))


_PLAT_CASE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"suffix(host, '{d}')" for d in domains) + f" THEN '{slug}'"
    for slug, domains in POSTING_PLATFORMS + (("company", COMPANY_DOMAINS),)) + " END"


@register("p5_resolve_platform", with_views(f"""
WITH u AS (SELECT 'page' AS src, page_id AS id, url FROM pages UNION ALL SELECT 'posting', ord, url FROM d_postings),
h AS (SELECT src, id, url, {host_sql('url')} AS host FROM u)
SELECT src, id, url, {_PLAT_CASE} AS platform_slug FROM h WHERE host <> '' AND ({_PLAT_CASE}) IS NOT NULL""", "d_postings"))
def p5(spark, sf):
    pages = read_table(spark, sf, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), "url")
    posts = derived(spark, sf, "d_postings").select(F.lit("posting").alias("src"), F.col("ord").alias("id"), "url")
    return U.resolve_platform(pages.unionByName(posts), company_domains=COMPANY_DOMAINS)


_PLATFORM_ROWS = ", ".join(f"('{d}', '{slug}', {k})" for k, (slug, domains) in enumerate(POSTING_PLATFORMS) for d in domains)


@register("p5b_platform_by_guild", with_views(f"""
WITH u AS (SELECT 'page' AS src, page_id AS id, url, page_id % 4 AS guild_id FROM pages UNION ALL SELECT 'posting', ord, url, ord % 4 FROM d_postings),
h AS (SELECT *, {host_sql('url')} AS host FROM u),
own AS (SELECT DISTINCT page_id % 4 AS guild_id, substr({host_sql('url')}, 2) AS domain FROM pages WHERE page_id % 3 = 0),
d(domain, platform_slug, priority, guild_id) AS (
  SELECT *, NULL FROM (VALUES {_PLATFORM_ROWS}) UNION ALL SELECT domain, 'company', 1000, guild_id FROM own WHERE domain <> ''),
m AS (SELECT host, h.guild_id, arg_min(platform_slug, priority) AS platform_slug FROM (SELECT DISTINCT host, guild_id FROM h WHERE host <> '') h
  JOIN d ON suffix(host, domain) AND (d.guild_id IS NULL OR d.guild_id = h.guild_id) GROUP BY host, h.guild_id)
SELECT src, id, url, h.guild_id, platform_slug FROM h JOIN m ON m.host = h.host AND m.guild_id = h.guild_id""", "d_postings"))
def p5b(spark, sf):
    """Company domains of each guild as rows: hosts of a third of its pages without their first letter, so bare suffixes count."""
    pages = read_table(spark, sf, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), "url", (F.col("page_id") % 4).alias("guild_id"))
    posts = derived(spark, sf, "d_postings").select(F.lit("posting").alias("src"), F.col("ord").alias("id"), "url", (F.col("ord") % 4).alias("guild_id"))
    own = U.url_hosts(pages.filter("id % 3 = 0")).select(F.expr("substring(host, 2)").alias("domain"), F.lit("company").alias("platform_slug"),
                                                         F.lit(1000).alias("priority"), "guild_id").distinct()
    declared = U.platform_domains(spark).withColumn("guild_id", F.lit(None).cast("bigint"))
    return U.resolve_platform_by_table(pages.unionByName(posts), declared.unionByName(own), guild="guild_id")
