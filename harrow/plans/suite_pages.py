"""Registered queries: page and posting extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import pages as P
from harrow.plans.fixtures import derived, with_views
from harrow.plans.registry import register
from harrow.plans.sqltext import (
    canonical_cte,
    company_from_url_sql,
    html_to_text_sql,
    snippet_sql,
    unescape_sql,
    url_job_id_sql,
)
from harrow.sources.tables import read_table

COMPANY_DOMAINS = ("careers.acme.com",)


@register("p6_external_ids", with_views(
    f"SELECT ord, url, platform_slug, {url_job_id_sql('url', 'platform_slug')} AS url_job_id FROM d_postings",
    "d_postings"))
def p6(spark, sf):
    d = derived(spark, sf, "d_postings").select("ord", "url", "platform_slug")
    return P.external_ids(d)


@register("p7_companies_from_url", with_views(
    f"SELECT ord, url, platform_slug, {company_from_url_sql('url', 'platform_slug')} AS url_company FROM d_postings",
    "d_postings"))
def p7(spark, sf):
    d = derived(spark, sf, "d_postings").select("ord", "url", "platform_slug")
    return P.companies_from_url(d)


@register("p8_page_text", f"SELECT page_id, {html_to_text_sql('html')} AS text FROM pages")
def p8(spark, sf):
    return P.page_text(read_table(spark, sf, "pages").select("page_id", "html")).select("page_id", "text")


@register("p9_text_snippets", f"SELECT doc_id, {snippet_sql('text', 400)} AS snippet FROM documents")
def p9(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return P.text_snippets(d).select("doc_id", "snippet")


_LD_BLOCK = "nullif(regexp_extract(html, '<script type=\"application/ld\\+json\">(.*?)</script>', 1), '')"
_LD_FIELDS = f"""
  coalesce(json_extract_string(b, '$."@type"') = 'JobPosting', false) AS ld_found,
  json_extract_string(b, '$.title') AS ld_title,
  json_extract_string(b, '$.hiringOrganization.name') AS ld_company,
  nullif(concat_ws(', ', nullif(json_extract_string(b, '$.jobLocation.address.addressLocality'), ''),
    nullif(json_extract_string(b, '$.jobLocation.address.addressRegion'), ''),
    nullif(json_extract_string(b, '$.jobLocation.address.addressCountry'), '')), '') AS ld_location,
  CAST(try_strptime(json_extract_string(b, '$.datePosted'), '%Y-%m-%d') AS TIMESTAMP) AS ld_posting_date,
  json_extract_string(b, '$.employmentType') AS ld_employment_type,
  CASE WHEN b IS NOT NULL THEN {html_to_text_sql("json_extract_string(b, '$.description')")} END AS ld_description,
  json_extract_string(b, '$.identifier.value') AS ld_external_id,
  CAST(try_strptime(json_extract_string(b, '$.validThrough'), '%Y-%m-%d') AS TIMESTAMP) AS ld_expires_at,
  CAST(NULL AS VARCHAR) AS ld_remote_status"""


@register("p10_jsonld_postings", with_views(f"""
WITH x AS (SELECT ord, {_LD_BLOCK} AS b FROM d_job_pages)
SELECT ord, {_LD_FIELDS} FROM x""", "d_job_pages"))
def p10(spark, sf):
    pages = derived(spark, sf, "d_job_pages").select("ord", "html")
    return P.jsonld_postings(pages).drop("html")


_META_SQL = """
  nullif(regexp_extract(html, '(?is)<meta property="og:title" content="([^"]*)"', 1), '') AS og_title,
  nullif(trim(regexp_extract(html, '(?is)<meta property="og:site_name" content="([^"]*)"', 1)), '') AS og_site_name,
  nullif(regexp_extract(html, '(?is)<meta property="og:description" content="([^"]*)"', 1), '') AS og_description,
  CASE WHEN regexp_matches(html, '(?is)<title\\b') THEN trim(""" + unescape_sql(
    "regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title', 1)") + """) END AS title_text"""


@register("p11_page_metadata", with_views(f"""
SELECT 'page' AS src, page_id AS id, {_META_SQL} FROM pages
UNION ALL SELECT 'job_page', ord, {_META_SQL} FROM d_job_pages""", "d_job_pages"))
def p11(spark, sf):
    pages = read_table(spark, sf, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), "html")
    jp = derived(spark, sf, "d_job_pages").select(F.lit("job_page").alias("src"), F.col("ord").alias("id"), "html")
    return P.page_metadata(pages.unionByName(jp)).drop("html")


def landed_job_pages(spark, sf):
    """Test pages for P12: d_job_pages minus every tenth row; a URL may have landed more than once."""
    return derived(spark, sf, "d_job_pages").filter(F.col("ord") % 10 != 9)


_P12_SQL = with_views(f"""
WITH pg AS (SELECT * FROM d_job_pages WHERE ord % 10 <> 9 QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1),
pf AS (SELECT url AS purl, final_url, status_code, html, {_LD_BLOCK} AS b FROM pg),
pf2 AS (SELECT purl, final_url, status_code, html, {_LD_FIELDS}, {_META_SQL} FROM pf),
{canonical_cte('d_postings', 'ord')},
j AS (SELECT h.ord, h.url, h.title AS hit_title, h.description AS hit_snippet, h.platform_slug, p.*, c.canonical_url,
        p.purl IS NOT NULL AS page FROM d_postings h LEFT JOIN pf2 p ON p.purl = h.url JOIN canon c ON c.ord = h.ord)
SELECT ord,
  CASE WHEN page THEN coalesce(nullif(ld_title, ''), nullif(og_title, ''), nullif(title_text, ''), hit_title) ELSE hit_title END AS title,
  CASE WHEN page THEN coalesce(nullif(ld_company, ''), og_site_name, {company_from_url_sql('final_url', 'platform_slug')}) END AS company,
  CASE WHEN page THEN ld_location END AS location,
  CASE WHEN page THEN final_url ELSE url END AS url,
  canonical_url,
  platform_slug,
  CASE WHEN page THEN ld_posting_date END AS posting_date,
  CASE WHEN page THEN ld_employment_type END AS employment_type,
  CASE WHEN page THEN coalesce(nullif(ld_description, ''), {snippet_sql('hit_snippet', 400)}) ELSE {snippet_sql('hit_snippet', 400)} END AS description,
  CASE WHEN page THEN coalesce(nullif(ld_external_id, ''), {url_job_id_sql('final_url', 'platform_slug')}) END AS external_job_id,
  CASE WHEN page THEN ld_expires_at END AS expires_at,
  CAST(NULL AS VARCHAR) AS remote_status,
  CASE WHEN page THEN status_code IN (404, 410) OR contains(lower(html), 'this position is closed') ELSE false END AS is_expired,
  CASE WHEN NOT page THEN 'search' WHEN ld_found THEN 'jsonld' ELSE 'html' END AS source
FROM j""", "d_postings", "d_job_pages")


@register("p12_extract_postings", _P12_SQL)
def p12(spark, sf):
    hits = derived(spark, sf, "d_postings").select("ord", "url", "title", F.col("description").alias("snippet"))
    return P.extract_postings(hits, landed_job_pages(spark, sf), company_domains=COMPANY_DOMAINS, order="ord")


@register("p13_academic_terms", with_views("""
SELECT ord, CASE
  WHEN contains(title, '2027') AND (contains(lower(title), 'summer 2027') OR contains(lower(title), 'winter 2027')
       OR contains(lower(title), 'fall 2027') OR contains(lower(title), 'spring 2027')) THEN
    CASE WHEN contains(lower(title), 'summer 2027') THEN 'Summer 2027' WHEN contains(lower(title), 'winter 2027') THEN 'Winter 2027'
         WHEN contains(lower(title), 'fall 2027') THEN 'Fall 2027' ELSE 'Spring 2027' END
  WHEN contains(description, '2027') THEN
    CASE WHEN contains(lower(description), 'summer 2027') THEN 'Summer 2027' WHEN contains(lower(description), 'winter 2027') THEN 'Winter 2027'
         WHEN contains(lower(description), 'fall 2027') THEN 'Fall 2027' WHEN contains(lower(description), 'spring 2027') THEN 'Spring 2027' END
  END AS internship_term
FROM d_postings""", "d_postings"))
def p13(spark, sf):
    d = derived(spark, sf, "d_postings").select("ord", "title", "description")
    return P.academic_terms(d).select("ord", "internship_term")
