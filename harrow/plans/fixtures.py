"""Derived test views built from the landed tables.

Each view is one SQL text that runs unchanged in Spark SQL and in DuckDB, so an
operator's Spark input and its oracle's input are the same rows.  In Spark the
views are registered as temp views over the landed parquet; an oracle inlines
them as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harrow.sources.tables import register_tables

D_POSTINGS = """
SELECT o.o_orderkey AS ord,
  CASE o.o_custkey % 7 WHEN 0 THEN 'ashby' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever' WHEN 3 THEN 'workday'
    WHEN 4 THEN 'smartrecruiters' WHEN 5 THEN 'workable' ELSE 'company' END AS platform_slug,
  CASE WHEN o.o_orderkey % 4 = 0 THEN CAST(10000 + o.o_orderkey % 900 AS STRING) END AS external_job_id,
  'https://' || CASE o.o_custkey % 7 WHEN 0 THEN 'jobs.ashbyhq.com' WHEN 1 THEN 'boards.greenhouse.io' WHEN 2 THEN 'jobs.lever.co'
    WHEN 3 THEN 'acme.wd1.myworkdayjobs.com' WHEN 4 THEN 'jobs.smartrecruiters.com' WHEN 5 THEN 'apply.workable.com'
    ELSE 'careers.acme.com' END
    || '/co-' || CAST(o.o_custkey % 200 AS STRING) || '/jobs/' || CAST(10000 + o.o_orderkey % 5000 AS STRING)
    || CASE o.o_orderkey % 3 WHEN 0 THEN '?utm_source=x&b=2&a=1' WHEN 1 THEN '/' ELSE '#top' END AS url,
  CASE WHEN o.o_orderkey % 50 = 7 THEN NULL ELSE
    c.c_mktsegment || ' ' || CAST(o.o_custkey % 200 AS STRING) || CASE o.o_orderkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Technologies' ELSE '' END
  END AS company,
  CASE o.o_orderkey % 12 WHEN 0 THEN 'Software Engineer Intern, Summer 2027' WHEN 1 THEN 'Software Engineer Intern'
    WHEN 2 THEN 'Backend Engineer Intern (Summer 2027) at Acme' WHEN 3 THEN 'Senior Software Engineer'
    WHEN 4 THEN 'Mechanical Design Intern' WHEN 5 THEN 'Machine Learning Intern' WHEN 6 THEN 'Mobile Engineer Intern - iOS'
    WHEN 7 THEN 'Sales Intern' WHEN 8 THEN 'Software Developer Co-op Fall 2027'
    WHEN 9 THEN 'Platform Infrastructure Reliability Tooling Systems Software Engineer Intern'
    WHEN 10 THEN 'Platform Infrastructure Reliability Tooling Systems Software Engineer Team Intern' ELSE NULL END AS title,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'Toronto, ON, CA' WHEN 1 THEN 'New York, NY, US' WHEN 2 THEN 'Remote' WHEN 3 THEN '' ELSE NULL END AS location,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'Build backend services. Students welcome.' WHEN 1 THEN 'Write embedded firmware; of course remote.'
    WHEN 2 THEN 'CAD and manufacturing' WHEN 3 THEN 'ML engineer role, not html.' WHEN 4 THEN '' ELSE NULL END AS description,
  CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE o.o_orderdate END AS posting_date,
  o.o_orderkey % 25 = 3 AS is_expired
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

D_CATALOG = """
SELECT p.*, CASE o.o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'expired' ELSE 'closed' END AS status,
  CAST(o.o_orderkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS score, o.o_orderkey % 3 = 0 AS posted,
  CASE WHEN o.o_orderkey % 4 = 1 THEN NULL ELSE o.o_orderdate END AS last_checked_at, o.o_orderdate AS first_seen_at
FROM d_postings p JOIN orders o ON o.o_orderkey = p.ord
"""

D_JOB_PAGES = """
SELECT ord, url, url AS final_url, CASE ord % 20 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 503 ELSE 200 END AS status_code,
  '<html><head><title>' || coalesce(title, '') || '</title>'
  || CASE WHEN ord % 3 = 0 THEN '<meta property="og:site_name" content="' || coalesce(company, '') || '" />' ELSE '' END
  || CASE WHEN ord % 2 = 0 THEN '<script type="application/ld+json">{"@type":"JobPosting","title":"' || coalesce(title, '')
     || '","datePosted":"2026-07-13"' || CASE WHEN ord % 8 = 0 THEN ',"validThrough":"2020-01-01"' ELSE '' END
     || ',"hiringOrganization":{"name":"' || coalesce(company, '') || '"},"jobLocation":{"address":{"addressLocality":"Toronto","addressRegion":"ON","addressCountry":"CA"}}'
     || CASE ord % 6 WHEN 0 THEN ',"identifier":{"value":"' || CAST(ord AS STRING) || '"}' WHEN 2 THEN ',"identifier":{"name":"x"}' ELSE '' END
     || ',"description":"<p>' || coalesce(description, '') || ' R&amp;D</p>"}</script>' ELSE '' END
  || '</head><body><h1>x</h1>' || CASE ord % 11 WHEN 0 THEN '<p>This position is CLOSED.</p>' WHEN 1 THEN '<button disabled>Apply</button>'
     WHEN 2 THEN '<a href="/apply">Apply now</a>' ELSE '' END || '</body></html>' AS html
FROM d_postings
"""

D_HITS = """
SELECT page_id AS ord, 'q' || CAST(page_id % 20 AS STRING) AS query_hash, page_id % 3 AS run_id,
  CASE page_id % 4 WHEN 0 THEN 'serper' WHEN 1 THEN 'bing' WHEN 2 THEN 'brave' ELSE 'google_pse' END AS provider,
  url, 'Title ' || CAST(page_id % 30 AS STRING) AS title, 'snippet' AS snippet, page_id % 10 + 1 AS hit_rank, page_id % 5 = 0 AS is_relevant
FROM pages
"""

D_PAYLOADS = """
SELECT page_id AS ord, 'q' || CAST(page_id % 20 AS STRING) AS query_hash, page_id % 2 + 1 AS page, 10 AS per_page,
  CASE page_id % 4 WHEN 0 THEN 'serper' WHEN 1 THEN 'bing' WHEN 2 THEN 'brave' ELSE 'google_pse' END AS provider,
  CASE WHEN page_id % 5 = 0 THEN 'quota' WHEN page_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE page_id % 4
    WHEN 0 THEN '{"organic":[{"link":"' || url || '","title":"a","snippet":"s","position":3},{"link":"","title":"b"},{"link":"' || url || '2","title":"c"}]}'
    WHEN 1 THEN '{"webPages":{"value":[{"url":"","name":"b"},{"url":"' || url || '","name":"a","snippet":"s"}]}}'
    WHEN 2 THEN '{"web":{"results":[{"url":"' || url || '","title":"a","description":"s"},{"url":""}]}}'
    ELSE '{"items":[{"link":"' || url || '","title":"a","snippet":"s"}]}' END AS body
FROM pages
"""

D_QUERIES = """
SELECT p_brand AS platform_slug, p_type AS grp, v.variant AS variant, 'site:' || p_brand || ' ' || p_type || ' ' || v.variant AS text,
  v.factor * CAST(1 + length(p_type) % 5 AS DOUBLE) AS priority
FROM (SELECT DISTINCT p_brand, p_type FROM part) b
CROSS JOIN (SELECT 'title' AS variant, CAST(1.0 AS DOUBLE) AS factor UNION ALL SELECT 'title_term', CAST(0.8 AS DOUBLE) UNION ALL SELECT 'title_location', CAST(0.7 AS DOUBLE)) v
"""

D_SETTINGS_LOG = """
SELECT event_id AS seq, ts, user_id % 20 AS guild_id,
  CASE event_id % 12 WHEN 0 THEN 'min_score' WHEN 1 THEN 'interval' WHEN 2 THEN 'locations' WHEN 3 THEN 'terms' WHEN 4 THEN 'keywords'
    WHEN 5 THEN 'negative_keywords' WHEN 6 THEN 'add_domain' WHEN 7 THEN 'remove_domain' WHEN 8 THEN 'disable_platform'
    WHEN 9 THEN 'enable_platform' WHEN 10 THEN 'paused' ELSE 'channel' END AS setting_key,
  CASE event_id % 12 WHEN 0 THEN CAST(CAST(event_id % 15 AS DOUBLE) / CAST(10 AS DOUBLE) AS STRING) WHEN 1 THEN CAST(event_id % 5 AS STRING)
    WHEN 2 THEN ' Toronto; loc' || CAST(event_id % 7 AS STRING) || ',, Remote ' WHEN 3 THEN 'Summer 2027' WHEN 4 THEN 'python,go'
    WHEN 5 THEN 'firmware;cad' WHEN 6 THEN ' D' || CAST(event_id % 5 AS STRING) || '.Example.com ' WHEN 7 THEN 'd' || CAST(event_id % 5 AS STRING) || '.example.com'
    WHEN 8 THEN CASE WHEN event_id % 5 < 3 THEN 'lever' ELSE 'ashby' END WHEN 9 THEN CASE WHEN event_id % 5 < 3 THEN 'lever' ELSE 'workday' END
    WHEN 10 THEN CASE WHEN event_id % 5 < 2 THEN 'true' ELSE 'false' END ELSE CAST(event_id % 9 AS STRING) END AS setting_value
FROM events
"""

# Spark form of d_queries: the three variants come from inline() of a literal
# array instead of a cross join with a literal table (same rows).
D_QUERIES_SPARK = """
SELECT p_brand AS platform_slug, p_type AS grp, v.variant AS variant, 'site:' || p_brand || ' ' || p_type || ' ' || v.variant AS text,
  v.factor * CAST(1 + length(p_type) % 5 AS DOUBLE) AS priority
FROM (SELECT DISTINCT p_brand, p_type FROM part) b
LATERAL VIEW inline(array(named_struct('variant', 'title', 'factor', CAST(1.0 AS DOUBLE)),
                          named_struct('variant', 'title_term', 'factor', CAST(0.8 AS DOUBLE)),
                          named_struct('variant', 'title_location', 'factor', CAST(0.7 AS DOUBLE)))) v
"""

SPARK_OVERRIDES = {"d_queries": D_QUERIES_SPARK}

# name -> (sql, derived views it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "d_postings": (D_POSTINGS, ()),
    "d_catalog": (D_CATALOG, ("d_postings",)),
    "d_job_pages": (D_JOB_PAGES, ("d_postings",)),
    "d_hits": (D_HITS, ()),
    "d_payloads": (D_PAYLOADS, ()),
    "d_queries": (D_QUERIES, ()),
    "d_settings_log": (D_SETTINGS_LOG, ()),
}


def _closure(names) -> list[str]:
    out: list[str] = []
    def visit(n):
        for dep in VIEWS[n][1]:
            visit(dep)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a Spark DataFrame over the landed tables in ``sf_dir``."""
    register_tables(spark, sf_dir, ("orders", "customer", "pages", "part", "events"))
    for n in _closure([name]):
        spark.sql(SPARK_OVERRIDES.get(n, VIEWS[n][0])).createOrReplaceTempView(n)
    return spark.table(name)


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the derived views it needs, as CTEs."""
    parts = [f"{n} AS ({VIEWS[n][0]})" for n in _closure(names)]
    if not parts:
        return sql
    head = "WITH " + ",\n".join(parts)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return head + ",\n" + body[5:]
    return head + "\n" + body
