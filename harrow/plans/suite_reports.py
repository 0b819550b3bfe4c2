"""Registered queries: reports, lookups, settings and planning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from harrow.functions import dictionaries as _D
from harrow.functions.text import normalize_company, sha32
from harrow.operators import planning as Q
from harrow.operators import reports as R
from harrow.operators import settings as C
from harrow.operators.pages import academic_terms, announcement_rows
from harrow.plans.fixtures import derived, with_views
from harrow.plans.registry import register
from harrow.plans.sqltext import normalize_company_sql
from harrow.sources.tables import read_table

CATALOG_NOW = dt.datetime(1998, 6, 15)
EVENTS_NOW = dt.datetime(2024, 1, 31)


@register("a1_catalog_stats", with_views("""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active,
  count(*) FILTER (WHERE posted) AS posted, count(*) FILTER (WHERE status = 'expired') AS expired FROM d_catalog""", "d_catalog"))
def a1(spark, sf):
    return R.catalog_stats(derived(spark, sf, "d_catalog"))


@register("a2_top_companies", with_views("""
SELECT company, count(*) AS n FROM d_catalog WHERE company IS NOT NULL GROUP BY company ORDER BY n DESC, company LIMIT 20""", "d_catalog"))
def a2(spark, sf):
    return R.top_companies(derived(spark, sf, "d_catalog"))


@register("a5_scan_report", with_views("""
SELECT run_id, count(DISTINCT query_hash) AS queries_run, count(*) AS results_found,
  count(*) FILTER (WHERE is_relevant) AS jobs_new, count(*) FILTER (WHERE is_relevant AND hit_rank = 1) AS jobs_posted,
  'completed' AS status FROM d_hits GROUP BY run_id""", "d_hits"))
def a5(spark, sf):
    h = derived(spark, sf, "d_hits").withColumn("is_new", F.col("is_relevant")) \
        .withColumn("is_posted", F.col("is_relevant") & (F.col("hit_rank") == 1))
    return R.scan_report(h)


_DOC_CATALOG_SQL = "SELECT doc_id AS job_id, CAST(doc_id % 101 AS DOUBLE) / 100.0 AS score, 'active' AS status FROM documents"


def _doc_catalog(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("job_id"), ((F.col("doc_id") % 101).cast("double") / 100.0).alias("score"),
                    F.lit("active").alias("status"))


def _label_feedback(spark, sf):
    lab = read_table(spark, sf, "labels")
    kinds = F.array_compact(F.array(F.when(F.col("toxic") == 1, F.lit("irrelevant")),
                                    F.when(F.col("quality") == 0, F.lit("duplicate"))))
    return lab.select(F.col("doc_id").alias("job_id"), F.explode(kinds).alias("kind"))


@register("a6_fold_feedback", f"""
WITH c AS ({_DOC_CATALOG_SQL}),
v AS (SELECT doc_id AS job_id, count(*) FILTER (WHERE toxic = 1) AS n_irr, bool_or(quality = 0) AS dup FROM labels GROUP BY doc_id)
SELECT c.job_id, CASE WHEN coalesce(v.n_irr, 0) > 0 THEN greatest(0.0, c.score - 0.2) ELSE c.score END AS score,
  CASE WHEN coalesce(v.dup, false) THEN 'closed' ELSE c.status END AS status
FROM c LEFT JOIN v ON v.job_id = c.job_id""")
def a6(spark, sf):
    return R.fold_feedback(_label_feedback(spark, sf), _doc_catalog(spark, sf)).select("job_id", "score", "status")


_TERM_SQL = """CASE WHEN contains(title, '2027') AND regexp_matches(lower(title), 'summer 2027|winter 2027|fall 2027|spring 2027') THEN
    CASE WHEN contains(lower(title), 'summer 2027') THEN 'Summer 2027' WHEN contains(lower(title), 'winter 2027') THEN 'Winter 2027'
         WHEN contains(lower(title), 'fall 2027') THEN 'Fall 2027' ELSE 'Spring 2027' END
  WHEN contains(description, '2027') THEN
    CASE WHEN contains(lower(description), 'summer 2027') THEN 'Summer 2027' WHEN contains(lower(description), 'winter 2027') THEN 'Winter 2027'
         WHEN contains(lower(description), 'fall 2027') THEN 'Fall 2027' WHEN contains(lower(description), 'spring 2027') THEN 'Spring 2027' END END"""


@register("f4_search_catalog", with_views(f"""
WITH c AS (SELECT *, {_TERM_SQL} AS internship_term FROM d_catalog)
SELECT ord, title, location, internship_term, score FROM c
WHERE title ILIKE '%engineer%' AND location ILIKE '%on%' AND internship_term ILIKE '%2027%'
ORDER BY score DESC, ord LIMIT 10""", "d_catalog"))
def f4(spark, sf):
    c = academic_terms(derived(spark, sf, "d_catalog"))
    return R.search_catalog(c, "engineer", "on", "2027").select("ord", "title", "location", "internship_term", "score")


@register("f5_recent", """
SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 48 HOUR
ORDER BY value DESC, ts DESC, event_id LIMIT 25""")
def f5(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "ts", "value")
    return R.recent(e, EVENTS_NOW, 48, 25, seen="ts", score="value", key="event_id")


@register("f6_platform_filter", with_views("SELECT * FROM d_queries WHERE platform_slug = 'Brand#13'", "d_queries"))
def f6(spark, sf):
    return R.platform_filter(derived(spark, sf, "d_queries"), "Brand#13")


_SETTINGS_SQL = """
d_settings AS (
  WITH l AS (SELECT * FROM d_settings_log),
  s AS (SELECT guild_id, setting_key, arg_max(setting_value, (ts, seq)) AS v FROM l
        WHERE setting_key IN ('min_score','interval','locations','terms','keywords','negative_keywords','paused','channel')
        GROUP BY guild_id, setting_key),
  m AS (SELECT guild_id, CASE WHEN setting_key IN ('add_domain','remove_domain') THEN 'company_domains' ELSE 'disabled_platforms' END AS set_name,
          CASE WHEN setting_key IN ('add_domain','remove_domain') THEN lower(trim(setting_value)) ELSE setting_value END AS item,
          arg_max(setting_key IN ('add_domain','disable_platform'), (ts, seq)) AS present
        FROM l WHERE setting_key IN ('add_domain','remove_domain','disable_platform','enable_platform') GROUP BY ALL),
  g AS (SELECT DISTINCT guild_id FROM l)
  SELECT g.guild_id,
    (SELECT TRY_CAST(v AS BIGINT) FROM s WHERE s.guild_id = g.guild_id AND setting_key = 'channel') AS post_channel_id,
    coalesce((SELECT greatest(0.5, TRY_CAST(v AS DOUBLE)) FROM s WHERE s.guild_id = g.guild_id AND setting_key = 'interval'), 6.0) AS scan_interval_hours,
    coalesce((SELECT greatest(0.0, least(1.0, TRY_CAST(v AS DOUBLE))) FROM s WHERE s.guild_id = g.guild_id AND setting_key = 'min_score'), 0.55) AS min_score,
    coalesce((SELECT lower(v) = 'true' FROM s WHERE s.guild_id = g.guild_id AND setting_key = 'paused'), false) AS paused,
    coalesce((SELECT list_filter(list_transform(string_split(replace(v, ';', ','), ','), lambda x: trim(x)), lambda x: x <> '') FROM s WHERE s.guild_id = g.guild_id AND setting_key = 'locations'), []::VARCHAR[]) AS locations,
    coalesce((SELECT list_filter(list_transform(string_split(replace(v, ';', ','), ','), lambda x: trim(x)), lambda x: x <> '') FROM s WHERE s.guild_id = g.guild_id AND setting_key = 'terms'), []::VARCHAR[]) AS academic_terms,
    coalesce((SELECT list_filter(list_transform(string_split(replace(v, ';', ','), ','), lambda x: trim(x)), lambda x: x <> '') FROM s WHERE s.guild_id = g.guild_id AND setting_key = 'keywords'), []::VARCHAR[]) AS extra_keywords,
    coalesce((SELECT list_filter(list_transform(string_split(replace(v, ';', ','), ','), lambda x: trim(x)), lambda x: x <> '') FROM s WHERE s.guild_id = g.guild_id AND setting_key = 'negative_keywords'), []::VARCHAR[]) AS negative_keywords,
    coalesce((SELECT list_sort(list(item)) FROM m WHERE m.guild_id = g.guild_id AND set_name = 'company_domains' AND present), []::VARCHAR[]) AS company_domains,
    coalesce((SELECT list_sort(list(item)) FROM m WHERE m.guild_id = g.guild_id AND set_name = 'disabled_platforms' AND present), []::VARCHAR[]) AS disabled_platforms
  FROM g)"""


def settings_oracle(sql: str) -> str:
    return with_views("WITH " + _SETTINGS_SQL.strip() + "\n" + sql, "d_settings_log")


def d_settings(spark, sf):
    return C.fold_settings(derived(spark, sf, "d_settings_log"))


def _settings_view(df):
    return df.select("guild_id", "post_channel_id", "scan_interval_hours", "min_score", "paused",
                     *[F.array_join(c, "|").alias(c) for c in ("locations", "academic_terms", "extra_keywords",
                                                               "negative_keywords", "company_domains", "disabled_platforms")])


@register("c1_fold_settings", settings_oracle("""
SELECT guild_id, post_channel_id, scan_interval_hours, min_score, paused, array_to_string(locations, '|') AS locations,
  array_to_string(academic_terms, '|') AS academic_terms, array_to_string(extra_keywords, '|') AS extra_keywords,
  array_to_string(negative_keywords, '|') AS negative_keywords, array_to_string(company_domains, '|') AS company_domains,
  array_to_string(disabled_platforms, '|') AS disabled_platforms FROM d_settings"""))
def c1(spark, sf):
    return _settings_view(d_settings(spark, sf))


@register("f7_active_settings", settings_oracle("SELECT guild_id FROM d_settings WHERE NOT paused"))
def f7(spark, sf):
    return R.active_settings(d_settings(spark, sf)).select("guild_id")


_ALL_SLUGS = tuple(p[0] for p in _D.PLATFORMS)
_SLUG_LIST = "[" + ", ".join(f"'{s}'" for s in _ALL_SLUGS) + "]"
_TERMS_LIST = "[" + ", ".join(f"'{t}'" for t in _D.DEFAULT_ACADEMIC_TERMS) + "]"
_LOCS_LIST = "[" + ", ".join(f"'{t}'" for t in _D.DEFAULT_LOCATIONS) + "]"


@register("q2_enabled_platforms", settings_oracle(f"""
SELECT guild_id, array_to_string(list_filter({_SLUG_LIST}, lambda s: NOT list_contains(disabled_platforms, s)), '|') AS platforms,
  array_to_string(CASE WHEN len(academic_terms) > 0 THEN academic_terms ELSE {_TERMS_LIST} END, '|') AS academic_terms,
  array_to_string(CASE WHEN len(locations) > 0 THEN locations ELSE {_LOCS_LIST} END, '|') AS locations
FROM d_settings"""))
def q2(spark, sf):
    e = C.enabled_platforms(d_settings(spark, sf))
    return e.select("guild_id", *[F.array_join(c, "|").alias(c) for c in ("platforms", "academic_terms", "locations")])


def guild_templates(spark, sf):
    return Q.build_queries(C.enabled_platforms(d_settings(spark, sf)))


def _q1_oracle() -> str:
    from harrow.functions.dictionaries import GROUP_WEIGHT, JOB_TITLE_GROUPS, PLATFORMS, TITLE_GROUP_TO_CATEGORY
    cat, weight = dict(TITLE_GROUP_TO_CATEGORY), dict(GROUP_WEIGHT)

    def q(v):
        return "'" + v.replace("'", "''") + "'"
    plats = " UNION ALL ".join(f"SELECT {q(s)} AS slug, {q(d)} AS domain" for s, _, d in PLATFORMS)
    groups = " UNION ALL ".join(
        f"SELECT {q(g)} AS grp, [{', '.join(q(t) for t in titles)}] AS titles, {q(cat[g])} AS category, "
        f"CAST({weight.get(g, 1.0)!r} AS DOUBLE) AS weight" for g, titles in JOB_TITLE_GROUPS)
    clause = ("'(' || array_to_string(list_transform({x}, lambda t: CASE WHEN contains(t, ' ') OR contains(t, '-') "
              "THEN '\"' || t || '\"' ELSE t END), ' OR ') || ')'")
    return settings_oracle(f"""
, cfg AS (SELECT guild_id, list_filter({_SLUG_LIST}, lambda s: NOT list_contains(disabled_platforms, s)) AS platforms,
    CASE WHEN len(academic_terms) > 0 THEN academic_terms ELSE {_TERMS_LIST} END AS terms,
    CASE WHEN len(locations) > 0 THEN locations ELSE {_LOCS_LIST} END AS locs
  FROM d_settings),
pl AS ({plats}),
gr AS ({groups}),
base AS (SELECT c.guild_id, c.terms, c.locs, p.slug, p.domain, g.grp, g.category, g.weight,
    'site:' || p.domain || ' ' || {clause.format(x='g.titles[1:4]')} AS site
  FROM (SELECT guild_id, terms, locs, unnest(platforms) AS slug FROM cfg) c JOIN pl p ON p.slug = c.slug, gr g),
v AS (SELECT guild_id, site AS text, slug, grp, category, weight * 1.0 AS priority, 'title' AS variant FROM base
  UNION ALL SELECT guild_id, site || ' ' || {clause.format(x='terms')}, slug, grp, category, weight * 0.8, 'title_term' FROM base WHERE len(terms) > 0
  UNION ALL SELECT guild_id, site || ' ' || {clause.format(x='locs[1:5]')}, slug, grp, category, weight * 0.7, 'title_location' FROM base WHERE len(locs) > 0)
SELECT guild_id, text, slug AS platform_slug, grp, category, priority, variant, substr(sha256(text), 1, 32) AS query_hash FROM v""")


@register("q1_build_queries", _q1_oracle())
def q1(spark, sf):
    return guild_templates(spark, sf).drop("gen_order")


@register("q3_or_clauses", """
WITH t AS (SELECT p_brand, p_type, min(p_partkey) AS pos FROM part GROUP BY p_brand, p_type)
SELECT p_brand, '(' || string_agg(CASE WHEN contains(p_type, ' ') OR contains(p_type, '-') THEN '"' || p_type || '"' ELSE p_type END,
  ' OR ' ORDER BY pos, p_type) || ')' AS clause FROM t GROUP BY p_brand""")
def q3(spark, sf):
    return Q.or_clauses(read_table(spark, sf, "part"), "p_brand", "p_type", "p_partkey")


_RUNS_SQL = """
runs AS (SELECT substr(sha256(q.text), 1, 32) AS query_hash, e.ts AS run_ts, CAST(floor(e.value) AS BIGINT) AS result_count,
  CASE WHEN e.event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS relevant_count
  FROM events e JOIN (SELECT text, row_number() OVER (ORDER BY text) AS qn FROM d_queries) q ON q.qn = e.user_id + 1),
stats AS (SELECT query_hash, count(*) AS times_run, sum(result_count) AS total_results, sum(relevant_count) AS relevant_results,
  max(run_ts) AS last_run_at FROM runs GROUP BY query_hash),
bonus AS (SELECT query_hash, least(1.0, coalesce(relevant_results, 0) / times_run) AS bonus FROM stats WHERE times_run > 0)"""


def _runs(spark, sf):
    # the templates (platforms x groups x variants) are numbered in text order
    q = derived(spark, sf, "d_queries").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    q = q.select(F.posexplode("texts").alias("qn", "text"))
    e = read_table(spark, sf, "events")
    return e.join(q, q["qn"] == e["user_id"]).select(
        sha32(F.col("text")).alias("query_hash"), F.col("ts").alias("run_ts"),
        F.floor("value").cast("bigint").alias("result_count"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("relevant_count"))


@register("a3_query_yield", with_views("WITH " + _RUNS_SQL.strip() + " SELECT * FROM stats", "d_queries"))
def a3(spark, sf):
    return Q.query_yield(_runs(spark, sf))


@register("a4_learned_priority", with_views("WITH " + _RUNS_SQL.strip() + " SELECT * FROM bonus", "d_queries"))
def a4(spark, sf):
    return Q.learned_priority(Q.query_yield(_runs(spark, sf)))


@register("w4_top_queries", with_views("WITH " + _RUNS_SQL.strip() +
                                       " SELECT * FROM stats ORDER BY relevant_results DESC, times_run DESC, query_hash LIMIT 15", "d_queries"))
def w4(spark, sf):
    return R.top_queries(Q.query_yield(_runs(spark, sf)))


def _queries_with_stats(spark, sf):
    qs = derived(spark, sf, "d_queries").withColumn("query_hash", sha32(F.col("text")))
    return Q.queries_with_stats(qs, Q.learned_priority(Q.query_yield(_runs(spark, sf))))


_QWS_SQL = """qws AS (SELECT q.*, substr(sha256(q.text), 1, 32) AS query_hash2, coalesce(b.bonus, 0.0) AS bonus
  FROM d_queries q LEFT JOIN bonus b ON b.query_hash = substr(sha256(q.text), 1, 32))"""


@register("j7_queries_with_stats", with_views("WITH " + _RUNS_SQL.strip() + ", " + _QWS_SQL +
                                              " SELECT platform_slug, grp, variant, text, priority, query_hash2 AS query_hash, bonus FROM qws", "d_queries"))
def j7(spark, sf):
    return _queries_with_stats(spark, sf).select("platform_slug", "grp", "variant", "text", "priority", "query_hash", "bonus")


@register("w1_select_batch", with_views("WITH " + _RUNS_SQL.strip() + ", " + _QWS_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY platform_slug ORDER BY priority + bonus DESC, query_hash2) AS rn,
  count(*) OVER (PARTITION BY platform_slug) AS n FROM qws),
p AS (SELECT *, least(4, n) AS top_n, n - least(4, n) AS rest_len, 12 - least(4, n) AS need FROM r),
o AS (SELECT *, (3 * need) % greatest(rest_len, 1) AS start FROM p)
SELECT text, query_hash2 AS query_hash, CASE WHEN rn <= top_n THEN rn ELSE top_n + ((rn - top_n - 1 - start) % greatest(rest_len, 1) + greatest(rest_len, 1)) % greatest(rest_len, 1) + 1 END AS batch_pos
FROM o WHERE rn <= top_n OR ((rn - top_n - 1 - start) % greatest(rest_len, 1) + greatest(rest_len, 1)) % greatest(rest_len, 1) < least(need, rest_len)""", "d_queries"))
def w1(spark, sf):
    return Q.select_batch(_queries_with_stats(spark, sf), 12, "platform_slug", rotation=3).select("text", "query_hash", "batch_pos")


@register("q4_query_runs", with_views("""
SELECT query_hash, run_id, min(provider) AS provider, count(*) AS result_count, count(*) FILTER (WHERE is_relevant) AS relevant_count
FROM d_hits GROUP BY query_hash, run_id""", "d_hits"))
def q4(spark, sf):
    return Q.query_runs(derived(spark, sf, "d_hits"))


@register("s1_normalize_hits", with_views("""
WITH p AS (SELECT *, CASE provider WHEN 'serper' THEN json_extract(body, '$.organic[*]') WHEN 'bing' THEN json_extract(body, '$.webPages.value[*]')
   WHEN 'brave' THEN json_extract(body, '$.web.results[*]') ELSE json_extract(body, '$.items[*]') END AS items FROM d_payloads WHERE status = 'ok'),
e AS (SELECT ord, query_hash, page, per_page, provider, status, items, unnest(range(len(items))) AS i FROM p),
f AS (SELECT *, items[i + 1] AS it FROM e)
SELECT ord, query_hash, page, per_page, provider, status,
  CAST(CASE provider WHEN 'serper' THEN coalesce(CAST(json_extract_string(it, '$.position') AS BIGINT), i + 1)
    WHEN 'bing' THEN (page - 1) * per_page + i + 1 WHEN 'brave' THEN i + 1 ELSE (page - 1) * per_page + 1 + i END AS BIGINT) AS rank,
  coalesce(json_extract_string(it, CASE WHEN provider IN ('serper', 'google_pse') THEN '$.link' ELSE '$.url' END), '') AS url,
  json_extract_string(it, CASE WHEN provider = 'bing' THEN '$.name' ELSE '$.title' END) AS title,
  json_extract_string(it, CASE WHEN provider = 'brave' THEN '$.description' ELSE '$.snippet' END) AS snippet
FROM f WHERE coalesce(json_extract_string(it, CASE WHEN provider IN ('serper', 'google_pse') THEN '$.link' ELSE '$.url' END), '') <> ''""", "d_payloads"))
def s1(spark, sf):
    return Q.normalize_hits(derived(spark, sf, "d_payloads"))


@register("s2_resolve_provider", with_views("""
WITH ok AS (SELECT query_hash, arg_min(provider, CASE provider WHEN 'serper' THEN 0 WHEN 'bing' THEN 1 WHEN 'brave' THEN 2 ELSE 3 END) AS provider
  FROM d_payloads WHERE status = 'ok' GROUP BY query_hash)
SELECT q.query_hash, ok.provider, CASE WHEN ok.provider IS NULL THEN 'failed' ELSE 'ok' END AS status
FROM (SELECT DISTINCT query_hash FROM d_payloads) q LEFT JOIN ok ON ok.query_hash = q.query_hash""", "d_payloads"))
def s2(spark, sf):
    return Q.resolve_provider(derived(spark, sf, "d_payloads"))


@register("s3_admit_requests", """
WITH r AS (SELECT event_id AS request_id, ts, event_type <> 'error' AS succeeded, date_trunc('hour', ts) AS h, CAST(ts AS DATE) AS d FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY ts, request_id) AS hr FROM r WHERE succeeded),
e AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ts, request_id) AS dr FROM s WHERE hr <= 5),
rec AS (SELECT request_id FROM e WHERE dr <= 60),
x AS (SELECT r.*, rec.request_id IS NOT NULL AS recorded FROM r LEFT JOIN rec ON rec.request_id = r.request_id),
y AS (SELECT *, coalesce(sum(CAST(recorded AS INT)) OVER (PARTITION BY h ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hc,
  coalesce(sum(CAST(recorded AS INT)) OVER (PARTITION BY d ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dc FROM x)
SELECT request_id, ts, succeeded, CASE WHEN hc >= 5 THEN 'refused_hourly' WHEN dc >= 60 THEN 'refused_daily'
  WHEN succeeded THEN 'admitted' ELSE 'failed' END AS outcome FROM y""")
def s3(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("event_id").alias("request_id"), "ts",
                                                (F.col("event_type") != "error").alias("succeeded"))
    return Q.admit_requests(e, hourly=5, daily=60)


@register("s4_hits_for_site", """
SELECT page_id AS ord, url FROM pages WHERE contains(url, 'example.com') ORDER BY page_id LIMIT 10 OFFSET 10""")
def s4(spark, sf):
    p = read_table(spark, sf, "pages").select(F.col("page_id").alias("ord"), "url")
    return Q.hits_for_site(p, "site:example.com software intern", page=2, per_page=10)


@register("w2_pending", with_views("""
SELECT ord, score FROM d_catalog WHERE NOT posted AND status = 'active' AND score >= 0.55 ORDER BY score DESC, ord LIMIT 25""", "d_catalog"))
def w2(spark, sf):
    return R.pending(derived(spark, sf, "d_catalog"), 0.55).select("ord", "score")


@register("w3_due_for_recheck", with_views("""
SELECT ord, last_checked_at FROM d_catalog WHERE status = 'active'
  AND (last_checked_at IS NULL OR last_checked_at < TIMESTAMP '1998-06-15 00:00:00' - INTERVAL 24 HOUR)
ORDER BY last_checked_at ASC NULLS FIRST, ord LIMIT 50""", "d_catalog"))
def w3(spark, sf):
    return R.due_for_recheck(derived(spark, sf, "d_catalog"), CATALOG_NOW, 24).select("ord", "last_checked_at")


@register("w5_digest", with_views("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY platform_slug ORDER BY score DESC, ord) AS rn, count(*) OVER (PARTITION BY platform_slug) AS n FROM d_catalog)
SELECT platform_slug, rn, ord, substr(coalesce(title, '(untitled)'), 1, 200) AS name,
  substr('[' || coalesce(company, '?') || ' — ' || coalesce(location, 'N/A') || '](' || coalesce(url, '') || ') • ' || printf('%.2f', score), 1, 1024) AS value,
  greatest(n - 25, 0) AS more FROM r WHERE rn <= 25""", "d_catalog"))
def w5(spark, sf):
    return R.digest(derived(spark, sf, "d_catalog"), "platform_slug")


@register("w7_first_last_seen", """
SELECT user_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS sightings FROM events GROUP BY user_id""")
def w7(spark, sf):
    return R.first_last_seen(read_table(spark, sf, "events"), "user_id", "ts")


_IGNORED_SQL = f"""ign AS (SELECT DISTINCT c_nationkey % 20 AS guild_id,
  {normalize_company_sql("c_mktsegment || ' ' || CAST(c_custkey % 200 AS VARCHAR)")} AS normalized_company FROM customer WHERE c_acctbal < 0)"""


@register("j5_drop_ignored", with_views("WITH " + _IGNORED_SQL + f""",
p AS (SELECT ord, ord % 20 AS guild_id, company, {normalize_company_sql('company')} AS normalized_company FROM d_catalog)
SELECT ord, guild_id, company FROM p WHERE coalesce(company, '') = ''
   OR NOT EXISTS (SELECT 1 FROM ign WHERE ign.guild_id = p.guild_id AND ign.normalized_company = p.normalized_company)""", "d_catalog"))
def j5(spark, sf):
    cust = read_table(spark, sf, "customer").filter(F.col("c_acctbal") < 0)
    ign = cust.select((F.col("c_nationkey") % 20).alias("guild_id"),
                      normalize_company(F.concat(F.col("c_mktsegment"), F.lit(" "),
                                                 (F.col("c_custkey") % 200).cast("string"))).alias("normalized_company"))
    p = derived(spark, sf, "d_catalog").select("ord", (F.col("ord") % 20).alias("guild_id"), "company",
                                               normalize_company(F.col("company")).alias("normalized_company"))
    return R.drop_ignored(p, ign).select("ord", "guild_id", "company")


@register("j6_saved_list", """
WITH s AS (SELECT DISTINCT user_id, 1 + event_id % 2000 AS job_id, min(ts) OVER (PARTITION BY user_id, 1 + event_id % 2000) AS created_at FROM events)
SELECT s.job_id, s.created_at, p.p_name FROM s JOIN part p ON p.p_partkey = s.job_id WHERE s.user_id = 7
ORDER BY s.created_at DESC, s.job_id LIMIT 25""")
def j6(spark, sf):
    saved = (read_table(spark, sf, "events").select("user_id", (1 + F.col("event_id") % 2000).alias("job_id"), "ts")
             .groupBy("user_id", "job_id").agg(F.min("ts").alias("created_at")))
    part = read_table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), "p_name")
    return R.saved_list(saved, part, 7).select("job_id", "created_at", "p_name")


@register("s8_get_jobs", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49)""")
def s8(spark, sf):
    ids = read_table(spark, sf, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)) \
        .select(F.col("l_orderkey").alias("o_orderkey"))
    return R.get_jobs(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ids, "o_orderkey")


@register("p14_announcement_rows", with_views(f"""
WITH c AS (SELECT *, {_TERM_SQL} AS internship_term FROM d_catalog),
t AS (SELECT *, CASE WHEN internship_term IS NOT NULL AND NOT contains(coalesce(title, '(untitled)'), internship_term)
        THEN coalesce(title, '(untitled)') || ', ' || internship_term ELSE coalesce(title, '(untitled)') END AS tt FROM c)
SELECT ord, substr(tt, 1, 256) AS embed_title, url AS embed_url, CASE WHEN score >= 0.75 THEN 3066993 ELSE 3447003 END AS color,
  CASE platform_slug WHEN 'ashby' THEN 'Ashby' WHEN 'greenhouse' THEN 'Greenhouse' WHEN 'lever' THEN 'Lever' WHEN 'workday' THEN 'Workday'
    WHEN 'smartrecruiters' THEN 'SmartRecruiters' WHEN 'workable' THEN 'Workable' ELSE upper(substr(platform_slug, 1, 1)) || lower(substr(platform_slug, 2)) END AS platform,
  CAST(epoch(posting_date) AS BIGINT) AS posted_epoch, CAST(epoch(first_seen_at) AS BIGINT) AS discovered_epoch,
  printf('%.2f', score) AS relevance, CAST(NULL AS VARCHAR) AS match, substr(description, 1, 500) AS embed_description,
  substr(company, 1, 1024) AS company_field, substr(location, 1, 1024) AS location_field
FROM t""", "d_catalog"))
def p14(spark, sf):
    c = academic_terms(derived(spark, sf, "d_catalog")).withColumn("canonical_url", F.col("url"))
    return announcement_rows(c)


@register("j8_with_children", with_views("""
SELECT c.ord, coalesce(array_to_string(list_sort(k.cats), ','), '') AS categories FROM d_catalog c
LEFT JOIN (SELECT ord, list(category) AS cats FROM (
  SELECT ord, unnest(CASE WHEN ord % 4 = 0 THEN ['backend', 'security'] WHEN ord % 4 = 1 THEN ['mobile'] ELSE []::VARCHAR[] END) AS category
  FROM d_catalog) GROUP BY ord) k ON k.ord = c.ord""", "d_catalog"))
def j8(spark, sf):
    cat = derived(spark, sf, "d_catalog")
    kids = cat.select("ord", F.explode(F.when(F.col("ord") % 4 == 0, F.array(F.lit("backend"), F.lit("security")))
                                       .when(F.col("ord") % 4 == 1, F.array(F.lit("mobile")))
                                       .otherwise(F.array().cast("array<string>"))).alias("category"))
    out = R.with_children(cat.select("ord"), kids, "ord", "category", "categories")
    return out.select("ord", F.array_join("categories", ",").alias("categories"))
