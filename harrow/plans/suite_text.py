"""Registered queries: normalization, identity, keywords, scoring."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from harrow.functions.dictionaries import (
    CATEGORY_KEYWORDS,
    INTERNSHIP_INDICATORS,
    NEGATIVE_KEYWORDS,
    SOFTWARE_INDICATORS,
)
from harrow.operators import scoring as S
from harrow.operators import text as T
from harrow.operators.urls import canonicalize_urls
from harrow.plans.fixtures import D_POSTINGS, derived, with_views
from harrow.plans.registry import register
from harrow.plans.suite_reports import d_settings, settings_oracle
from harrow.plans.sqltext import (
    any_hit_sql,
    canonical_cte,
    freshness_sql,
    hay_sql,
    matched_sql,
    normalize_company_sql,
    title_key_sql,
    title_norm_sql,
)
from harrow.session import reliable_checkpoint
from harrow.sources.tables import read_table

POSTINGS_NOW = dt.datetime(1998, 6, 15)
EVENTS_NOW = dt.datetime(2024, 1, 31)


@register("t1_normalize_companies", with_views(f"""
SELECT 'posting' AS src, ord AS id, company AS name, {normalize_company_sql('company')} AS normalized_company FROM d_postings
UNION ALL SELECT 'supplier', s_suppkey, s_name, {normalize_company_sql('s_name')} FROM supplier
UNION ALL SELECT 'customer', c_custkey, c_name, {normalize_company_sql('c_name')} FROM customer""", "d_postings"))
def t1(spark, sf):
    p = derived(spark, sf, "d_postings").select(F.lit("posting").alias("src"), F.col("ord").alias("id"), F.col("company").alias("name"))
    s = read_table(spark, sf, "supplier").select(F.lit("supplier").alias("src"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = read_table(spark, sf, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return T.normalize_companies(p.unionByName(s).unionByName(c), "name")


@register("t2_normalize_titles", with_views(f"""
SELECT 'posting' AS src, ord AS id, title, {title_norm_sql('title')} AS title_norm, {title_key_sql('title')} AS title_key FROM d_postings
UNION ALL SELECT 'part', p_partkey, p_name, {title_norm_sql('p_name')}, {title_key_sql('p_name')} FROM part""", "d_postings"))
def t2(spark, sf):
    p = derived(spark, sf, "d_postings").select(F.lit("posting").alias("src"), F.col("ord").alias("id"), "title")
    q = read_table(spark, sf, "part").select(F.lit("part").alias("src"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return T.normalize_titles(p.unionByName(q))


@register("t3_identity_keys", with_views(f"""
WITH {canonical_cte('d_postings', 'ord, platform_slug, external_job_id, company, title, location, description')},
k AS (SELECT *, {normalize_company_sql('company')} AS nc, {title_key_sql('title')} AS tk FROM canon)
SELECT ord, nc AS normalized_company, tk AS title_key,
  substr(sha256(CASE WHEN nullif(platform_slug, '') IS NOT NULL AND nullif(external_job_id, '') IS NOT NULL
                     THEN platform_slug || ':' || external_job_id
                     WHEN nullif(canonical_url, '') IS NOT NULL THEN canonical_url ELSE nc || '|' || tk END), 1, 32) AS dedup_key,
  substr(sha256(nc || '|' || tk || '|' || trim(lower(coalesce(location, ''))) || '|' || substr(trim(lower(coalesce(description, ''))), 1, 2000)), 1, 32) AS content_hash
FROM k""", "d_postings"))
def t3(spark, sf):
    d = canonicalize_urls(derived(spark, sf, "d_postings"))
    return T.identity_keys(d).select("ord", "normalized_company", "title_key", "dedup_key", "content_hash")


@register("t3b_document_content_hash", """
SELECT doc_id, substr(sha256(trim(lower(coalesce(source, ''))) || '||' || trim(lower(coalesce(lang, ''))) || '|' ||
  substr(trim(lower(coalesce(text, ''))), 1, 2000)), 1, 32) AS content_hash FROM documents""")
def t3b(spark, sf):
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("company"), F.lit(None).cast("string").alias("title"),
        F.col("lang").alias("location"), F.col("text").alias("description"))
    # company normalization on the source label is not part of this check
    d = T.identity_keys(d.withColumn("platform_slug", F.lit(None).cast("string"))
                         .withColumn("external_job_id", F.lit(None).cast("string"))
                         .withColumn("canonical_url", F.lit(None).cast("string")))
    return d.select("doc_id", F.substring(F.sha2(F.concat_ws(
        "|", F.regexp_replace(F.lower(F.coalesce(F.col("company"), F.lit(""))), r"^\s+|\s+$", ""), F.col("title_key"),
        F.regexp_replace(F.lower(F.coalesce(F.col("location"), F.lit(""))), r"^\s+|\s+$", ""),
        F.substring(F.regexp_replace(F.lower(F.coalesce(F.col("description"), F.lit(""))), r"^\s+|\s+$", ""), 1, 2000)),
        256), 1, 32).alias("content_hash"))


@register("t4_jaccard_pairs", """
WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS tokens FROM documents)
SELECT a.doc_id AS left_id, b.doc_id AS right_id, len(a.tokens) AS left_size, len(b.tokens) AS right_size,
  CASE WHEN len(a.tokens) = 0 OR len(b.tokens) = 0 THEN 0.0
       ELSE len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) END AS jaccard
FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""")
def t4(spark, sf):
    d = T.token_sets(read_table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "tokens")
    a = d.select(F.col("doc_id").alias("left_id"), F.col("tokens").alias("lt"))
    b = d.select(F.col("doc_id").alias("right_id"), F.col("tokens").alias("rt"))
    pairs = a.join(b, F.col("right_id") == F.col("left_id") + 1)
    return T.jaccard_pairs(pairs, "lt", "rt").select(
        "left_id", "right_id", F.size("lt").alias("left_size"), F.size("rt").alias("right_size"), "jaccard")


# A tagging dictionary mixing the scoring vocabulary with words of the corpus.
CORPUS_TERMS = ("the", "and", "que", "der", "und", "de la", "of the", "pour", "aux", "ment", "tion")
T5_TERMS = tuple(INTERNSHIP_INDICATORS) + tuple(SOFTWARE_INDICATORS) + tuple(NEGATIVE_KEYWORDS) + CORPUS_TERMS


@register("t5_tag_keywords", f"""
WITH h AS (SELECT doc_id, {hay_sql('text')} AS hay FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct({matched_sql('hay', T5_TERMS)})), ',') AS matched FROM h""")
def t5(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return S.tag_keywords(d, "text", T5_TERMS).select("doc_id", F.array_join("matched", ",").alias("matched"))


_TERM_ROWS = ", ".join("('" + t.replace("'", "''") + "')" for t in (*T5_TERMS, "(the", "de.", ", und"))


@register("t5b_dictionary_join", f"""
WITH h AS (SELECT doc_id, {hay_sql('text')} AS hay FROM documents),
w AS (SELECT DISTINCT term FROM (
  SELECT lower(regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+')) AS term FROM benchmark UNION ALL SELECT * FROM (VALUES {_TERM_ROWS})) WHERE term <> ''),
m AS (SELECT doc_id, term FROM h JOIN w ON contains(hay, term) AND regexp_matches(hay, '(^|[^a-z0-9])\\Q' || term || '\\E($|[^a-z0-9])'))
SELECT h.doc_id, coalesce(string_agg(term, ',' ORDER BY term), '') AS matched FROM h LEFT JOIN m ON m.doc_id = h.doc_id GROUP BY h.doc_id""")
def t5b(spark, sf):
    """The dictionary as a table: the terms of t5, some with marks, and the first two words of every benchmark passage."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    words = read_table(spark, sf, "benchmark").select(F.lower(F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0)).alias("term")).filter("term <> ''")
    own = spark.createDataFrame([(t,) for t in (*T5_TERMS, "(the", "de.", ", und")], "term string")
    return S.tag_keywords_by_table(d, "text", words.unionByName(own)).select("doc_id", F.array_join("matched", ",").alias("matched"))


@register("t7_freshness", f"SELECT event_id, {freshness_sql('ts', '2024-01-31 00:00:00')} AS freshness FROM events")
def t7(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "ts")
    return S.freshness(e, "ts", EVENTS_NOW).select("event_id", "freshness")


def _score_oracle(src: str, now: str, min_score: float = 0.55, params: bool = False) -> str:
    """T8 in SQL.  With ``params`` the source also carries per-row lists
    (locations, academic_terms, negative_keywords) and a min_score column."""
    cats = ", ".join(f"CASE WHEN {any_hit_sql('hay', kws)} THEN '{c}' END" for c, kws in CATEGORY_KEYWORDS)
    if params:
        extra_cols = ", locations, academic_terms, negative_keywords, min_score AS min_s"
        terms = ("list_filter(list_transform(academic_terms, lambda t: lower(t)), lambda t: "
                 "contains(lower(concat_ws(' ', nullif(title, ''), nullif(description, ''))), t))")
        locs = ("list_filter(list_transform(locations, lambda t: lower(t)), lambda t: "
                "contains(lower(concat_ws(' ', nullif(location, ''), nullif(title, ''), nullif(description, ''))), t))")
        extra_neg = ("list_filter(list_transform(negative_keywords, lambda k: lower(k)), lambda k: "
                     "regexp_matches(hay, '(^|[^a-z0-9])\\Q' || k || '\\E($|[^a-z0-9])'))")
        min_expr = "min_s"
    else:
        extra_cols = ""
        terms = locs = extra_neg = "[]::VARCHAR[]"
        min_expr = str(min_score)
    return f"""
WITH b AS (SELECT ord, title, location, description, platform_slug, posting_date, coalesce(is_expired, false) AS expired{extra_cols},
    {hay_sql("concat_ws(' ', nullif(title, ''), nullif(company, ''), nullif(location, ''), nullif(description, ''))")} AS hay,
    {hay_sql('title')} AS thay FROM {src}),
k AS (SELECT *, {matched_sql('hay', INTERNSHIP_INDICATORS)} AS ints, {matched_sql('hay', SOFTWARE_INDICATORS)} AS sws,
    list_concat({matched_sql('hay', NEGATIVE_KEYWORDS)}, {extra_neg}) AS negs,
    {terms} AS terms, {locs} AS locs,
    nullif(title, '') IS NOT NULL AND {any_hit_sql('thay', SOFTWARE_INDICATORS)} AND {any_hit_sql('thay', INTERNSHIP_INDICATORS)} AS title_hit,
    {freshness_sql('posting_date', now)} * 0.1 AS fresh,
    nullif(platform_slug, '') IS NOT NULL AND platform_slug NOT IN ('company', 'generic') AS ats FROM b),
f AS (SELECT *, len(ints) > 0 AS is_int, len(sws) > 0 AS is_sw, len(negs) > 0 AS has_neg, len(terms) > 0 AS has_term,
    len(locs) > 0 AS has_loc FROM k),
s AS (SELECT *, ((((((0.0::DOUBLE + CASE WHEN is_int THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN is_sw THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END)
      + CASE WHEN title_hit THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN has_term THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)
      + CASE WHEN has_loc THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN ats THEN 0.07::DOUBLE ELSE 0.0::DOUBLE END) + fresh AS raw,
      is_int AND is_sw AND NOT has_neg AS gate FROM f),
t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (raw / 1.0::DOUBLE) - CASE WHEN has_neg THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END)) AS sc FROM s)
SELECT ord,
  CASE WHEN expired THEN 0.0::DOUBLE ELSE round(sc, 4) END AS score,
  CASE WHEN expired THEN false ELSE gate AND sc >= {min_expr} END AS is_relevant,
  is_int AS is_internship, is_sw AS is_software, gate AS passes_gate,
  CASE WHEN expired THEN '' ELSE array_to_string(list_sort(list_distinct(list_concat(ints, sws, terms, locs))), ',') END AS matched_keywords,
  array_to_string(list_sort(list_distinct(negs)), ',') AS negatives,
  CASE WHEN expired OR NOT gate THEN '' ELSE coalesce(nullif(array_to_string(list_filter([{cats}]::VARCHAR[], lambda x: x IS NOT NULL), ','), ''), 'software') END AS categories,
  CASE WHEN expired THEN 'expired' ELSE concat_ws('; ', CASE WHEN NOT is_int THEN 'no internship indicator' END,
      CASE WHEN NOT is_sw THEN 'no software indicator' END, CASE WHEN title_hit THEN 'software internship in title' END,
      CASE WHEN has_neg THEN 'negative keywords: ' || array_to_string(list_sort(list_distinct(negs)), ', ') END) END AS reasons,
  CASE WHEN NOT expired AND is_int THEN 0.25::DOUBLE END AS bd_internship,
  CASE WHEN NOT expired AND is_sw THEN 0.25::DOUBLE END AS bd_software,
  CASE WHEN NOT expired AND title_hit THEN 0.15::DOUBLE END AS bd_title,
  CASE WHEN NOT expired AND ats THEN 0.07::DOUBLE END AS bd_ats,
  CASE WHEN NOT expired THEN round(fresh, 4) END AS bd_freshness,
  CASE WHEN NOT expired AND has_neg THEN -0.6::DOUBLE END AS bd_negative_penalty{", CASE WHEN NOT expired AND has_term THEN 0.1::DOUBLE END AS bd_term, CASE WHEN NOT expired AND has_loc THEN 0.08::DOUBLE END AS bd_location" if params else ""}
FROM t"""


def score_view(scored, extra_keys=()):
    bd = F.col("breakdown")
    return scored.select(
        "ord", "score", "is_relevant", "is_internship", "is_software", "passes_gate",
        F.array_join("matched_keywords", ",").alias("matched_keywords"),
        F.array_join("negatives", ",").alias("negatives"),
        F.array_join("categories", ",").alias("categories"),
        F.array_join("reasons", "; ").alias("reasons"),
        *[F.try_element_at(bd, F.lit(k)).alias("bd_" + k)
          for k in ("internship", "software", "title", "ats", "freshness", "negative_penalty") + tuple(extra_keys)],
    )


@register("t8_score_postings", with_views(_score_oracle("d_postings", "1998-06-15 00:00:00"), "d_postings"))
def t8(spark, sf):
    return score_view(S.score_postings(derived(spark, sf, "d_postings"), POSTINGS_NOW))


@register("t6_tag_categories", with_views(
    "SELECT ord, unnest(string_split(categories, ',')) AS category FROM ("
    + _score_oracle("d_postings", "1998-06-15 00:00:00") + ") WHERE categories <> ''", "d_postings"))
def t6(spark, sf):
    return S.tag_categories(S.score_postings(derived(spark, sf, "d_postings"), POSTINGS_NOW))


@register("t9_gate", with_views(
    "SELECT ord, score FROM (" + _score_oracle("d_postings", "1998-06-15 00:00:00") + ") WHERE passes_gate", "d_postings"))
def t9(spark, sf):
    # scored once and written, so the gate is no second evaluation of the keyword patterns
    return S.gate(reliable_checkpoint(S.score_postings(derived(spark, sf, "d_postings"), POSTINGS_NOW).select("ord", "score", "passes_gate"))).select(
        "ord", "score")


@register("t10_score_params", settings_oracle(
    "SELECT * FROM (" + _score_oracle("(SELECT p.*, coalesce(s.locations, []::VARCHAR[]) AS locations, "
                                      "coalesce(s.academic_terms, []::VARCHAR[]) AS academic_terms, "
                                      "coalesce(s.negative_keywords, []::VARCHAR[]) AS negative_keywords, "
                                      "coalesce(s.min_score, 0.55) AS min_score "
                                      "FROM d_postings p LEFT JOIN d_settings s ON s.guild_id = p.ord % 20)",
                                      "1998-06-15 00:00:00", params=True) + ")").replace(
    "WITH d_settings_log AS", "WITH d_postings AS (" + D_POSTINGS
    + "),\nd_settings_log AS", 1))
def t10(spark, sf):
    posts = derived(spark, sf, "d_postings").withColumn("guild_id", F.col("ord") % 20)
    return score_view(S.score_params(posts, d_settings(spark, sf), POSTINGS_NOW), ("term", "location"))
