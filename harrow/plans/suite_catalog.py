"""Registered queries: batch acceptance, catalog maintenance, expiry."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from harrow.functions.dictionaries import EXPIRED_PHRASES
from harrow.operators import catalog as M
from harrow.operators import dedup as D
from harrow.operators import expiry as X
from harrow.operators import reports as R
from harrow.operators import scoring as S
from harrow.plans.fixtures import derived, with_views
from harrow.plans.registry import register
from harrow.plans.sqltext import normalize_company_sql
from harrow.plans.suite_dedup import keyed_postings
from harrow.plans.suite_pages import _LD_BLOCK, landed_job_pages
from harrow.session import reliable_checkpoint
from harrow.sources.tables import read_table

POSTINGS_NOW = dt.datetime(1998, 6, 15)
PAGES_NOW = dt.datetime(2024, 1, 31)


def scored_batch(spark, sf):
    return S.score_postings(keyed_postings(spark, sf), POSTINGS_NOW)


def _j3_sql(old: str | None = None, then: str = " SELECT * FROM j3") -> str:
    """Acceptance in rounds over all match pairs; rows that fulfil ``old`` are the catalog, before all others."""
    from harrow.plans.suite_dedup import matches_sql
    from harrow.plans.suite_text import _score_oracle
    is_old = {x: f"({old.replace('ord', x + '.ord')})" if old else "false" for x in "nbc"}
    place = f"CASE WHEN {is_old['c']} THEN c.ord - 1000000000000 ELSE c.ord END"
    return with_views(matches_sql(f"NOT {is_old['n']} AND ({is_old['c']} OR c.ord < n.ord)") + f""",
sc AS ({_score_oracle('d_postings', '1998-06-15 00:00:00')}),
p AS MATERIALIZED (SELECT new_ord, cand_ord, min(rule) AS rule FROM r WHERE rule IS NOT NULL GROUP BY new_ord, cand_ord),
st AS (
  SELECT 0 AS round, b.ord, sc.passes_gate AS gate, CASE WHEN {is_old['b']} THEN 'A' ELSE 'U' END AS s FROM base b JOIN sc ON sc.ord = b.ord
  UNION ALL
  SELECT st.round + 1, st.ord, st.gate, CASE WHEN st.s <> 'U' THEN st.s WHEN x.hit THEN 'D' WHEN x.waits THEN 'U' WHEN st.gate THEN 'A' ELSE 'R' END
  FROM st LEFT JOIN (SELECT p.new_ord, bool_or(c.s = 'A') AS hit, bool_or(c.s = 'U' AND c.gate) AS waits
    FROM p JOIN st c ON c.ord = p.cand_ord GROUP BY p.new_ord) x ON x.new_ord = st.ord
  WHERE (SELECT count(*) FROM st WHERE s = 'U') > 0),
done AS MATERIALIZED (SELECT ord, s FROM st WHERE round = (SELECT max(round) FROM st)),
hit AS (SELECT p.new_ord, arg_min(c.ord, {place}) AS t, arg_min(p.rule, {place}) AS rule
  FROM p JOIN done c ON c.ord = p.cand_ord AND c.s = 'A' GROUP BY p.new_ord),
j3 AS (SELECT b.ord, b.s = 'A' AS accepted, b.s = 'D' AS is_duplicate, hit.t AS target_ord, {is_old['c'].replace('c.ord', 'hit.t')} AND hit.t IS NOT NULL AS in_catalog,
  (['dedup_key', 'platform_job_id', 'canonical_url', 'content_hash', 'company_title', 'fuzzy_title_desc', 'fuzzy_title'])[hit.rule] AS reason
FROM done b LEFT JOIN hit ON hit.new_ord = b.ord AND b.s = 'D' WHERE NOT {is_old['b']}){then}""", "d_postings").replace("WITH ", "WITH RECURSIVE ", 1)


@register("j3_dedup_batch", _j3_sql())
def j3(spark, sf):
    return D.dedup_batch(scored_batch(spark, sf)).withColumn("in_catalog", F.coalesce("target_in_catalog", F.lit(False))).drop("target_in_catalog")


_OLD = "ord % 3 = 0"


@register("j3b_dedup_catalog", _j3_sql(_OLD))
def j3b(spark, sf):
    """Every third posting is in the catalog, the others are a batch."""
    scored = reliable_checkpoint(scored_batch(spark, sf).select(*D.DEDUP_COLUMNS, "passes_gate"))
    found = D.dedup_batch(scored.filter(f"NOT ({_OLD})"), catalog=scored.filter(_OLD))
    return found.withColumn("in_catalog", F.coalesce("target_in_catalog", F.lit(False))).drop("target_in_catalog")


_PHRASE_SQL = "CASE " + " ".join(
    f"WHEN contains(lower(html), '{p}') THEN 'phrase:{p}'" for p in EXPIRED_PHRASES) + " END"

_BTN_SQL = """(len(list_filter(list_transform(regexp_extract_all(html, '(?is)<button\\b[^>]*>.*?</button\\s*>|<a\\b[^>]*>.*?</a\\s*>'),
    lambda e: {'t': lower(trim(regexp_replace(regexp_replace(e, '(?is)^<[a-z]+\\b[^>]*>|</[a-z]+\\s*>$', '', 'g'), '<[^>]+>', '', 'g'))),
               'a': regexp_extract(e, '(?is)^<[a-z]+\\b([^>]*)>', 1)}), lambda x: contains(x.t, 'apply'))) > 0
  AND len(list_filter(list_transform(regexp_extract_all(html, '(?is)<button\\b[^>]*>.*?</button\\s*>|<a\\b[^>]*>.*?</a\\s*>'),
    lambda e: {'t': lower(trim(regexp_replace(regexp_replace(e, '(?is)^<[a-z]+\\b[^>]*>|</[a-z]+\\s*>$', '', 'g'), '<[^>]+>', '', 'g'))),
               'a': regexp_extract(e, '(?is)^<[a-z]+\\b([^>]*)>', 1)}),
    lambda x: contains(x.t, 'apply') AND NOT regexp_matches(x.a, '(?i)(^|\\s)(disabled|aria-disabled)(\\s*=|\\s|/|$)'))) = 0)"""


@register("f1_expired_phrases", with_views(f"""
SELECT 'page' AS src, page_id AS id, {_PHRASE_SQL} AS expired_reason FROM pages
UNION ALL SELECT 'job_page', ord, {_PHRASE_SQL} FROM d_job_pages""", "d_job_pages"))
def f1(spark, sf):
    p = read_table(spark, sf, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), "html")
    j = derived(spark, sf, "d_job_pages").select(F.lit("job_page").alias("src"), F.col("ord").alias("id"), "html")
    return X.expired_phrases(p.unionByName(j)).drop("html")


@register("f2_disabled_apply", with_views(f"""
SELECT 'page' AS src, page_id AS id, {_BTN_SQL} AS apply_disabled FROM pages
UNION ALL SELECT 'job_page', ord, {_BTN_SQL} FROM d_job_pages""", "d_job_pages"))
def f2(spark, sf):
    p = read_table(spark, sf, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), "html")
    j = derived(spark, sf, "d_job_pages").select(F.lit("job_page").alias("src"), F.col("ord").alias("id"), "html")
    return X.disabled_apply(p.unionByName(j)).drop("html")


_F3_SQL = f"""
x AS (SELECT ord, url, status_code, html, CAST(try_strptime(json_extract_string({_LD_BLOCK}, '$.validThrough'), '%Y-%m-%d') AS TIMESTAMP) AS vt FROM pg),
y AS (SELECT *, vt IS NOT NULL AND vt < TIMESTAMP '2024-01-31 00:00:00' AS past, {_PHRASE_SQL} AS phrase, {_BTN_SQL} AS btn FROM x),
ev AS (SELECT ord, url, status_code IN (404, 410) OR (status_code < 500 AND (past OR phrase IS NOT NULL OR btn)) AS is_expired,
  CASE WHEN status_code IN (404, 410) OR status_code >= 500 THEN 'http_' || CAST(status_code AS VARCHAR)
       WHEN past THEN 'validThrough_past' WHEN phrase IS NOT NULL THEN phrase WHEN btn THEN 'apply_button_disabled' END AS reason,
  CASE WHEN status_code NOT IN (404, 410) AND status_code < 500 AND past THEN vt END AS expires_at FROM y)"""


@register("f3_evaluate_expiry", with_views("WITH pg AS (SELECT * FROM d_job_pages), " + _F3_SQL +
                                           " SELECT ord, is_expired, reason, expires_at FROM ev", "d_job_pages"))
def f3(spark, sf):
    return X.evaluate_expiry(derived(spark, sf, "d_job_pages"), PAGES_NOW).select("ord", "is_expired", "reason", "expires_at")


@register("m7_mark_expired", with_views(
    "WITH pg AS (SELECT * FROM d_job_pages WHERE ord % 10 <> 9 QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1), "
    + _F3_SQL + """
SELECT c.ord, CASE WHEN c.status = 'active' AND coalesce(ev.is_expired, false) THEN 'expired' ELSE c.status END AS status,
  CASE WHEN c.status = 'active' THEN TIMESTAMP '2024-01-31 00:00:00' ELSE c.last_checked_at END AS last_checked_at,
  CASE WHEN c.status = 'active' THEN coalesce(ev.reason, CASE WHEN ev.url IS NULL THEN 'unfetchable' END) END AS check_reason
FROM d_catalog c LEFT JOIN ev ON ev.url = c.url""", "d_catalog", "d_job_pages"))
def m7(spark, sf):
    cat = derived(spark, sf, "d_catalog").select("ord", "url", "status", "last_checked_at")
    pages = landed_job_pages(spark, sf)
    return X.mark_expired(cat, pages, PAGES_NOW, order="ord").select("ord", "status", "last_checked_at", "check_reason")


_TOUCH_SQL = """t AS (SELECT user_id AS job_id, event_id AS ord, event_type AS content_hash,
  CASE WHEN value >= 25 THEN 'title-' || CAST(event_id AS VARCHAR) ELSE '' END AS title,
  CASE WHEN value < 10 THEN 'desc-' || CAST(event_id AS VARCHAR) ELSE '' END AS description FROM events),
a AS (SELECT *, lag(content_hash) OVER (PARTITION BY job_id ORDER BY ord) AS prev, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS rn FROM t),
b AS (SELECT *, rn > 1 AND content_hash <> prev AS changed FROM a),
c AS (SELECT *,
  last_value(CASE WHEN rn = 1 THEN coalesce(nullif(title, ''), '(untitled)') WHEN changed THEN nullif(title, '') END IGNORE NULLS)
    OVER (PARTITION BY job_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur_title,
  last_value(CASE WHEN rn = 1 THEN description WHEN changed THEN nullif(description, '') END IGNORE NULLS)
    OVER (PARTITION BY job_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur_description FROM b),
d AS (SELECT *, lag(cur_title) OVER (PARTITION BY job_id ORDER BY ord) AS prev_title,
  lag(cur_description) OVER (PARTITION BY job_id ORDER BY ord) AS prev_description FROM c)"""


def touches(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("content_hash"),
                    F.when(F.col("value") >= 25, F.concat(F.lit("title-"), F.col("event_id").cast("string"))).otherwise(F.lit("")).alias("title"),
                    F.when(F.col("value") < 10, F.concat(F.lit("desc-"), F.col("event_id").cast("string"))).otherwise(F.lit("")).alias("description"))


@register("w6_version_chain", "WITH " + _TOUCH_SQL + """
SELECT job_id, ord, prev AS content_hash, prev_title AS title, prev_description AS description FROM d WHERE changed""")
def w6(spark, sf):
    versions, _ = M.version_chain(touches(spark, sf))
    return versions


@register("m2_merge_touch", "WITH " + _TOUCH_SQL + """,
f AS (SELECT job_id, arg_max(content_hash, ord) AS content_hash, arg_max(cur_title, ord) AS title,
  arg_max(cur_description, ord) AS description FROM d GROUP BY job_id),
seen AS (SELECT user_id AS job_id, max(ts) AS last_seen_at FROM events GROUP BY user_id)
SELECT c_custkey AS job_id, c_name AS company, coalesce(f.content_hash, c_mktsegment) AS content_hash, coalesce(f.title, 'old') AS title,
  coalesce(f.description, 'old') AS description, greatest(seen.last_seen_at, TIMESTAMP '2000-01-01') AS last_seen_at
FROM customer LEFT JOIN f ON f.job_id = c_custkey LEFT JOIN seen ON seen.job_id = c_custkey""")
def m2(spark, sf):
    """Customers as catalog rows; some are touched by events, the others stay as they are."""
    _, final = M.version_chain(touches(spark, sf))
    seen = read_table(spark, sf, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("last_seen_at"))
    catalog = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("job_id"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("content_hash"),
        F.lit("old").alias("title"), F.lit("old").alias("description"), F.lit("2000-01-01").cast("timestamp").alias("last_seen_at"))
    return M.merge_touch(catalog, final.join(seen, "job_id"), key="job_id")


@register("w6b_touch_count", "WITH " + _TOUCH_SQL + """
SELECT job_id, count(*) FILTER (WHERE changed) AS versions, count(*) AS touches FROM d GROUP BY job_id""")
def w6b(spark, sf):
    versions, _ = M.version_chain(touches(spark, sf))
    v = versions.groupBy("job_id").agg(F.count(F.lit(1)).alias("versions"))
    t = touches(spark, sf).groupBy("job_id").agg(F.count(F.lit(1)).alias("touches"))
    return t.join(v, "job_id", "left").select("job_id", F.coalesce("versions", F.lit(0)).cast("bigint").alias("versions"), "touches")


def _gated_sql():
    from harrow.plans.suite_dedup import _KEYED
    from harrow.plans.suite_text import _score_oracle
    return f"""WITH {_KEYED}, sc AS ({_score_oracle('d_postings', '1998-06-15 00:00:00')}),
g AS (SELECT base.ord, base.dk AS dedup_key, base.canonical_url, p.url, p.title, p.company, p.platform_slug, sc.score, p.is_expired, sc.categories
  FROM base JOIN sc ON sc.ord = base.ord JOIN d_postings p ON p.ord = base.ord WHERE sc.passes_gate)"""


def gated_batch(spark, sf, *columns):
    """The gated postings, scored once."""
    scored = scored_batch(spark, sf).select("ord", "dedup_key", "platform_slug", "passes_gate", *columns)
    return S.gate(reliable_checkpoint(scored))


_IN_CATALOG = "platform_slug = 'company' AND ord % 2 = 0"


@register("m1_merge_new", with_views(_gated_sql() + f""",
cat AS (SELECT * FROM g WHERE {_IN_CATALOG} QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY ord) = 1),
new AS (SELECT * FROM g WHERE dedup_key NOT IN (SELECT dedup_key FROM cat) QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY ord) = 1)
SELECT ord, dedup_key, canonical_url, url, title, company, score, 'active' AS status FROM cat UNION ALL
SELECT ord, dedup_key, coalesce(nullif(canonical_url, ''), url), url, coalesce(nullif(title, ''), '(untitled)'), company, score,
  CASE WHEN coalesce(is_expired, false) THEN 'expired' ELSE 'active' END FROM new""", "d_postings"))
def m1(spark, sf):
    """Half of the company-site postings are in the catalog; the batch repeats them and adds the rest."""
    cols = ["canonical_url", "url", "title", "company", "score"]
    batch = gated_batch(spark, sf, *cols, "is_expired")
    old = batch.filter(_IN_CATALOG).groupBy("dedup_key").agg(F.min_by(F.struct("ord", *cols), "ord").alias("x"))
    catalog = old.select("dedup_key", "x.*").withColumn("status", F.lit("active"))
    return M.merge_new(catalog, batch.select("ord", "dedup_key", *cols, "is_expired"))


_SOURCES = """SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS job_key, url AS raw_url,
  arg_min(query_hash, ord) AS query_hash, arg_min(provider, ord) AS provider, min(ord) AS first_ord FROM d_hits"""


@register("m3_merge_sources", with_views(f"""
WITH old AS ({_SOURCES} WHERE ord % 3 = 1 GROUP BY ALL), new AS ({_SOURCES} GROUP BY ALL)
SELECT * FROM old UNION ALL SELECT new.* FROM new ANTI JOIN old ON new.job_key = old.job_key AND new.raw_url = old.raw_url""", "d_hits"))
def m3(spark, sf):
    """A third of the hits have been merged before."""
    from harrow.functions.urls import url_host

    h = derived(spark, sf, "d_hits")
    hits = h.select(url_host(F.col("url")).alias("job_key"), F.col("url").alias("raw_url"), "query_hash", "provider", "ord")
    empty = spark.createDataFrame([], "job_key string, raw_url string, query_hash string, provider string, first_ord bigint")
    return M.merge_sources(M.merge_sources(empty, hits.filter("ord % 3 = 1")), hits)


@register("m5_merge_saved", """
SELECT user_id, 1 + event_id % 2000 AS job_id, min(ts) AS created_at FROM events GROUP BY ALL""")
def m5(spark, sf):
    saves = read_table(spark, sf, "events").select("user_id", (1 + F.col("event_id") % 2000).alias("job_id"),
                                                    F.col("ts").alias("created_at"))
    empty = spark.createDataFrame([], "user_id bigint, job_id bigint, created_at timestamp")
    once = M.merge_saved(empty, saves)
    return M.merge_saved(once, saves)


@register("s7_outbox", with_views("""
WITH p AS (SELECT ord FROM d_catalog WHERE NOT posted AND status = 'active' AND score >= 0.55 ORDER BY score DESC, ord LIMIT 25)
SELECT c.ord, c.posted OR p.ord IS NOT NULL AS posted, CASE WHEN p.ord IS NOT NULL THEN TIMESTAMP '1998-06-15 00:00:00' END AS posted_at
FROM d_catalog c LEFT JOIN p ON p.ord = c.ord""", "d_catalog"))
def s7(spark, sf):
    cat = derived(spark, sf, "d_catalog")
    sent = R.pending(cat, 0.55)
    return M.outbox(sent, cat.select("ord", "posted", "score", "status"), POSTINGS_NOW).select("ord", "posted", "posted_at")


@register("s7b_announce_once", with_views("""
WITH p AS (SELECT ord % 5 AS guild_id, ord FROM d_catalog WHERE NOT posted AND status = 'active' AND score >= 0.55)
SELECT guild_id, ord, CASE WHEN ord % 2 = 0 THEN 1 ELSE 2 END AS run FROM p""", "d_catalog"))
def s7b(spark, sf):
    """Two runs, each retried after its commit: the first announces half of the pending rows, the second finds all pending."""
    import uuid

    from harrow.operators.store import Store
    from harrow.session import checkpoint_dir
    store = Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/s7-{uuid.uuid4().hex}", M.OUTBOX, 4)
    rows = derived(spark, sf, "d_catalog").filter("NOT posted AND status = 'active' AND score >= 0.55").select(
        (F.col("ord") % 5).alias("guild_id"), "ord")
    M.announce(store, rows.filter("ord % 2 = 0"), "1")
    first = M.announce(store, rows, "1")
    M.announce(store, rows, "2")
    second = M.announce(store, rows, "2")
    return first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))


_M6_EVENTS = """,
e AS (SELECT j.ord, coalesce(t.dk, b.dk) AS dedup_key, b.ch AS content_hash, p.title, p.description, p.url AS raw_url, j.accepted
  FROM j3 j JOIN base b ON b.ord = j.ord JOIN d_postings p ON p.ord = j.ord LEFT JOIN base t ON t.ord = j.target_ord
  WHERE j.accepted OR j.is_duplicate),
e1 AS (SELECT *, lag(content_hash) OVER w AS prev FROM e WINDOW w AS (PARTITION BY dedup_key ORDER BY ord)),
e2 AS (SELECT *, NOT accepted AND content_hash <> prev AS changed,
  last_value(CASE WHEN accepted THEN coalesce(nullif(title, ''), '(untitled)') WHEN content_hash <> prev THEN nullif(title, '') END IGNORE NULLS) OVER w AS cur_title,
  last_value(CASE WHEN accepted THEN description WHEN content_hash <> prev THEN nullif(description, '') END IGNORE NULLS) OVER w AS cur_description
  FROM e1 WINDOW w AS (PARTITION BY dedup_key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e3 AS (SELECT *, lag(cur_title) OVER w AS prev_title, lag(cur_description) OVER w AS prev_description
  FROM e2 WINDOW w AS (PARTITION BY dedup_key ORDER BY ord)),
f AS (SELECT dedup_key, arg_max(content_hash, ord) AS content_hash, arg_max(cur_title, ord) AS title,
  arg_max({'d': cur_description}, ord).d AS description FROM e3 GROUP BY dedup_key)"""

_TERM = "CASE " + " ".join(f"WHEN contains({x}, '2027') AND contains(lower({x}), '{t.lower()}') THEN '{t}'" for x in ("p.title", "p.description")
                           for t in ("Summer 2027", "Winter 2027", "Fall 2027", "Spring 2027")) + " END"
_STREAMED: dict[tuple[str, str], str] = {}


def streamed(spark, sf):
    """The store after the scan stream over postings that land in two parts, the second with a compaction; run once a session."""
    import uuid

    from harrow.session import checkpoint_dir
    from harrow.streaming.catalog_stream import catalog_store, stream_catalog
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STREAMED:
        root = f"{checkpoint_dir(spark).rstrip('/')}/m6-{uuid.uuid4().hex}"
        posts = derived(spark, sf, "d_postings")
        mid = posts.agg(F.percentile_approx("ord", 0.5)).first()[0]
        for name, part in (("a", F.col("ord") <= mid), ("b", F.col("ord") > mid)):
            posts.filter(part).write.parquet(f"{root}/landed/{name}")
            stream_catalog(spark, f"{root}/landed/*", posts.schema, root, POSTINGS_NOW, buckets=8)
        _STREAMED[key] = f"{root}/catalog"
    return catalog_store(spark, _STREAMED[key], 8)


@register("m6_stream_catalog", _j3_sql(then=_M6_EVENTS + f"""
SELECT f.dedup_key, j.ord, coalesce(nullif(b.canonical_url, ''), p.url) AS canonical_url, p.url, f.title, p.company, b.nc AS normalized_company,
  p.platform_slug, p.external_job_id, f.content_hash, f.description, p.location, s.score, CASE WHEN p.is_expired THEN 'expired' ELSE 'active' END AS status,
  {_TERM} AS internship_term, CAST(p.posting_date AS TIMESTAMP) AS posted_at, s.matched_keywords,
  TIMESTAMP '1998-06-15 00:00:00' AS last_seen_at
FROM j3 j JOIN base b ON b.ord = j.ord JOIN d_postings p ON p.ord = j.ord JOIN f ON f.dedup_key = b.dk JOIN sc s ON s.ord = j.ord
WHERE j.accepted"""))
def m6(spark, sf):
    """The catalog after the stream."""
    return streamed(spark, sf).rows("catalog").drop("remote_status", "employment_type", "salary", "breakdown", "first_seen_at").withColumn(
        "matched_keywords", F.array_join("matched_keywords", ","))


@register("m6b_stream_versions", _j3_sql(then=_M6_EVENTS + """
SELECT dedup_key, ord, prev AS content_hash, prev_title AS title, prev_description AS description FROM e3 WHERE changed"""))
def m6b(spark, sf):
    return streamed(spark, sf).rows("versions")


@register("m6c_stream_sources", _j3_sql(then=_M6_EVENTS + """
SELECT dedup_key, raw_url, min(ord) AS first_ord FROM e GROUP BY dedup_key, raw_url"""))
def m6c(spark, sf):
    return streamed(spark, sf).rows("sources").select("dedup_key", "raw_url", "first_ord")


@register("m6d_stream_categories", _j3_sql(then="""
SELECT DISTINCT b.dk AS dedup_key, unnest(string_split(sc.categories, ',')) AS category FROM j3 j JOIN base b ON b.ord = j.ord JOIN sc ON sc.ord = j.ord
WHERE j.accepted AND sc.categories <> ''"""))
def m6d(spark, sf):
    return streamed(spark, sf).rows("categories")


@register("s5_join_pages", with_views("""
WITH pg AS (SELECT * FROM d_job_pages WHERE ord % 10 <> 9 QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1)
SELECT h.ord, h.url, pg.url IS NOT NULL AS has_page, pg.final_url, pg.status_code
FROM d_postings h LEFT JOIN pg ON pg.url = h.url""", "d_postings", "d_job_pages"))
def s5(spark, sf):
    from harrow.sources.pages import join_pages
    hits = derived(spark, sf, "d_postings").select("ord", "url")
    return join_pages(hits, landed_job_pages(spark, sf), order="ord").select("ord", "url", "has_page", "final_url", "status_code")


@register("s6_snapshot_roundtrip", with_views(
    "SELECT ord, dedup_key, status, score FROM (SELECT ord, substr(sha256(url), 1, 32) AS dedup_key, status, score FROM d_catalog)",
    "d_catalog"))
def s6(spark, sf):
    import uuid

    from harrow.session import checkpoint_dir
    root = f"{checkpoint_dir(spark).rstrip('/')}/s6-{uuid.uuid4().hex}"
    cat = derived(spark, sf, "d_catalog").select("ord", F.substring(F.sha2(F.col("url"), 256), 1, 32).alias("dedup_key"),
                                                 "status", "score")
    M.write_snapshot(cat, root, "catalog", partition_by="status")
    return M.read_snapshot(spark, root, "catalog").select("ord", "dedup_key", "status", "score")


@register("m4_merge_categories", with_views(_gated_sql() + """
SELECT DISTINCT dedup_key, unnest(string_split(categories, ',')) AS category FROM g WHERE categories <> ''
UNION ALL SELECT 'gone', 'backend'""", "d_postings"))
def m4(spark, sf):
    """Categories of every second posting, and one of a job that is gone, are there already."""
    scored = gated_batch(spark, sf, "categories")
    gone = spark.createDataFrame([("gone", "backend")], "dedup_key string, category string")
    return M.merge_categories(M.merge_categories(gone, scored.filter("ord % 2 = 0")), scored)


@register("m5b_merge_ignored", with_views(f"""
WITH h AS (SELECT user_id % 20 AS guild_id, 1 + event_id AS ord FROM events WHERE event_type = 'click'),
c AS (SELECT ord, {normalize_company_sql('company')} AS normalized_company FROM d_catalog)
SELECT DISTINCT h.guild_id, c.normalized_company FROM h JOIN c ON c.ord = h.ord WHERE c.normalized_company <> ''""", "d_catalog"))
def m5b(spark, sf):
    from harrow.functions.text import normalize_company
    hides = read_table(spark, sf, "events").filter(F.col("event_type") == "click") \
        .select((F.col("user_id") % 20).alias("guild_id"), (1 + F.col("event_id")).alias("ord"))
    cat = derived(spark, sf, "d_catalog").select("ord", "company", normalize_company(F.col("company")).alias("normalized_company"))
    empty = spark.createDataFrame([], "guild_id bigint, normalized_company string")
    return M.merge_ignored(M.merge_ignored(empty, hides, cat), hides, cat)
