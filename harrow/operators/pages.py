"""Page and posting extraction jobs.

HTML is the widest column by far, so every page-level rule (text, JSON-LD,
meta tags, expiry phrases, apply buttons) is computed in one projection over
the pages and the html column is dropped before any shuffle.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from harrow.functions.dictionaries import (
    COLOR_HIGH,
    COLOR_HIGH_MIN_SCORE,
    COLOR_NORMAL,
    EXPIRED_PHRASES,
    PLATFORMS,
    SNIPPET_HIT,
    SNIPPET_OG,
    TERM_CANDIDATES,
    TERM_YEAR,
)
from harrow.functions.text import (
    cut_snippet,
    html_to_text,
    nullif_blank,
    python_title,
    snippet,
    unescape_html,
)
from harrow.functions.urls import URL_RX, url_host, with_canonical_url
from harrow.operators.urls import host_platform_slug

URL_PATH_SLUGS = ("ashby", "greenhouse", "lever", "smartrecruiters", "workable")
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


# --------------------------------------------------------------------------- P6
def _rx(url: Column, pattern: str) -> Column:
    return nullif_blank(F.regexp_extract(url, pattern, 1))


def external_id_from_url(url: Column, slug: Column) -> Column:
    """Per-platform job id found in a URL; the generic 4+ digit rule otherwise."""
    base = _rx(url, r"(?U)/(\d{4,})(?:[/?#]|$)")
    query = F.regexp_extract(url, URL_RX, 4)
    gh_pairs = F.filter(F.split(query, "&"), lambda p: p.startswith("gh_jid="))
    gh_value = F.substring(F.try_element_at(gh_pairs, F.lit(1)), 8, 1 << 30)
    greenhouse = (
        F.when(_rx(url, r"(?U)/jobs/(\d+)").isNotNull(), _rx(url, r"(?U)/jobs/(\d+)"))
        .when(F.size(gh_pairs) > 0, nullif_blank(gh_value))
        .otherwise(base)
    )
    workday = F.upper(_rx(url, r"(?iU)_((?:R|JR|REQ)[-_]?\d+)"))
    return (
        F.when(slug.isin("ashby", "lever"), F.coalesce(_rx(url, "/[^/]+/(" + UUID + ")"), base))
        .when(slug == "greenhouse", greenhouse)
        .when(slug == "workday", F.coalesce(F.replace(workday, F.lit("_"), F.lit("-")), base))
        .when(slug == "smartrecruiters", F.coalesce(_rx(url, r"(?U)/[^/]+/(\d{6,})"), base))
        .when(slug == "workable", F.coalesce(F.upper(_rx(url, r"(?iU)/j/([0-9A-F]{6,})")), base))
        .otherwise(base)
    )


def external_ids(df: DataFrame, url: str = "url", slug: str = "platform_slug",
                 out: str = "url_job_id") -> DataFrame:
    return df.withColumn(out, external_id_from_url(F.col(url), F.col(slug)))


# --------------------------------------------------------------------------- P7
def company_from_url(url: Column, slug: Column) -> Column:
    """First path segment (workday: first host label), '-' to space, title case."""
    u = F.regexp_replace(F.regexp_replace(url, r"^[\x{00}-\x{20}]+", ""), r"[\t\r\n]", "")
    seg = F.regexp_extract(F.regexp_extract(u, URL_RX, 3), r"^/*([^/]+)", 1)
    tenant = F.try_element_at(F.split(url_host(url), r"\."), F.lit(1))
    from_seg = F.when(seg != "", python_title(F.replace(seg, F.lit("-"), F.lit(" "))))
    from_host = F.when(tenant != "", python_title(F.replace(tenant, F.lit("-"), F.lit(" "))))
    return F.when(slug.isin(*URL_PATH_SLUGS), from_seg).when(slug == "workday", from_host)


def companies_from_url(df: DataFrame, url: str = "url", slug: str = "platform_slug",
                       out: str = "url_company") -> DataFrame:
    return df.withColumn(out, company_from_url(F.col(url), F.col(slug)))


# ------------------------------------------------------------------- P8 / P9
def page_text(df: DataFrame, col: str = "html", out: str = "text") -> DataFrame:
    return df.withColumn(out, html_to_text(F.col(col)))


def text_snippets(df: DataFrame, col: str = "text", limit: int = SNIPPET_HIT,
                  out: str = "snippet") -> DataFrame:
    return df.withColumn(out, snippet(F.col(col), limit))


# -------------------------------------------------------------------------- P10
JSONLD_RX = (r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?(?=[\s>/])[^>]*>(.*?)</script\s*>")
DATE_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
)
# other ways to write a date, tried after the ISO forms; the name of the day and a final zone name are cut off first
LOOSE_DATE_FORMATS = (
    "yyyy-MM-dd HH:mm", "yyyyMMdd", "yyyyMMdd'T'HHmmss", "yyyy/M/d", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy",
    "d MMMM yyyy", "d MMM yyyy", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss XX", "MMM d, yyyy HH:mm:ss", "yyyy-M-d",
)
DAY_NAME_RX = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
ZONE_NAME_RX = r"(?i)\s*\b(?:gmt|utc)$"
# nesting of lists and @graph that is flattened natively; deeper documents are walked in Python
FLATTEN_DEPTH = 3
DEEP = '{"@type":"@deep"}'


def _vget(v: Column, path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(v, path, typ)


def _as_obj(v: Column) -> Column:
    return _vget(v, "$", "map<string,variant>")


def _as_arr(v: Column) -> Column:
    return _vget(v, "$", "array<variant>")


def _vstr(v: Column) -> Column:
    """The value when it is a JSON string, else NULL."""
    return F.when(F.schema_of_variant(v) == "STRING", _vget(v, "$", "string"))


def _flat_nodes(v: Column, depth: int) -> Column:
    """Objects of a JSON-LD value: lists and @graph flattened (``depth`` levels);
    what is nested deeper stands as one DEEP marker.

    Each level's type probes are bound once (a one-element transform), so the
    expression grows linearly with depth instead of exponentially.
    """
    empty = F.array().cast("array<variant>")
    probe = F.struct(v.alias("v"), _as_arr(v).alias("arr"), _as_obj(v).isNotNull().alias("is_obj"),
                     _vget(v, '$["@graph"]').alias("graph"))

    def level(s):
        own = F.when(s["is_obj"], F.array(s["v"])).otherwise(empty)
        if depth == 0:
            return F.when(s["graph"].isNull() & s["arr"].isNull(), own).otherwise(F.array(F.parse_json(F.lit(DEEP))))
        return (
            F.when(s["arr"].isNotNull(), F.flatten(F.transform(s["arr"], lambda x: _flat_nodes(x, depth - 1))))
            .when(s["is_obj"] & s["graph"].isNotNull(), _flat_nodes(s["graph"], depth - 1))
            .otherwise(own)
        )

    return F.try_element_at(F.transform(F.array(probe), level), F.lit(1))


def _is_job_posting(n: Column) -> Column:
    t = _vget(n, '$["@type"]')
    listed = F.exists(F.coalesce(_as_arr(t), F.array().cast("array<variant>")),
                      lambda x: F.coalesce(_vstr(x) == "JobPosting", F.lit(False)))
    return F.coalesce(_vstr(t) == "JobPosting", F.lit(False)) | listed


def parse_date(s: Column) -> Column:
    """A date in ISO or one of the loose forms (month first where digits leave it open), else NULL."""
    loose = F.regexp_replace(F.regexp_replace(F.trim(s), DAY_NAME_RX, ""), ZONE_NAME_RX, "")
    # bound by a one-element array: cut once, and the generated code stays small
    tried = F.transform(F.array(loose), lambda x: F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in LOOSE_DATE_FORMATS]))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS], F.get(tried, F.lit(0)))


@F.pandas_udf(StringType())
def _walk_blocks(blocks: pd.Series) -> pd.Series:
    """The first JobPosting of each row's JSON-LD blocks at any depth, as JSON; NULL rows stay NULL."""
    def first(texts):
        if texts is None:
            return None
        for text in texts:
            try:
                waiting = [json.loads(text)]
            except (ValueError, RecursionError):
                continue
            while waiting:
                node = waiting.pop()
                if isinstance(node, dict) and "@graph" in node:
                    node = [node["@graph"]]
                if isinstance(node, list):
                    waiting.extend(reversed(node))
                elif isinstance(node, dict):
                    kind = node.get("@type")
                    if "JobPosting" in (kind if isinstance(kind, list) else [kind]):
                        return json.dumps(node)
        return None
    return blocks.map(first)


def _read_jsonld(df: DataFrame, html: str) -> DataFrame:
    """The native part of ``with_jsonld``: ``__ld_node``, and ``__ld_deep`` with the blocks of documents that Python has to walk, else NULL."""
    df = df.withColumn("__blocks", F.filter(F.regexp_extract_all(F.col(html), F.lit(JSONLD_RX), F.lit(1)), lambda b: b != ""))
    df = df.withColumn("__nodes", F.flatten(F.transform("__blocks", lambda b: F.coalesce(
        _flat_nodes(F.try_parse_json(b), FLATTEN_DEPTH), F.array().cast("array<variant>")))))
    df = df.withColumn("__found", F.struct(
        F.exists("__nodes", lambda n: F.coalesce(_vstr(_vget(n, '$["@type"]')) == "@deep", F.lit(False))).alias("deep"),
        F.try_element_at(F.filter("__nodes", _is_job_posting), F.lit(1)).alias("node")))
    return (df.withColumn("__ld_deep", F.when(F.col("__found.deep"), F.col("__blocks")))
              .withColumn("__ld_node", F.when(F.col("__found.deep"), F.lit(None)).otherwise(F.col("__found.node")))
              .drop("__blocks", "__nodes", "__found"))


def _walk_jsonld(df: DataFrame, out: str) -> DataFrame:
    """The other part: deep documents walked in Python."""
    walked = F.try_parse_json(_walk_blocks(F.col("__ld_deep")))
    return df.withColumn(out, F.when(F.col("__ld_deep").isNotNull(), walked).otherwise(F.col("__ld_node"))).drop("__ld_deep", "__ld_node")


def with_jsonld(df: DataFrame, html: str, out: str) -> DataFrame:
    """``out``: the first JobPosting node (as VARIANT) over all ld+json blocks, or NULL.

    Lists and @graph are flattened natively up to FLATTEN_DEPTH.  Only documents
    nested deeper send their blocks to Python, where any depth is walked in the
    same order; all others travel there as NULL.
    """
    return _walk_jsonld(_read_jsonld(df, html), out)


def _location(n: Column) -> Column:
    loc = _vget(n, "$.jobLocation")
    first = F.when(_as_arr(loc).isNotNull(), F.try_element_at(_as_arr(loc), F.lit(1))).otherwise(loc)
    addr = _vget(first, "$.address")
    parts = F.array(*[nullif_blank(_vstr(_vget(addr, f"$.{k}")))
                      for k in ("addressLocality", "addressRegion", "addressCountry")])
    joined = F.when(_as_obj(first).isNotNull() & _as_obj(addr).isNotNull(),
                    nullif_blank(F.array_join(parts, ", ")))
    remote = F.when(_vstr(_vget(n, "$.jobLocationType")) == "TELECOMMUTE", F.lit("Remote"))
    return F.coalesce(joined, remote)


def jsonld_fields(df: DataFrame, node: str = "jsonld") -> DataFrame:
    """Flatten a JobPosting node column into posting fields (prefix ``ld_``)."""
    n = F.col(node)
    org = _vget(n, "$.hiringOrganization")
    company = F.when(_as_obj(org).isNotNull(), _vstr(_vget(org, "$.name"))).otherwise(_vstr(org))
    ident = _vget(n, "$.identifier")
    ident_value = _vget(ident, "$.value")
    ident_text = F.when(_as_obj(ident).isNotNull() & ident_value.isNotNull() & ~F.is_variant_null(ident_value),
                        F.coalesce(_vstr(ident_value), _vget(ident_value, "$", "string")))
    return (
        df.withColumn("ld_found", n.isNotNull())
        .withColumn("ld_title", _vstr(_vget(n, "$.title")))
        .withColumn("ld_company", company)
        .withColumn("ld_location", _location(n))
        .withColumn("ld_posting_date", parse_date(_vstr(_vget(n, "$.datePosted"))))
        .withColumn("ld_employment_type", _vstr(_vget(n, "$.employmentType")))
        .withColumn("ld_description_html", _vstr(_vget(n, "$.description")))
        .withColumn("ld_external_id", ident_text)
        .withColumn("ld_expires_at", parse_date(_vstr(_vget(n, "$.validThrough"))))
        .withColumn("ld_remote_status", F.when(_vstr(_vget(n, "$.jobLocationType")) == "TELECOMMUTE", F.lit("Remote")))
    )


def _jsonld_columns(df: DataFrame) -> DataFrame:
    out = jsonld_fields(df)
    return (out.withColumn("ld_description", F.when(F.col("ld_found"), html_to_text(F.col("ld_description_html"))))
               .drop("jsonld", "ld_description_html"))


def jsonld_postings(pages: DataFrame, html: str = "html") -> DataFrame:
    """P10: JSON-LD JobPosting fields per page; description cleaned to text."""
    return _jsonld_columns(with_jsonld(pages, html, "jsonld"))


# -------------------------------------------------------------------------- P11
META_RX = r"(?is)<meta\b[^>]*>"


def _attr_value(tag: Column, attr: str) -> Column:
    rx = r"(?is)\b" + attr + r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(F.regexp_extract(tag, rx, 1), F.regexp_extract(tag, rx, 2), F.regexp_extract(tag, rx, 3))


def _meta_content(metas: Column, prop: str) -> Column:
    def first_with(attr):
        rx = r"(?is)\b" + attr + r"\s*=\s*[\"']?" + prop.replace(".", r"\.") + r"(?:[\"'\s/>]|$)"
        tag = F.try_element_at(F.filter(metas, lambda m: m.rlike(rx)), F.lit(1))
        return nullif_blank(_attr_value(tag, "content"))
    return F.coalesce(first_with("property"), first_with("name"))


def _read_metadata(pages: DataFrame, html: str) -> DataFrame:
    df = pages.withColumn("__metas", F.regexp_extract_all(F.col(html), F.lit(META_RX), 0))
    metas = F.col("__metas")
    title_raw = F.when(F.col(html).rlike(r"(?is)<title\b"),
                       F.regexp_extract(F.col(html), r"(?is)<title\b[^>]*>(.*?)</title", 1))
    return (df.withColumn("__og_title", _meta_content(metas, "og:title"))
              .withColumn("__og_site", _meta_content(metas, "og:site_name"))
              .withColumn("__og_desc", _meta_content(metas, "og:description"))
              .withColumn("__title", title_raw).drop("__metas"))


def _clean_metadata(df: DataFrame) -> DataFrame:
    return (df.withColumn("og_title", F.trim(unescape_html(F.col("__og_title"))))
              .withColumn("og_site_name", F.trim(unescape_html(F.col("__og_site"))))
              .withColumn("og_description", F.trim(unescape_html(F.col("__og_desc"))))
              .withColumn("title_text", F.trim(unescape_html(F.col("__title"))))
              .drop("__og_title", "__og_site", "__og_desc", "__title"))


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """Og:title, og:site_name, og:description (property or name) and <title>."""
    return _clean_metadata(_read_metadata(pages, html))


# --------------------------------------------------------------------------- F1
def expired_phrase(html: Column) -> Column:
    """First expiry phrase (list order) in the lower-cased page, as 'phrase:x'."""
    low = F.lower(html)
    out = None
    for p in EXPIRED_PHRASES:
        cond = low.contains(p)
        out = F.when(cond, F.lit("phrase:" + p)) if out is None else out.when(cond, F.lit("phrase:" + p))
    return out


# --------------------------------------------------------------------------- F2
APPLY_RX = r"(?is)<(a|button)\b([^>]*)>(.*?)</\1\s*>"


def apply_disabled(html: Column) -> Column:
    """True when there are apply buttons/links and every one is disabled."""
    elems = F.regexp_extract_all(html, F.lit(APPLY_RX), 0)
    texts = F.transform(elems, lambda e: F.struct(
        F.lower(F.trim(F.regexp_replace(F.regexp_extract(e, APPLY_RX, 3), r"<[^>]+>", ""))).alias("t"),
        F.regexp_extract(e, APPLY_RX, 2).alias("a"),
    ))
    applies = F.filter(texts, lambda x: x["t"].contains("apply"))
    disabled = lambda x: x["a"].rlike(r"(?i)(^|\s)(disabled|aria-disabled)(\s*=|\s|/|$)")
    return (F.size(applies) > 0) & F.forall(applies, disabled)


# ----------------------------------------------------------------- page features
def _read_page(pages: DataFrame, html: str) -> DataFrame:
    """All that is read from the html, without Python; html dropped."""
    df = _read_metadata(_read_jsonld(pages, html), html)
    return (df.withColumn("expired_phrase", expired_phrase(F.col(html)))
              .withColumn("apply_disabled", apply_disabled(F.col(html))).drop(html))


def _finish_page(read: DataFrame) -> DataFrame:
    """The Python steps on what ``_read_page`` found."""
    last = ["expired_phrase", "apply_disabled"]
    out = _clean_metadata(_jsonld_columns(_walk_jsonld(read, "jsonld")))
    return out.select(*[c for c in out.columns if c not in last], *last)


def page_features(pages: DataFrame, html: str = "html") -> DataFrame:
    """One pass over the html: JSON-LD fields, meta tags, expiry signals; html dropped.

    Rows that wait for Python's answers are queued, on disk if a sort of the same
    task needs the memory, so all that reads the html comes before.
    """
    return _finish_page(_read_page(pages, html))


def one_per_url(features: DataFrame, url: str = "url", order: str | None = None) -> DataFrame:
    """Of pages landed more than once, the first by ``order`` (by their columns without one).

    Runs on features, after html is gone, with map-side aggregation.
    """
    rest = [c for c in features.columns if c not in (url, order)]
    row = F.struct(*rest)
    first = F.min_by(row, order) if order else F.min(row)
    return features.groupBy(url).agg(first.alias("__row")).select(url, "__row.*")


# -------------------------------------------------------------------------- P12
def _posting_fields(features: DataFrame) -> DataFrame:
    """What a posting takes from its page, each field once: the first source that has it."""
    og_snip = nullif_blank(cut_snippet(html_to_text(F.col("og_description")), SNIPPET_OG))
    return features.select(
        "url", "final_url",
        F.coalesce(*[nullif_blank(F.col(c)) for c in ("ld_title", "og_title", "title_text")]).alias("page_title"),
        F.coalesce(nullif_blank(F.col("ld_company")), nullif_blank(F.col("og_site_name"))).alias("page_company"),
        "ld_location", "ld_posting_date", "ld_employment_type", "ld_expires_at", "ld_remote_status", "ld_found",
        F.coalesce(nullif_blank(F.col("ld_description")), og_snip).alias("page_description"),
        nullif_blank(F.col("ld_external_id")).alias("page_external_id"),
        (F.col("status_code").isin(404, 410) | F.col("expired_phrase").isNotNull()).alias("page_expired"))


def extract_postings(hits: DataFrame, pages: DataFrame, company_domains=(), order: str | None = None) -> DataFrame:
    """One posting per recognised hit.

    hits: ord, url, title, snippet.  pages: url, final_url, status_code, html
    and, if given, the column ``order`` that decides which landing of a url
    counts.  Hits whose host no platform claims are dropped; hits without a
    landed page become search-only postings.  With ``order`` the landing of a url
    is chosen before the Python steps, which then share no task with the sort
    of all landings.
    """
    h = (hits.select("ord", "url", F.col("title").alias("hit_title"), snippet(F.col("snippet"), SNIPPET_HIT).alias("hit_snip"))
             .withColumn("__host", url_host(F.col("url")))
             .withColumn("platform_slug", host_platform_slug(F.col("__host"), company_domains))
             .filter(F.col("platform_slug").isNotNull()).drop("__host"))
    columns = ["url", "final_url", "status_code", "html"] + ([F.col(order).alias("__landed")] if order else [])
    pages = pages.select(*columns)
    # without an order the landing is told by all of its features
    feats = _finish_page(one_per_url(_read_page(pages, "html"), "url", "__landed")) if order else one_per_url(page_features(pages), "url")
    feats = _posting_fields(feats)
    j = h.join(feats.withColumn("has_page", F.lit(True)), "url", "left")
    j = with_canonical_url(j, "url", "__canon_hit")
    j = with_canonical_url(j, "final_url", "__canon_final")
    page = F.coalesce(F.col("has_page"), F.lit(False))
    slug, final = F.col("platform_slug"), F.col("final_url")
    hit_snip = F.col("hit_snip")
    title_page = F.coalesce("page_title", "hit_title")
    company_page = F.coalesce(F.col("page_company"), company_from_url(final, slug))
    desc_page = F.coalesce(F.col("page_description"), hit_snip)
    expired = F.col("page_expired")
    return j.select(
        "ord",
        F.when(page, title_page).otherwise(F.col("hit_title")).alias("title"),
        F.when(page, company_page).alias("company"),
        F.when(page, F.col("ld_location")).alias("location"),
        F.when(page, final).otherwise(F.col("url")).alias("url"),
        F.when(page, F.col("__canon_final")).otherwise(F.col("__canon_hit")).alias("canonical_url"),
        slug.alias("platform_slug"),
        F.when(page, F.col("ld_posting_date")).alias("posting_date"),
        F.when(page, F.col("ld_employment_type")).alias("employment_type"),
        F.when(page, desc_page).otherwise(hit_snip).alias("description"),
        F.when(page, F.coalesce(F.col("page_external_id"), external_id_from_url(final, slug)))
         .alias("external_job_id"),
        F.when(page, F.col("ld_expires_at")).alias("expires_at"),
        F.when(page, F.col("ld_remote_status")).alias("remote_status"),
        F.when(page, expired).otherwise(F.lit(False)).alias("is_expired"),
        F.when(~page, F.lit("search")).when(F.col("ld_found"), F.lit("jsonld")).otherwise(F.lit("html")).alias("source"),
    )


# -------------------------------------------------------------------------- P13
def academic_term(*sources: Column) -> Column:
    """First source containing the year and one of the terms (in term order)."""
    picks = []
    for s in sources:
        low = F.lower(s)
        pick = None
        for cand in TERM_CANDIDATES:
            cond = low.contains(cand.lower())
            pick = F.when(cond, F.lit(cand)) if pick is None else pick.when(cond, F.lit(cand))
        picks.append(F.when(s.contains(TERM_YEAR), pick))
    return F.coalesce(*picks)


def academic_terms(df: DataFrame, out: str = "internship_term") -> DataFrame:
    cols = [F.col(c) for c in ("internship_term", "title", "description") if c in df.columns]
    return df.withColumn(out, academic_term(*cols))


# -------------------------------------------------------------------------- P14
def platform_display(slug: Column) -> Column:
    out = None
    for s, name, _ in PLATFORMS:
        out = F.when(slug == s, F.lit(name)) if out is None else out.when(slug == s, F.lit(name))
    return F.when(slug.isNull() | (slug == ""), F.lit("Unknown")).otherwise(
        F.coalesce(out, python_title(slug)))


def announcement_rows(catalog: DataFrame, keywords: str | None = None) -> DataFrame:
    """Presentation fields of a catalog row (title with term, colour, platform
    name, epochs, 2-decimal score, first 8 keywords, description cut)."""
    title = F.coalesce(F.col("title"), F.lit("(untitled)"))
    term = F.col("internship_term")
    title = F.when(term.isNotNull() & ~title.contains(term), F.concat(title, F.lit(", "), term)).otherwise(title)
    out = catalog.select(
        "ord",
        F.substring(title, 1, 256).alias("embed_title"),
        F.col("canonical_url").alias("embed_url"),
        F.when(F.col("score") >= COLOR_HIGH_MIN_SCORE, F.lit(COLOR_HIGH)).otherwise(F.lit(COLOR_NORMAL)).alias("color"),
        platform_display(F.col("platform_slug")).alias("platform"),
        F.unix_timestamp(F.col("posting_date")).alias("posted_epoch"),
        F.unix_timestamp(F.col("first_seen_at")).alias("discovered_epoch"),
        F.format_string("%.2f", F.col("score")).alias("relevance"),
        (F.array_join(F.slice(F.col(keywords), 1, 8), ", ") if keywords else F.lit(None).cast("string")).alias("match"),
        F.substring(F.col("description"), 1, 500).alias("embed_description"),
        F.substring(F.col("company"), 1, 1024).alias("company_field"),
        F.substring(F.col("location"), 1, 1024).alias("location_field"),
    )
    return out
