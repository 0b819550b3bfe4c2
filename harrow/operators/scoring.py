"""Keyword tagging and relevance scoring.

The haystack is built once per row; patterns are evaluated only on texts that
contain one of their terms, category patterns of a row once.
All parameters (now, thresholds, preferred lists) are arguments or columns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.dictionaries import (
    CATEGORY_KEYWORDS,
    DEFAULT_CATEGORY,
    DEFAULT_MIN_SCORE,
    FRESHNESS_OLDEST,
    FRESHNESS_STEPS,
    FRESHNESS_UNKNOWN,
    INTERNSHIP_INDICATORS,
    NEGATIVE_KEYWORDS,
    NEGATIVE_PENALTY,
    NON_ATS_SLUGS,
    SCORE_WEIGHTS,
    SEEN_PENALTY,
    SOFTWARE_INDICATORS,
)
from harrow.functions.text import has_any, keyword_haystack, matched_terms, nullif_blank
from harrow.session import reliable_checkpoint

W = dict(SCORE_WEIGHTS)
MAX_POSITIVE = sum(w for _, w in SCORE_WEIGHTS)


def _empty() -> Column:
    return F.array().cast("array<string>")


def _join_present(*cols: Column) -> Column:
    return F.concat_ws(" ", *[nullif_blank(c) for c in cols])


def tag_keywords(df: DataFrame, col: str, terms, out: str = "matched") -> DataFrame:
    """T5: sorted distinct dictionary terms found in ``col``."""
    df = df.withColumn("__hay", keyword_haystack(F.col(col)))
    return df.withColumn(out, F.array_sort(F.array_distinct(matched_terms(F.col("__hay"), terms)))).drop("__hay")


# stands before and behind a lower-cased text, where no other letter A-Z is left
EDGE = "A"


def tag_keywords_by_table(df: DataFrame, col: str, terms: DataFrame, out: str = "matched") -> DataFrame:
    """T5 with a dictionary of any size: ``terms`` has a column ``term``; the result equals ``tag_keywords``.

    A text is cut into runs of [a-z0-9] and what stands between.  Every different
    stretch of as many runs as some term has meets the terms in an equi-join on
    the text from the first to the last run.  Terms with other characters before
    or behind meet stretches that come with what stands around them; these
    characters must be there and must not reach to the next run.  Equal texts are
    tagged once.  Terms without a letter or digit match nothing, nor do terms with
    a letter A-Z.  The dictionary is written, so that Spark knows its size.
    """
    core = F.regexp_extract("term", r"(?s)^[^a-z0-9]*([a-z0-9](?:.*[a-z0-9])?)", 1)
    d = (terms.select("term").distinct().withColumn("core", core).filter("core <> ''").filter(~F.col("term").rlike("[A-Z]"))
              .withColumn("lead", F.expr("substring(term, 1, instr(term, core) - 1)"))
              .withColumn("trail", F.expr("substring(term, length(lead) + length(core) + 1)"))
              .withColumn("n", F.size(F.regexp_extract_all("core", F.lit("[a-z0-9]+"), F.lit(0)))))
    d = reliable_checkpoint(d.withColumn("bare", F.col("term") == F.col("core")))
    # as many numbers as terms have lengths in runs
    sizes = {bare: sorted(ns) for bare, ns in d.groupBy("bare").agg(F.collect_set("n")).collect()}
    hay = df.withColumn("__hay", keyword_haystack(F.col(col))).withColumn("__key", F.sha2(F.col("__hay"), 256))
    if not sizes:
        return hay.withColumn(out, _empty()).drop("__hay", "__key")
    texts = hay.select("__key", "__hay").distinct().select("__key", F.concat(F.lit(EDGE), "__hay", F.lit(EDGE)).alias("__hay"))

    def stretches(n: int, around: str) -> Column:
        if n == 1 and not around:
            return F.array_distinct(F.regexp_extract_all("__hay", F.lit("[a-z0-9]+"), F.lit(0)))
        # found ahead of each place where a run or, with ``around``, what is before it begins, so that stretches may overlap
        start = r"(?<![^a-z0-9])" if around else r"(?<![a-z0-9])"
        runs = "[a-z0-9]++" + (f"(?:[^a-z0-9]++[a-z0-9]++){{{n - 1}}}+" if n > 1 else "")
        return F.array_distinct(F.regexp_extract_all("__hay", F.lit(f"{start}(?=({around}{runs}{around}))"), F.lit(1)))

    def found(bare: bool, around: str) -> DataFrame:
        return texts.select("__key", F.explode(F.concat(*[stretches(n, around) for n in sizes[bare]])).alias("__stretch"))

    hits = []
    if True in sizes:
        hits.append(found(True, "").join(d.filter("bare"), F.col("__stretch") == F.col("core")).select("__key", "term"))
    if False in sizes:
        wide = found(False, "[^a-z0-9]++").withColumn("core", F.regexp_extract("__stretch", r"(?s)^[^a-z0-9]+(.*[a-z0-9])[^a-z0-9]+\z", 1))
        before, behind = F.regexp_extract("__stretch", "^[^a-z0-9]+", 0), F.regexp_extract("__stretch", r"[^a-z0-9]+\z", 0)
        left = (F.col("lead") == "") | (F.endswith(before, "lead") & (F.length(before) > F.length("lead")))
        right = (F.col("trail") == "") | (F.startswith(behind, "trail") & (F.length(behind) > F.length("trail")))
        hits.append(wide.join(d.filter("not bare"), "core").filter(left & right).select("__key", "term"))
    hits = hits[0].unionByName(hits[1]) if len(hits) > 1 else hits[0]
    tagged = hits.groupBy("__key").agg(F.array_sort(F.collect_set("term")).alias("__found"))
    return hay.join(tagged, "__key", "left").withColumn(out, F.coalesce("__found", _empty())).drop("__hay", "__key", "__found")


def categories_of(hay: Column) -> Column:
    """Category tags present in a prepared haystack, none if there are none."""
    return F.array_compact(F.array(*[F.when(has_any(hay, kws), F.lit(cat)) for cat, kws in CATEGORY_KEYWORDS]))


def freshness_factor(ts: Column, now: Column) -> Column:
    """Age-band factor; NULL date 0.5; future dates count as fresh."""
    age = (F.unix_micros(now) - F.unix_micros(ts)).cast("double") / 1000000.0 / 86400.0
    out = None
    for days, factor in FRESHNESS_STEPS:
        out = F.when(age <= days, F.lit(factor)) if out is None else out.when(age <= days, F.lit(factor))
    return F.when(ts.isNull(), F.lit(FRESHNESS_UNKNOWN)).otherwise(out.otherwise(F.lit(FRESHNESS_OLDEST)))


def freshness(df: DataFrame, col: str, now: dt.datetime, out: str = "freshness") -> DataFrame:
    return df.withColumn(out, freshness_factor(F.col(col), ts_lit(now)))


def ts_lit(now) -> Column:
    """A session-UTC timestamp literal from a naive datetime or ISO string."""
    text = now.isoformat(sep=" ") if isinstance(now, dt.datetime) else str(now)
    return F.to_timestamp(F.lit(text))


def _lit_array(values) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]).cast("array<string>") if values else _empty()


def score_postings(df: DataFrame, now: dt.datetime, min_score: float = DEFAULT_MIN_SCORE,
                   locations=(), terms=(), extra_negatives=(), already_seen: str | None = None,
                   params: dict | None = None) -> DataFrame:
    """Score, flags, keywords, categories, breakdown map and reasons.

    ``locations``/``terms``/``extra_negatives`` are literal lists; ``params``
    may instead name array columns (``locations``, ``terms``, ``negatives``)
    and a ``min_score`` column, as T10 does per guild.
    """
    params = params or {}
    cols = set(df.columns)
    term = F.col("internship_term") if "internship_term" in cols else F.lit(None).cast("string")
    title, desc, loc = F.col("title"), F.col("description"), F.col("location")
    df = (df.withColumn("__hay", keyword_haystack(_join_present(title, F.col("company"), loc, term, desc)))
            .withColumn("__thay", keyword_haystack(title)))
    hay, thay = F.col("__hay"), F.col("__thay")
    neg_extra_col = F.col(params["negatives"]) if "negatives" in params else None
    df = (df.withColumn("__int", matched_terms(hay, INTERNSHIP_INDICATORS))
            .withColumn("__sw", matched_terms(hay, SOFTWARE_INDICATORS))
            .withColumn("__neg", matched_terms(hay, NEGATIVE_KEYWORDS)))
    if neg_extra_col is not None:
        extra = F.filter(F.transform(neg_extra_col, lambda k: F.lower(k)), lambda k: F.rlike(
            hay, F.concat(F.lit(r"(?<![a-z0-9])\Q"), k, F.lit(r"\E(?![a-z0-9])"))))
        df = df.withColumn("__neg", F.concat(F.col("__neg"), F.coalesce(extra, _empty())))
    elif extra_negatives:
        df = df.withColumn("__neg", F.concat(F.col("__neg"),
                                             matched_terms(hay, [k.lower() for k in extra_negatives])))
    is_int = F.size(F.col("__int")) > 0
    is_sw = F.size(F.col("__sw")) > 0
    has_neg = F.size(F.col("__neg")) > 0
    title_hit = nullif_blank(title).isNotNull() & has_any(thay, SOFTWARE_INDICATORS) & has_any(thay, INTERNSHIP_INDICATORS)

    term_src = F.lower(_join_present(term, title, desc))
    loc_src = F.lower(_join_present(loc, title, desc))
    terms_arr = (F.transform(F.col(params["terms"]), lambda t: F.lower(t)) if "terms" in params
                 else _lit_array([t.lower() for t in terms]))
    locs_arr = (F.transform(F.col(params["locations"]), lambda t: F.lower(t)) if "locations" in params
                else _lit_array([t.lower() for t in locations]))
    df = (df.withColumn("__terms", F.filter(F.coalesce(terms_arr, _empty()), lambda t: F.instr(term_src, t) > 0))
            .withColumn("__locs", F.filter(F.coalesce(locs_arr, _empty()), lambda t: F.instr(loc_src, t) > 0)))
    has_term, has_loc = F.size(F.col("__terms")) > 0, F.size(F.col("__locs")) > 0
    slug = nullif_blank(F.col("platform_slug"))
    is_ats = slug.isNotNull() & ~slug.isin(*NON_ATS_SLUGS)
    fresh = freshness_factor(F.col("posting_date"), ts_lit(now)) * W["freshness"]

    def w(cond, key):
        return F.when(cond, F.lit(W[key])).otherwise(F.lit(0.0))

    raw = (((((((F.lit(0.0) + w(is_int, "internship")) + w(is_sw, "software")) + w(title_hit, "title"))
             + w(has_term, "term")) + w(has_loc, "location")) + w(is_ats, "ats")) + fresh)
    seen = F.coalesce(F.col(already_seen), F.lit(False)) if already_seen else F.lit(False)
    s = raw / F.lit(MAX_POSITIVE)
    s = F.when(has_neg, s - F.lit(NEGATIVE_PENALTY)).otherwise(s)
    s = F.when(seen, s - F.lit(SEEN_PENALTY)).otherwise(s)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
    df = (df.withColumn("__title_hit", title_hit).withColumn("__fresh", fresh).withColumn("__s", s)
            .withColumn("__is_int", is_int).withColumn("__is_sw", is_sw).withColumn("__has_neg", has_neg))
    is_int, is_sw, has_neg = F.col("__is_int"), F.col("__is_sw"), F.col("__has_neg")
    gate = is_int & is_sw & ~has_neg
    min_s = F.col(params["min_score"]) if "min_score" in params else F.lit(min_score)
    expired = F.coalesce(F.col("is_expired"), F.lit(False)) if "is_expired" in cols else F.lit(False)
    # in a projection of their own: they are asked for twice below
    df = df.withColumn("__tags", F.when(~expired & gate, categories_of(hay)))
    tags = F.when(F.size("__tags") == 0, F.array(F.lit(DEFAULT_CATEGORY))).otherwise(F.col("__tags"))
    negatives = F.array_sort(F.array_distinct(F.col("__neg")))
    matched = F.array_sort(F.array_distinct(F.concat(
        F.col("__int"), F.col("__sw"), F.col("__terms"), F.col("__locs"))))
    entries = [
        (is_int, "internship", F.lit(W["internship"])),
        (is_sw, "software", F.lit(W["software"])),
        (F.col("__title_hit"), "title", F.lit(W["title"])),
        (has_term, "term", F.lit(W["term"])),
        (has_loc, "location", F.lit(W["location"])),
        (is_ats, "ats", F.lit(W["ats"])),
        (F.lit(True), "freshness", F.round(F.col("__fresh"), 4)),
        (has_neg, "negative_penalty", F.lit(-NEGATIVE_PENALTY)),
        (seen, "seen_penalty", F.lit(-SEEN_PENALTY)),
    ]
    breakdown = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), F.when(c, v).alias("value")) for c, k, v in entries]),
        lambda e: e["value"].isNotNull()))
    reasons = F.array_compact(F.array(
        F.when(~is_int, F.lit("no internship indicator")),
        F.when(~is_sw, F.lit("no software indicator")),
        F.when(F.col("__title_hit"), F.lit("software internship in title")),
        F.when(has_neg, F.concat(F.lit("negative keywords: "), F.array_join(negatives, ", "))),
    ))
    empty_map = F.create_map().cast("map<string,double>")
    out = df.select(
        *[c for c in df.columns if not c.startswith("__")],
        F.when(expired, F.lit(0.0)).otherwise(F.round(F.col("__s"), 4)).alias("score"),
        F.when(expired, F.lit(False)).otherwise(gate & (F.col("__s") >= min_s)).alias("is_relevant"),
        is_int.alias("is_internship"),
        is_sw.alias("is_software"),
        gate.alias("passes_gate"),
        F.when(expired, _empty()).otherwise(matched).alias("matched_keywords"),
        negatives.alias("negatives"),
        F.when(expired | ~gate, _empty()).otherwise(tags).alias("categories"),
        F.when(expired, empty_map).otherwise(breakdown).alias("breakdown"),
        F.when(expired, F.array(F.lit("expired"))).otherwise(reasons).alias("reasons"),
    )
    return out


def gate(scored: DataFrame) -> DataFrame:
    """Rows worth persisting (internship, software, no negatives); independent
    of min_score and expiry."""
    return scored.filter(F.col("passes_gate"))


def tag_categories(scored: DataFrame, key: str = "ord") -> DataFrame:
    """T6 as rows: one (key, category) per tag of a gated posting.

    Rows without a tag are dropped behind the generator: ``explode`` infers a
    filter on its array, which is pushed below the projections of the scorer and
    there evaluates every keyword pattern on a haystack that it builds anew.
    """
    tags = scored.select(key, F.posexplode_outer("categories").alias("__place", "category"))
    return tags.filter("__place is not null").select(key, "category")


def score_params(postings: DataFrame, settings: DataFrame, now: dt.datetime, guild: str = "guild_id") -> DataFrame:
    """Score each posting with its guild's preferred locations and terms,
    extra negative keywords and min_score.  A posting belongs to one guild's
    scan, so this is an equi-join on the guild (the settings side is one row
    per guild), never a cross product."""
    cfg = settings.select(guild, F.col("locations").alias("__locs_p"), F.col("academic_terms").alias("__terms_p"),
                          F.col("negative_keywords").alias("__neg_p"), F.col("min_score").alias("__min_p"))
    # a guild without settings rows scores with the defaults (settings are created on first use)
    j = (postings.join(cfg, guild, "left")
         .withColumn("__min_p", F.coalesce(F.col("__min_p"), F.lit(DEFAULT_MIN_SCORE))))
    out = score_postings(j, now, params={"locations": "__locs_p", "terms": "__terms_p",
                                         "negatives": "__neg_p", "min_score": "__min_p"})
    return out.drop("__locs_p", "__terms_p", "__neg_p", "__min_p")
