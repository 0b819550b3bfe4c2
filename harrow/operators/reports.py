"""Catalog reports and lookups.

Top-k reports use ``orderBy().limit()`` (TakeOrderedAndProject: a bounded
per-partition heap, no full sort) with the row key as the last sort key, so
ties are deterministic.  Per-group top-k uses ``row_number() <= k``, which
Spark plans as a WindowGroupLimit that trims each group before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.dictionaries import DIGEST_LIMIT, IRRELEVANT_PENALTY, PENDING_LIMIT, RECHECK_LIMIT
from harrow.operators.scoring import ts_lit


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """A1: total, active, posted, expired in one pass."""
    return catalog.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("posted")).alias("posted"),
        F.count_if(F.col("status") == "expired").alias("expired"),
    )


def top_companies(catalog: DataFrame, k: int = 20) -> DataFrame:
    """A2: postings per non-null company, most first (name breaks ties)."""
    return (catalog.filter(F.col("company").isNotNull()).groupBy("company")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("company")).limit(k))


def scan_report(hits: DataFrame, run: str = "run_id", runs: DataFrame | None = None) -> DataFrame:
    """A5: per scan run, queries run, results found, new and posted jobs.

    ``runs`` (run, error) lists every started run: one with an error is
    ``failed``, also when it left no hits; without it all runs are completed.
    """
    found = _scan_counts(hits, run)
    if runs is None:
        return found
    counts = ("queries_run", "results_found", "jobs_new", "jobs_posted")
    return runs.join(found.drop("status"), run, "left").select(
        run, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.when(F.col("error").isNotNull(), F.lit("failed")).otherwise(F.lit("completed")).alias("status"))


def _scan_counts(hits: DataFrame, run: str) -> DataFrame:
    return hits.groupBy(run).agg(
        F.count_distinct("query_hash").alias("queries_run"),
        F.count(F.lit(1)).alias("results_found"),
        F.count_if(F.col("is_new")).alias("jobs_new"),
        F.count_if(F.col("is_posted")).alias("jobs_posted"),
        F.lit("completed").alias("status"),
    )


def fold_feedback(feedback: DataFrame, catalog: DataFrame, key: str = "job_id") -> DataFrame:
    """A6: 'irrelevant' votes lower the score by 0.2 each (floored at 0, applied
    one vote at a time), a 'duplicate' vote closes the job; other kinds are
    only recorded.  Votes are pre-aggregated per job before the join."""
    votes = feedback.groupBy(key).agg(
        F.count_if(F.col("kind") == "irrelevant").alias("n_irrelevant"),
        F.bool_or(F.col("kind") == "duplicate").alias("has_duplicate"),
    )
    j = catalog.join(votes, key, "left")
    n = F.coalesce(F.col("n_irrelevant"), F.lit(0))
    # once the score is 0 it stays 0, so no more steps than that are needed
    steps = F.least(n, F.ceil(F.greatest(F.col("score"), F.lit(0.0)) / F.lit(IRRELEVANT_PENALTY)) + 1)
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), F.col("score"),
                         lambda acc, _x: F.greatest(F.lit(0.0), acc - F.lit(IRRELEVANT_PENALTY)))
    return (j.withColumn("score", F.when(n > 0, folded).otherwise(F.col("score")))
             .withColumn("status", F.when(F.coalesce(F.col("has_duplicate"), F.lit(False)), F.lit("closed"))
                         .otherwise(F.col("status")))
             .drop("n_irrelevant", "has_duplicate"))


def search_catalog(catalog: DataFrame, title: str | None = None, location: str | None = None,
                   term: str | None = None, k: int = 10, key: str = "ord") -> DataFrame:
    """case-insensitive substring filters ('%' and '_' act as wildcards)."""
    df = catalog
    for col, value in (("title", title), ("location", location), ("internship_term", term)):
        if value:
            df = df.filter(F.col(col).ilike(f"%{value}%"))
    return df.orderBy(F.desc("score"), F.asc(key)).limit(k)


def recent(df: DataFrame, now: dt.datetime, hours: int = 24, k: int = PENDING_LIMIT,
           seen: str = "first_seen_at", score: str = "score", key: str = "ord") -> DataFrame:
    """first seen within ``hours`` of now; best score, then newest."""
    since = ts_lit(now) - F.make_interval(hours=F.lit(hours))
    return (df.filter(F.col(seen) >= since)
              .orderBy(F.desc(score), F.desc(seen), F.asc(key)).limit(k))


def platform_filter(queries: DataFrame, slug: str | None) -> DataFrame:
    """F6."""
    return queries.filter(F.col("platform_slug") == slug) if slug else queries


def active_settings(settings: DataFrame) -> DataFrame:
    """guilds that are not paused."""
    return settings.filter(~F.coalesce(F.col("paused"), F.lit(False)))


def pending(catalog: DataFrame, min_score: float, k: int = PENDING_LIMIT, key: str = "ord") -> DataFrame:
    """Not posted, active, score at least min_score; best first."""
    return (catalog.filter(~F.col("posted") & (F.col("status") == "active") & (F.col("score") >= min_score))
                   .orderBy(F.desc("score"), F.asc(key)).limit(k))


def due_for_recheck(catalog: DataFrame, now: dt.datetime, hours: float,
                    k: int = RECHECK_LIMIT, key: str = "ord") -> DataFrame:
    """Active and never checked or checked before the cutoff; oldest first."""
    cutoff = ts_lit(now) - F.make_interval(secs=F.lit(float(hours) * 3600.0))
    chk = F.col("last_checked_at")
    return (catalog.filter((F.col("status") == "active") & (chk.isNull() | (chk < cutoff)))
                   .orderBy(chk.asc_nulls_first(), F.asc(key)).limit(k))


def top_queries(stats: DataFrame, k: int = 15) -> DataFrame:
    """Most relevant results, then most runs."""
    return stats.orderBy(F.desc("relevant_results"), F.desc("times_run"), F.asc("query_hash")).limit(k)


def digest(jobs: DataFrame, group: str, k: int = DIGEST_LIMIT, key: str = "ord") -> DataFrame:
    """Per group, the first ``k`` jobs (best score) as digest lines plus the
    count of the rest.  The group size comes from a pre-aggregated count, so a
    hot group never has to be held in one window partition."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), F.asc(key))
    top = jobs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    sizes = jobs.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    line = F.concat(
        F.lit("["), F.coalesce(F.col("company"), F.lit("?")), F.lit(" — "),
        F.coalesce(F.col("location"), F.lit("N/A")), F.lit("]("), F.coalesce(F.col("url"), F.lit("")),
        F.lit(") • "), F.format_string("%.2f", F.col("score")))
    return (top.join(sizes, group)
               .select(group, "rn", key,
                       F.substring(F.coalesce(F.col("title"), F.lit("(untitled)")), 1, 200).alias("name"),
                       F.substring(line, 1, 1024).alias("value"),
                       F.greatest(F.col("__n") - k, F.lit(0)).alias("more")))


def first_last_seen(sightings: DataFrame, key: str, ts: str) -> DataFrame:
    """First and last sighting per key (partial aggregation before the shuffle)."""
    return sightings.groupBy(key).agg(F.min(ts).alias("first_seen_at"), F.max(ts).alias("last_seen_at"),
                                      F.count(F.lit(1)).alias("sightings"))


def drop_ignored(pending_rows: DataFrame, ignored: DataFrame) -> DataFrame:
    """Remove rows whose (guild, normalized company) is ignored; rows
    without a company are kept.  ``ignored`` is one row per pair (deduplicated
    first), so the anti join probes a key set no larger than the pairs."""
    keys = ignored.select("guild_id", "normalized_company").distinct()
    has_company = F.coalesce(F.col("company"), F.lit("")) != ""
    with_company = pending_rows.filter(has_company).join(keys, ["guild_id", "normalized_company"], "left_anti")
    return with_company.unionByName(pending_rows.filter(~has_company))


def saved_list(saved: DataFrame, catalog: DataFrame, user_id: int, k: int = PENDING_LIMIT,
               key: str = "job_id") -> DataFrame:
    """A user's saved jobs, newest save first."""
    mine = saved.filter(F.col("user_id") == user_id)
    return mine.join(catalog, key).orderBy(F.desc("created_at"), F.asc(key)).limit(k)


def with_children(catalog: DataFrame, children: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Catalog rows with the distinct values of one child column (sorted) per job."""
    kids = children.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(out))
    return catalog.join(kids, key, "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast("array<string>")))


def get_jobs(catalog: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in an id table (left semi join)."""
    return catalog.join(ids.select(key).distinct(), key, "left_semi")
