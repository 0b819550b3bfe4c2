"""Guild settings from their change log (C1) and per-guild query config (Q2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.dictionaries import (
    DEFAULT_ACADEMIC_TERMS,
    DEFAULT_GUILD_MIN_SCORE,
    DEFAULT_LOCATIONS,
    DEFAULT_SCAN_INTERVAL_HOURS,
    MIN_SCAN_INTERVAL_HOURS,
    PLATFORMS,
)
from harrow.functions.regex import PY_WS_EDGES

SCALAR_KEYS = ("min_score", "interval", "locations", "terms", "keywords", "negative_keywords", "paused", "channel")
SET_KEYS = {"add_domain": ("company_domains", True), "remove_domain": ("company_domains", False),
            "disable_platform": ("disabled_platforms", True), "enable_platform": ("disabled_platforms", False)}


def parse_list(c: Column) -> Column:
    """'a; b,,c ' -> ['a', 'b', 'c']: ';' and ',' separate, items trimmed, blanks dropped."""
    parts = F.transform(F.split(F.replace(c, F.lit(";"), F.lit(",")), ","), lambda x: F.regexp_replace(x, PY_WS_EDGES, ""))
    return F.filter(parts, lambda x: x != "")


def fold_settings(changes: DataFrame) -> DataFrame:
    """Current settings per guild from (seq, ts, guild_id, setting_key, setting_value).

    Scalar keys: the last value wins (by ts, then seq).  Domain and platform
    sets: the last add/remove per item decides membership.  Both are plain
    group aggregations with partial aggregation before the shuffle.
    """
    order = F.struct("ts", "seq")
    last = (changes.filter(F.col("setting_key").isin(*SCALAR_KEYS))
            .groupBy("guild_id").pivot("setting_key", list(SCALAR_KEYS))
            .agg(F.max_by("setting_value", order)))
    item = F.when(F.col("setting_key").isin("add_domain", "remove_domain"),
                  F.lower(F.regexp_replace(F.col("setting_value"), PY_WS_EDGES, ""))).otherwise(F.col("setting_value"))
    target = F.when(F.col("setting_key").isin("add_domain", "remove_domain"), F.lit("company_domains")) \
              .otherwise(F.lit("disabled_platforms"))
    adds = F.col("setting_key").isin("add_domain", "disable_platform")
    members = (changes.filter(F.col("setting_key").isin(*SET_KEYS))
               .select("guild_id", target.alias("set_name"), item.alias("item"), adds.alias("is_add"), "ts", "seq")
               .groupBy("guild_id", "set_name", "item").agg(F.max_by("is_add", F.struct("ts", "seq")).alias("present"))
               .filter("present")
               .groupBy("guild_id").agg(
                   F.sort_array(F.collect_list(F.when(F.col("set_name") == "company_domains", F.col("item")))).alias("company_domains"),
                   F.sort_array(F.collect_list(F.when(F.col("set_name") == "disabled_platforms", F.col("item")))).alias("disabled_platforms")))
    guilds = changes.select("guild_id").distinct()
    s = guilds.join(last, "guild_id", "left").join(members, "guild_id", "left")
    empty = F.array().cast("array<string>")
    minimum = F.col("min_score").try_cast("double")
    interval = F.col("interval").try_cast("double")
    return s.select(
        "guild_id",
        F.coalesce(F.col("channel").try_cast("bigint"), F.lit(None).cast("bigint")).alias("post_channel_id"),
        F.coalesce(F.greatest(F.lit(MIN_SCAN_INTERVAL_HOURS), interval), F.lit(DEFAULT_SCAN_INTERVAL_HOURS)).alias("scan_interval_hours"),
        F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), minimum)), F.lit(DEFAULT_GUILD_MIN_SCORE)).alias("min_score"),
        F.coalesce(F.lower(F.col("paused")) == "true", F.lit(False)).alias("paused"),
        F.coalesce(parse_list(F.col("locations")), empty).alias("locations"),
        F.coalesce(parse_list(F.col("terms")), empty).alias("academic_terms"),
        F.coalesce(parse_list(F.col("keywords")), empty).alias("extra_keywords"),
        F.coalesce(parse_list(F.col("negative_keywords")), empty).alias("negative_keywords"),
        F.coalesce(F.col("company_domains"), empty).alias("company_domains"),
        F.coalesce(F.col("disabled_platforms"), empty).alias("disabled_platforms"),
    )


def enabled_platforms(settings: DataFrame) -> DataFrame:
    """Q2: query config per guild: declared platforms minus disabled ones (in
    declaration order); empty term/location lists fall back to the defaults."""
    all_slugs = F.array(*[F.lit(p[0]) for p in PLATFORMS])
    terms_default = F.array(*[F.lit(t) for t in DEFAULT_ACADEMIC_TERMS])
    locs_default = F.array(*[F.lit(t) for t in DEFAULT_LOCATIONS])
    return settings.select(
        "guild_id",
        F.array_except(all_slugs, F.col("disabled_platforms")).alias("platforms"),
        F.when(F.size("academic_terms") > 0, F.col("academic_terms")).otherwise(terms_default).alias("academic_terms"),
        F.when(F.size("locations") > 0, F.col("locations")).otherwise(locs_default).alias("locations"),
    )
