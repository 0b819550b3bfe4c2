"""Search planning and provider data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.dictionaries import (
    GROUP_WEIGHT,
    JOB_TITLE_GROUPS,
    MAX_LOCATIONS_PER_CLAUSE,
    MAX_TITLES_PER_CLAUSE,
    PLATFORMS,
    PROVIDER_LAYOUTS,
    QUERY_VARIANTS,
    TITLE_GROUP_TO_CATEGORY,
)
from harrow.functions.text import sha32


# -------------------------------------------------------------------------- Q3
def quote_term(t: Column) -> Column:
    return F.when(t.contains(" ") | t.contains("-"), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)


def or_clause(terms: Column) -> Column:
    """'(a OR "b c")' from an ordered array of terms."""
    return F.concat(F.lit("("), F.array_join(F.transform(terms, quote_term), " OR "), F.lit(")"))


def or_clauses(df: DataFrame, group: str, term: str, pos: str) -> DataFrame:
    """Q3: one OR clause per group, terms in ``pos`` order (distinct terms first,
    so the collected list is bounded by the vocabulary, not the row count)."""
    terms = df.groupBy(group, term).agg(F.min(pos).alias("__pos"))
    return (terms.groupBy(group)
            .agg(F.sort_array(F.collect_list(F.struct(F.col("__pos"), F.col(term)))).alias("__t"))
            .select(group, or_clause(F.transform("__t", lambda s: s[term])).alias("clause")))


# -------------------------------------------------------------------------- Q1
def _dictionary_tables(spark):
    plat = spark.createDataFrame([(s, d) for s, _, d in PLATFORMS], "slug string, domain string")
    cat = dict(TITLE_GROUP_TO_CATEGORY)
    weight = dict(GROUP_WEIGHT)
    groups = spark.createDataFrame(
        [(g, list(titles), cat[g], weight.get(g, 1.0), i) for i, (g, titles) in enumerate(JOB_TITLE_GROUPS)],
        "grp string, titles array<string>, category string, weight double, grp_pos int")
    return plat, groups


def build_queries(config: DataFrame, include_terms: bool = True, include_locations: bool = True,
                  max_titles: int = MAX_TITLES_PER_CLAUSE, max_locations: int = MAX_LOCATIONS_PER_CLAUSE) -> DataFrame:
    """Q1: search templates per config row (guild_id, platforms, academic_terms,
    locations): platform x title group x variant.  The dictionaries are tiny
    literal tables joined on keys (slug) or exploded from arrays, so the
    output is bounded by guilds x 19 x 10 x 3."""
    spark = config.sparkSession
    plat, groups = _dictionary_tables(spark)
    per_platform = (config.select("guild_id", "academic_terms", "locations",
                                  F.posexplode("platforms").alias("plat_pos", "slug"))
                    .join(F.broadcast(plat), "slug"))
    grp_array = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(i).alias("grp_pos")) for i, (g, _) in enumerate(JOB_TITLE_GROUPS)])
    rows = (per_platform.select("*", F.explode(grp_array).alias("g")).select("*", "g.grp", "g.grp_pos").drop("g")
            .join(F.broadcast(groups.drop("grp_pos")), "grp"))
    title_clause = or_clause(F.slice("titles", 1, max_titles))
    site = F.concat(F.lit("site:"), F.col("domain"), F.lit(" "), title_clause)
    variants = [F.struct(F.lit("title").alias("variant"), site.alias("text"), F.lit(QUERY_VARIANTS[0][1]).alias("factor"),
                         F.lit(0).alias("v_pos"))]
    if include_terms:
        variants.append(F.when(F.size("academic_terms") > 0, F.struct(
            F.lit("title_term").alias("variant"), F.concat(site, F.lit(" "), or_clause(F.col("academic_terms"))).alias("text"),
            F.lit(QUERY_VARIANTS[1][1]).alias("factor"), F.lit(1).alias("v_pos"))))
    if include_locations:
        variants.append(F.when(F.size("locations") > 0, F.struct(
            F.lit("title_location").alias("variant"),
            F.concat(site, F.lit(" "), or_clause(F.slice("locations", 1, max_locations))).alias("text"),
            F.lit(QUERY_VARIANTS[2][1]).alias("factor"), F.lit(2).alias("v_pos"))))
    out = rows.select("guild_id", "slug", "grp", "category", "weight", "plat_pos", "grp_pos",
                      F.explode(F.array_compact(F.array(*variants))).alias("v"))
    return out.select(
        "guild_id", F.col("v.text").alias("text"), F.col("slug").alias("platform_slug"), "grp", "category",
        (F.col("weight") * F.col("v.factor")).alias("priority"), F.col("v.variant").alias("variant"),
        sha32(F.col("v.text")).alias("query_hash"),
        (F.col("plat_pos") * 100 + F.col("grp_pos") * 10 + F.col("v.v_pos")).alias("gen_order"),
    )


# ------------------------------------------------------------------ A3 / A4 / W4
def query_yield(runs: DataFrame) -> DataFrame:
    """A3: per query, runs, results, relevant results, last run."""
    return runs.groupBy("query_hash").agg(
        F.count(F.lit(1)).alias("times_run"),
        F.sum("result_count").alias("total_results"),
        F.sum("relevant_count").alias("relevant_results"),
        F.max("run_ts").alias("last_run_at"),
    )


def learned_priority(stats: DataFrame) -> DataFrame:
    """A4: min(1, relevant / runs) for queries that ran (per run, not per result)."""
    return (stats.filter(F.col("times_run") > 0)
                 .select("query_hash", F.least(F.lit(1.0), F.coalesce(F.col("relevant_results"), F.lit(0))
                                              / F.col("times_run")).alias("bonus")))


# -------------------------------------------------------------------------- J7
def queries_with_stats(queries: DataFrame, bonus: DataFrame) -> DataFrame:
    """Templates with their learned bonus (0 when never run)."""
    return (queries.join(bonus, "query_hash", "left")
                   .withColumn("bonus", F.coalesce(F.col("bonus"), F.lit(0.0))))


# -------------------------------------------------------------------------- W1
def select_batch(queries: DataFrame, size: int, group: str, rotation: int = 0) -> DataFrame:
    """Per ``group`` (a guild, a platform), the top max(1, size//3) by priority+bonus (hash breaks
    ties), then a window of the rest starting at (rotation*need) mod len,
    wrapping.  A template set is bounded (platforms x groups x variants), so a
    per-group window is bounded too."""
    if size <= 0:
        return queries.limit(0).withColumn("batch_pos", F.lit(0))
    eff = F.col("priority") + F.coalesce(F.col("bonus"), F.lit(0.0)) if "bonus" in queries.columns else F.col("priority")
    w = Window.partitionBy(group).orderBy(F.desc("__eff"), F.asc("query_hash"))
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    df = queries.withColumn("__eff", eff).withColumn("__rn", F.row_number().over(w)).withColumn("__n", n)
    reserved = max(1, size // 3)
    top_n = F.least(F.lit(reserved), F.col("__n"))
    rest_len = F.col("__n") - top_n
    need = F.lit(size) - top_n
    start = F.pmod(F.lit(rotation) * need, F.greatest(rest_len, F.lit(1)))
    idx = F.col("__rn") - top_n - 1
    offset = F.pmod(idx - start, F.greatest(rest_len, F.lit(1)))
    in_top = F.col("__rn") <= top_n
    in_window = (~in_top) & (offset < F.least(need, rest_len))
    return (df.filter(in_top | in_window)
              .withColumn("batch_pos", F.when(in_top, F.col("__rn")).otherwise(top_n + offset + 1))
              .drop("__eff", "__rn", "__n"))


# -------------------------------------------------------------------------- Q4
def query_runs(hits: DataFrame) -> DataFrame:
    """Q4: per (query, run): provider, result count and relevant count."""
    return hits.groupBy("query_hash", "run_id").agg(
        F.min("provider").alias("provider"),
        F.count(F.lit(1)).alias("result_count"),
        F.count_if(F.col("is_relevant")).alias("relevant_count"),
    )


def new_queries(runs: DataFrame, known: DataFrame) -> DataFrame:
    """Q4 upsert: distinct query hashes not yet known."""
    return runs.select("query_hash").distinct().join(known.select("query_hash"), "query_hash", "left_anti")


def upsert_queries(known: DataFrame, runs: DataFrame) -> DataFrame:
    """Q4: known query counters plus those of new runs; unseen queries are inserted.

    One aggregation over both, so a query with a third of all runs is reduced
    before the shuffle.  Both sides hold query_hash; ``known`` the A3 counters,
    ``runs`` result_count, relevant_count and run_ts.
    """
    added = query_yield(runs)
    return known.select(*added.columns).unionByName(added).groupBy("query_hash").agg(
        F.sum("times_run").alias("times_run"), F.sum("total_results").alias("total_results"),
        F.sum("relevant_results").alias("relevant_results"), F.max("last_run_at").alias("last_run_at"))


# -------------------------------------------------------------------------- S1
_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in
                      ("link", "url", "title", "name", "snippet", "description")]
                     + [T.StructField("position", T.LongType())])
_BODY = T.StructType([
    T.StructField("organic", T.ArrayType(_ITEM)),
    T.StructField("webPages", T.StructType([T.StructField("value", T.ArrayType(_ITEM))])),
    T.StructField("web", T.StructType([T.StructField("results", T.ArrayType(_ITEM))])),
    T.StructField("items", T.ArrayType(_ITEM)),
])


def normalize_hits(payloads: DataFrame) -> DataFrame:
    """Provider payload bodies to (rank, url, title, snippet) rows.

    One explicit JSON schema covers the four layouts; the provider picks the
    item list and field names, rank follows each provider's numbering rule,
    and empty URLs are dropped after numbering."""
    body = F.from_json(F.col("body"), _BODY)
    layout = {name: (path, u, t, s) for name, path, u, t, s in PROVIDER_LAYOUTS}
    prov = F.col("provider")

    def items(name):
        path = layout[name][0].split(".")
        c = body
        for p in path:
            c = c[p]
        return c
    arr = None
    for name in layout:
        arr = F.when(prov == name, items(name)) if arr is None else arr.when(prov == name, items(name))
    df = payloads.filter(F.col("status") == "ok").withColumn("__items", arr)
    df = df.select("*", F.posexplode("__items").alias("__i", "__it")).drop("__items")
    it = F.col("__it")

    def pick(field_idx):
        out = None
        for name, vals in layout.items():
            v = F.coalesce(it[vals[field_idx]], F.lit("")) if field_idx == 1 else it[vals[field_idx]]
            out = F.when(prov == name, v) if out is None else out.when(prov == name, v)
        return out
    i1 = F.col("__i") + 1
    page_off = (F.col("page") - 1) * F.col("per_page")
    rank = (F.when(prov == "serper", F.coalesce(it["position"], i1))
            .when(prov == "bing", page_off + i1)
            .when(prov == "brave", i1)
            .otherwise(page_off + 1 + F.col("__i")))
    out = df.select(*[c for c in payloads.columns if c != "body"],
                    rank.cast("long").alias("rank"), pick(1).alias("url"), pick(2).alias("title"), pick(3).alias("snippet"))
    return out.filter(F.col("url") != "")


# -------------------------------------------------------------------------- S2
def resolve_provider(responses: DataFrame, provider_order=("serper", "bing", "brave", "google_pse")) -> DataFrame:
    """Per query, the first provider (configured order) whose call
    succeeded; queries with no success get provider NULL and status 'failed'."""
    order = None
    for i, p in enumerate(provider_order):
        order = F.when(F.col("provider") == p, F.lit(i)) if order is None else order.when(F.col("provider") == p, F.lit(i))
    ok = responses.filter((F.col("status") == "ok") & order.isNotNull()).withColumn("__ord", order)
    chosen = ok.groupBy("query_hash").agg(F.min_by("provider", "__ord").alias("provider"))
    return (responses.select("query_hash").distinct().join(chosen, "query_hash", "left")
            .withColumn("status", F.when(F.col("provider").isNull(), F.lit("failed")).otherwise(F.lit("ok"))))


# -------------------------------------------------------------------------- S3
def admit_requests(requests: DataFrame, hourly: int, daily: int, ts: str = "ts", ok: str = "succeeded",
                   key: str = "request_id", split_hot: bool = False) -> DataFrame:
    """S3: budget decision per request in arrival order.

    Hour check precedes day check; only admitted, successful calls use budget.
    Successes are ranked within their hour, the first ``hourly`` of them are
    ranked within the day, and the first ``daily`` of those are recorded; the
    running count of recorded calls then gives every request its outcome.
    The ranks are windows per hour and day.  A log whose single days are too
    large for one task asks for ``split_hot``: the ranks are then running counts
    of a segmented scan over (day, ts, key), which spreads a day over many tasks
    at the price of several passes.
    """
    from harrow.operators import segmented as G

    df = requests.withColumn("__day", F.to_date(F.col(ts))).withColumn("__hour", F.date_trunc("hour", F.col(ts)))
    if not split_hot:
        return _admit_requests_window(df, hourly, daily, ts, ok, key)
    df = G.sort_and_index(df, "__day", [ts, key])
    succ = F.coalesce(F.col(ok), F.lit(False))
    df = G.running_count(df, "__hour", succ, "__h", inclusive=True)
    df = df.withColumn("__elig", succ & (F.col("__h") <= hourly))
    df = G.running_count(df, "__day", F.col("__elig"), "__d", inclusive=True)
    df = df.withColumn("__rec", F.col("__elig") & (F.col("__d") <= daily))
    df = G.running_count(df, "__hour", F.col("__rec"), "__hc", inclusive=False)
    df = G.running_count(df, "__day", F.col("__rec"), "__dc", inclusive=False)
    outcome = (F.when(F.col("__hc") >= hourly, F.lit("refused_hourly"))
               .when(F.col("__dc") >= daily, F.lit("refused_daily"))
               .when(succ, F.lit("admitted")).otherwise(F.lit("failed")))
    return (df.withColumn("outcome", outcome)
              .drop("__day", "__hour", "__h", "__elig", "__d", "__rec", "__hc", "__dc", G.PID, G.POS))


def _admit_requests_window(df: DataFrame, hourly: int, daily: int, ts: str, ok: str, key: str) -> DataFrame:
    """S3 with windows per hour and day."""
    order = [F.col(ts), F.col(key)]
    succ = F.coalesce(F.col(ok), F.lit(False))
    by_hour = Window.partitionBy("__hour").orderBy(*order)
    by_day = Window.partitionBy("__day").orderBy(*order)
    before_h = by_hour.rowsBetween(Window.unboundedPreceding, -1)
    before_d = by_day.rowsBetween(Window.unboundedPreceding, -1)
    upto_h = by_hour.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto_d = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__h", F.sum(succ.cast("long")).over(upto_h))
    df = df.withColumn("__elig", succ & (F.col("__h") <= hourly))
    df = df.withColumn("__d", F.sum(F.col("__elig").cast("long")).over(upto_d))
    df = df.withColumn("__rec", F.col("__elig") & (F.col("__d") <= daily))
    df = (df.withColumn("__hc", F.coalesce(F.sum(F.col("__rec").cast("long")).over(before_h), F.lit(0)))
            .withColumn("__dc", F.coalesce(F.sum(F.col("__rec").cast("long")).over(before_d), F.lit(0))))
    outcome = (F.when(F.col("__hc") >= hourly, F.lit("refused_hourly"))
               .when(F.col("__dc") >= daily, F.lit("refused_daily"))
               .when(succ, F.lit("admitted")).otherwise(F.lit("failed")))
    return df.withColumn("outcome", outcome).drop("__day", "__hour", "__h", "__elig", "__d", "__rec", "__hc", "__dc")


# -------------------------------------------------------------------------- S4
def hits_for_site(hits: DataFrame, query: str, page: int = 1, per_page: int = 10, order: str = "ord") -> DataFrame:
    """Hits whose URL contains the query's ``site:`` token, one result page."""
    site = None
    for tok in query.split():
        if tok.startswith("site:"):
            site = tok[len("site:"):]
            break
    df = hits.filter(F.col("url").contains(site)) if site else hits
    start = (page - 1) * per_page
    return df.orderBy(order).offset(start).limit(per_page)
