"""URL table jobs: canonical URLs (P1), duplicate URL groups (P2), hosts (P3),
crawl allowlist (P4) and platform resolution (P5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.dictionaries import (
    NON_PUBLIC_IPV4,
    PLATFORMS,
    POSTING_PLATFORMS,
    PUBLIC_IPV4_EXCEPTIONS,
)
from harrow.functions.urls import URL_RX, url_host, with_canonical_url
from harrow.session import reliable_checkpoint


def canonicalize_urls(df: DataFrame, col: str = "url", out: str = "canonical_url") -> DataFrame:
    return with_canonical_url(df, col, out)


def duplicate_urls(df: DataFrame, col: str = "url", key: str = "page_id") -> DataFrame:
    """Rows grouped under one canonical URL: variant count and first key.

    A partial aggregate runs before the shuffle, so a hot canonical URL costs
    one row per map task, not one per variant.
    """
    return (
        canonicalize_urls(df.select(key, col), col)
        .groupBy("canonical_url")
        .agg(F.count(F.lit(1)).alias("n_variants"), F.min(key).alias(f"first_{key}"),
             F.count_distinct(col).alias("n_distinct_urls"))
    )


def url_hosts(df: DataFrame, col: str = "url", out: str = "host") -> DataFrame:
    return df.withColumn(out, url_host(F.col(col)))


def _domain_match(host: Column, domains, dot_boundary: bool) -> Column:
    conds = []
    for d in domains:
        d = d.lower()
        conds.append((host == d) | host.endswith("." + d) if dot_boundary else host.endswith(d))
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def _ipv4_in(host: Column, cidr: str) -> Column:
    net, bits = cidr.split("/")
    a, b, c, d = (int(x) for x in net.split("."))
    base = (a << 24) | (b << 16) | (c << 8) | d
    size = 1 << (32 - int(bits))
    lo = base - base % size
    return host.between(lo, lo + size - 1)


def _ipv4_value(host: Column) -> Column:
    octets = [F.regexp_extract(host, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", i).cast("long")
              for i in (1, 2, 3, 4)]
    valid = host.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")
    return F.when(valid, octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3])


def filter_crawlable(df: DataFrame, col: str = "url", extra_domains=(), strict_suffix: bool = True) -> DataFrame:
    """Allowlist check per URL -> ``allowed`` flag and the refusal ``reason``.

    Scheme must be http(s); a host is required; it must be one of the 19
    platform domains or an extra domain.  A literal IPv4 host must be public
    (name resolution itself is a network step and is not done here).
    ``strict_suffix`` requires a dot boundary; False is the reference's bare
    suffix test.
    """
    u = F.regexp_replace(F.regexp_replace(F.col(col), r"^[\x{00}-\x{20}]+", ""), r"[\t\r\n]", "")
    df = df.withColumn("__scheme", F.lower(F.regexp_extract(u, URL_RX, 1))).withColumn("__host", url_host(F.col(col)))
    df = df.withColumn("__ip", _ipv4_value(F.col("__host")))
    scheme, host = F.col("__scheme"), F.col("__host")
    domains = [p[2] for p in PLATFORMS] + [d.strip().lower() for d in extra_domains]
    on_list = _domain_match(host, domains, strict_suffix)
    ip = F.col("__ip")
    in_public_exception = F.lit(False)
    for cidr in PUBLIC_IPV4_EXCEPTIONS:
        in_public_exception = in_public_exception | _ipv4_in(ip, cidr)
    non_public = F.lit(False)
    for cidr in NON_PUBLIC_IPV4:
        non_public = non_public | _ipv4_in(ip, cidr)
    non_public = ip.isNotNull() & non_public & ~in_public_exception
    reason = (
        F.when(~scheme.isin("http", "https"), F.concat(F.lit("disallowed scheme: '"), scheme, F.lit("'")))
        .when(host == "", F.lit("missing host"))
        .when(~on_list, F.concat(F.lit("host not on allowlist: "), host))
        .when(non_public, F.concat(F.lit("host "), host, F.lit(" resolves to non-public address "), host))
    )
    return (df.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())
              .drop("__scheme", "__host", "__ip"))


def host_platform_slug(host: Column, company_domains=(), dot_boundary: bool = False) -> Column:
    """host -> platform slug; declared platforms first, then company domains."""
    out = None
    for slug, domains in POSTING_PLATFORMS:
        cond = _domain_match(host, domains, dot_boundary)
        out = F.when(cond, F.lit(slug)) if out is None else out.when(cond, F.lit(slug))
    domains = [d.strip().lower() for d in company_domains if d and d.strip()]
    if domains:
        out = out.when(_domain_match(host, domains, dot_boundary), F.lit("company"))
    return F.when(host != "", out)


def resolve_platform(df: DataFrame, col: str = "url", company_domains=(), dot_boundary: bool = False,
                     keep_unmatched: bool = False) -> DataFrame:
    """Attach ``platform_slug``; rows no adapter recognises are dropped."""
    out = (df.withColumn("__host", url_host(F.col(col)))
             .withColumn("platform_slug", host_platform_slug(F.col("__host"), company_domains, dot_boundary))
             .drop("__host"))
    return out if keep_unmatched else out.filter(F.col("platform_slug").isNotNull())


def platform_domains(spark: SparkSession) -> DataFrame:
    """The declared platforms as a table: domain, platform_slug, priority (a lower one wins)."""
    rows = [(d, slug, k) for k, (slug, domains) in enumerate(POSTING_PLATFORMS) for d in domains]
    return spark.createDataFrame(rows, "domain string, platform_slug string, priority int")


def resolve_platform_by_table(df: DataFrame, domains: DataFrame, col: str = "url", guild: str | None = None, dot_boundary: bool = False,
                              keep_unmatched: bool = False) -> DataFrame:
    """P5 with any number of domains: (domain, platform_slug, priority) and, with ``guild``, that column.

    A host is cut to its ends of the lengths that domains have, and these meet
    the domains in an equi-join, so the bare suffix rule is exact too;
    ``dot_boundary`` asks for a dot before the domain.  Rows of ``domains`` whose
    guild is null hold for all guilds.  The lowest priority wins, then the domain
    that sorts first.  Every different host (of a guild) is looked up once.
    """
    d = domains.select(F.lower(F.trim("domain")).alias("__end"), "platform_slug", "priority", *([guild] if guild else [])).filter("__end <> ''")
    # as many numbers as there are lengths of host names
    lengths = sorted(r[0] for r in d.select(F.length("__end")).distinct().collect())
    out = df.drop("platform_slug").withColumn("__host", url_host(F.col(col)))
    if not lengths:
        out = out.withColumn("platform_slug", F.lit(None).cast("string")).drop("__host")
        return out if keep_unmatched else out.filter("platform_slug is not null")
    own = ["__host"] + ([guild] if guild else [])
    # no filter on the host here or below: it would be pushed down to the scan, where the URL is taken apart once more for it
    hosts = out.select(*own).distinct()
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("__host"))
    ends = hosts.select(*own, F.explode(F.transform(fitting, lambda n: F.right(F.col("__host"), n))).alias("__end"))
    if dot_boundary:
        ends = ends.filter((F.col("__end") == F.col("__host")) | F.col("__host").endswith(F.concat(F.lit("."), F.col("__end"))))
    if guild:
        # an end meets the domains of all guilds, whose guild is null, and those of its own
        ends = ends.withColumn("__for", F.explode(F.when(F.col(guild).isNull(), F.array(F.col(guild))).otherwise(
            F.array(F.lit(None), F.col(guild)))))
        d = d.withColumnsRenamed({guild: "__whose", "__end": "__domain"})
        found = ends.join(d, (F.col("__end") == F.col("__domain")) & F.col("__for").eqNullSafe(F.col("__whose")))
    else:
        found = ends.join(d, "__end")
    best = found.groupBy(*own).agg(F.min(F.struct("priority", "__end", "platform_slug"))["platform_slug"].alias("platform_slug"))
    # written, so that Spark knows its size: rows of a few frequent hosts meet a small table where they are and aren't sent
    best = reliable_checkpoint(best.withColumnsRenamed({c: f"__of_{c}" for c in own}))
    same = F.col("__host") == F.col("__of___host")
    if guild:
        same = same & F.col(guild).eqNullSafe(F.col(f"__of_{guild}"))
    out = out.join(best, same, "left").drop("__host", *[f"__of_{c}" for c in own])
    return out if keep_unmatched else out.filter("platform_slug is not null")
