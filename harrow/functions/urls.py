"""URL column builders: canonical form (P1) and host.

The URL is split with one pattern that follows the generic URI layout
``scheme:[//netloc]path[?query][#fragment]``; every part is then rebuilt with
built-in string, array and URL functions, so the whole rule stays inside
whole-stage codegen (no Python UDF, no ``parse_url``: it rejects hosts with
``_`` and keeps host case).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.dictionaries import TRACKING_PARAMS
from harrow.functions.regex import PY_WS_EDGES

URL_RX = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Schemes whose empty-netloc URLs are still written with "//".
USES_NETLOC = (
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
    "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn",
    "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
)


def _prepare(c: Column, strip: bool) -> Column:
    u = F.regexp_replace(c, PY_WS_EDGES, "") if strip else c
    u = F.regexp_replace(u, r"^[\x{00}-\x{20}]+", "")
    return F.regexp_replace(u, r"[\t\r\n]", "")


def _hostinfo(netloc: Column) -> Column:
    return F.regexp_replace(netloc, r"^.*@", "")


def _hostname(hostinfo: Column) -> Column:
    bracketed = F.regexp_extract(hostinfo, r"\[([^\]]*)", 1)
    plain = F.regexp_extract(hostinfo, r"^([^:]*)", 1)
    return F.lower(F.when(hostinfo.contains("["), bracketed).otherwise(plain))


def _port_text(hostinfo: Column) -> Column:
    bracketed = F.regexp_extract(hostinfo, r"\[[^\]]*\][^:]*:(.*)$", 1)
    plain = F.regexp_extract(hostinfo, r"^[^:]*:(.*)$", 1)
    return F.when(hostinfo.contains("["), bracketed).otherwise(plain)


def url_host(c: Column) -> Column:
    """Lower-cased hostname of a URL, '' when there is none."""
    u = _prepare(c, strip=False)
    netloc = F.substring(F.regexp_extract(u, URL_RX, 2), 3, 1 << 30)
    return F.coalesce(_hostname(_hostinfo(netloc)), F.lit(""))


def _decode(c: Column) -> Column:
    # Form decoding; a lone '%' stays literal as in the reference's decoder.
    return F.try_url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    # Form encoding with the reference's safe set (letters, digits, _.-~).
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def with_canonical_url(df: DataFrame, col: str, out: str = "canonical_url") -> DataFrame:
    """Add the canonical URL of ``col`` as ``out``.

    NULL/'' pass through; an invalid port or unbalanced brackets give NULL.
    Built in staged projections over temporary columns so each regex runs
    once per row and the generated code stays small.
    """
    t = "__cu_"
    c = F.col(col)
    df = df.withColumn(t + "u", _prepare(c, strip=True))
    u = F.col(t + "u")
    df = (df.withColumn(t + "sch", F.lower(F.regexp_extract(u, URL_RX, 1)))
            .withColumn(t + "nl", F.substring(F.regexp_extract(u, URL_RX, 2), 3, 1 << 30))
            .withColumn(t + "p0", F.regexp_extract(u, URL_RX, 3))
            .withColumn(t + "q", F.regexp_extract(u, URL_RX, 4)))
    df = df.withColumn(t + "info", _hostinfo(F.col(t + "nl")))
    info = F.col(t + "info")
    df = df.withColumn(t + "host", _hostname(info)).withColumn(t + "ps", _port_text(info))
    scheme = F.when(F.col(t + "sch") == "", F.lit("https")).otherwise(F.col(t + "sch"))
    port_s = F.col(t + "ps")
    port_digits = F.regexp_replace(port_s, r"^0+(?=.)", "")
    port_ok = (port_s == "") | (port_s.rlike(r"^[0-9]+$") & (F.length(port_digits) <= 5))
    nl = F.col(t + "nl")
    df = (df.withColumn(t + "scheme", scheme)
            .withColumn(t + "pi", F.when(port_ok & (port_s != ""), port_digits.cast("int")))
            .withColumn(t + "ok", port_ok & (nl.contains("[") == nl.contains("]"))))
    scheme, host, port_i = F.col(t + "scheme"), F.col(t + "host"), F.col(t + "pi")
    default_port = ((scheme == "http") & (port_i == 80)) | ((scheme == "https") & (port_i == 443))
    netloc_out = F.when(
        (F.coalesce(port_i, F.lit(0)) > 0) & ~F.coalesce(default_port, F.lit(False)),
        F.concat(host, F.lit(":"), port_i.cast("string")),
    ).otherwise(host)
    p0 = F.col(t + "p0")
    path = F.when(p0 == "", F.lit("/")).otherwise(p0)
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, r"/+$", "")).otherwise(path)

    tracking = F.array(*[F.lit(p) for p in TRACKING_PARAMS])
    # name=value pairs with a non-blank raw value, as form decoding keeps them
    pairs = F.filter(F.split(F.col(t + "q"), "&"),
                     lambda x: (F.instr(x, "=") > 0) & (F.length(x) > F.instr(x, "=")))
    kv = F.transform(pairs, lambda x: F.struct(
        _decode(F.substring_index(x, "=", 1)).alias("k"),
        _decode(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v"),
    ))
    kv = F.filter(kv, lambda p: ~(
        F.array_contains(tracking, F.lower(p["k"]))
        & ~((F.lower(p["k"]) == "gh_jid") & host.contains("greenhouse"))
    ))
    query_out = F.array_join(
        F.transform(F.array_sort(kv), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))),
        "&",
    )
    df = (df.withColumn(t + "nlo", netloc_out).withColumn(t + "path", path)
            .withColumn(t + "qo", query_out))
    path, netloc_out, query_out = F.col(t + "path"), F.col(t + "nlo"), F.col(t + "qo")
    slash_path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    rest = (
        F.when(netloc_out != "", F.concat(F.lit("//"), netloc_out, slash_path))
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when(scheme.isin(*USES_NETLOC) & path.startswith("/"), F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    result = F.concat(scheme, F.lit(":"), rest,
                      F.when(query_out != "", F.concat(F.lit("?"), query_out)).otherwise(F.lit("")))
    df = df.withColumn(out, F.when(c.isNull() | (c == ""), c).when(F.col(t + "ok"), result))
    return df.drop(*[f for f in df.columns if f.startswith(t)])
