"""DuckDB expression builders for the oracles.

The oracles restate each rule in plain SQL (RE2 regexes, DuckDB list lambdas),
independently of the Spark column builders.
"""

from __future__ import annotations

from harrow.functions.dictionaries import TRACKING_PARAMS

URL_RX = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
USES_NETLOC = ("", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
               "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn",
               "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services")


def lit_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def host_sql(u: str) -> str:
    """Lower-cased host of URL expression ``u`` ('' when none)."""
    nl = f"regexp_replace(substr(regexp_extract({u}, '{URL_RX}', 2), 3), '^.*@', '')"
    return (f"coalesce(lower(CASE WHEN contains({nl}, '[') THEN regexp_extract({nl}, '\\[([^\\]]*)', 1) "
            f"ELSE regexp_extract({nl}, '^([^:]*)', 1) END), '')")


def canonical_cte(src: str, keep: str, col: str = "url") -> str:
    """CTE chain ending in relation ``canon`` with columns ``keep`` + canonical_url."""
    trk = lit_list(TRACKING_PARAMS)
    un = lit_list(USES_NETLOC)
    return f"""
c0 AS (SELECT {keep}, {col} AS raw_url,
   regexp_replace(regexp_replace(regexp_replace({col}, '^\\s+|\\s+$', '', 'g'), '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g') AS u FROM {src}),
c1 AS (SELECT *, lower(regexp_extract(u, '{URL_RX}', 1)) AS sch0,
   regexp_replace(substr(regexp_extract(u, '{URL_RX}', 2), 3), '^.*@', '') AS info,
   substr(regexp_extract(u, '{URL_RX}', 2), 3) AS netloc,
   regexp_extract(u, '{URL_RX}', 3) AS path0, regexp_extract(u, '{URL_RX}', 4) AS q FROM c0),
c2 AS (SELECT *, CASE WHEN sch0 = '' THEN 'https' ELSE sch0 END AS scheme,
   lower(CASE WHEN contains(info, '[') THEN regexp_extract(info, '\\[([^\\]]*)', 1) ELSE regexp_extract(info, '^([^:]*)', 1) END) AS host,
   CASE WHEN contains(info, '[') THEN regexp_extract(info, '\\[[^\\]]*\\][^:]*:(.*)$', 1) ELSE regexp_extract(info, '^[^:]*:(.*)$', 1) END AS port_s FROM c1),
c3 AS (SELECT *, (port_s = '' OR (regexp_full_match(port_s, '[0-9]+') AND length(ltrim(port_s, '0')) <= 5
          AND TRY_CAST(port_s AS BIGINT) <= 65535)) AND (contains(netloc, '[') = contains(netloc, ']')) AS valid,
   CASE WHEN port_s <> '' AND regexp_full_match(port_s, '[0-9]+') AND length(ltrim(port_s, '0')) <= 5 THEN TRY_CAST(port_s AS BIGINT) END AS port_i,
   CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path1 FROM c2),
c4 AS (SELECT *,
   CASE WHEN coalesce(port_i, 0) > 0 AND NOT ((scheme = 'http' AND port_i = 80) OR (scheme = 'https' AND port_i = 443))
        THEN host || ':' || CAST(port_i AS VARCHAR) ELSE host END AS netloc_out,
   CASE WHEN length(path1) > 1 AND suffix(path1, '/') THEN rtrim(path1, '/') ELSE path1 END AS path,
   array_to_string(list_transform(list_sort(list_filter(list_transform(
       list_filter(string_split(q, '&'), lambda x: strpos(x, '=') > 0 AND length(x) > strpos(x, '=')),
       lambda x: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(substr(x, strpos(x, '=') + 1), '+', ' '))}}),
       lambda p: NOT (list_contains({trk}, lower(p.k)) AND NOT (lower(p.k) = 'gh_jid' AND contains(host, 'greenhouse'))))),
       lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&') AS q_out FROM c3),
canon AS (SELECT {keep},
   CASE WHEN raw_url IS NULL OR raw_url = '' THEN raw_url WHEN NOT valid THEN NULL ELSE
     scheme || ':' ||
     CASE WHEN netloc_out <> '' THEN '//' || netloc_out || CASE WHEN prefix(path, '/') THEN path ELSE '/' || path END
          WHEN prefix(path, '//') THEN '//' || path
          WHEN list_contains({un}, scheme) AND prefix(path, '/') THEN '//' || path
          ELSE path END
     || CASE WHEN q_out <> '' THEN '?' || q_out ELSE '' END
   END AS canonical_url FROM c4)"""


def unescape_sql(x: str) -> str:
    """Entity decoding for the entities present in the test pages (single pass:
    &amp; last so '&amp;lt;' stays '&lt;')."""
    pairs = [("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"),
             ("&middot;", "·"), ("&amp;", "&")]
    for ent, ch in pairs:
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def html_to_text_sql(x: str) -> str:
    t = f"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    t = unescape_sql(t)
    t = f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
    return f"coalesce({t}, '')"


def snippet_sql(x: str, limit: int) -> str:
    t = html_to_text_sql(x)
    return (f"CASE WHEN length({t}) <= {limit} THEN {t} "
            f"ELSE regexp_replace(substr({t}, 1, {limit - 1}), ' [^ ]*$', '') || '…' END")


def title_case_sql(x: str) -> str:
    c = "\\p{Lu}\\p{Ll}\\p{Lt}"
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '([{c}]+|[^{c}]+)', 1), "
            f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')")


def url_path_sql(u: str) -> str:
    return f"regexp_extract({u}, '{URL_RX}', 3)"


def company_from_url_sql(u: str, slug: str) -> str:
    seg = f"regexp_extract({url_path_sql(u)}, '^/*([^/]+)', 1)"
    tenant = f"split_part({host_sql(u)}, '.', 1)"
    return (f"CASE WHEN {slug} IN ('ashby', 'greenhouse', 'lever', 'smartrecruiters', 'workable') "
            f"THEN CASE WHEN {seg} <> '' THEN {title_case_sql(f'replace({seg}, ' + chr(39) + '-' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')} END "
            f"WHEN {slug} = 'workday' THEN CASE WHEN {tenant} <> '' THEN {title_case_sql(f'replace({tenant}, ' + chr(39) + '-' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')} END END")


UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def url_job_id_sql(u: str, slug: str) -> str:
    def rx(p):
        return f"nullif(regexp_extract({u}, '{p}', 1), '')"
    base = rx("/(\\d{4,})(?:[/?#]|$)")
    q = f"regexp_extract({u}, '{URL_RX}', 4)"
    gh = f"list_filter(string_split({q}, '&'), lambda p: prefix(p, 'gh_jid='))"
    return f"""CASE WHEN {slug} IN ('ashby', 'lever') THEN coalesce({rx('/[^/]+/(' + UUID + ')')}, {base})
  WHEN {slug} = 'greenhouse' THEN CASE WHEN {rx('/jobs/(\\d+)')} IS NOT NULL THEN {rx('/jobs/(\\d+)')}
      WHEN len({gh}) > 0 THEN nullif(substr({gh}[1], 8), '') ELSE {base} END
  WHEN {slug} = 'workday' THEN coalesce(replace(upper({rx('(?i)_((?:R|JR|REQ)[-_]?\\d+)')}), '_', '-'), {base})
  WHEN {slug} = 'smartrecruiters' THEN coalesce({rx('/[^/]+/(\\d{6,})')}, {base})
  WHEN {slug} = 'workable' THEN coalesce(upper({rx('(?i)/j/([0-9A-F]{6,})')}), {base})
  ELSE {base} END"""


def normalize_company_sql(x: str) -> str:
    from harrow.functions.dictionaries import COMPANY_SUFFIX_PATTERN as P
    t = f"regexp_replace(lower({x}), '{P}', ' ', 'g')"
    t = f"regexp_replace({t}, '[^a-z0-9 ]+', ' ', 'g')"
    return f"coalesce(trim(regexp_replace({t}, '\\s+', ' ', 'g')), '')"


def title_norm_sql(x: str) -> str:
    from harrow.functions.dictionaries import TITLE_SPLIT_PATTERN as P
    t = f"regexp_split_to_array(lower({x}), '{P}')[1]"
    t = f"regexp_replace({t}, '[^a-z0-9 ]+', ' ', 'g')"
    return f"coalesce(trim(regexp_replace({t}, '\\s+', ' ', 'g')), '')"


def title_key_sql(x: str) -> str:
    from harrow.functions.dictionaries import TITLE_NOISE_PATTERN as P
    t = f"regexp_replace({title_norm_sql(x)}, '{P}', ' ', 'gi')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def hay_sql(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g')"


def _re2(term: str) -> str:
    from harrow.functions.regex import escape
    return escape(term).replace("'", "''")


def term_hit_sql(h: str, term: str) -> str:
    return f"regexp_matches({h}, '(^|[^a-z0-9]){_re2(term)}($|[^a-z0-9])')"


def any_hit_sql(h: str, terms) -> str:
    return "(" + " OR ".join(term_hit_sql(h, t) for t in terms) + ")" if terms else "false"


def matched_sql(h: str, terms) -> str:
    items = ", ".join(f"CASE WHEN {term_hit_sql(h, t)} THEN '{t}' END" for t in terms)
    return f"list_filter([{items}]::VARCHAR[], lambda x: x IS NOT NULL)"


def freshness_sql(ts: str, now: str) -> str:
    age = f"((epoch_us(TIMESTAMP '{now}') - epoch_us({ts})) / 1000000.0 / 86400.0)"
    return (f"CAST(CASE WHEN {ts} IS NULL THEN 0.5 WHEN {age} <= 3 THEN 1.0 WHEN {age} <= 7 THEN 0.8 "
            f"WHEN {age} <= 14 THEN 0.6 WHEN {age} <= 30 THEN 0.3 ELSE 0.1 END AS DOUBLE)")
