"""Text column builders: HTML to text, snippets, name/title normalization,
token sets, Jaccard, keyword tagging and Python-style title case.

All are built-in expressions except HTML entity decoding, which runs as one
Arrow-batched pandas UDF (the standard library's HTML5 entity table).
"""

from __future__ import annotations

import html as _html
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from harrow.functions.dictionaries import (
    COMPANY_SUFFIX_PATTERN,
    TITLE_NOISE_PATTERN,
    TITLE_SPLIT_PATTERN,
)
from harrow.functions.regex import PY_WS_CLASS, PY_WS_EDGES, PY_WS_RUN, escape

SCRIPT_STYLE_RX = r"(?is)<(script|style)[^>]*>.*?</\1>"
TAG_RX = r"<[^>]+>"
CASED = r"\p{Lu}\p{Ll}\p{Lt}"


@pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(_html.unescape, na_action="ignore")


def unescape_html(c: Column) -> Column:
    """HTML entity decoding (named, numeric, legacy forms); only texts with an ampersand are sent to Python."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, PY_WS_RUN, " ")


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, PY_WS_EDGES, "")


def html_to_text(c: Column) -> Column:
    """Drop script/style blocks, tags to spaces, decode entities, collapse
    whitespace, trim.  NULL and '' give ''."""
    t = F.regexp_replace(c, SCRIPT_STYLE_RX, " ")
    t = F.regexp_replace(t, TAG_RX, " ")
    t = unescape_html(t)
    t = F.trim(collapse_ws(t))
    return F.coalesce(t, F.lit(""))


def cut_snippet(text: Column, limit: int) -> Column:
    """Cut already-clean text: over ``limit`` chars keeps the first limit-1
    chars up to the last space and appends an ellipsis."""
    head = F.regexp_replace(F.substring(text, 1, limit - 1), r" [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit("…")))


def snippet(c: Column, limit: int = 400) -> Column:
    return cut_snippet(html_to_text(c), limit)


def normalize_company(c: Column) -> Column:
    """Lower, drop legal suffix words, non [a-z0-9 ] to space, collapse, trim."""
    t = F.lower(c)
    t = F.regexp_replace(t, "(?iU)" + COMPANY_SUFFIX_PATTERN, " ")
    t = F.regexp_replace(t, r"[^a-z0-9 ]+", " ")
    t = F.trim(collapse_ws(t))
    return F.coalesce(t, F.lit(""))


def normalize_title(c: Column) -> Column:
    """Lower, keep the part before a ' - ', ' | ', ' at ' separator, non-alnum
    to space, collapse, trim."""
    t = F.try_element_at(F.split(F.lower(c), "(?U)" + TITLE_SPLIT_PATTERN, 2), F.lit(1))
    t = F.regexp_replace(t, r"[^a-z0-9 ]+", " ")
    t = F.trim(collapse_ws(t))
    return F.coalesce(t, F.lit(""))


def title_key(c: Column) -> Column:
    """normalize_title with season/year/intern/work-mode noise words removed."""
    t = F.regexp_replace(normalize_title(c), "(?iU)" + TITLE_NOISE_PATTERN, " ")
    return F.trim(collapse_ws(t))


def token_set(c: Column) -> Column:
    """Distinct whitespace tokens (empty array for NULL/blank)."""
    toks = F.filter(F.split(F.coalesce(c, F.lit("")), "(?U)" + PY_WS_CLASS + "+"), lambda x: x != "")
    return F.array_distinct(toks)


def jaccard(a: Column, b: Column) -> Column:
    """|A n B| / |A u B| over token arrays; 0 when either is empty."""
    inter = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(F.array_union(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


def keyword_haystack(c: Column) -> Column:
    """Case-folded text with whitespace runs collapsed (no trim)."""
    return collapse_ws(F.lower(F.coalesce(c, F.lit(""))))


def term_pattern(term: str) -> str:
    return r"(?<![a-z0-9])" + escape(term) + r"(?![a-z0-9])"


def has_any(hay: Column, terms) -> Column:
    """True when any term occurs in a prepared haystack, not next to [a-z0-9].

    Only texts that contain a term evaluate the pattern.
    """
    terms = list(terms)
    if not terms:
        return F.lit(False)
    return reduce(or_, [hay.contains(t) for t in terms]) & hay.rlike(r"(?<![a-z0-9])(?:" + "|".join(escape(t) for t in terms) + r")(?![a-z0-9])")


def matched_terms(hay: Column, terms) -> Column:
    """Terms (in dictionary order) found in a prepared haystack.

    Only texts that contain a term evaluate its pattern.
    """
    terms = list(terms)
    if not terms:
        return F.array().cast("array<string>")
    found = F.array_compact(F.array(*[
        F.when(hay.contains(t) & hay.rlike(term_pattern(t)), F.lit(t)) for t in terms
    ]))
    return F.when(hay.isNotNull(), found).otherwise(F.array().cast("array<string>"))


def python_title(c: Column) -> Column:
    """str.title(): upper the first cased letter of each cased run, lower the rest."""
    runs = F.regexp_extract_all(c, F.lit(f"([{CASED}]+|[^{CASED}]+)"), 1)
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))),
        "",
    )


def nullif_blank(c: Column) -> Column:
    return F.when(c != "", c)


def sha32(*parts: Column) -> Column:
    """First 32 hex chars of SHA-256 over parts joined by '|'."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)
