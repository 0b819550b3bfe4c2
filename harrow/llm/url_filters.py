"""URL filters: pattern rules indexed by their rarest literal token.

A URL is judged by the longest rule that fits it.  Every rule is compiled to one
regular expression over ``host`` + newline + ``path`` and to the literal tokens
that any fitting URL must contain.  The index holds each rule once, under that
of its tokens which the fewest URLs contain.  A URL looks up its own tokens and
runs only the expressions found there.  All of it is DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import ascii_lower, fresh

#: What separates literal tokens in hosts and paths.
TOKEN_BREAK = "[./]+"


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains; the path begins with ``path`` (letters compared as they are)."""
    verdict: str
    host: str
    path: str = "/"
    tokens: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        host = [x for x in self.host.split(".") if x]
        # the last piece of a path may go on in the url, so it is no whole token unless a slash closes it
        path = [x for x in self.path.split("/")[:-1] if x]
        path = [t for x in path for t in re.split(r"[.]+", x) if t]
        if not host:
            raise ValueError(f"a rule needs a host: {self}")
        object.__setattr__(self, "tokens", tuple(dict.fromkeys(host + path)))

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"^(?:[^\n]*[.])?\Q{self.host}\E\n\Q{self.path}\E"


#: The rule list of the registered query, longest fitting rule wins.
RULES = (
    Rule("allow", "org"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_rows(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(rule, verdict, pattern, size, token): one row for each literal token of a rule."""
    rows = F.array(*[F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"),
                              F.lit(r.pattern).alias("pattern"), F.lit(len(r.text)).alias("size"),
                              F.array(*map(F.lit, r.tokens)).alias("tokens")) for r in rules])
    return spark.range(1, numPartitions=1).select(F.inline(rows)).withColumn("token", F.explode("tokens")).drop("tokens")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` plus host, path, rule and verdict (existing columns of these names are replaced).

    Null urls and urls without ``://`` have empty host and path, fit no rule and
    get ``default``, as does every url that no rule fits.  Rules of equal length:
    the one whose text sorts last wins, then the verdict that sorts last.  An
    empty rule list gives ``default`` everywhere.  Repeated urls are judged
    once each value and joined back, so equal rows get equal verdicts.

    Shuffles carry urls and candidates only: token counts are pre-aggregated per
    map task, candidates are reduced to the best rule per url before and after
    the shuffle, and the last join leaves splitting a hot url to Spark.
    """
    spark = pages.sparkSession
    pages = pages.drop("host", "path", "rule", "verdict")
    own_url, best = fresh(pages, "_url", "_best")
    out = pages.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    if not rules:
        return out.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    tokens = F.filter(F.array_distinct(F.split(F.concat("_host", F.lit("/"), "_path"), TOKEN_BREAK)), lambda t: t != "")
    seen = (pages.where(F.col(url).contains("://"))
                 .select(F.col(url).alias(own_url), url_host(F.col(url)).alias("_host"), url_path(F.col(url)).alias("_path")))
    urls = seen.withColumn("token", F.explode(tokens))
    rows = _rule_rows(spark, rules)
    counts = urls.join(rows.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    index = (rows.join(counts, "token", "left")
                 .groupBy("rule", "verdict", "pattern", "size")
                 .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")))
    fits = (urls.join(index, "token")
                .where(F.expr("concat(_host, '\n', _path) rlike pattern"))
                .groupBy(own_url)
                .agg(F.max(F.struct("size", "rule", "verdict")).alias(best)))
    return (out.join(fits, F.col(url) == F.col(own_url), "left")
               .withColumn("rule", F.col(f"{best}.rule"))
               .withColumn("verdict", F.coalesce(F.col(f"{best}.verdict"), F.lit(default)))
               .drop(own_url, best))
