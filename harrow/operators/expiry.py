"""Expiry evaluation of landed pages (F1-F3) and catalog marking (M7)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators.pages import _read_jsonld, _vget, _vstr, _walk_jsonld, apply_disabled, expired_phrase, one_per_url, parse_date
from harrow.operators.scoring import ts_lit


def expired_phrases(pages: DataFrame, html: str = "html") -> DataFrame:
    """'phrase:<first phrase>' or NULL."""
    return pages.withColumn("expired_reason", expired_phrase(F.col(html)))


def disabled_apply(pages: DataFrame, html: str = "html") -> DataFrame:
    """every apply button/link is disabled (and there is at least one)."""
    return pages.withColumn("apply_disabled", apply_disabled(F.col(html)))


def evaluate_expiry(pages: DataFrame, now: dt.datetime, html: str = "html") -> DataFrame:
    """is_expired, reason, expires_at per landed page.

    404/410 expire; 5xx never do (transient); then a past JSON-LD validThrough,
    an expiry phrase, or all apply buttons disabled.
    """
    df = _read_jsonld(pages, html)
    # before the Python step, so that html isn't queued for it
    df = df.withColumn("__phrase", expired_phrase(F.col(html))).withColumn("__btn", apply_disabled(F.col(html)))
    df = _walk_jsonld(df, "__node")
    df = df.withColumn("__exp", parse_date(_vstr(_vget(F.col("__node"), "$.validThrough"))))
    status = F.col("status_code")
    code = F.concat(F.lit("http_"), status.cast("string"))
    past = F.col("__exp").isNotNull() & (F.col("__exp") < ts_lit(now))
    reason = (F.when(status.isin(404, 410), code).when(status >= 500, code)
              .when(past, F.lit("validThrough_past")).when(F.col("__phrase").isNotNull(), F.col("__phrase"))
              .when(F.col("__btn"), F.lit("apply_button_disabled")))
    expired = (status.isin(404, 410) | ((status < 500) & (past | F.col("__phrase").isNotNull() | F.col("__btn"))))
    return (df.withColumn("is_expired", F.coalesce(expired, F.lit(False))).withColumn("reason", reason)
              .withColumn("expires_at", F.when(~status.isin(404, 410) & (status < 500) & past, F.col("__exp")))
              .drop("__node", "__exp", "__phrase", "__btn"))


def mark_expired(catalog: DataFrame, pages: DataFrame, now: dt.datetime, key: str = "ord",
                 url: str = "url", order: str | None = None) -> DataFrame:
    """M7: check active catalog rows against their landed page; set
    last_checked_at=now, status='expired' when expired.  Rows without a page
    are 'unfetchable' (checked, not expired).  Page features are computed
    before the join so html never crosses the shuffle; of pages landed twice the
    first by ``order`` counts."""
    landed = [F.col(order).alias("__landed")] if order else []
    checks = evaluate_expiry(pages, now).select(F.col(url).alias("__url"), "is_expired", "reason", *landed)
    checks = one_per_url(checks, "__url", "__landed" if order else None)
    active = F.col("status") == "active"
    j = catalog.join(checks, catalog[url] == F.col("__url"), "left")
    return j.select(
        *[c for c in catalog.columns if c not in ("status", "last_checked_at")],
        F.when(active & F.coalesce(F.col("is_expired"), F.lit(False)), F.lit("expired")).otherwise(F.col("status")).alias("status"),
        F.when(active, ts_lit(now)).otherwise(F.col("last_checked_at")).alias("last_checked_at"),
        F.when(active, F.coalesce(F.col("reason"), F.when(F.col("__url").isNull(), F.lit("unfetchable")))).alias("check_reason"),
    )
