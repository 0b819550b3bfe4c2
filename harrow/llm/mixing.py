"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixed corpus.  Its rate is the number of
times that a document of it should appear on average: target share times the
wanted size, over the source's own size.  A document's count is the inverse of
the Poisson distribution with that mean at a uniform number hashed from
(seed, doc_id, text); it is then exploded into that many copies and all copies are put into a
global order by another hash.  All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import materialize

#: Production parameters: three named sources, every other one weighs 1.
WEIGHTS = {"src0": 6.0, "src1": 2.0, "src2": 0.5}
SEED = "mix-1"
#: The distribution is tabulated from mean - TAIL * sqrt(mean) to mean + TAIL * sqrt(mean) + TAIL_LEAST copies; the mass outside is under 2**-52.
TAIL, TAIL_LEAST = 12, 40
#: Rates up to this are tabulated from 0 on; above, Stirling's series is exact to a double's last digits at every value in the table.
SMALL_RATE = 1000
#: Copies are exploded in blocks of this many, so that no array grows with a document's count.
BLOCK = 1 << 16


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 over the parts, joined by colons; null counts as empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0,
                 epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, n_docs, n_bytes, target_share, rate): one row per source of ``docs``, the null source included.

    Sizes are UTF-8 bytes of whole texts.  Target shares are the weights over
    their sum.  The mixed corpus has ``epochs`` times the bytes of the input on
    average.  Sources without text have the rate ``epochs``.  Only two totals
    reach the driver.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n_bytes"))
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    sizes = materialize(sizes.withColumn("weight", F.when(F.col("n_bytes") > 0, weight).otherwise(F.lit(0.0))))
    all_weight, all_bytes = sizes.agg(F.sum("weight"), F.sum("n_bytes")).first()
    share = F.col("weight") / F.lit(all_weight or 1.0)
    rate = F.when(F.col("n_bytes") > 0, F.lit(float(epochs)) * F.col("target_share") * F.lit(float(all_bytes or 0)) / F.col("n_bytes"))
    return (sizes.withColumn("target_share", share).withColumn("rate", F.coalesce(rate, F.lit(float(epochs))))
                 .select("source", "n_docs", "n_bytes", "target_share", "rate"))


def poisson_table(rates: DataFrame) -> DataFrame:
    """(source, first, cdf) for (source, rate): the distribution function of Poisson(rate) at first, first + 1, ...

    Only TAIL deviations around the mean are tabulated, one row a value and
    2 * TAIL * sqrt(rate) + TAIL_LEAST rows a source; a running sum over them adds
    up logarithms, then terms.  A term far from 0 starts from Stirling's
    series in a form without cancellation, so any rate works.
    """
    rate, k = F.col("rate"), F.col("k")
    first = F.when(rate > SMALL_RATE, F.floor(rate - TAIL * F.sqrt(rate))).otherwise(F.lit(0)).cast("long")
    last = F.when(rate > 0, F.floor(rate + TAIL * F.sqrt(rate) + TAIL_LEAST)).otherwise(F.lit(0)).cast("long")
    x = (rate - k) / k
    far = k * (F.log1p(x) - x) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k)
    step = F.when(k > F.col("first"), F.log(rate) - F.log(k)).when(k == 0, -rate).otherwise(far)
    upward = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    terms = (rates.select("source", "rate", first.alias("first"), F.explode(F.sequence(first, last)).alias("i")).withColumn("k", F.col("i").cast("double"))
                  .withColumn("log_p", F.sum(step).over(upward)).withColumn("total", F.sum(F.exp("log_p")).over(upward)))
    # the distribution function never falls, so its values sort as their places do
    return terms.groupBy("source", "first").agg(F.sort_array(F.collect_list("total")).alias("cdf"))


def copy_count(u: Column, first: Column, cdf: Column) -> Column:
    """How many values of the distribution function are <= ``u``: those before ``first`` are.

    ``u`` is bound by a one-element array: inside the filter it would be hashed again for every term.
    """
    def count(v: Column) -> Column:
        return first + F.size(F.filter(cdf, lambda c: c <= v))
    return F.get(F.transform(F.array(u), count), F.lit(0))


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default_weight: float = 1.0, epochs: float = 1.0,
        seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of ``docs`` as often as its count says, with ``copy`` (from 0) and ``shuffle_key``, in global random order.

    Rows with equal doc_id and text get equal counts (a repeated row is
    repeated equally often again).  Null doc_id, text or source are values of
    their own; null text has no bytes.  An empty table gives an empty
    table.  Existing columns named copy or shuffle_key are replaced.

    The rates need one small aggregation per source.  The join with them leaves
    it to Spark whether to broadcast (few sources) or to split a hot source.
    The only shuffle of texts deals the copies out by their uniform key and sorts
    each partition by it: a random order of the whole, without a sampling pass.
    """
    docs = docs.drop("copy", "shuffle_key")
    tables = poisson_table(source_rates(docs, weights, default_weight, epochs, source, text))
    rates = materialize(tables.select(F.col("source").alias("__mix_source"), F.col("first").alias("__mix_first"), F.col("cdf").alias("__mix_cdf")))
    u = unit_hash(F.lit(seed), F.col(doc_id), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    out = docs.join(rates, F.col(source).eqNullSafe(F.col("__mix_source")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = out.select(*own, copy_count(u, F.col("__mix_first"), F.col("__mix_cdf")).alias("__mix_n")).where("__mix_n > 0")
    out = out.select(*own, "__mix_n", F.explode(F.expr(f"sequence(0L, (__mix_n - 1) div {BLOCK})")).alias("__mix_block"))
    out = out.select(*own, F.explode(F.expr(
        f"sequence(int(__mix_block * {BLOCK}), int(least(__mix_n, (__mix_block + 1) * {BLOCK}) - 1))")).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
                            F.col("copy").cast("string")).cast("binary"))
    return out.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
