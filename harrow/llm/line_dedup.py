"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of ROLLING neighbouring lines puts a boundary
after a line when it is divisible by DIVISOR, so boundaries inside a shared
passage are the same in every document, wherever it stands.  A line of
LONG_WORDS words or more is a passage by itself and always a chunk of its own.
Chunks of two or more lines, and such long lines, that occur more than once in
the whole corpus are removed, all but their first occurrence, after their bytes
were compared.  All of it is DataFrame functions.

Chunks leave lines of a shared passage standing where no boundary fits its
edges.  ``dedup_passages`` has no chunks: it follows repeated pairs of
neighbouring lines to both ends of the passage and removes it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import materialize

ROLLING, DIVISOR, LONG_WORDS = 2, 2, 50
FACTOR = 31


def hash_prefix(c: Column, digits: int) -> Column:
    """The first hexadecimal digits of an md5 as a long."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, digits), 16, 10).cast("long")


def chunks(text: Column) -> Column:
    """Array of (start, size, long) over the lines of ``text``: line numbers from 0, and whether it is one long line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    marked = F.transform(lines, lambda x: F.struct(
        hash_prefix(x, 8).alias("h"),
        ((F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))) >= LONG_WORDS - 1).alias("long")))

    def ends(rows: Column) -> Column:
        """Number of lines up to each boundary."""
        def cut(i: Column) -> Column:
            rolled = F.get(rows, i - 1)["h"]
            for back in range(1, ROLLING):
                rolled = rolled + F.coalesce(F.get(rows, i - 1 - back)["h"], F.lit(0)) * FACTOR ** back
            return ((rolled % DIVISOR == 0) | F.get(rows, i - 1)["long"] | F.coalesce(F.get(rows, i)["long"], F.lit(False))
                    | (i == F.size(rows)))
        return F.filter(F.sequence(F.lit(1), F.size(rows)), cut)

    def spans(pair: Column) -> Column:
        def span(e: Column, k: Column) -> Column:
            start = F.coalesce(F.get(pair["e"], k - 1), F.lit(0))
            return F.struct(start.alias("start"), (e - start).alias("size"), F.get(pair["rows"], start)["long"].alias("long"))
        return F.transform(pair["e"], span)

    # one-element arrays bind what is used again, so that it is computed once
    bound = F.transform(F.array(marked), lambda rows: F.struct(rows.alias("rows"), ends(rows).alias("e")))
    return F.get(F.transform(bound, spans), F.lit(0))


def _chunk_text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["start"] + 1, chunk["size"]), "\n")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``, plus removed_chunks and removed_lines (replaced if they exist).

    The first occurrence by (doc_id, md5 of the text, line) stays, null doc_ids
    last.  Rows equal in doc_id and text are one document and get the same
    result, so their lines don't count as repeated.  Blank chunks are left
    alone, as are texts in which nothing repeats (null stays null).  An empty
    table gives an empty table.

    Chunk hashes are counted with map-side aggregation; only texts of chunks
    whose hash repeats are shuffled and compared.  Joins against written tables
    leave splitting a hot chunk to Spark.
    """
    docs = docs.drop("removed_chunks", "removed_lines")
    place = F.struct(F.col("_id").isNull().alias("n"), F.coalesce("_id", F.lit(0)).alias("i"), F.col("_hash").alias("t"),
                     F.col("x.start").alias("s"))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    whole = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    occurrences = (docs.select(F.col(doc_id).alias("_id"), whole.alias("_hash"), lines.alias("_lines"), chunks(F.col(text)).alias("_chunks"))
                       .select("_id", "_hash", "_lines", F.explode(F.filter("_chunks", lambda c: (c["size"] > 1) | c["long"])).alias("x"))
                       .select(place.alias("place"), F.col("x.size").alias("size"), _chunk_text(F.col("_lines"), F.col("x")).alias("chunk"))
                       .where(F.trim(F.replace("chunk", F.lit("\n"), F.lit(""))) != "")
                       .withColumn("h", hash_prefix(F.col("chunk"), 15)))
    repeated = materialize(occurrences.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b"))
                                      .where("a <> b").select("h"))
    # the same plan at every size: texts are dealt out by hash and looked up there without sorting them
    candidates = materialize(occurrences.join(repeated.hint("shuffle_hash"), "h", "left_semi").select("h", "chunk", "place", "size"))
    same = materialize(candidates.groupBy("h", "chunk").agg(F.min("place").alias("first"), F.max("place").alias("last"))
                                 .where("first <> last").drop("last"))
    removed = (candidates.join(same, ["h", "chunk"]).where("place <> first")
                         .select(F.when(~F.col("place.n"), F.col("place.i")).alias("__line_id"), F.col("place.t").alias("__line_hash"),
                                 F.col("place.s").alias("start"), "size").distinct()
                         .groupBy("__line_id", "__line_hash")
                         .agg(F.collect_list("start").alias("__line_gone"), F.sum("size").alias("__line_n")))
    out = docs.join(removed, F.col(doc_id).eqNullSafe(F.col("__line_id")) & (whole == F.col("__line_hash")), "left")
    kept = F.filter(chunks(F.col(text)), lambda c: ~F.array_contains(F.col("__line_gone"), c["start"]))
    rest = F.array_join(F.transform(kept, lambda c: _chunk_text(lines, c)), "\n")
    return (out.withColumn(text, F.when(F.col("__line_gone").isNull(), F.col(text)).otherwise(rest))
               .withColumn("removed_chunks", F.greatest(F.size("__line_gone"), F.lit(0)).cast("long"))
               .withColumn("removed_lines", F.coalesce("__line_n", F.lit(0)).cast("long"))
               .drop("__line_id", "__line_hash", "__line_gone", "__line_n"))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _runs(units: DataFrame) -> DataFrame:
    """Runs of ``units`` that follow each other in their own text and in that of their first places, if they count.

    (n, i, t, start, end) of each, with the head text's (hn, hi, ht).  A run counts with LONG_WORDS words or two lines
    that aren't blank.
    """
    aligned = ["n", "i", "t", "hn", "hi", "ht", "offset"]
    own = Window.partitionBy(*aligned).orderBy("start", "size")
    end = F.col("start") + F.col("size")
    before = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    following = F.lead("start").over(Window.partitionBy(*aligned, "run").orderBy("start", "size"))

    def lines(first: str, second: str) -> Column:
        """A line of a run is counted with the last unit that begins with it, the run's last line with its last unit."""
        return (F.when(F.col("next") == F.col("start"), 0).when(F.col("next").isNull(), F.col(first) + F.col(second))
                 .otherwise(F.col(first)))

    return (units.withColumn("offset", F.col("start") - F.col("hs"))
                 .withColumn("fresh", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
                 .withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn("next", following)
                 .groupBy(*aligned, "run")
                 .agg(F.min("start").alias("start"), F.max(end).alias("end"), F.sum(lines("w1", "w2")).alias("words"),
                      F.sum(lines("f1", "f2")).alias("filled"))
                 .where((F.col("words") >= LONG_WORDS) | (F.col("filled") >= 2))
                 .select("n", "i", "t", "start", "end", "hn", "hi", "ht"))


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, plus removed_runs and removed_lines (replaced if they exist).

    A line pair, or a line of LONG_WORDS words or more, is repeated if it
    occurred before; its head is the first place by (doc_id, md5 of the text,
    line), null doc_ids last.  A run is a chain of repeated units that overlap
    and whose heads follow each other in one text in the same way, so it is a
    copy of one stretch of that text.  Runs of LONG_WORDS words, or of two lines
    that aren't blank, are removed whole.

    A run goes only if the stretch that it copies stays: heads of which a line
    would itself be cut lend nothing, and the runs are found again without them.
    That leaves fewer runs, so the remaining heads stay whole; every removed
    run stands unbroken in the text of its heads.  Later copies of a unit whose
    head is cut stay unless other units cover them.  A unit that overlaps its
    own head is no copy.  Rows equal in doc_id and text are one document and get
    the same result.  Texts in which nothing is removed are left alone (null stays null).

    Units are counted by a hash with map-side aggregation; of those whose hash
    repeats the text is shuffled and compared.  Afterwards places alone are
    moved; runs are found by windows over one pair of texts and one offset.
    """
    docs = docs.drop("removed_runs", "removed_lines")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    whole = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    place = F.struct(F.col("_id").isNull().alias("n"), F.coalesce("_id", F.lit(0)).alias("i"), F.col("_hash").alias("t"),
                     F.col("x.start").alias("s"))
    sized = F.transform("_lines", lambda x: F.struct(_words(x).alias("w"), (F.trim(x) != "").cast("int").alias("f")))

    def unit(start: Column, size: int, first: Column, w2: Column, f2: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(size).alias("size"), first["w"].alias("w1"), first["f"].alias("f1"),
                        w2.alias("w2"), f2.alias("f2"))

    pairs = F.transform(F.slice("_sized", 2, F.greatest(F.size("_sized") - 1, F.lit(0))),
                        lambda y, i: unit(i, 2, F.get("_sized", i), y["w"], y["f"]))
    long = F.filter(F.transform("_sized", lambda x, i: unit(i, 1, x, F.lit(0), F.lit(0))), lambda u: u["w1"] >= LONG_WORDS)
    units = (docs.select(F.col(doc_id).alias("_id"), whole.alias("_hash"), lines.alias("_lines"))
                 .select("*", sized.alias("_sized"))
                 .select("_id", "_hash", "_lines", F.explode(F.concat(pairs, long)).alias("x"))
                 .select(place.alias("place"), "x.size", "x.w1", "x.f1", "x.w2", "x.f2", _chunk_text(F.col("_lines"), F.col("x")).alias("chunk"))
                 .withColumn("h", hash_prefix(F.col("chunk"), 15)))
    seen = F.xxhash64("place")
    repeated = materialize(units.groupBy("h").agg(F.min(seen).alias("a"), F.max(seen).alias("b")).where("a <> b").select("h"))
    candidates = materialize(units.join(repeated.hint("shuffle_hash"), "h", "left_semi"))
    first = materialize(candidates.groupBy("h", "chunk").agg(F.min("place").alias("head"), F.max("place").alias("last"))
                                  .where("head <> last").drop("last"))
    head_doc = (F.col("place.n") == F.col("head.n")) & (F.col("place.i") == F.col("head.i")) & (F.col("place.t") == F.col("head.t"))
    later = materialize(
        candidates.join(first, ["h", "chunk"]).where(~(head_doc & (F.col("place.s") < F.col("head.s") + F.col("size"))))
                  .select("place.n", "place.i", "place.t", F.col("place.s").alias("start"), "size", "w1", "f1", "w2", "f2",
                          *[F.col(f"head.{c}").alias(f"h{c}") for c in "nits"]).distinct())
    cut = _runs(later).select(*[F.col(c).alias(f"h{c}") for c in "nit"], F.explode(F.expr("sequence(start, end - 1)")).alias("line")).distinct()
    head = ["hn", "hi", "ht", "hs", "size"]
    broken = materialize(later.select(*head).distinct().withColumn("line", F.explode(F.expr("sequence(hs, hs + size - 1)")))
                              .join(cut, ["hn", "hi", "ht", "line"], "left_semi").select(*head).distinct())
    runs = (_runs(later.join(broken, head, "left_anti"))
            .select(F.when(~F.col("n"), F.col("i")).alias("__line_id"), F.col("t").alias("__line_hash"), "start", "end")
            .groupBy("__line_id", "__line_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__line_runs")))
    out = docs.join(runs, F.col(doc_id).eqNullSafe(F.col("__line_id")) & (whole == F.col("__line_hash")), "left")

    # what stays are the stretches before, between and behind the runs, which may overlap
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def advance(acc: Column, run: Column) -> Column:
        gap = F.struct(acc["at"].alias("start"), run["start"].alias("end"))
        return F.struct(F.greatest(acc["at"], run["end"]).alias("at"),
                        F.when(run["start"] > acc["at"], F.concat(acc["kept"], F.array(gap))).otherwise(acc["kept"]).alias("kept"))

    def close(acc: Column) -> Column:
        return F.concat(acc["kept"], F.array(F.struct(acc["at"].alias("start"), F.size(lines).alias("end"))))

    start = F.struct(F.lit(0).alias("at"), nothing.alias("kept"))
    out = out.withColumn("__line_kept", F.aggregate("__line_runs", start, advance, close))
    rest = F.array_join(F.flatten(F.transform("__line_kept", lambda x: F.slice(lines, x["start"] + 1, x["end"] - x["start"]))), "\n")
    left = F.aggregate("__line_kept", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    return (out.withColumn("removed_runs", F.greatest(F.size("__line_runs"), F.lit(0)).cast("long"))
               .withColumn("removed_lines", F.coalesce(F.size(lines) - left, F.lit(0)).cast("long"))
               .withColumn(text, F.when(F.col("__line_runs").isNull(), F.col(text)).otherwise(rest))
               .drop("__line_id", "__line_hash", "__line_runs", "__line_kept"))
