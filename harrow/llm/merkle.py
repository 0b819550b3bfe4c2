"""Merkle manifest of a dataset, and the proof of every row climbed by a recursive query.

Every row is a leaf: the SHA-256 of its fields, each with its length.  Leaves of
one group (``lang``) ascend by id and every FAN consecutive nodes become their
parent until one remains, the group's subroot; subroots in the order of the
groups become the root the same way.

Built levels are stored as node rows linked to their parents: the node's hash,
its parent's place, and the hashes of its siblings on either side.  A Spark
recursive query then ascends from the leaves, appending the siblings of each
node passed and folding the hash.  The up to FAN leaves of one run share all
nodes above it, so they climb in one row: each has a hash of its own to fold, and
the siblings that they share are appended once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import ascii_lower, materialize

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the subroots; the trees of the groups are numbered from 0.
TOP = -1
NODE = "tree long, level int, place long, hash binary, up_tree long, up_level int, up_place long, before binary, after binary, subroot boolean"


def digest(c: Column) -> Column:
    """SHA-256 as 32 bytes; ``c`` is text or bytes."""
    return F.unhex(F.sha2(c.cast("binary"), 256))


def as_text(c: Column) -> Column:
    """Digests as lower-case hexadecimal text; several digests in a row give theirs in a row."""
    return F.lower(F.hex(c))


def encoded(fields: Sequence[Column]) -> Column:
    """What a leaf hashes: each field's UTF-8 byte count, a colon and its value; ``-`` for null."""
    values = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def tampered_with(doc_id: Column) -> Column:
    """Whether 3 divides the crc32 of the decimal id; no for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", group: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, grp, leaf, start, row): ``start`` is the leaf after tampering, null where that changes nothing.

    Written once; ``row`` tells equal rows apart.
    """
    own = [F.col(f"`{f}`") for f in fields]
    changed = [ascii_lower(c) if f == text else c for f, c in zip(fields, own)]
    found = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(group).cast("string").alias("grp"), digest(encoded(own)).alias("leaf"),
        F.when(tampered_with(F.col(doc_id)) & (ascii_lower(F.col(text)) != F.col(text)), digest(encoded(changed))).alias("start"))
    return materialize(found.withColumn("row", F.monotonically_increasing_id()))


def ranked(found: DataFrame) -> DataFrame:
    """``found`` plus tree, place and n: the group's number, the leaf's place in it and the group's size.

    One range shuffle puts the leaves in order; a group of any size lies over
    many partitions.  Places then follow from the sizes of the (partition, group)
    parts, of which there are at most as many as partitions and groups together.
    """
    keys = ["grp", "doc_id", "leaf", "row"]
    sorted_ = materialize(found.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
                               .withColumn("at", F.monotonically_increasing_id()))
    parts = materialize(sorted_.groupBy("part", "grp").agg(F.count("*").alias("size"), F.min("at").alias("first")))
    # a group's number: groups that begin in earlier partitions, and those that begin in its own before it
    begun = parts.groupBy("grp").agg(F.min("part").alias("begin"), F.sum("size").alias("n"))
    per_part = begun.groupBy("begin").agg(F.count("*").alias("groups"))
    earlier = Window.orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition at most
    offsets = per_part.select("begin", F.coalesce(F.sum("groups").over(earlier), F.lit(0)).alias("offset"))
    numbered = begun.join(offsets, "begin").select("grp", "n", (
        F.col("offset") + F.row_number().over(Window.partitionBy("begin").orderBy("grp")) - 1).alias("tree"))
    previous = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("part", "grp", (F.coalesce(F.sum("size").over(previous), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = numbered.select(F.col("grp").alias("g"), "n", "tree")
    shifts = materialize(shifts.join(numbered, F.col("grp").eqNullSafe(F.col("g"))).select(
        F.col("part").alias("p"), "g", "n", "tree", "shift"))
    return sorted_.join(shifts, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g"))).select(
        "doc_id", "leaf", "start", "tree", (F.col("at") + F.col("shift")).alias("place"), "n")


def _parent_hash(children: Column) -> Column:
    return digest(F.array_join(F.transform(children, lambda c: as_text(c["hash"])), ""))


def _between(children: Column, start: Column, size: Column) -> Column:
    """The hashes of some children in a row, as bytes."""
    return F.unhex(F.array_join(F.transform(F.slice(children, start, size), lambda c: F.hex(c["hash"])), ""))


def _linked(families: DataFrame, tree: Column, level: int, subroots: bool) -> DataFrame:
    """Node rows of the children of ``families`` (tree, up, children); ``subroots``: children have tree and level of their own."""
    child = F.posexplode("children").alias("k", "x")
    own = [F.col("x.tree"), F.col("x.level"), F.lit(0).cast("long")] if subroots else [tree, F.lit(level), F.col("x.place")]
    return families.select("tree", "up", "children", child).select(
        own[0].cast("long").alias("tree"), own[1].cast("int").alias("level"), own[2].alias("place"), F.col("x.hash").alias("hash"),
        F.col("tree").alias("up_tree"), F.lit(1 if subroots else level + 1).alias("up_level"), F.col("up").alias("up_place"),
        _between(F.col("children"), F.lit(1), F.col("k")).alias("before"),
        _between(F.col("children"), F.col("k") + 2, F.greatest(F.size("children") - F.col("k") - 1, F.lit(0))).alias("after"),
        F.lit(subroots).alias("subroot"))


def _families(nodes: DataFrame, *more: str) -> DataFrame:
    """(tree, up, children, m): every FAN consecutive nodes of a tree; ``m`` is the number of nodes of the level above."""
    child = F.struct("place", "hash", *more)
    grouped = nodes.groupBy("tree", F.floor(F.col("place") / FAN).alias("up")).agg(
        F.sort_array(F.collect_list(child)).alias("children"), F.first("m").alias("m"))
    return materialize(grouped.withColumn("m", F.ceil(F.col("m") / FAN)))


def _parents(families: DataFrame) -> DataFrame:
    return families.select("tree", F.col("up").alias("place"), _parent_hash(F.col("children")).alias("hash"), "m")


def build(runs: DataFrame) -> DataFrame:
    """The node table over ``runs`` (tree, run, children, n): every level's nodes, written once, linked to their parents.

    A level is one aggregation over an eighth of the rows of the one below; the
    number of levels is the logarithm of the largest group.  Only the size of the
    widest level reaches the driver.
    """
    lone = F.col("n") == 1
    nodes = materialize(runs.select("tree", F.col("run").alias("place"), F.ceil(F.col("n") / FAN).alias("m"), F.when(
        lone, F.col("children")[0]["hash"]).otherwise(_parent_hash(F.col("children"))).alias("hash")))
    level, links, subroots = 1, [], []
    while True:
        subroots.append(nodes.where("m = 1").select("tree", F.lit(level).alias("level"), "hash"))
        nodes = nodes.where("m > 1")
        if nodes.isEmpty():
            break
        families = _families(nodes)
        links.append(_linked(families, F.col("tree"), level, False))
        nodes, level = _parents(families), level + 1
    tops = subroots[0]
    for more in subroots[1:]:
        tops = tops.unionByName(more)
    tops = materialize(tops)
    count = tops.count()
    # the subroots are nodes of the top tree, in the order of their groups
    nodes = tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(count).alias("m"), "hash",
                        F.col("tree").alias("own"), "level")
    top_level = 0
    while count > 1:
        families = (_families(nodes, "own", "level") if not top_level else _families(nodes))
        if not top_level:
            families = families.withColumn("children", F.transform("children", lambda c: F.struct(
                c["place"].alias("place"), c["hash"].alias("hash"), c["own"].alias("tree"), c["level"].alias("level"))))
        links.append(_linked(families, F.lit(TOP), top_level, not top_level))
        nodes, top_level, count = _parents(families), top_level + 1, -(-count // FAN)
    if top_level:
        root = nodes.select(F.col("tree"), F.lit(top_level).alias("level"), "place", "hash", F.lit(False).alias("subroot"))
    else:  # one group: its subroot is the root
        root = nodes.select(F.col("own").alias("tree"), "level", F.lit(0).cast("long").alias("place"), "hash", F.lit(True).alias("subroot"))
    none = F.lit(b"")
    links.append(root.select("tree", "level", "place", "hash", F.lit(None).cast("long").alias("up_tree"), F.lit(None).cast("int").alias("up_level"),
                             F.lit(None).cast("long").alias("up_place"), none.alias("before"), none.alias("after"), "subroot"))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return materialize(out)


CLIMB = """
WITH RECURSIVE climb(tree, run, at_tree, at_level, at_place, folded, siblings, subroot, root) AS (
  SELECT tree, run, tree, 1, run, folded, CAST('' AS BINARY), CAST(NULL AS BINARY), CAST(NULL AS BINARY) FROM {starts}
  UNION ALL
  SELECT c.tree, c.run, n.up_tree, n.up_level, n.up_place,
    CASE WHEN n.up_level IS NULL THEN c.folded
      ELSE transform(c.folded, h -> unhex(sha2(CAST(lower(concat(hex(n.before), hex(h), hex(n.after))) AS BINARY), 256))) END,
    concat(c.siblings, n.before, n.after),
    CASE WHEN n.subroot THEN n.hash ELSE c.subroot END,
    CASE WHEN n.up_level IS NULL THEN n.hash END
  FROM climb c JOIN {nodes} n ON c.at_tree = n.tree AND c.at_level = n.level AND c.at_place = n.place)
SELECT tree, run, folded, siblings, subroot, root FROM climb WHERE root IS NOT NULL"""


def climb(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, run, folded, siblings, subroot, root) of every run at the top of the tree, by the recursive query.

    ``starts`` (tree, run, folded) stands at the runs' first nodes.  Each step
    joins the rows of one level with the node table; the step out of the root
    ends the climb.  The recursion is as deep as the tree; its rows grow with the
    input, so Spark's limit on their number is lifted while it runs.
    """
    spark, key = starts.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        return materialize(spark.sql(CLIMB.format(starts="{starts}", nodes="{nodes}"), starts=starts, nodes=nodes))
    finally:
        spark.conf.set(key, before)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", group: str = "lang", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Null fields are ``-``.  Null ids come first in their group, equal ids by
    leaf, and equal rows are leaves of their own; a null id is never tampered
    with.  The null group comes first, the others bytewise.  A group of one row
    has that leaf as its subroot, one group alone has its subroot as the root.
    An empty table gives an empty table.  Other columns are not read.
    """
    found = leaves(docs, fields, doc_id, group, text)
    if found.isEmpty():
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    child = F.struct("place", F.col("leaf").alias("hash"), "start", "doc_id")
    runs = materialize(ranked(found).groupBy("tree", F.floor(F.col("place") / FAN).alias("run")).agg(
        F.sort_array(F.collect_list(child)).alias("children"), F.first("n").alias("n")))
    nodes = build(runs)

    def run_text(children: Column, k: Column, own: Column) -> Column:
        return F.array_join(F.transform(children, lambda c, i: F.when(i == k, own).otherwise(as_text(c["hash"]))), "")

    first = F.transform("children", lambda c, k: F.when(F.col("n") == 1, F.coalesce(c["start"], c["hash"])).otherwise(
        digest(run_text(F.col("children"), k, as_text(F.coalesce(c["start"], c["hash"]))))))
    top = climb(runs.select("tree", "run", first.alias("folded")), nodes)
    leaf = F.posexplode(F.arrays_zip("children", "folded")).alias("k", "x")
    out = runs.join(top, ["tree", "run"]).select("children", "siblings", "subroot", "root", leaf)
    proof = F.concat(run_text(F.col("children"), F.col("k"), F.lit("")), as_text(F.col("siblings")))
    return out.select(
        F.col("x.children.doc_id").alias("doc_id"), as_text(F.col("x.children.hash")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"),
        as_text(F.col("root")).alias("root"), F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        as_text(F.col("x.folded")).alias("folded_root"), (F.col("x.folded") == F.col("root")).alias("verified"))
