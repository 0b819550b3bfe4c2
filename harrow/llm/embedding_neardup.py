"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

Vectors of one label are compared tile by tile.  A unit vector x is written as
s * q + e with int8 codes q; the length of e is known exactly.  For two vectors
the product of the codes misses the true cosine by at most
|s q| |e'| + |e| |s' q'| + |e| |e'|.  Pairs whose upper bound reaches the
threshold are computed again in double precision, and only those decide.

Equal vectors are one node, so copies are never paired.  The nodes of a label
are dealt to tiles of about TILE; each pair of tiles is a task unit.  A unit
reports how many links each node has and how its nodes hang together, so its
output grows with its nodes and not with its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import materialize, prepare_python
from harrow.llm.components import components

THRESHOLD, TILE = 0.93, 2048
#: Rounding of the double-precision bound itself.
SLACK = 1e-9
#: Float32 products of int8 codes are exact up to this dimension (127 * 127 * 1040 < 2 ** 24); beyond, doubles are used.
EXACT_DIM = 1040


def node_of(label: object, vector: np.ndarray) -> bytes:
    """128 bits for a label and a vector (-0.0 is 0.0)."""
    return hashlib.blake2b(repr(label).encode() + b"\0" + (vector + 0.0).tobytes(), digest_size=16).digest()


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scale, |scale * codes| and |error| of the unit vectors."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    kept = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.sqrt((kept * kept).sum(axis=1)), np.sqrt(((unit - kept) ** 2).sum(axis=1))


def near_pairs(left: np.ndarray, right: np.ndarray, threshold: float, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes (i, j) with cosine >= threshold in double precision, some rows of ``left`` at a time."""
    kind = np.float32 if left.shape[1] <= EXACT_DIM else np.float64
    codes, scale, size, error = quantise(left)
    codes2, scale2, size2, error2 = quantise(right)
    norm, norm2 = np.sqrt((left * left).sum(axis=1)), np.sqrt((right * right).sum(axis=1))
    codes2 = codes2.astype(kind).T
    for k in range(0, len(left), rows):
        part = slice(k, k + rows)
        bound = (codes[part].astype(kind) @ codes2).astype(np.float64)
        bound *= scale[part, None] * scale2[None, :]
        bound += size[part, None] * error2[None, :] + error[part, None] * (size2 + error2)[None, :]
        i, j = np.nonzero(bound >= threshold - SLACK)
        i += k
        for c in range(0, len(i), 65536):
            a, b = i[c:c + 65536], j[c:c + 65536]
            exact = np.einsum("ij,ij->i", left[a], right[b]) / (norm[a] * norm2[b])
            yield a[exact >= threshold], b[exact >= threshold]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) after also linking a with b."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def valid_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, dim, node, vector) of the rows; node is null for rows that link with nothing."""
    schema = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label")).schema
    prepare_python(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, nodes, raw = [], [], []
            for name, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                good = value and name is not None and None not in value
                v = np.array(value, dtype=np.float64) if good else None
                # squares must neither overflow nor vanish
                if good and np.isfinite(v).all() and np.isfinite(s := float(v @ v)) and s > 0:
                    dims.append(len(v))
                    nodes.append(node_of(name, v))
                    raw.append(v.tobytes())
                else:
                    dims.append(None), nodes.append(None), raw.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(nodes, pa.binary()),
                 pa.array(raw, pa.binary())], ["vec_id", "label", "dim", "node", "vector"])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding")).mapInArrow(
        run, ", ".join([*columns, "dim int", "node binary", "vector binary"]))


def tile_links(nodes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(node, root, links): links found for a node in one unit, weighted by copies, and a node it hangs together with."""
    sizes = materialize(nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    units = (nodes.join(sizes, ["label", "dim"]).withColumn("i", own)
                  .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
                  .select("label", "dim", F.least("i", "j").alias("first"), F.greatest("i", "j").alias("second"),
                          (F.col("i") <= F.col("j")).alias("is_first"), "node", "copies", "vector"))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table.column("node").to_pylist(), dtype="S16"), kind="stable")
        table = table.take(pa.array(order))
        names, copies = table.column("node").to_pylist(), table.column("copies").to_numpy()
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(names), -1)
        first = table.column("is_first").to_numpy(zero_copy_only=False)
        alone = bool(first.all())
        left = np.flatnonzero(first)
        right = left if alone else np.flatnonzero(~first)
        degree, label = np.zeros(len(names), np.int64), np.arange(len(names))
        if len(left) and len(right):
            for a, b in near_pairs(vectors[left], vectors[right], threshold):
                a, b = left[a], right[b]
                if alone:
                    a, b = a[a != b], b[a != b]
                np.add.at(degree, a, copies[b])
                if not alone:
                    np.add.at(degree, b, copies[a])
                if len(a):
                    label = _join(label, a, b)
        linked = np.flatnonzero((degree > 0) | (label != np.arange(len(names))))
        return pa.table({"node": pa.array([names[i] for i in linked], pa.binary()),
                         "root": pa.array([names[label[i]] for i in linked], pa.binary()),
                         "links": pa.array(degree[linked])})

    return units.groupBy("label", "dim", "first", "second").applyInArrow(run, "node binary, root binary, links long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept, label) for every row of ``vectors``.

    Two rows link if their labels are equal and not null, their vectors are of
    the same length and their cosine in double precision is >= ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing.  n_links counts the other rows linked directly, rows
    with equal vectors included.  component_id is the smallest vec_id that
    links reach; a null vec_id names a component only if it has no other id,
    and is never kept.  Rows that repeat a vec_id and a vector get equal
    results.  An empty table gives an empty table.
    """
    rows = materialize(valid_vectors(vectors, vec_id, embedding, label))
    nodes = materialize(rows.where("node is not null").groupBy("label", "dim", "node").agg(
        F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id")))
    found = materialize(tile_links(nodes, threshold, tile))
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = materialize(nodes.select("node", "copies", "first_id").join(roots, "node", "left").join(degrees, "node", "left")
                         .select("node", "first_id", F.coalesce("root", "node").alias("root"),
                                 (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialize(rooted.join(ids, "root").select(F.col("node").alias("_node"), "n_links", "component_id"))
    out = rows.join(classes, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), "label")
