"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r every one of the 64 bit positions gets a vector of r + 1 bits.  Each
non-zero vector v of r + 1 bits is a table: its mask keeps the positions whose
vector has an odd product with v.  At most r differing positions span at most r
dimensions, so some v is orthogonal to all of them, and its table puts both
fingerprints into one bucket: no pair within the radius is lost.

Only different fingerprints are compared.  Buckets are counted first; those of
one fingerprint go, larger ones are split into blocks of BLOCK fingerprints and
every pair of blocks is a task unit of its own.  A unit reports how its
fingerprints hang together, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import materialize, prepare_python
from harrow.llm.components import components

SHINGLE, RADIUS, SEED, BITS = 4, 4, 42, 64
BLOCK = 16384
#: Runs up to this length are compared pair by pair over whole batches; longer ones by growing components.
SHORT_RUN = 32
MIX = 0x9E3779B97F4A7C15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 hashes of the text's word shingles; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-1].tolist()]
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.array(hashes[k:k + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def masks(radius: int = RADIUS) -> np.ndarray:
    """The 2 ** (radius + 1) - 1 masks of the covering construction."""
    size = radius + 1
    # a fixed pseudo-random non-zero vector for each position
    vectors = np.array([1 + ((i + 1) * MIX % 2 ** 64 >> 32) % (2 ** size - 1) for i in range(BITS)], dtype=np.uint64)
    out = []
    for v in range(1, 2 ** size):
        odd = np.bitwise_count(vectors & np.uint64(v)) & 1
        out.append(sum(1 << i for i in range(BITS) if odd[i]))
    return np.array(out, dtype=np.uint64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                 *more: str) -> DataFrame:
    """(doc_id, fp) of every row, and the columns ``more``; fp is the fingerprint as a signed long."""
    prepare_python(docs.sparkSession)

    @F.pandas_udf("long")
    def computed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [fingerprint(t.encode(), shingle) if isinstance(t, str) else 0 for t in texts]
            yield pd.Series(np.array(found, dtype=np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), computed(F.col(text)).alias("fp"), *more)


def _grown(fps: np.ndarray, radius: int) -> np.ndarray:
    """Index of a component's first member for each fingerprint, by growing one component at a time.

    Fingerprints already reached are not compared again, so a tight cluster costs little more than its size.
    """
    label = np.full(len(fps), -1, np.int64)
    left = np.arange(len(fps))
    while len(left):
        start, left = left[0], left[1:]
        label[start] = start
        queue = [start]
        while queue and len(left):
            some, queue = queue[:64], queue[64:]
            near = np.zeros(len(left), bool)
            for x in fps[some]:
                near |= np.bitwise_count(fps[left] ^ x) <= radius
            reached = left[near]
            label[reached] = start
            left = left[~near]
            queue.extend(reached.tolist())
    return label


def _unit_links(run: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that hang together whatever lies within the radius inside each run; ``run`` is sorted."""
    a, b = [], []
    edges = np.flatnonzero(np.diff(run)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(run)]))
    sizes = ends - starts
    for i in np.flatnonzero(sizes > SHORT_RUN):
        part = fps[starts[i]:ends[i]]
        label = _grown(part, radius)
        other = np.flatnonzero(label != np.arange(len(part)))
        a.append(part[label[other]])
        b.append(part[other])
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    run, fps = run[short], fps[short]
    for shift in range(1, min(SHORT_RUN, len(run))):
        same = run[:-shift] == run[shift:]
        if not same.any():
            break
        near = same & (np.bitwise_count(fps[:-shift] ^ fps[shift:]) <= radius)
        a.append(fps[:-shift][near])
        b.append(fps[shift:][near])
    empty = [np.empty(0, np.uint64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b) over the different values of ``fp``: components of these links are those of all pairs within ``radius``."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(int(m)).alias("m"))
                               for i, m in enumerate(masks(radius).astype(np.int64))]))
    buckets = distinct.select("fp", keys.alias("x")).select(
        "fp", F.xxhash64("x.t", F.col("fp").bitwiseAND(F.col("x.m"))).alias("bucket"))
    shared = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    members = buckets.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks")).cast("int")
    units = (members.withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                    .select(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("unit"), "fp"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(r, f):
            a, b = _unit_links(r, f, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            run = np.concatenate((run, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
            whole = int(np.searchsorted(run, run[-1])) if len(run) else 0  # the last run may go on
            if whole > 65536:
                yield found(run[:whole], fps[:whole])
                run, fps = run[whole:], fps[whole:]
        if len(run):
            yield found(run, fps)

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, "a long, b long").distinct()


def _classes(values: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) for each different fingerprint of ``values`` (fp, first_id)."""
    roots = components(links(values, radius))
    rooted = materialize(values.join(roots, F.col("fp") == F.col("node"), "left")
                         .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return materialize(rooted.join(ids, "root").select("fp", "root", "component_id"))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                   radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius``
    differing bits reach.  Null and wordless texts have fingerprint zero and
    link like any other.  A null doc_id names a component only if it has no
    other id.  Repeated rows are rows of their own.  An empty table gives an
    empty table.
    """
    rows = materialize(fingerprints(docs, doc_id, text, shingle))
    values = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    return rows.join(_classes(values, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                  radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null is the largest).

    Of rows with that doc_id in one component, the text that hashes lowest
    stays, and of rows equal in doc_id and text, one.
    """
    key = F.xxhash64(F.col(text))
    rows = materialize(fingerprints(docs.withColumn("__sim_hash", key), doc_id, text, shingle, "__sim_hash"))
    values = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__sim_hash"))
    kept = (rows.join(_classes(values, radius).select("fp", "root"), "fp").groupBy("root").agg(best.alias("x"))
                .select(F.col("x.doc_id").alias("__sim_id"), F.col("x.__sim_hash").alias("__sim_kept")))
    own = docs.withColumn("__sim_hash", key)
    found = own.join(kept, F.col(doc_id).eqNullSafe(F.col("__sim_id")) & (F.col("__sim_hash") == F.col("__sim_kept")), "left_semi")
    return found.dropDuplicates([doc_id, "__sim_hash"]).drop("__sim_hash")
