"""Exact deduplication by Grace hashing.

Texts are equal when identical after lower-casing A-Z.  Map tasks first reduce
the copies among a few megabytes of rows, so that a text which a third of all rows hold is
shuffled a few times only.  Spark then deals the rest out by content hash.  In
each task an open-addressing table compares complete contents; when its rows
exceed MEMORY, table and remaining input are split by further hash bits into
FANOUT spill files, each of which is treated likewise, until every bucket fits.
Spill files lie in a temporary folder of the task and go with it.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.common import prepare_python

#: Bytes of rows that a task's table may hold, and spill files that it is split into beyond.
MEMORY, FANOUT = 48 << 20, 16
BITS = FANOUT.bit_length() - 1
HASH, SIZE, TIE = "__grace_hash", "__grace_size", "__grace_tie"


def normalized(text: pa.Scalar) -> bytes:
    return (text.cast(pa.large_string()).as_py() or "").encode().lower()


def digest(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


class Table:
    """Open addressing with linear probing over the rows of Arrow batches; equal content is one entry.

    An entry remembers its best row: the largest doc_id (null is the smallest), then the largest tie value.
    """

    def __init__(self, text: str, doc_id: str):
        self.text, self.doc_id = text, doc_id
        self.batches: list[pa.RecordBatch] = []
        self.bytes = 0
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[bytes] = []
        self.first: list[tuple[int, int]] = []  # where the content can be read
        self.best: list[tuple[int, int]] = []
        self.rank: list[tuple] = []
        self.sizes: list[int] = []

    def content(self, place: tuple[int, int]) -> bytes:
        return normalized(self.batches[place[0]].column(self.text)[place[1]])

    def _slot(self, key: bytes, content: bytes | None) -> int:
        """The slot of this content, or the free one where it belongs; no content: the first free one."""
        mask = len(self.slots) - 1
        at = int.from_bytes(key[-8:], "little") & mask
        while (entry := int(self.slots[at])) >= 0:
            if content is not None and self.hashes[entry] == key and self.content(self.first[entry]) == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)
        self.bytes += batch.nbytes
        columns = [batch.column(c).to_pylist() for c in (HASH, SIZE, self.doc_id, TIE)]
        for i, (key, size, doc_id, tie) in enumerate(zip(*columns)):
            place, rank = (len(self.batches) - 1, i), (doc_id is not None, doc_id if doc_id is not None else 0, tie)
            slot = self._slot(key, self.content(place))
            entry = int(self.slots[slot])
            if entry < 0:
                self.slots[slot] = len(self.hashes)
                self.hashes.append(key)
                self.first.append(place)
                self.best.append(place)
                self.rank.append(rank)
                self.sizes.append(size)
                if 2 * len(self.hashes) > len(self.slots):
                    self._grow()
            else:
                self.sizes[entry] += size
                if rank > self.rank[entry]:
                    self.best[entry], self.rank[entry] = place, rank

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        for entry, key in enumerate(self.hashes):
            self.slots[self._slot(key, None)] = entry

    def reduced(self) -> Table:
        """A table of the best rows only."""
        out = Table(self.text, self.doc_id)
        for batch in self.rows():
            out.add(batch)
        return out

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The best row of each entry, with the entry's size."""
        by_batch: dict[int, list[int]] = {}
        for entry, (b, _) in enumerate(self.best):
            by_batch.setdefault(b, []).append(entry)
        for b, entries in by_batch.items():
            out = self.batches[b].take(pa.array([self.best[e][1] for e in entries]))
            at = out.schema.get_field_index(SIZE)
            yield out.set_column(at, SIZE, pa.array([self.sizes[e] for e in entries], pa.int64()))


def grace(batches: Iterator[pa.RecordBatch], text: str, doc_id: str, memory: int = MEMORY, level: int = 0,
          folder: str | None = None) -> Iterator[pa.RecordBatch]:
    """One row per content of ``batches``; buckets beyond ``memory`` go through spill files under ``folder``."""
    table = Table(text, doc_id)
    deepest = 32 * 8 // BITS - 16  # the table's own slots use the last 64 bits
    for batch in batches:
        table.add(batch)
        if table.bytes > memory:
            table = table.reduced()  # copies need no memory
            if table.bytes > memory // 2 and len(table.hashes) > 1 and level < deepest:
                break
    else:
        yield from table.rows()
        return
    with tempfile.TemporaryDirectory(prefix="grace-", dir=folder) as own:
        writers: dict[int, tuple] = {}

        def spill(batch: pa.RecordBatch) -> None:
            at = BITS * level
            bucket = np.array([int.from_bytes(k, "big") >> (256 - at - BITS) & (FANOUT - 1)
                               for k in batch.column(HASH).to_pylist()], np.int64)
            for b in np.unique(bucket).tolist():
                if b not in writers:
                    sink = pa.OSFile(os.path.join(own, f"{b}.arrow"), "wb")
                    writers[b] = (sink, pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")))
                writers[b][1].write_batch(batch.take(pa.array(np.flatnonzero(bucket == b))))

        for batch in table.rows():
            spill(batch)
        del table
        for batch in batches:
            spill(batch)
        for sink, writer in writers.values():
            writer.close()
            sink.close()
        for b in sorted(writers):
            path = os.path.join(own, f"{b}.arrow")
            with pa.OSFile(path) as source, pa.ipc.open_stream(source) as reader:
                yield from grace(iter(reader), text, doc_id, memory, level + 1, own)
            os.remove(path)


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def content_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memory: int = MEMORY) -> DataFrame:
    """One row per different text: all columns of the row that stays, with ``__grace_hash`` (SHA-256) and ``__grace_size``.

    Null texts count as empty.  The row with the largest doc_id stays, null
    being the smallest; among rows equal in doc_id and text, the one whose
    other columns hash highest.  An empty table gives an empty table.
    """
    prepare_python(docs.sparkSession)
    keys = [F.col(f"`{f.name}`") for f in docs.schema if _hashable(f.dataType)]
    tied = docs.withColumn(TIE, F.xxhash64(*keys))
    schema = T.StructType([*tied.schema.fields, T.StructField(HASH, T.BinaryType()), T.StructField(SIZE, T.LongType())])

    def reduce_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(text, doc_id)
        for batch in batches:
            hashes = [digest(normalized(t)) for t in batch.column(text)]
            names = [*batch.schema.names, HASH, SIZE]
            table.add(pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hashes, pa.binary()), pa.array([1] * len(hashes), pa.int64())], names))
            if table.bytes > memory // 4:
                yield from table.rows()
                table = Table(text, doc_id)
        yield from table.rows()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grace(batches, text, doc_id, memory)

    return tied.mapInArrow(reduce_batch, schema).repartition(HASH).mapInArrow(build, schema)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memory: int = MEMORY) -> DataFrame:
    """``docs`` with one row of each group of equal texts (see ``content_groups`` for which one)."""
    return content_groups(docs, doc_id, text, memory).select(*[F.col(f"`{c}`") for c in docs.columns])


def duplicate_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memory: int = MEMORY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Rows equal in doc_id and text are counted first and written out again at the
    end, where one of them is kept, so nothing has to be told apart.  The
    group table holds no texts; joining with it leaves splitting the rows of a
    hot text to Spark.
    """
    prepare_python(docs.sparkSession)

    @F.pandas_udf("binary")
    def sha(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([digest(t.encode().lower() if isinstance(t, str) else b"") for t in texts], dtype=object)

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    groups = content_groups(ids, memory=memory).select(
        F.col(HASH).alias("_hash"), F.col("doc_id").alias("keep_id"), F.col(SIZE).alias("group_size"))
    rows = ids.select("doc_id", sha("text").alias("_hash")).groupBy("doc_id", "_hash").agg(F.count("*").cast("int").alias("_n"))
    joined = rows.join(groups, "_hash").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return joined.select("doc_id", "keep_id", "group_size",
                         (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"),
                         F.lower(F.hex("_hash")).alias("text_sha256"))
