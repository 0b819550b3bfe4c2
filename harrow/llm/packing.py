"""Sequence packing by sums of squares.

Documents are tokenized and cut into pieces of at most CAPACITY tokens; pieces
of full length are sequences of their own.  Every other piece goes into the open
sequence, or a new one, after which the squared numbers of open sequences per
residual gap sum to the least.

A document has one piece at most that is shorter.  These are dealt to shards of
about SHARD_DOCS by a hash of their row number, so copies of one row spread like
any others, and each shard is packed by one task, independently: a few kilobytes
of state and a few dozen bytes per piece, whatever the size of the input.  A
shard leaves a few unfilled sequences at its end, under one in a thousand.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import materialize, prepare_python
from harrow.llm.pretokens import PieceReader, byte_symbols

CAPACITY, END_ID = 1024, 2
SHARD_DOCS = 100_000
#: Sequence ids of full pieces begin here; those of shards are below.
FULL = 1 << 62
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Little-endian 32-bit ids of whole texts, as the tokenizers library gives them without added specials."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.reader = PieceReader(specials, self._word, self._ids, self._ids)
        vocab, self.model = self.tokenizer.get_vocab(), self.tokenizer.model
        name = {i: token for token, i in vocab.items()}
        self.letters = {b: name[i] for b, i in enumerate(byte_symbols(vocab))}

    def _word(self, word: str) -> bytes:
        """A plain word is one pre-token: the library's model alone, without its other steps, gives its ids."""
        letters = "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(self.reader.results(text))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces: only a longer one is cut, and only its first piece may be shorter."""
    head = length if length <= capacity else length % capacity
    edges = ([0] if head else []) + list(range(head, length, capacity)) + [length]
    return list(zip(edges, edges[1:])) if head != length else [(0, length)]


def tokenize_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                    end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit, on request) of every piece.

    A document is the ids of its whole text (null: empty) and ``end_id``, so each row of ``docs`` has a piece at least.
    """
    prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, t in zip(batch.column(0).to_pylist(), texts):
                ids = encoder.encode(t) + end
                for k, (a, b) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * a:4 * b]
                    for column, value in zip(rows, (i, k, a, b - a, zlib.crc32(part), part if with_ids else None)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            last = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds)][:last], names[:last])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, PIECES + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, taken in the order given; every length is from 1 to ``capacity``.

    ``open_[g]`` counts open sequences with gap g.  A piece of length s turns a
    gap g into g - s, so the sum changes by 2 * (open_[g - s] - open_[g]) + 2;
    an exact fit by -2 * open_[s] + 1, a new sequence by 2 * open_[capacity - s] + 1.
    Ties go to the smallest gap, and to an open sequence before a new one.
    """
    open_ = np.zeros(capacity, dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used, closed = 0, np.int64(1) << 40
    for i, s in enumerate(lengths.tolist()):
        here = open_[s:]
        gap = 0
        if s < capacity:
            change = 2 * (open_[:capacity - s] - here) + 2
            change[0] -= 1
            change[here == 0] = closed
            best = int(change.argmin())
            if change[best] <= 2 * open_[capacity - s] + 1:
                gap = s + best
        if gap:
            sequence[i] = waiting[gap].pop()
            open_[gap] -= 1
            offset[i] = capacity - gap
        else:
            sequence[i], offset[i], gap = used, 0, capacity
            used += 1
        if gap > s:
            waiting[gap - s].append(int(sequence[i]))
            open_[gap - s] += 1
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
         capacity: int = CAPACITY, with_ids: bool = False, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    Null texts are empty documents of ``end_id`` alone.  Repeated rows and
    repeated or null doc_ids are documents of their own; however often a row is
    repeated, its pieces lie in all shards alike.  An empty table gives an empty
    table.  Sequence ids are shard << 40 plus the place in the shard, those of
    full pieces FULL plus a row number.  Within a shard, pieces are packed from
    the longest to the shortest, equal ones by id and checksum, so a task that runs again
    packs alike.

    One count over the rows (no text is read) gives the number of shards; the
    only shuffle carries the rows of shorter pieces.
    """
    n = docs.count()
    shards = max(1, -(-n // shard_docs))
    found = tokenize_pieces(docs, tokenizer, doc_id, text, end_id, capacity, with_ids)
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()))
    schema = PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    full = found.where(F.col("length") == capacity).withColumn("sequence_id", F.col("row") + FULL).withColumn(
        "offset", F.lit(0).cast("long")).drop("row")
    short = found.where(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long")).drop("row")

    def run(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        order = np.lexsort((table.column("ids_crc32").to_numpy(), table.column("piece").to_numpy(),
                            table.column("doc_id").fill_null(-1).to_numpy(), -length))
        sequence, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        sequence[order], offset[order] = sum_of_squares(length[order], capacity)
        shard = table.column("shard")[0].as_py() << 40
        return (table.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence + shard))
                     .append_column("offset", pa.array(offset)))

    return full.unionByName(short.groupBy("shard").applyInArrow(run, schema))
