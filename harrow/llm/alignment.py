"""Cross-tokenizer alignment by products of sparse incidence matrices.

Tokenizer A (byte-level) reads a space and the text, tokenizer B (sentencepiece)
the text, before which it puts that space itself; so the tokens of both cover
the same bytes.  A token-byte incidence matrix in compressed sparse rows (CSR)
says which bytes a token covers.  Gustavson's row products of A with the
transpose of B give the overlaps of their tokens.  Byte offsets where tokens of
both end cut the tokens into groups; the product of A's and B's group-incidence
matrices, with equal ids as one row, gives how often each pair of ids is linked
by a shared group.

A text is cut before single spaces, where both tokenizers begin a new token and
so a new group.  Different segments are multiplied once, many in one block
diagonal matrix, and remembered.  How many documents hold a pair of ids linked
is counted over the whole corpus: documents are gathered to chunks, a chunk
lists its different pairs once, and only those lists are shuffled to be counted
and to fetch the counts.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.agenda import PairTable
from harrow.llm.common import materialize, prepare_python
from harrow.llm.piece_bpe import FEW, MARKS, SPACE, PieceModel
from harrow.llm.pretokens import byte_symbols, is_word

#: A chunk is closed when it holds so many (document, pair) entries or documents; one document is never split.
CHUNK_ENTRIES, CHUNK_DOCS = 1_000_000, 20_000
#: Characters of text aligned together, and segments remembered at most (those of the texts in hand come on top).
TOGETHER, REMEMBERED = 1_000_000, 200_000
#: Entries that a matrix product expands at once.
EXPANDED = 500_000
#: A pair of ids as one long: the id of A times this, plus the id of B.
PAIR = 1 << 24
#: Where both tokenizers begin a new token: before a space between other characters.
SPACES = r"(?<=\S)(?= \S)"
#: And behind a plain word, if no piece of B goes on there.
MARKED = rf"{SPACES}|(?<=[A-Za-z])(?=[{"".join(sorted(MARKS))}])"


class Csr(NamedTuple):
    """A sparse matrix: row i has values[k] in column columns[k] for k from starts[i] to starts[i + 1]."""
    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def csr(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> Csr:
    """From entries in any order, each (row, column) once."""
    order = np.argsort(rows, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=height))))
    return Csr(starts, columns[order], values[order])


def transpose(m: Csr, width: int) -> Csr:
    return csr(m.columns, m.rows, m.values, width)


def gustavson(left: Csr, right: Csr, width: int) -> Csr:
    """The product by rows: each entry of a left row adds a multiple of one right row to that row's sums.

    Rows are taken in blocks that expand to about EXPANDED entries; ``width`` is the number of columns of ``right``.
    """
    wide = np.diff(right.starts)[left.columns]
    reach = np.concatenate(([0], np.cumsum(wide)))[left.starts]  # entries that come before each row
    out, first, height = [], 0, len(left.starts) - 1
    while first < height:
        last = max(first + 1, int(np.searchsorted(reach, reach[first] + EXPANDED, side="right")) - 1)
        a, b = left.starts[first], left.starts[last]
        size = wide[a:b]
        place = np.arange(size.sum()) + np.repeat(right.starts[left.columns[a:b]] - (np.cumsum(size) - size), size)
        row = np.repeat(np.repeat(np.arange(first, last), np.diff(left.starts[first:last + 1])), size)
        key = row * width + right.columns[place]
        value = np.repeat(left.values[a:b], size) * right.values[place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        out.append((key[heads], np.add.reduceat(value[order], heads) if len(heads) else value))
        first = last
    key = np.concatenate([k for k, _ in out] or [np.empty(0, np.int64)])
    starts = np.searchsorted(key, np.arange(height + 1) * width)
    return Csr(starts, key % width, np.concatenate([v for _, v in out] or [np.empty(0, np.int64)]))


def byte_incidence(lengths: np.ndarray) -> Csr:
    """Which bytes each token covers; the tokens follow each other without gaps."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return Csr(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64))


def group_incidence(owner: np.ndarray, ids: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, Csr]:
    """The different (owner, id), as owner * PAIR + id in order, and for each how many of its tokens lie in which group."""
    rows, row = np.unique(owner * PAIR + ids, return_inverse=True)
    entries, times = np.unique(row * n_groups + group, return_counts=True)
    return rows, csr(entries // n_groups, entries % n_groups, times, len(rows))


class Segments(NamedTuple):
    """Alignments of segments: five counts each, the groups as text, and the linked pairs of ids with their numbers of links."""
    counts: np.ndarray
    groups: list[str]
    starts: np.ndarray  # where the pairs of each begin
    pairs: np.ndarray
    links: np.ndarray
    same: np.ndarray  # whether the bytes of both tokenizers equal the segment's

    def add(self, more: Segments) -> Segments:
        return Segments(np.concatenate((self.counts, more.counts)), self.groups + more.groups,
                        np.concatenate((self.starts, self.starts[-1] + more.starts[1:])), np.concatenate((self.pairs, more.pairs)),
                        np.concatenate((self.links, more.links)), np.concatenate((self.same, more.same)))


_LONGS = np.empty(0, np.int64)
NO_SEGMENTS = Segments(np.empty((0, 5), np.int64), [], np.zeros(1, np.int64), _LONGS, _LONGS, np.empty(0, bool))


class Document(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    n_overlaps: int
    groups: str
    pairs: np.ndarray  # different pairs in order
    links: np.ndarray  # number of links of each


NO_TOKENS = Document(0, 0, 0, 0, 0, "", _LONGS, _LONGS)


def bytes_of_ids(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer (tokens with other characters stand for themselves)."""
    names = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    byte_of = {names[i]: b for b, i in enumerate(byte_symbols(tokenizer.get_vocab()))}
    return [bytes(byte_of[c] for c in name) if byte_of.keys() >= set(name) else name.encode() for name in names]


class Aligner:
    """Aligns texts under the byte-level tokenizer file ``path_a`` and the sentencepiece model file ``path_b``."""

    def __init__(self, path_a: str, path_b: str):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # special strings in a text are plain text
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, joins = model["vocab"], {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            joins[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]
        self.joins, self.of_byte = PairTable(joins), np.array(byte_symbols(vocab), np.int64)
        self.b = PieceModel(path_b)
        self.bytes_a, self.bytes_b = bytes_of_ids(self.a), self.b.surface
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        #: an id and what follows it: 4 * id + 0 for another id of its side, 1 for the other side, 2 for a group, 3 for nothing
        self.words = [f"{i}{end}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for end in (",", "|", ";", "")]
        closed = not any((c, m) in self.b.joined for c in string.ascii_letters for m in MARKS)
        self.cut = re.compile(MARKED if closed else SPACES)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.known = NO_SEGMENTS

    def _ids_a(self, segments: Sequence[str]) -> list[bytes]:
        """Ids of A as 32-bit numbers; plain words are one pre-token each and merged together, the library reads the rest."""
        out: list[bytes | None] = [None] * len(segments)
        data = {k: s.encode() for k, s in enumerate(segments) if len(s) <= FEW and is_word(s[1:] if s[:1] == " " else s)}
        owner = np.repeat(np.fromiter(data, np.int64, len(data)), np.fromiter(map(len, data.values()), np.int64, len(data)))
        for owners, ids, _ in self.joins.merge(self.of_byte[np.frombuffer(b"".join(data.values()), np.uint8)], owner):
            for k, x in zip(owners, ids):
                out[k] = x
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, self.a.encode_batch_fast([segments[k] for k in rest], add_special_tokens=False)):
            out[k] = array("i", e.ids).tobytes()
        return out

    def _ids_b(self, segments: Sequence[str]) -> list[bytes]:
        """Ids of B as 32-bit numbers; segments stand for themselves here, so B's own cache isn't asked."""
        parts = [self.b.segments(s.replace(" ", SPACE)) for s in segments]
        flat, out, k = self.b.merge_each(list(chain.from_iterable(parts))), [], 0
        for own in parts:
            out.append(flat[k] if len(own) == 1 else b"".join(flat[k:k + len(own)]))
            k += len(own)
        return out

    def _same(self, ids: list[bytes], content: list[bytes], surface: list[bytes]) -> np.ndarray:
        """Whether the bytes of the tokens are those of the segment."""
        tokens = list(map(surface.__getitem__, np.frombuffer(b"".join(ids), np.int32).tolist()))
        edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)))
        size = np.concatenate(([0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))))
        fits = np.diff(size[edges]) == np.fromiter(map(len, content), np.int64, len(content))
        if fits.all() and b"".join(tokens) == b"".join(content):
            return fits
        edges = edges.tolist()
        return np.array([b"".join(tokens[i:j]) == c for i, j, c in zip(edges, edges[1:], content)], bool)

    def multiply(self, segments: Sequence[str]) -> Segments:
        """Alignments of segments that have their space in front already, by products of block diagonal matrices."""
        ids_a, ids_b, content = self._ids_a(segments), self._ids_b(segments), [s.encode() for s in segments]
        same = self._same(ids_a, content, self.bytes_a) & self._same(ids_b, content, self.bytes_b)
        if not same.all():
            ids_a, ids_b = ([x if ok else b"" for x, ok in zip(ids, same.tolist())] for ids in (ids_a, ids_b))
        count = len(segments)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, count) // 4 for x in (ids_a, ids_b))
        flat_a, flat_b = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (ids_a, ids_b))
        if not len(flat_a):
            return Segments(np.zeros((count, 5), np.int64), [""] * count, np.zeros(count + 1, np.int64), _LONGS, _LONGS, same)
        owner_a, owner_b = np.repeat(np.arange(count), n_a), np.repeat(np.arange(count), n_b)
        over_a, over_b = byte_incidence(self.sizes_a[flat_a]), byte_incidence(self.sizes_b[flat_b])
        width = int(over_a.starts[-1])
        overlaps = gustavson(over_a, transpose(over_b, width), len(flat_b))
        # a group ends at each byte offset where tokens of both end
        ends = np.zeros(width + 1, bool)
        ends[np.intersect1d(over_a.starts[1:], over_b.starts[1:])] = True
        passed = np.cumsum(ends)
        group_a, group_b, n_groups = passed[over_a.starts[1:] - 1], passed[over_b.starts[1:] - 1], int(passed[-1])
        rows_a, m_a = group_incidence(owner_a, flat_a, group_a, n_groups)
        rows_b, m_b = group_incidence(owner_b, flat_b, group_b, n_groups)
        links = gustavson(m_a, transpose(m_b, n_groups), len(rows_b))
        row = rows_a[links.rows]
        starts = np.searchsorted(row // PAIR, np.arange(count + 1))
        pairs = row % PAIR * PAIR + rows_b[links.columns] % PAIR
        owner_of_group = np.zeros(n_groups, np.int64)
        owner_of_group[group_a] = owner_a

        def per_segment(owner: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
            return np.bincount(owner, weights, count).astype(np.int64)

        counts = np.stack([n_a, n_b, per_segment(owner_of_group), per_segment(row // PAIR, links.values),
                           per_segment(owner_a[overlaps.rows])], axis=1)
        return Segments(counts, self._texts(flat_a, flat_b, group_a, group_b, owner_of_group, n_a + n_b), starts, pairs, links.values, same)

    def _texts(self, flat_a, flat_b, group_a, group_b, owner_of_group, sizes) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every segment."""
        side = np.concatenate((2 * group_a, 2 * group_b + 1))
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate((flat_a, flat_b))[order]
        after = np.append(side[1:], -2)
        owner = owner_of_group[side // 2]
        end = np.where(after == side, 0, np.where(after // 2 == side // 2, 1, np.where(np.append(owner[1:], -1) == owner, 2, 3)))
        words = list(map(self.words.__getitem__, (4 * ids + end).tolist()))
        edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
        return ["".join(words[a:b]) for a, b in zip(edges, edges[1:])]

    def _places(self, names: list[str]) -> np.ndarray:
        """Where each segment is in ``known``; new ones are aligned first."""
        new = list(dict.fromkeys(name for name in names if name not in self.place))
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.known = self.known.add(self.multiply(new))
        return np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))

    def align(self, texts: Sequence[str]) -> list[Document]:
        """Whole texts; empty ones, and those whose bytes a tokenizer changes, have no tokens."""
        if len(self.place) > REMEMBERED:
            self.forget()
        cut = [self.cut.split(" " + t) if t else [""] for t in texts]
        place = self._places(list(chain.from_iterable(cut)))
        edges = np.concatenate(([0], np.cumsum(list(map(len, cut)))))
        wrong = np.flatnonzero(np.add.reduceat(~self.known.same[place], edges[:-1]) if len(texts) else [])
        if len(wrong):  # segments whose bytes differ may still make up for each other: such texts count as one segment
            for k in wrong.tolist():
                cut[k] = [" " + texts[k]]
            place = self._places(list(chain.from_iterable(cut)))
            edges = np.concatenate(([0], np.cumsum(list(map(len, cut)))))
        return self._documents(place, edges)

    def _documents(self, place: np.ndarray, edges: np.ndarray) -> list[Document]:
        known, n = self.known, len(edges) - 1
        if not n:
            return []
        counts = np.add.reduceat(known.counts[place], edges[:-1], axis=0).tolist()
        # each document's different segments, and from them its different pairs
        used, times = np.unique(np.repeat(np.arange(n), np.diff(edges)) * len(self.place) + place, return_counts=True)
        doc, used = used // len(self.place), used % len(self.place)
        size = known.starts[used + 1] - known.starts[used]
        at = np.arange(size.sum()) + np.repeat(known.starts[used] - (np.cumsum(size) - size), size)
        doc, links, pair = np.repeat(doc, size), np.repeat(times, size) * known.links[at], known.pairs[at]
        order = np.lexsort((pair, doc))
        doc, links, pair = doc[order], links[order], pair[order]
        heads = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
        links = np.add.reduceat(links, heads) if len(heads) else links
        doc, pair = doc[heads], pair[heads]
        bounds = np.searchsorted(doc, np.arange(n + 1)).tolist()
        order_of = place.tolist()
        edges = edges.tolist()
        return [Document(*counts[k], ";".join(map(known.groups.__getitem__, order_of[edges[k]:edges[k + 1]])),
                         pair[bounds[k]:bounds[k + 1]], links[bounds[k]:bounds[k + 1]]) if counts[k][0] else NO_TOKENS for k in range(n)]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker process, with its cache."""
    return Aligner(path_a, path_b)


class _Chunk:
    """Documents gathered in one task until there are enough entries."""

    def __init__(self, with_groups: bool):
        self.with_groups = with_groups
        self.ids: list[int | None] = []
        self.docs: list[Document] = []
        self.digests: list[str] = []
        self.entries = 0

    def add(self, doc_id: int | None, doc: Document) -> bool:
        """Whether the chunk is full with this document."""
        self.ids.append(doc_id)
        self.digests.append(hashlib.sha256(doc.groups.encode()).hexdigest() if doc.groups else "")
        self.docs.append(doc if self.with_groups else doc._replace(groups=""))
        self.entries += len(doc.pairs)
        return self.entries >= CHUNK_ENTRIES or len(self.ids) >= CHUNK_DOCS

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        """One row: columns of its documents, its different pairs, how many of its documents hold each, and the packed entries."""
        found, entry = np.unique(np.concatenate([d.pairs for d in self.docs]), return_inverse=True)
        links = np.concatenate([d.links for d in self.docs])
        sizes = np.array([len(d.pairs) for d in self.docs], np.int32)
        packed = zstd.ZstdCompressor(level=1).compress(sizes.tobytes() + entry.astype(np.int32).tobytes() + links.tobytes())
        columns = [self.ids, *([d[k] for d in self.docs] for k in range(5)), self.digests,
                   [d.groups for d in self.docs] if self.with_groups else None,
                   found, np.bincount(entry, minlength=len(found)), packed]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, schema)], schema=schema)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
_CHUNK = (", ".join(f"{c} array<long>" for c in ("doc_id", *_COUNTS)) +
          ", groups_sha256 array<string>, groups array<string>, pairs array<long>, holders array<long>, entries binary")
_RESULT = (", ".join(f"{c} long" for c in ("doc_id", *_COUNTS, "n_best", "count_sum")) + ", groups_sha256 string, groups string")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about TOGETHER characters, or of one longer text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(i)
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            if size >= TOGETHER or len(texts) >= CHUNK_DOCS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def chunks(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """Every document aligned, gathered to chunks of about CHUNK_ENTRIES (document, pair) entries, one row each."""
    prepare_python(docs.sparkSession)
    longs = pa.list_(pa.int64())
    schema = pa.schema([*((c, longs) for c in ("doc_id", *_COUNTS)), ("groups_sha256", pa.list_(pa.string())),
                        ("groups", pa.list_(pa.string())), ("pairs", longs), ("holders", longs), ("entries", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, chunk = aligner(path_a, path_b), _Chunk(with_groups)
        for ids, texts in _together(batches):
            for i, doc in zip(ids, reader.align(texts)):
                if chunk.add(i, doc):
                    yield chunk.row(schema)
                    chunk = _Chunk(with_groups)
        if chunk.ids:
            yield chunk.row(schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _CHUNK)


def pair_counts(lists: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that hold a pair, and whether no other pair of its id of A is held by more."""
    counts = materialize(lists.groupBy("pair").agg(F.sum("holders").alias("n")))
    of_a = F.shiftrightunsigned("pair", 24)
    top = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("top"))
    return materialize(counts.withColumn("a", of_a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
          with_groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256, groups.

    ``path_a`` names a byte-level .json file of tokenizers, ``path_b`` a
    sentencepiece model file, on every machine.  ``groups`` (on request, else
    null) is the text ``a1,a2|b1;a3|b2,b3`` of ids.  Null and empty texts, and
    texts whose bytes a tokenizer changes, have no tokens: zeros and empty
    groups.  Repeated rows, null ids and equal ids are documents of their own.
    An empty table gives an empty table.

    Texts are read in map tasks, which write chunks once; a pair that a third
    of all documents hold is one entry in each chunk's list, so counting and
    fetching counts move lists and not (document, pair) rows.
    """
    found = materialize(chunks(docs, path_a, path_b, doc_id, text, with_groups).withColumn("chunk", F.monotonically_increasing_id()))
    lists = found.select("chunk", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "x")).select(
        "chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.holders").alias("holders"))
    fetched = (lists.join(pair_counts(lists.select("pair", "holders")), "pair").groupBy("chunk")
                    .agg(F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("counted")))
    kept = ["doc_id", *_COUNTS, "groups_sha256", "groups", "entries"]
    joined = found.select("chunk", *kept).join(fetched, "chunk", "left").select(
        *kept, F.col("counted.n").alias("counts"), F.col("counted.best").alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _documents({name: batch.column(name)[k] for name in batch.schema.names})

    return joined.mapInArrow(run, _RESULT)


def _documents(row: dict[str, pa.Scalar]) -> pa.RecordBatch:
    """The documents of one chunk with sums over their links."""
    ids = row["doc_id"].values
    data = zstd.ZstdDecompressor().decompress(row["entries"].as_py())
    n = len(ids)
    sizes = np.frombuffer(data, np.int32, n)
    entry = np.frombuffer(data, np.int32, int(sizes.sum()), 4 * n)
    links = np.frombuffer(data, np.int64, offset=4 * n + 4 * len(entry))
    owner = np.repeat(np.arange(n), sizes)
    n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(entry):
        np.add.at(n_best, owner, links * row["best"].values.to_numpy(zero_copy_only=False)[entry])
        np.add.at(count_sum, owner, links * row["counts"].values.to_numpy()[entry])
    groups = row["groups"].values if row["groups"].is_valid else pa.nulls(n, pa.string())
    return pa.RecordBatch.from_arrays([ids, *(row[c].values for c in _COUNTS), pa.array(n_best), pa.array(count_sum), row["groups_sha256"].values,
                                       groups], ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256", "groups"])
