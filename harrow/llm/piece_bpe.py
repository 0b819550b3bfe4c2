"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols, one for each character, behind the space that the model
puts before it.  An agenda holds the adjacent pairs that join to a piece of the
vocabulary, ordered by score and then from the left; the best is popped and
joined until the agenda is empty.  Symbols that are no piece become their bytes.

The symbols are cut before each run of spaces, at line feeds and before closing
marks, if no piece of the vocabulary reaches across.  Each segment is merged by
itself, and those that recur are kept in a bounded cache; of a batch each
different segment is looked up once.  Every Arrow batch is checked against the
sentencepiece library.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.agenda import PairTable
from harrow.llm.common import prepare_python
from harrow.llm.pretokens import CACHE_LENGTH, MARKS, Cache

SPACE = "▁"
#: Segments of up to so many symbols are merged together.
FEW = 40
#: Characters of a batch that are read together.
SLICE = 1 << 22


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """One replacement character for every byte that is no UTF-8."""
    return "�" * (error.end - error.start), error.end


codecs.register_error("harrow-each-byte", _each_byte)


class PieceModel:
    """The vocabulary of the sentencepiece model file at ``path``, with its own encoder and decoder.

    The model must be of merge type with byte pieces, without a rewriting
    normaliser and without user-defined or unused pieces; ``ValueError`` if its
    vocabulary says otherwise.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        special = [lib.is_control(i) or lib.is_unknown(i) for i in range(len(names))]
        self.id_of = {p: i for i, p in enumerate(names) if not special[i] and not lib.is_byte(i)}
        self.of_byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(map(lib.is_unused, range(len(names)))) or not all(map(lib.is_byte, self.of_byte)):
            raise ValueError(f"{path}: pieces must be plain ones, byte pieces for every byte, and control pieces")
        # equal scores share a rank: the agenda then prefers the leftmost pair
        order = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in self.id_of.values()}, reverse=True))}
        self.rank = {p: order[lib.get_score(i)] for p, i in self.id_of.items() if len(p) > 1}
        # for many short segments at once: numbers of pieces and characters, and what two numbers join to
        number = dict(self.id_of)
        self.inner = {c for p in self.rank for c in p if c not in number}  # characters only inside of pieces
        for c in sorted(self.inner):
            number[c] = len(names) + len(number)
        self.number = np.full(0x110000, -1, np.int64)
        for c in filter(lambda p: len(p) == 1, number):
            self.number[ord(c)] = number[c]
        joins = {number[p[:k]] << 20 | number[p[k:]]: r << 20 | number[p] for p, r in self.rank.items()
                 for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.joins = PairTable(joins)
        often = Counter(self.rank.values())
        tied = {p for p, r in self.rank.items() if often[r] > 1}
        #: pieces of equal score, without those that hold another: their order is left to the heap
        self.tied = [p for p in tied if not any(q in p for q in tied if q != p)]
        #: bytes of each id in a text; space is a space again
        self.surface = [p.replace(SPACE, " ").encode() for p in names]
        for i in range(len(names)):
            if lib.is_control(i):
                self.surface[i] = b""
            elif lib.is_unknown(i):
                self.surface[i] = lib.decode([i]).encode()
        for b, i in enumerate(self.of_byte):
            self.surface[i] = bytes([b])
        self.control = frozenset(i for i in range(len(names)) if lib.is_control(i))
        self.spaced = frozenset(i for p, i in self.id_of.items() if p.startswith(SPACE))
        self.joined = {pair for p in self.rank for pair in zip(p, p[1:])}
        #: whether no piece reaches over a space into what stands before it, nor over a line feed
        self.closed = not any(b == SPACE != a for a, b in self.joined) and not any("\n" in pair for pair in self.joined)
        self.cutter = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+") if self.closed else re.compile(".+", re.S)
        self.known, self.spaced_words = Cache(self._segment), Cache(lambda word: self._segment(SPACE + word))

    def merge(self, text: str) -> list[int]:
        """Ids of symbols (spaces as SPACE already) by an agenda of adjacent pairs."""
        found = [(s, self.id_of.get(s)) for s in self._merged(text)]
        return [i for s, known in found for i in ((known,) if known is not None else map(self.of_byte.__getitem__, s.encode()))]

    def merge_each(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian 32-bit ids of many segments; the agendas of short ones advance together."""
        out: list[bytes | None] = [None] * len(texts)
        fit = [k for k, t in enumerate(texts) if 0 < len(t) <= FEW and not any(x in t for x in self.tied) and self.inner.isdisjoint(t)]
        symbol = self.number[np.frombuffer("".join([texts[k] for k in fit]).encode("utf-32-le"), "<u4")]
        owner = np.repeat(np.array(fit, np.int64), np.array([len(texts[k]) for k in fit], np.int64))
        for owners, found, strange in self.joins.merge(symbol, owner):
            for k, ids, bad in zip(owners, found, strange):
                if not bad:  # a character that is no piece is left to ``merge``
                    out[k] = ids
        return [array("i", self.merge(t)).tobytes() if x is None else x for t, x in zip(texts, out)]

    def _merged(self, text: str) -> list[str]:
        """The agenda is a heap of (rank, place), the symbols a linked list."""
        symbol: list[str] = list(text)
        rank, n = self.rank, len(symbol)
        agenda = []
        for i in range(n - 1):
            found = rank.get(symbol[i] + symbol[i + 1])
            if found is not None:
                agenda.append(found << 32 | i)
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            best = heapq.heappop(agenda)
            i = best & 0xFFFFFFFF
            j = after[i]
            if j >= n or not symbol[i]:
                continue
            pair = symbol[i] + symbol[j]
            if rank.get(pair) != best >> 32:
                continue  # one side has been joined since
            symbol[i], symbol[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = rank.get(pair + symbol[k])
                if found is not None:
                    heapq.heappush(agenda, found << 32 | i)
            h = before[i]
            if h >= 0:
                found = rank.get(symbol[h] + pair)
                if found is not None:
                    heapq.heappush(agenda, found << 32 | h)
        return [s for s in symbol if s]

    def _segment(self, segment: str) -> bytes:
        if len(segment) > 1 and segment[-1] in MARKS and (segment[-2], segment[-1]) not in self.joined:
            word = segment[:-1]
            return (self.spaced_words[word[1:]] if word[0] == SPACE else self.known[word]) + self.known[segment[-1]]
        return array("i", self.merge(segment)).tobytes()

    def segments(self, symbols: str) -> list[str]:
        """Symbols cut where nothing can be joined across."""
        return self.cutter.findall(symbols)

    def _runs(self, text: str) -> list[tuple[Cache, list[str]]]:
        """A text as runs of segments; those of ``spaced_words`` have a space before them."""
        if not text:
            return []
        if not self.closed:
            return [(self.known, [SPACE + text.replace(" ", SPACE)])]
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append((self.known, ["\n"]))
            if "  " in line or SPACE in line or not k and line.startswith(" "):  # runs of spaces are joined
                out.append((self.known, self.segments(("" if k else SPACE) + line.replace(" ", SPACE))))
            elif k:
                first, *rest = line.split(" ")
                if first:
                    out.append((self.known, [first]))
                out.append((self.spaced_words, rest))
            else:
                out.append((self.spaced_words, line.split(" ")))
        return out

    def _learn(self, cache: Cache, words: Sequence[str]) -> None:
        """Merge all new words together; a closing mark that nothing joins is left to ``make``."""
        cut = {w[:-1] if w and w[-1] in MARKS and (w[-2:-1] or SPACE, w[-1]) not in self.joined else w for w in words}
        space = SPACE if cache is self.spaced_words else ""
        new = [w for w in cut if (w or space) and len(w) < FEW and w not in cache and w not in cache.old]
        cache.learn(new, self.merge_each([space + w for w in new]))

    def _ids(self, cache: Cache, words: list[str]) -> list[bytes]:
        """Ids of different segments of ``cache``; what its young generation lacks is looked up, merged and remembered together."""
        found = list(map(cache.get, words))
        missing = [w for w, x in zip(words, found) if x is None]
        if not missing:
            return found
        own = {w: x for w, x in zip(missing, map(cache.old.get, missing)) if x is not None}
        new = [w for w in missing if w not in own]
        self._learn(cache, new)
        for w in new:
            x = cache.get(w)
            own[w] = cache.make(w) if x is None else x
        kept = [w for w in missing if len(w) <= CACHE_LENGTH]
        cache.learn(kept, [own[w] for w in kept])
        return [own[w] if x is None else x for w, x in zip(words, found)]

    def encode_all(self, texts: Sequence[str]) -> list[np.ndarray]:
        """All ids of each text, without begin or end; none for an empty text.

        The segments of all texts are numbered, each different one is looked up
        or merged once, and the ids are gathered by number.
        """
        words, sizes, spaced, per_text = [], [], [], []
        for t in texts:
            before = len(words)
            for cache, run in self._runs(t):
                words += run
                sizes.append(len(run))
                spaced.append(cache is self.spaced_words)
            per_text.append(len(words) - before)
        if not words:
            return [np.empty(0, np.int32) for _ in texts]
        numbered = pa.array(words, pa.large_string()).dictionary_encode()
        number = 2 * numbered.indices.to_numpy().astype(np.int64) + np.repeat(np.array(spaced, np.int64), sizes)
        names = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        of_number, ids = np.empty(2 * len(names), np.int64), []
        for kind, cache in enumerate((self.known, self.spaced_words)):
            met = np.zeros(len(names), bool)
            met[number[number & 1 == kind] >> 1] = True
            which = np.flatnonzero(met)
            of_number[2 * which + kind] = np.arange(len(ids), len(ids) + len(which))
            ids += self._ids(cache, [names[k] for k in which.tolist()])
        length = np.array([len(x) >> 2 for x in ids], np.int64)
        begin = np.cumsum(length) - length
        met = of_number[number]
        many = length[met]
        ends = np.cumsum(many)
        place = np.repeat(begin[met] - (ends - many), many) + np.arange(ends[-1])
        out = np.frombuffer(b"".join(ids), np.int32)[place]
        edges = np.concatenate(([0], ends))[np.cumsum(per_text)]
        return np.split(out, edges[:-1])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of any ids; the space that opens the first piece (control pieces aside) is left out."""
        if self.control.isdisjoint(ids):
            out = b"".join(map(self.surface.__getitem__, ids)).decode(errors="harrow-each-byte")
        else:  # bytes on two sides of a control piece make no character
            runs = [list(run) for control, run in groupby(ids, self.control.__contains__) if not control]
            ids = [i for run in runs for i in run]
            out = "".join(b"".join(map(self.surface.__getitem__, run)).decode(errors="harrow-each-byte") for run in runs)
        return out[1:] if len(ids) and ids[0] in self.spaced else out


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model per worker process, with its cache."""
    return PieceModel(path)


def encode_and_decode(docs: DataFrame, model: str, text: str = "text", check: bool = True) -> DataFrame:
    """``docs`` plus piece_ids (array of int) and decoded_text, existing columns of these names replaced.

    ``model`` is the path of the model file on every machine.  Null and empty
    texts have no ids and decode to the empty text.  Whole texts of any length,
    no shuffle; repeated rows are encoded like any other.  With ``check`` every
    batch is also encoded and decoded by the library, and a difference stops the
    query with the place of the first one.
    """
    prepare_python(docs.sparkSession)
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = piece_model(model)
        for batch in batches:
            ids, decoded = [], []
            for texts in _slices([t or "" for t in batch.to_pylist()]):
                found = pieces.encode_all(texts)
                plain = [x.tolist() for x in found]
                back = list(map(pieces.decode, plain))
                if check:
                    _compare("encode", texts, plain, pieces.library.encode(texts, num_threads=1))
                    _compare("decode", texts, back, pieces.library.decode(plain, num_threads=1))
                ids += found
                decoded += back
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
            values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            yield pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string())], fields=list(kind))

    out = docs.drop("piece_ids", "decoded_text")
    # a generator cannot hold the struct twice: it is computed once and then taken apart
    rest = [F.col(f"`{c}`") for c in out.columns]
    read_once = out.select(F.struct(*rest).alias("row"), read(F.col(text)).alias("read"))
    return read_once.select("row.*", F.col("read.ids").alias("piece_ids"), F.col("read.decoded").alias("decoded_text"))


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of SLICE characters at most, or one longer text."""
    begin = size = 0
    for k, t in enumerate(texts):
        if k > begin and size + len(t) > SLICE:
            yield texts[begin:k]
            begin = k
            size = 0
        size += len(t)
    if texts:
        yield texts[begin:]


def _compare(what: str, texts: list[str], own: list, library: list) -> None:
    if own != library:
        k = next(i for i, (a, b) in enumerate(zip(own, library)) if a != b)
        raise RuntimeError(f"{what} differs from the sentencepiece library in a text of {len(texts[k])} characters: {texts[k][:80]!r}")


def piece_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: digests of ``encode_and_decode``."""
    found = encode_and_decode(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    csv = F.array_join(F.col("piece_ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"),
                        F.sha2(csv.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"))
