"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into the tokenizer's pre-tokens.  Each starts as a linked list of
byte symbols; a heap holds the ranks of adjacent pairs, the lowest is popped
and merged until none is left.  The count is the number of initial symbols
minus the merges; no token ids are made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import prepare_python
from harrow.llm.pretokens import PieceReader, byte_symbols


class MergeCounter:
    """Counts tokens as the byte-level BPE tokenizer file at ``path`` does, special strings in a text included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        #: (left << 20 | right) -> rank << 20 | merged
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]
        cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.of_byte = byte_symbols(vocab)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.reader = PieceReader(
            specials, word=lambda w: self.merged([self.of_byte[b] for b in w.encode()]),
            piece=lambda p: sum(self.merged([vocab[c] for c in w]) for w, _ in cut(p)), special=lambda _: 1)

    def merged(self, symbol: list[int]) -> int:
        """Symbols left when no adjacent pair of one pre-token can be merged any more."""
        merges = self.merges
        count = n = len(symbol)
        heap = []
        for i in range(n - 1):
            found = merges.get(symbol[i] << 20 | symbol[i + 1])
            if found is not None:
                heap.append((found >> 20) << 32 | i)
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            lowest = heapq.heappop(heap)
            i = lowest & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            found = merges.get(symbol[i] << 20 | symbol[j])
            if found is None or found >> 20 != lowest >> 32:
                continue  # one side has been merged since
            count -= 1
            symbol[i], symbol[j] = found & 0xFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get(symbol[i] << 20 | symbol[k])
                if found is not None:
                    heapq.heappush(heap, (found >> 20) << 32 | i)
            h = before[i]
            if h >= 0:
                found = merges.get(symbol[h] << 20 | symbol[i])
                if found is not None:
                    heapq.heappush(heap, (found >> 20) << 32 | h)
        return count

    def count(self, text: str) -> int:
        return sum(self.reader.results(text))


@lru_cache(maxsize=2)
def _counter(path: str) -> MergeCounter:
    """One counter per worker process, with its caches."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` plus n_bytes, n_tokens and over_limit (n_tokens > limit), existing columns of these names replaced.

    ``tokenizer`` is the path of a byte-level BPE .json file on every machine.
    Null texts count as empty: 0 bytes, 0 tokens.  Whole texts, no shuffle;
    repeated rows are counted like any other.
    """
    prepare_python(docs.sparkSession)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(tokenizer)
        for texts in batches:
            yield pd.Series([counter.count(t) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return (docs.drop("n_bytes", "n_tokens", "over_limit")
                .withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
                .withColumn("n_tokens", counted(F.col(text)))
                .withColumn("over_limit", F.col("n_tokens") > limit))
