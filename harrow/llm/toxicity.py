"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
A text is cut into windows of WINDOW words.  Each window is compressed with
both; the bytes that the toxic dictionary saves are the window's evidence.  How
often each saving occurs in toxic and in ordinary documents calibrates it as a
log-likelihood ratio; a document counts its strongest run of windows, and a
logistic curve fitted on the training documents turns that into a score.

The classifier is fitted on a bounded sample: about TOXIC_SAMPLE toxic and
ORDINARY_SAMPLE ordinary labelled documents, of each at most SAMPLE_CHARS
neighbouring characters at a hashed place.  All of them serve the word counts
and the calibration; the dictionaries are trained on at most DICTIONARY_TEXTS
different ones of each kind, chosen by a hash of the text.  Scoring reads every
whole text.

Toxic documents consist mostly of ordinary language, so toxic *text* is found
first: the words which toxic documents use in significantly more different
contexts (neighbouring words), or in significantly more different documents,
than ordinary ones do.  Copies of a document lend nothing.  The toxic dictionary
is trained on the stretches of toxic text that hold those words (without any
such word, on all toxic text), lists the words and then shares the ordinary
dictionary's content, so that common language costs the same with either and
only toxic material makes a difference.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import ascii_lower, hashed_window, materialize, sample_fraction, prepare_python, text_bytes

TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_CHARS, DICTIONARY_TEXTS = 2000, 4000, 50_000, 500
WINDOW = 16
LEVEL = 6
ORDINARY_BYTES, TOXIC_BYTES = 32768, 32768
#: Savings of this many bytes or more count alike.
MOST_SAVED = 11
THRESHOLD = 0.3
WORD = r"[^\x00-/:-@\[-`{-\x7F]+"
_WORD_BYTES = re.compile(WORD.encode())


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The text's words, lower-cased A-Z, in runs of ``size``; no words: one empty window."""
    words = text.lower().split()
    return [b" " + b" ".join(words[i:i + size]) + b" " for i in range(0, len(words), size)] or [b"  "]


def _lengths(compressor: zstd.ZstdCompressor, pieces: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, compressor.multi_compress_to_buffer(pieces)), np.int64, len(pieces))


@dataclass(frozen=True)
class Dictionaries:
    toxic: bytes
    ordinary: bytes

    def compressors(self) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
        out = []
        params = zstd.ZstdCompressionParameters.from_level(
            LEVEL, source_size=8 * WINDOW, dict_size=max(len(self.toxic), len(self.ordinary)), write_content_size=0, write_checksum=0,
            write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS)
        for content in (self.toxic, self.ordinary):
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            out.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))
        return out[0], out[1]


def savings(text: bytes, compressors) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window, from 0 to MOST_SAVED."""
    toxic, ordinary = compressors
    pieces = windows(text)
    return np.clip(_lengths(ordinary, pieces) - _lengths(toxic, pieces), 0, MOST_SAVED)


@dataclass(frozen=True)
class Classifier:
    dictionaries: Dictionaries
    evidence: tuple[float, ...]  # log-likelihood ratio of each saving
    slope: float
    offset: float

    def strongest(self, saved: np.ndarray) -> float:
        """The largest sum of evidence over any run of neighbouring windows."""
        run = np.concatenate(([0.0], np.cumsum(np.asarray(self.evidence)[saved])))
        return float((run[1:] - np.minimum.accumulate(run)[:-1]).max())

    def score(self, strongest: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * strongest + self.offset))))


def _train(samples: list[bytes], size: int) -> bytes:
    """zstandard's dictionary of at most ``size`` bytes; samples too few or too small for its trainer are joined instead."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b" ".join(samples)[-size:]


def stretches(text: bytes, words: frozenset[bytes]) -> list[bytes]:
    """The runs of neighbouring ``words`` in each window of 8 words."""
    out = []
    for window in windows(text, 8):
        run: list[bytes] = []
        for w in [*window.split(), b""]:
            if not words.isdisjoint(_WORD_BYTES.findall(w)):
                run.append(w)
            elif run:
                out.append(b" " + b" ".join(run) + b" ")
                run = []
    return out


def distinctive_words(sample: DataFrame) -> list[bytes]:
    """Words of toxic documents (``_text``, ``_toxic``) by falling evidence, as far as TOXIC_BYTES reach.

    Evidence is the G statistic of the numbers of different contexts in toxic
    and ordinary documents, or of the numbers of different documents if that is
    more; it must exceed what the best of all words reaches by chance.
    """
    words = F.expr(f"regexp_extract_all(_low, '{WORD}', 0)".replace("\\", "\\\\"))
    around = F.expr("transform(_words, (w, i) -> struct(w as word, xxhash64(w, get(_words, i - 1), get(_words, i + 1)) as ctx))")
    low = sample.select("_toxic", ascii_lower(F.col("_text")).alias("_low")).withColumn("_words", words)
    contexts = low.select("_toxic", F.explode(around).alias("x")).select("_toxic", "x.word", "x.ctx").distinct()
    holders = low.select("_toxic", F.xxhash64("_low").alias("ctx"), F.explode(F.array_distinct("_words")).alias("word")).distinct()
    found: dict[str, float] = {}
    for supports in (contexts, holders):
        for row in _significant(supports):
            found[row.word] = max(row.g, found.get(row.word, 0.0))
    out, size = [], 0
    for word, _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        size += len(word.encode()) + 1
        if size > TOXIC_BYTES:
            break
        out.append(word.encode())
    return out


def _significant(supports: DataFrame) -> list:
    """(word, g) of the words with significantly more supports (rows of _toxic and word) in toxic documents."""
    counts = materialize(supports.groupBy("word").agg(F.sum("_toxic").alias("a"), F.sum(F.lit(1) - F.col("_toxic")).alias("b")))
    all_a, all_b, tried = counts.agg(F.sum("a"), F.sum("b"), F.count_if(F.col("a") + F.col("b") >= 3)).first()
    if not all_a or not all_b:
        return []
    n = float(all_a + all_b)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    a, b, w = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    g = 2 * (part(a, w * (all_a / n)) + part(b, w * (all_b / n))
             + part(F.lit(all_a) - a, F.lit(all_a) - w * (all_a / n)) + part(F.lit(all_b) - b, F.lit(all_b) - w * (all_b / n)))
    least = 2 * math.log(max(tried, 2)) + 4
    return (counts.withColumn("g", g).where((F.col("g") >= least) & (a / F.lit(all_a) > 5 * (b + 0.5) / F.lit(all_b)))
                  .orderBy(F.desc("g"), "word").limit(TOXIC_BYTES // 4).collect())


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve (Newton steps, a weak prior on the slope)."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    prior = np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + prior,
                               design.T @ (weight * (y - p)) - prior @ beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", toxic: str = "toxic", key: str = "doc_id") -> Classifier:
    """Fit on the documents that ``labels`` marks with ``toxic`` 1 or 0 (other rows are left out), by ``key``.

    The sample is drawn from the labels, so only its few texts are gathered.
    A document with several labels counts with each.  Without documents of
    either kind the classifier gives every text the share of toxic labels (0 if
    there are none).
    """
    prepare_python(docs.sparkSession)
    known = labels.where(F.col(toxic).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(toxic).cast("int").alias("_toxic"))
    shares = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}  # two rows at most
    target = F.when(F.col("_toxic") == 1, TOXIC_SAMPLE).otherwise(ORDINARY_SAMPLE)
    chosen = materialize(sample_fraction(known, "_toxic", target, F.col("_key")))
    sample = materialize(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(chosen, "_key").select(
        "_toxic", hashed_window(F.coalesce("_text", F.lit("")), SAMPLE_CHARS).alias("_text")))
    n1, n0 = shares.get(1, 0), shares.get(0, 0)
    words = distinctive_words(sample)

    def texts(kind: int) -> list[bytes]:
        """At most DICTIONARY_TEXTS different texts, the same ones in every run."""
        return [r["_text"].encode() for r in sample.where(F.col("_toxic") == kind).select("_text").distinct().orderBy(
            F.xxhash64("_text"), "_text").limit(DICTIONARY_TEXTS).collect()]

    plain, marked = texts(0), texts(1)
    base = _train([w for t in plain for w in windows(t, 8)], ORDINARY_BYTES) if plain else b""
    listed = b" " + b" ".join(reversed(words)) + b" "
    if words:
        held = frozenset(words)
        found, used = [x for t in marked for x in stretches(t, held)], set()
    else:  # calibrated on the other half of the toxic texts
        found, used = [w for t in marked[::2] for w in windows(t, 8)], set(marked[::2]) if len(marked) > 1 else set()
    special = (_train(found, TOXIC_BYTES) if found else b"") + listed
    dictionaries = Dictionaries(special + base, base + b" ")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = dictionaries.compressors()
        for batch in batches:
            kept = [(y, t) for y, t in zip(batch.column("_toxic").to_pylist(), text_bytes(batch.column("_text"))) if not y or t not in used]
            saved = [savings(t, pair).astype("int8").tobytes() for _, t in kept]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in kept], pa.int32()), pa.array(saved, pa.binary())], ["_toxic", "saved"])

    # bounded: one byte per window of the sample
    rows = sample.mapInArrow(count, "_toxic int, saved binary").collect()
    y = np.array([r["_toxic"] for r in rows], dtype=float)
    saved = [np.frombuffer(bytes(r["saved"]), np.int8) for r in rows]
    if not y.any() or y.all():
        share = n1 / (n1 + n0) if n1 + n0 else 0.0
        return Classifier(dictionaries, (0.0,) * (MOST_SAVED + 1), 0.0, math.log((share + 1e-6) / (1 - share + 1e-6)))
    tables = [sum((np.bincount(s, minlength=MOST_SAVED + 1) for s, label in zip(saved, y) if label == kind),
                  np.zeros(MOST_SAVED + 1)) + 0.5 for kind in (1, 0)]
    ratio = np.log(tables[0] / tables[0].sum()) - np.log(tables[1] / tables[1].sum())
    ratio[1:] = np.maximum.accumulate(ratio[1:])  # a larger saving is never weaker evidence
    model = Classifier(dictionaries, tuple(map(float, ratio)), 1.0, 0.0)
    x = np.array([model.strongest(s) for s in saved])
    weight = np.where(y == 1, n1 / max(y.sum(), 1), n0 / max((1 - y).sum(), 1))
    slope, offset = _logistic(x, y, weight)
    return Classifier(dictionaries, model.evidence, slope, offset)


def score(docs: DataFrame, model: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` plus ``out``, from 0 to 1, over each whole text (an existing column of this name is replaced).

    Null and empty texts are scored as one empty window.  Nothing but the text
    is read.  No shuffle; the model (at most 2 * TOXIC_BYTES + 2 * ORDINARY_BYTES
    and a few numbers) travels with the tasks.
    """
    prepare_python(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pair = model.dictionaries.compressors()
        for texts in batches:
            yield pd.Series([model.score(model.strongest(savings(t.encode() if isinstance(t, str) else b"", pair))) for t in texts], dtype="float64")

    return docs.withColumn(out, scored(F.col(text)))
