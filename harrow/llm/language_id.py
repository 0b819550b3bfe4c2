"""Language identification by compression.

One raw-content zstandard dictionary per language holds sample text.  A text is
cut into chunks of CHUNK bytes; each is compressed with every dictionary, and
the language whose dictionary needs the fewest bytes in all wins.  If the
second best comes within MARGIN of it, the decision is marked as rejected.

The dictionaries are fitted on a bounded sample: about SAMPLE_DOCS different
labelled texts a language, at most EXCERPT characters of each, and DICTIONARY
bytes in all, to which every sampled text gives an equal share.  An excerpt lies
at a hashed place among the text's letters, so no part of a text is preferred.
Prediction reads every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import regex
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import fresh, hashed_window, materialize, prepare_python, sample_fraction

SAMPLE_DOCS, EXCERPT, DICTIONARY = 200, 1000, 65536
CHUNK = 1024
LEVEL = 5
#: Least lead over the second best, as a share of the best size, for a decision that is not rejected.
MARGIN = 0.01
#: Below this lead the text is compressed again behind RUN_IN bytes of each dictionary, and those bytes are added.
NARROW, RUN_IN = 0.05, 128
#: Scores are softmax weights of the saved bytes; one byte counts SHARPNESS.
SHARPNESS = 0.25
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def clean(text: str) -> bytes:
    """What is compressed: lower case, everything but letters and apostrophes as one space."""
    return regex.sub(r"[^\p{L}\p{M}']+", " ", " " + text.lower() + " ").encode()


def even_shares(parts: list[bytes], total: int) -> list[bytes]:
    """The starts of all parts, cut at one length so that they fit into ``total`` bytes; what short parts leave goes to the others."""
    most, left = 0, total
    for k, size in enumerate(sorted(map(len, parts))):
        most = left // (len(parts) - k)
        if size > most:
            break
        left -= size
    return [p[:most] for p in parts]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language; rows with null lang or without letters are left out.

    Whole texts that differ in nothing but case, digits and marks are one
    text, so copies neither crowd the sample nor the dictionary.  A hash of its
    letters decides what is sampled, where its excerpt lies, and orders the
    dictionary.  Runs of anything but letters count as one character of the
    excerpt, so texts that open with digits or marks lend letters as well.
    """
    letters = F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}']+", " ")))
    known = (labelled.where(F.col(lang).isNotNull() & F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}"))
                     .select(F.col(lang).alias("_lang"), letters.alias("_letters"))
                     .select("_lang", F.xxhash64("_letters").alias("_hash"), hashed_window(F.col("_letters"), EXCERPT).alias("_text")))
    # only hashes are made different and counted; the join with the few chosen ones is a map-side filter
    chosen = materialize(sample_fraction(known.select("_lang", "_hash").distinct(), "_lang", SAMPLE_DOCS, F.col("_hash")))
    # bounded: about SAMPLE_DOCS * EXCERPT characters a language
    found = known.join(chosen, ["_lang", "_hash"]).groupBy("_lang", "_hash").agg(F.min("_text").alias("_text")).collect()
    parts: dict[str, list[bytes]] = {}
    for r in sorted(found, key=lambda r: (r["_lang"], r["_hash"])):
        parts.setdefault(r["_lang"], []).append(clean(r["_text"]))
    return {name: b"".join(even_shares(x, DICTIONARY)) for name, x in sorted(parts.items())}


def _compressors(dictionaries: Mapping[str, bytes]) -> list[zstd.ZstdCompressor]:
    out = []
    for content in dictionaries.values():
        params = zstd.ZstdCompressionParameters.from_level(
            LEVEL, source_size=CHUNK, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))
    return out


def sizes(text: str, compressors: list[zstd.ZstdCompressor], run_in: list[bytes] | None = None) -> np.ndarray:
    """Compressed bytes of the whole text with each dictionary.

    A block that would not shrink is stored as it is, so short texts tie.  With
    ``run_in``, a piece of each dictionary's own content before every chunk, all
    blocks shrink and each byte that a dictionary saves counts.
    """
    body = clean(text)
    chunks = [body[i:i + CHUNK] for i in range(0, len(body), CHUNK)]
    if run_in is None:
        return np.array([sum(map(len, c.multi_compress_to_buffer(chunks))) for c in compressors])
    out = []
    for c, start in zip(compressors, run_in):
        own = len(c.compress(start))
        out.append(sum(len(x) - own for x in c.multi_compress_to_buffer([start + chunk for chunk in chunks])))
    return np.array(out)


def _lead(size: np.ndarray) -> float:
    """How far the best is before the second best, as a share of the best."""
    return float((np.partition(size, 1)[1] - size.min()) / max(size.min(), 1)) if len(size) > 1 else math.inf


def predict(docs: DataFrame, dictionaries: Mapping[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, score and rejected (existing columns of these names are replaced).

    Texts that are null or have no letter: ``und``, score 0, rejected.  Every
    other text gets the language with the fewest bytes, ties the one whose name
    sorts first; score is its softmax weight, rejected says that the margin is
    narrow.  Without any dictionary every text is ``und``.  No shuffle; the
    dictionaries (DICTIONARY bytes a language) travel with the tasks.
    """
    prepare_python(docs.sparkSession)
    names = list(dictionaries)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors, run_in = _compressors(dictionaries), [d[:RUN_IN] for d in dictionaries.values()]
        for texts in batches:
            rows = []
            for t in texts:
                if not names or not isinstance(t, str) or not LETTER.search(t):
                    rows.append((UNKNOWN, 0.0, True))
                    continue
                size = sizes(t, compressors)
                if _lead(size) < NARROW:
                    size = size + sizes(t, compressors, run_in)
                best = int(size.argmin())
                weight = np.exp(-np.minimum(SHARPNESS * (size - size[best]), 700.0))
                rows.append((names[best], float(1.0 / weight.sum()), _lead(size) < MARGIN))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    docs = docs.drop("lang_pred", "score", "rejected")
    [own] = fresh(docs, "_judged")
    return docs.withColumn(own, judged(F.col(text))).select("*", f"{own}.*").drop(own)
