"""Registered queries op1 to op13 over whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from harrow.llm import (alignment, embedding_neardup, exact_dedup, language_id, line_dedup, merkle, mixing, packing, piece_bpe, simhash,
                        token_counts, toxicity, url_filters)
from harrow.llm.common import held_out, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_embedding_near_dedup(spark, sf_dir):
    return embedding_neardup.near_duplicates(table(spark, sf_dir, "embeddings")).drop("label")


def op2_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op3_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def toxicity_model(spark, sf_dir):
    """Fitted on labelled documents outside the held-out quarter; ids only join labels and decide the split and the sample."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)))


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op6_whole_passages(spark, sf_dir):
    """Repeated passages removed to their ends; op6_line_dedup keeps the chunk rule that its SQL states."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_passages(docs)


def op7_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, TOKENIZER).drop("text")


def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 5, 0)
    found = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op11_sentencepiece(spark, sf_dir):
    return piece_bpe.piece_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)


def op12_token_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, PIECES).drop("groups")


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_url_filters, op3_mix_sources, op4_best_fit_packing, op5_toxicity, op6_line_dedup, op6_whole_passages,
    op7_token_counts, op8_simhash_near_dedup, op9_exact_dedup, op10_language_id, op11_sentencepiece, op12_token_alignment,
    op13_merkle_manifest)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
found AS (
  SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(vec_id, b), vec_id) AS component_id
  FROM embeddings LEFT JOIN degree ON degree.a = vec_id LEFT JOIN lowest ON lowest.a = vec_id)
SELECT *, vec_id = component_id AS kept FROM found"""

_RULES = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in url_filters.RULES)
_OP2 = f"""
WITH p AS (
  SELECT page_id, url, {_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")} AS host,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES {_RULES}),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN best USING (page_id)"""

_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mixing.WEIGHTS.items()) + " ELSE 1.0 END"
_OP3 = f"""
WITH RECURSIVE sizes AS (
  SELECT source, coalesce(sum(strlen(text)), 0)::BIGINT AS n FROM documents GROUP BY source),
weights AS (SELECT source, n, (CASE WHEN n > 0 THEN {_WEIGHT} ELSE 0 END)::DOUBLE AS w FROM sizes),
rates AS (
  SELECT source, coalesce(CASE WHEN n > 0 THEN 1.0::DOUBLE * (w / (SELECT sum(w) FROM weights))
    * (SELECT sum(n) FROM weights)::DOUBLE / n END, 1.0::DOUBLE) AS rate FROM weights),
terms AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS cdf FROM rates WHERE rate > 0
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln((k + 1)::DOUBLE), cdf + exp(log_p + ln(rate) - ln((k + 1)::DOUBLE))
  FROM terms WHERE k < floor(rate + {mixing.TAIL} * sqrt(rate) + {mixing.TAIL_LEAST})),
drawn AS (
  SELECT *, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT
    / {float(1 << 52)}::DOUBLE AS u FROM documents),
numbers AS (
  SELECT d.doc_id, d.text, count(t.k) AS n FROM (SELECT DISTINCT doc_id, text, source, u FROM drawn) d
  JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND t.cdf <= d.u GROUP BY d.doc_id, d.text)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INTEGER AS copy,
  md5('{mixing.SEED}:order:' || coalesce(d.doc_id::VARCHAR, '') || ':' || c.copy::VARCHAR) AS shuffle_key
FROM documents d JOIN numbers x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text IS NOT DISTINCT FROM x.text,
  unnest(range(x.n)) AS c(copy)"""

_LONG = f"(length(line) - length(replace(line, ' ', ''))) >= {line_dedup.LONG_WORDS - 1}"
_OP6 = f"""
WITH d AS (SELECT DISTINCT doc_id, text, md5(coalesce(text, '')) AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, t, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM d),
hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, {_LONG} AS long FROM lines),
cut AS (
  SELECT *, coalesce((h + {line_dedup.FACTOR} * coalesce(lag(h) OVER w, 0)) % {line_dedup.DIVISOR} = 0 OR long
    OR coalesce(lead(long) OVER w, false) OR i = n, true) AS is_end FROM hashed WINDOW w AS (PARTITION BY doc_id, t ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id, t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM cut),
chunks AS (
  SELECT doc_id, t, c, min(i) AS s, count(*) AS size, bool_or(long) AS long, string_agg(line, chr(10) ORDER BY i) AS chunk
  FROM numbered GROUP BY doc_id, t, c),
ranked AS (
  SELECT *, (size > 1 OR long) AND trim(replace(chunk, chr(10), '')) <> '' AND row_number() OVER (
    PARTITION BY chunk, (size > 1 OR long) ORDER BY doc_id IS NULL, doc_id, t, s) > 1 AS gone FROM chunks),
rest AS (
  SELECT doc_id, t, string_agg(chunk, chr(10) ORDER BY c) FILTER (WHERE NOT gone) AS text, count(*) FILTER (WHERE gone) AS removed_chunks,
    coalesce(sum(size) FILTER (WHERE gone), 0) AS removed_lines FROM ranked GROUP BY doc_id, t)
SELECT documents.doc_id, CASE WHEN removed_chunks = 0 THEN documents.text ELSE coalesce(rest.text, '') END AS text,
  removed_chunks::BIGINT AS removed_chunks, removed_lines::BIGINT AS removed_lines
FROM documents JOIN rest ON documents.doc_id IS NOT DISTINCT FROM rest.doc_id AND md5(coalesce(documents.text, '')) = rest.t"""

_NORMAL = _LOWER.format("coalesce(text, '')")
_OP9 = f"""
WITH d AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256, {_NORMAL} AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body),
n AS (SELECT *, row_number() OVER (PARTITION BY body, doc_id) AS i FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND i = 1 AS kept, text_sha256 FROM n JOIN g USING (body)"""

_LEVELS, _TOP_LEVELS = 8, 3  # enough for 8 ** 8 documents a language and 8 ** 3 languages


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"


def _level(below: str, own: str, part: str) -> str:
    """Nodes of a level with the path of their children; a tree with one node stays as it is."""
    by = f"PARTITION BY {part}, i // {merkle.FAN}"
    return f"""
{own}_c AS (SELECT *, count(*) OVER (PARTITION BY {part}) AS n, string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
    string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM {below} WINDOW w AS ({by} ORDER BY i)),
{own} AS (SELECT {part}, i // {merkle.FAN} AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
    FROM {own}_c GROUP BY {part}, i // {merkle.FAN})"""


def _climb(before: str, own: str, level: str, part: str) -> str:
    """Every leaf's hash and proof one level higher."""
    return f"""
{own} AS (SELECT s.* REPLACE (s.i // {merkle.FAN} AS i, CASE WHEN c.n = 1 THEN s.f ELSE sha256(coalesce(c.l, '') || s.f || coalesce(c.r, '')) END AS f,
    s.p || coalesce(c.l, '') || coalesce(c.r, '') AS p) FROM {before} s JOIN {level}_c c ON c.{part} = s.{part} AND c.i = s.i)"""


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
_HASHED = " || ".join(_field(c) for c in merkle.FIELDS)
_OP13 = f"""
WITH d AS (SELECT doc_id, lang, sha256({_HASHED}) AS leaf, coalesce({_CRC} % 3 = 0, false) AS hit,
    sha256({_HASHED.replace("text", "low")}) AS changed FROM (SELECT *, {_LOWER.format("text")} AS low FROM documents)),
l0 AS (SELECT doc_id, leaf AS h, leaf, CASE WHEN hit THEN changed ELSE leaf END AS f, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{",".join(_level(f"l{k}", f"l{k + 1}", "t") for k in range(_LEVELS))},
s0 AS (SELECT doc_id, leaf, f, t, i, '' AS p FROM l0),
{",".join(_climb(f"s{k}", f"s{k + 1}", f"l{k + 1}", "t") for k in range(_LEVELS))},
t0 AS (SELECT 0 AS z, t AS i, h FROM l{_LEVELS}),
{",".join(_level(f"t{k}", f"t{k + 1}", "z") for k in range(_TOP_LEVELS))},
u0 AS (SELECT s.doc_id, s.leaf, s.f, s.p, s.t AS i, 0 AS z, l.h AS subroot FROM s{_LEVELS} s JOIN l{_LEVELS} l ON l.t = s.t),
{",".join(_climb(f"u{k}", f"u{k + 1}", f"t{k + 1}", "z") for k in range(_TOP_LEVELS))}
SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified FROM u{_TOP_LEVELS}, t{_TOP_LEVELS}"""

ORACLES = {"op1_embedding_near_dedup": _OP1, "op2_url_filters": _OP2, "op3_mix_sources": _OP3, "op6_line_dedup": _OP6,
           "op9_exact_dedup": _OP9, "op13_merkle_manifest": _OP13}
