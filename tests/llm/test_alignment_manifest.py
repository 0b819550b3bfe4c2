"""SentencePiece encoding, tokenizer alignment and the Merkle manifest against the libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from harrow.llm import alignment, merkle, piece_bpe
from harrow.llm.common import table
from harrow.llm.queries import PIECES, QUERIES, TOKENIZER
from tests.conftest import SF_SMALL
from tests.llm.odd import no_docs, odd_docs, odd_rows

LIBRARY_B = SentencePieceProcessor(model_file=PIECES)
LIBRARY_A = Tokenizer.from_file(TOKENIZER)
LIBRARY_A.encode_special_tokens = True
PARTS = [" ", "  ", " " * 7, "\n", "\t", "a", "b", " th", "'s", "1", "23", ".", ",", "word,", "é", "日本", "😀", "<s>", "<|endoftext|>", "<0x0A>",
         "▁", "▁▁", "the ", "\x00", "\r\n", "　", "ﬁ", "̀", " \n ", "aaaaaaaaab", "⁇"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=14).map("".join)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(sf):
    import duckdb
    return duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall()


# ------------------------------------------------------------- SentencePiece
@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_like_the_library(text):
    own = piece_bpe.piece_model(PIECES)
    ids = own.encode(text).tolist()
    assert ids == LIBRARY_B.encode(text)
    assert own.decode(ids) == LIBRARY_B.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 13, 35, 131, 150, 156, 162, 172, 195, 200, 230, 243, 259, 264, 28705, 31000]), max_size=9))
def test_any_ids_decode_like_the_library(ids):
    assert piece_bpe.piece_model(PIECES).decode(ids) == LIBRARY_B.decode(ids)


def test_encode_and_decode_keep_all_columns(spark):
    docs = odd_docs(spark)
    found = piece_bpe.encode_and_decode(docs, PIECES)
    assert found.columns == [*docs.columns, "piece_ids", "decoded_text"]
    rows = found.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert r.piece_ids == LIBRARY_B.encode(r.text or "")
        assert r.decoded_text == LIBRARY_B.decode(r.piece_ids)
    assert piece_bpe.encode_and_decode(no_docs(spark), PIECES).count() == 0
    again = piece_bpe.encode_and_decode(found, PIECES)
    assert again.columns == found.columns and again.count() == len(rows)


def test_a_difference_from_the_library_stops_the_query():
    with pytest.raises(RuntimeError, match="encode differs"):
        piece_bpe._compare("encode", ["a", "b"], [[1], [2]], [[1], [3]])


def test_sentencepiece_query(spark):
    texts = dict(documents(SF_SMALL))
    rows = QUERIES["op11_sentencepiece"](spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY_B.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY_B.decode(ids)))


# ----------------------------------------------------------------- alignment
def brute_groups(text):
    """(ids of A, ids of B) of every group, by walking both token sequences; None if a tokenizer changes the bytes."""
    if not text:
        return None
    own = alignment.aligner(TOKENIZER, PIECES)
    ids_a, ids_b = LIBRARY_A.encode(" " + text, add_special_tokens=False).ids, LIBRARY_B.encode(text)
    bytes_a = [own.bytes_a[i] for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if LIBRARY_B.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, LIBRARY_B.id_to_piece(i)) for i in ids_b)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
    out, k, j = [], 0, 0
    behind_a, behind_b = ({end: i + 1 for i, end in enumerate(x)} for x in (ends_a, ends_b))
    for end in sorted(set(ends_a) & set(ends_b)):
        a, b = behind_a[end], behind_b[end]
        out.append((ids_a[k:a], ids_b[j:b]))
        k, j = a, b
    return out


def brute_alignment(texts):
    groups = [brute_groups(t) or [] for t in texts]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    holders = Counter(pair for own in links for pair in own)
    top = defaultdict(int)
    for (a, _), n in holders.items():
        top[a] = max(top[a], n)
    return [(sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()),
             sum(n for p, n in own.items() if holders[p] == top[p[0]]), sum(n * holders[p] for p, n in own.items()),
             sha(t) if (t := ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)) else "")
            for g, own in zip(groups, links)]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_alignment_of_texts(texts):
    found = alignment.aligner(TOKENIZER, PIECES).align(texts)
    assert len(found) == len(texts)
    for text, doc in zip(texts, found):
        groups = brute_groups(text) or []
        assert doc.groups == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        links = Counter(a * alignment.PAIR + b for x, y in groups for a in x for b in y)
        assert dict(zip(doc.pairs.tolist(), doc.links.tolist())) == links
        assert (doc.n_a, doc.n_b, doc.n_groups) == (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups))


def test_products_equal_dense_ones(monkeypatch):
    monkeypatch.setattr(alignment, "EXPANDED", 7)  # several blocks of rows
    rng = np.random.default_rng(3)
    for _ in range(30):
        x, y = (rng.integers(0, 4, size) * (rng.random(size) < 0.3) for size in ((9, 6), (6, 8)))
        left, right = (alignment.csr(*np.nonzero(m), m[np.nonzero(m)], m.shape[0]) for m in (x, y))
        made = alignment.gustavson(left, right, 8)
        dense = np.zeros((9, 8), int)
        dense[made.rows, made.columns] = made.values
        assert (dense == x @ y).all()
        back = alignment.transpose(right, 8)
        dense = np.zeros((8, 6), int)
        dense[back.rows, back.columns] = back.values
        assert (dense == y.T).all()


def test_overlaps_are_those_of_the_byte_ranges():
    own = alignment.aligner(TOKENIZER, PIECES)
    text = "The thnrheing 日本 walked, ndstha 12345"
    a = [own.bytes_a[i] for i in LIBRARY_A.encode(" " + text, add_special_tokens=False).ids]
    b = [own.bytes_b[i] for i in LIBRARY_B.encode(text)]
    ends_a, ends_b = np.cumsum(list(map(len, a))), np.cumsum(list(map(len, b)))
    n = sum(max(e - len(x), f - len(y)) < min(e, f) for x, e in zip(a, ends_a) for y, f in zip(b, ends_b))
    assert own.align([text])[0].n_overlaps == n


def test_segments_are_forgotten(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    own = alignment.Aligner(TOKENIZER, PIECES)
    texts = [f"some words {i} that change nnthe{i}" for i in range(40)]
    want = [d.groups for d in own.align(texts)]
    assert [own.align([t])[0].groups for t in texts] == want
    assert len(own.place) < 20


@pytest.mark.parametrize("entries", [1, 1_000_000])
def test_alignment_of_odd_documents(spark, monkeypatch, entries):
    monkeypatch.setattr(alignment, "CHUNK_ENTRIES", entries)  # one document a chunk, or all of a task
    texts = [r[1] for r in odd_rows()] + ["a ▁ b", "x▁"]
    docs = odd_docs(spark).select("doc_id", "text", "n", "kept").unionByName(
        spark.createDataFrame([(900, "a ▁ b", 1, "k"), (901, "x▁", 1, "k")], "doc_id long, text string, n int, kept string"))
    rows = alignment.align(docs, TOKENIZER, PIECES, with_groups=True).collect()
    assert Counter(r.doc_id for r in rows) == Counter([r[0] for r in odd_rows()] + [900, 901])
    want = brute_alignment(texts)
    own = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)
    assert own == Counter((i, *w) for i, w in zip([r[0] for r in odd_rows()] + [900, 901], want))
    assert all(r.groups_sha256 == (sha(r.groups) if r.groups else "") for r in rows)
    assert alignment.align(no_docs(spark), TOKENIZER, PIECES).collect() == []


def test_alignment_query(spark):
    docs = documents(SF_SMALL)
    rows = {r.doc_id: r for r in QUERIES["op12_token_alignment"](spark, SF_SMALL).collect()}
    for (i, _), want in zip(docs, brute_alignment([t for _, t in docs])):
        r = rows.pop(i)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want
    assert not rows


# ------------------------------------------------------------------ manifest
def lower_ascii(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root of (doc_id, source, lang, n_chars, text) rows."""
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k:k + 8])) for k in range(0, len(levels[-1]), 8)])
        return levels

    def fold(levels, k, start):
        siblings = ""
        for level in levels[:-1]:
            run = level[k // 8 * 8:k // 8 * 8 + 8]
            siblings += "".join(h for j, h in enumerate(run) if j != k % 8)
            run[k % 8] = start
            start, k = sha("".join(run)), k // 8
        return start, siblings

    groups = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        changed = (*r[:4], lower_ascii(r[4])) if hit and r[4] is not None else r
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf(changed), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g])]) for g in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for t, g in enumerate(names):
        for k, x in enumerate(sorted(groups[g])):
            folded, low = fold(trees[t], k, x[3])
            folded, high = fold(top, t, folded)
            out.append((x[4], x[2], trees[t][-1][0], top[-1][0], sha(low + high), folded, folded == top[-1][0]))
    return out


def manifest_rows(df):
    return Counter(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))


def test_manifest_of_odd_documents(spark):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows()]
    found = manifest_rows(merkle.manifest(odd_docs(spark)))
    assert found == Counter(brute_manifest(rows))
    assert merkle.manifest(no_docs(spark)).collect() == []


@pytest.mark.parametrize("sizes", [[1], [9], [65, 1, 8, 3], [600, 2] + [1] * 9])
def test_manifest_of_many_shapes(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.choice([None, *range(500)]), "s", None if g == 0 and len(sizes) > 1 else f"l{g}é", k, rng.choice(["A b", "a b", None, ""]))
            for g, n in enumerate(sizes) for k in range(n)]
    rows += rows[:1] * 3 if len(rows) > 500 else []
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    found = manifest_rows(merkle.manifest(docs))
    assert found == Counter(brute_manifest(rows))
    assert len(rows) < 9 or {x[-1] for x in found} == {True, False}


def test_row_limit_of_the_recursion_is_restored(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.manifest(table(spark, SF_SMALL, "documents"))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
