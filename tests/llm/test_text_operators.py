"""Token counts, packing, exact dedup, SimHash and line dedup against brute force, on odd and on given tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from harrow.llm import exact_dedup, line_dedup, packing, simhash, token_counts
from harrow.llm.queries import QUERIES, TOKENIZER
from tests.conftest import SF_SMALL
from tests.llm.odd import no_docs, odd_docs, odd_rows

LIBRARY = Tokenizer.from_file(TOKENIZER)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


PARTS = [" ", "  ", "\n", "\t", " ", "\x1c", "\x85", "a", "b", " th", "'s", "'", "1", "23", ".", ",", "é", "ß", "日本", "😀",
         "՘", "<|endoftext|>", "<|", "the ", "_", "-", "\r\n", "　", "ﬁ", "̀", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_pieces_tokenize_like_the_library(text):
    want = ids_of(text)
    assert np.frombuffer(packing._encoder(TOKENIZER).encode(text), "<u4").tolist() == want
    assert token_counts._counter(TOKENIZER).count(text) == len(want)


def test_cache_keeps_results_when_it_turns_over(monkeypatch):
    monkeypatch.setattr("harrow.llm.pretokens.CACHE_ENTRIES", 3)
    counter = token_counts.MergeCounter(TOKENIZER)
    text = " ".join(f"word{i % 7} other{i}," for i in range(50))
    assert counter.count(text) == counter.count(text) == len(ids_of(text))


def test_token_counts(spark):
    rows = token_counts.count_tokens(odd_docs(spark), TOKENIZER).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        n = len(ids_of(r.text))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 1024)
    assert token_counts.count_tokens(no_docs(spark), TOKENIZER).count() == 0


def test_token_counts_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op7_token_counts"](spark, SF_SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(ids_of(t)) for i, t in texts.items()}


def check_packing(rows, docs, capacity=1024):
    """Pieces are whole documents in order, sequences are gapless and never too long."""
    pieces = Counter()
    for doc_id, text in docs:
        ids = ids_of(text) + [2]
        head = len(ids) if len(ids) <= capacity else len(ids) % capacity
        edges = sorted({0, len(ids), *range(head, len(ids), capacity)})
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            pieces[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places), sum(r.length for r in rows) / capacity


def test_packing(spark):
    docs = [(r[0], r[1]) for r in odd_rows()]
    check_packing(packing.pack(odd_docs(spark), TOKENIZER).collect(), docs)
    check_packing(packing.pack(odd_docs(spark), TOKENIZER, shard_docs=5).collect(), docs)
    assert packing.pack(no_docs(spark), TOKENIZER).count() == 0
    for r in packing.pack(odd_docs(spark), TOKENIZER, with_ids=True).collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_packing_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    used, least = check_packing(QUERIES["op4_best_fit_packing"](spark, SF_SMALL).collect(), docs)
    assert used <= 1.05 * least + 1


def test_sum_of_squares_is_the_least_of_all_choices():
    rng = np.random.default_rng(3)
    capacity, lengths = 20, rng.integers(1, 21, 300)
    sequence, offset = packing.sum_of_squares(lengths, capacity)
    gaps = {}
    for s, q, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        def squares(change):
            left = Counter(g for g in {**gaps, **change}.values() if 0 < g < capacity)
            return sum(n * n for n in left.values())
        choices = [squares({k: g - s}) for k, g in gaps.items() if g >= s] + [squares({-1: capacity - s})]
        before = gaps.get(q, capacity)
        assert o == capacity - before
        assert squares({q: before - s}) == min(choices)
        gaps[q] = before - s


def normal(text):
    return (text or "").encode().lower()


def test_exact_dedup(spark):
    rows = odd_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    best = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in groups.items()}
    report = exact_dedup.duplicate_report(odd_docs(spark)).collect()
    want = Counter((i, best[k], len(v), hashlib.sha256(k).hexdigest()) for k, v in groups.items() for i in v)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in report) == want
    assert Counter(r.text_sha256 for r in report if r.kept) == Counter(hashlib.sha256(k).hexdigest() for k in groups)
    kept = exact_dedup.exact_dedup(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert Counter((r.doc_id, normal(r.text)) for r in kept.collect()) == Counter((best[k], k) for k in groups)
    assert exact_dedup.duplicate_report(no_docs(spark)).count() == exact_dedup.exact_dedup(no_docs(spark)).count() == 0


@pytest.mark.parametrize("memory", [1 << 30, 4000, 200])
def test_grace_spills_and_cleans_up(memory, tmp_path):
    rng = np.random.default_rng(1)
    texts = [f"Text {rng.integers(0, 300)}" * 5 for _ in range(3000)] + ["hot"] * 3000
    rng.shuffle(texts)
    hashes = [exact_dedup.digest(normal(t)) for t in texts]
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts, exact_dedup.TIE: [0] * len(texts),
                      exact_dedup.HASH: pa.array(hashes, pa.binary()), exact_dedup.SIZE: pa.array([1] * len(texts), pa.int64())})
    out = [r for b in exact_dedup.grace(iter(table.to_batches(100)), "text", "doc_id", memory, folder=str(tmp_path)) for r in b.to_pylist()]
    want = {}
    for i, t in enumerate(texts):
        n, _ = want.get(t, (0, 0))
        want[t] = (n + 1, i)
    assert {r["text"]: (r[exact_dedup.SIZE], r["doc_id"]) for r in out} == want and len(out) == len(want)
    assert not list(tmp_path.iterdir())


def test_open_addressing_compares_content_when_hashes_collide():
    table = exact_dedup.Table("text", "doc_id")
    texts = ["a", "b", "A", "c", "B"]
    same = [b"\0" * 32] * len(texts)
    table.add(pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, None, 5], "text": texts, exact_dedup.TIE: [0] * 5,
                                          exact_dedup.HASH: pa.array(same, pa.binary()), exact_dedup.SIZE: [1] * 5}))
    rows = {r["text"].lower(): (r["doc_id"], r[exact_dedup.SIZE]) for b in table.rows() for r in b.to_pylist()}
    assert rows == {"a": (3, 2), "b": (5, 2), "c": (None, 1)}


def simple_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def lowest_reachable(fps, ids, radius=4):
    label = list(range(len(fps)))
    fps = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = label[i], label[j]
            if a != b:
                label = [a if x == b else x for x in label]
    low = {}
    for k, i in zip(label, ids):
        if i is not None:
            low[k] = min(low.get(k, i), i)
    return [low.get(k) for k in label], label


def test_masks_cover_every_difference_within_the_radius():
    rng = np.random.default_rng(5)
    tables = simhash.masks()
    assert len(tables) == 31
    for _ in range(3000):
        x = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert (tables & np.uint64(x) == 0).any()


def test_simhash(spark):
    rows = odd_rows()
    fps = [simple_fingerprint(r[1]) for r in rows]
    ids, label = lowest_reachable(fps, [r[0] for r in rows])
    found = simhash.simhash_groups(odd_docs(spark)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == Counter(
        (r[0], f"{f:016x}", i) for r, f, i in zip(rows, fps, ids))
    kept = simhash.simhash_dedup(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(dict(zip(label, ids)).values())
    assert simhash.simhash_groups(no_docs(spark)).count() == simhash.simhash_dedup(no_docs(spark)).count() == 0


def test_simhash_links_lose_nothing_in_large_and_split_buckets(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2 ** 63, 3)
    fps = set()
    for c in centre.tolist():
        for _ in range(150):
            x = c
            for b in rng.choice(64, 3, replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps | {int(x) for x in rng.integers(0, 2 ** 63, 100)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, first_id long")
    want, _ = lowest_reachable(fps, list(range(len(fps))))
    for block in (16384, 20):
        found = simhash.links(distinct, block=block).collect()
        label = {x: x for x in signed}
        for r in found:
            a, b = label[r.a], label[r.b]
            if a != b:
                label = {k: a if v == b else v for k, v in label.items()}
        low = {}
        for i, x in enumerate(signed):
            low.setdefault(label[x], i)
        assert [low[label[x]] for x in signed] == want
        assert len(found) < 31 * 20 * len(fps)


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    fps = [simple_fingerprint(r.text) for r in docs]
    ids, _ = lowest_reachable(fps, [r.doc_id for r in docs])
    rows = QUERIES["op8_simhash_near_dedup"](spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted(
        (r.doc_id, f"{f:016x}", i) for r, f, i in zip(docs, fps, ids))


PASSAGE = "\n".join(f"shared line number {i} with a few words" for i in range(12))


def test_line_dedup_removes_a_shared_passage_wherever_it_stands(spark):
    long_line = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"first own line\n{PASSAGE}\nlast own line"), (2, f"another start\nmore\nmore still\n{PASSAGE}\nanother end"),
            (3, f"head\n{long_line}\ntail"), (4, f"{long_line}\nother tail"), (5, "nothing shared\nat all here"), (5, "nothing shared\nat all here"),
            (6, None), (None, ""), (7, "\n\n\n"), (8, "\n\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r.doc_id, r.removed_lines > 0): r for r in line_dedup.dedup_lines(docs).collect()}
    assert line_dedup.dedup_lines(docs).count() == len(rows)
    assert out[1, False].text == rows[0][1] and out[3, False].text == rows[2][1]
    assert out[4, True].text == "other tail"
    shorter = out[2, True]
    assert shorter.removed_lines >= 6 and shorter.text.startswith("another start") and shorter.text.endswith("another end")
    assert out[5, False].text == rows[4][1] and out[6, False].text is None and out[None, False].text == ""
    assert out[7, False].text == out[8, False].text == "\n\n\n"


def test_line_dedup_on_odd_and_empty_tables(spark):
    out = line_dedup.dedup_lines(odd_docs(spark))
    assert out.count() == len(odd_rows())
    assert line_dedup.dedup_lines(no_docs(spark)).count() == 0


def test_passages_go_whole(spark):
    import random
    rng = random.Random(8)
    passages = [[f"p{k} l{j} " + " ".join(f"w{rng.randrange(999)}" for _ in range(10)) for j in range(5 + k % 4)] for k in range(30)]
    rows, own = [], {}
    for copy in range(2):
        for k, passage in enumerate(passages):
            i = copy * 100 + k
            own[i] = [f"own {i} {j} " + "x" * (i % 7) for j in range(6)]
            cut = rng.randrange(7)
            head, tail = own[i][:cut], own[i][cut:]
            rows.append((i, "\n".join(head + passage + ["see also", ""] + tail)))
    rows += [(500, None), (501, ""), (502, "a b\n\n\nc d"), (503, "a b\nother\n\n\nc d"), (504, "see also"), (504, "see also")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_passages(docs).collect()}
    for k, passage in enumerate(passages):
        assert out[k].text == rows[k][1] and out[k].removed_lines == 0
        rest = out[100 + k].text.split("\n")
        assert [x for x in rest if x not in ("see also", "")] == own[100 + k]
        assert out[100 + k].removed_runs == 1 and out[100 + k].removed_lines >= len(passage)
    assert all(out[i].text == t and out[i].removed_runs == 0 for i, t in rows[-6:])


def brute_passages(texts):
    """For texts by id: the kept lines of each and the removed runs as (id, start, end, id of the heads' text, its start)."""
    lines = {i: t.split("\n") for i, t in sorted(texts.items())}
    units = [(i, s, size) for i, x in lines.items() for size in (1, 2) for s in range(len(x) - size + 1)
             if size == 2 or len(x[s].split()) >= line_dedup.LONG_WORDS]
    heads = {}
    for i, s, size in sorted(units):
        heads.setdefault(tuple(lines[i][s:s + size]), (i, s))
    later = {}
    for i, s, size in units:
        j, r = heads[tuple(lines[i][s:s + size])]
        if (i, s) != (j, r) and not (i == j and s < r + size):
            later[i, s, size] = (j, r)

    def runs(units):
        groups = defaultdict(list)
        for (i, s, size), (j, r) in sorted(units.items()):
            chain = groups[i, j, s - r]
            if chain and s < chain[-1][1]:
                chain[-1][1] = max(chain[-1][1], s + size)
            else:
                chain.append([s, s + size])
        found = [(i, s, e, j, s - offset) for (i, j, offset), chains in groups.items() for s, e in chains]
        return [x for x in found if len(" ".join(lines[x[0]][x[1]:x[2]]).split()) >= line_dedup.LONG_WORDS
                or sum(bool(y.strip(" ")) for y in lines[x[0]][x[1]:x[2]]) >= 2]

    cut = {(i, k) for i, s, e, _, _ in runs(later) for k in range(s, e)}
    found = runs({u: (j, r) for u, (j, r) in later.items() if not any((j, k) in cut for k in range(r, r + u[2]))})
    gone = {(i, k) for i, s, e, _, _ in found for k in range(s, e)}
    return {i: [(k, y) for k, y in enumerate(x) if (i, k) not in gone] for i, x in lines.items()}, found, lines


def passage_rows(seed):
    """Texts over few different lines, so that runs overlap, repeat within a text and copy each other; some lines are long."""
    import random
    rng = random.Random(seed)
    pool = [f"l{k}" for k in range(14)] + ["", " ", "x y z"] + [f"g{k} " + "w " * 52 for k in range(3)]
    texts = [[rng.choice(pool) for _ in range(rng.randrange(1, 14))] for _ in range(60)]
    for _ in range(40):  # copies of stretches in other surroundings
        a = rng.choice(texts)
        s = rng.randrange(len(a))
        texts.append([rng.choice(pool)] * rng.randrange(3) + a[s:s + rng.randrange(2, 9)] + [rng.choice(pool)])
    return {i: "\n".join(x) for i, x in enumerate(texts)}


def check_passages(spark, texts):
    kept, runs, lines = brute_passages(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_passages(docs).collect()}
    per_text = Counter(x[0] for x in runs)
    for i, text in texts.items():
        assert out[i].text == ("\n".join(y for _, y in kept[i]) if per_text[i] else text)
        assert out[i].removed_runs == per_text[i] and out[i].removed_lines == len(lines[i]) - len(kept[i])
    for i, s, e, j, r in runs:  # what a run copies stands unbroken in a kept text
        assert lines[i][s:e] == lines[j][r:r + e - s] and {(k, lines[j][k]) for k in range(r, r + e - s)} <= set(kept[j])
    return runs


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force_and_what_they_copy_stays(spark, seed):
    assert len(check_passages(spark, passage_rows(seed))) > 30


def test_passages_of_overlapping_runs_stay_somewhere(spark):
    texts = {1: "x one\nb two\nc three", 2: "a zero\nb two\nc three", 3: "a zero\nb two\nq nine", 4: "e\ne\ne\ne\ne", 5: "f\ng\nf\ng\nf\ng"}
    assert check_passages(spark, texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.dedup_passages(docs).collect()}
    assert [out[i] for i in (1, 2, 3)] == [texts[1], "a zero", texts[3]] and out[5] == "f\ng"


def test_passages_odd_and_empty_tables(spark):
    assert line_dedup.dedup_passages(odd_docs(spark)).count() == len(odd_rows())
    assert line_dedup.dedup_passages(no_docs(spark)).count() == 0


def test_equal_rows_spread_over_shards(spark):
    docs = spark.createDataFrame([(7, "the same words")] * 3000, "doc_id long, text string").repartition(4)
    rows = packing.pack(docs, TOKENIZER, shard_docs=1000).select("sequence_id", "length").collect()
    shards = Counter(r.sequence_id >> 40 for r in rows)
    assert len(shards) == 3 and max(shards.values()) < 1150
    assert len({r.sequence_id for r in rows}) <= 3 * (1 + 1000 * rows[0].length // 1000)


def test_full_pieces_are_sequences_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b " * 3000), (1, "a b " * 3000)], "doc_id long, text string")
    rows = packing.pack(docs, TOKENIZER).collect()
    full = [r for r in rows if r.length == 1024]
    assert full and len({r.sequence_id for r in full}) == len(full) and all(r.offset == 0 and r.sequence_id >= packing.FULL for r in full)
    check_packing(rows, [(1, "a b " * 3000)] * 2)
