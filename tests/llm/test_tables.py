"""Embeddings, URL filters, mixing, classifiers, components and the pipeline."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from harrow.llm import embedding_neardup, language_id, mixing, toxicity, url_filters
from harrow.llm.common import held_out, table
from harrow.llm.components import components
from harrow.llm.queries import QUERIES, TOKENIZER
from tests.conftest import SF_SMALL
from tests.llm.odd import no_docs, odd_docs, odd_rows, prose
from tests.llm.test_text_operators import check_packing, lowest_reachable, normal, simple_fingerprint


def brute_components(n, pairs):
    label = list(range(n))
    for i, j in pairs:
        a, b = label[i], label[j]
        if a != b:
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)]
    pairs += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    rng.shuffle(pairs)
    edges = spark.createDataFrame(pairs + [(7, None), (None, 8), (5, 5)], "a long, b long")
    label = brute_components(400, pairs)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert {(r.node, r.root) for r in components(edges).collect()} == {(x, label[x]) for x in nodes}
    assert components(edges.where("false")).count() == 0


def vector_rows():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.normal(scale=0.15, size=16)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(300 + i, rows[0][1], 0) for i in range(30)]  # copies
    rows += [(400, rows[0][1], None), (401, None, 0), (402, [0.0] * 16, 0), (403, [1.0] * 15 + [math.nan], 0),
             (404, [], 0), (405, [1.0, 2.0], 0), (406, [1.0, None], 0), (None, rows[1][1], 1), (5, rows[5][1], 2), (407, [math.inf] * 16, 0)]
    return rows


def test_embedding_neardup(spark):
    rows = vector_rows()
    good = [i for i, (_, e, l) in enumerate(rows) if l is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    pairs = []
    for x, i in enumerate(good):
        for j in good[x + 1:]:
            (_, e, l), (_, f, m) = rows[i], rows[j]
            if l == m and len(e) == len(f):
                e, f = np.array(e), np.array(f)
                if e @ f / math.sqrt((e @ e) * (f @ f)) >= 0.93:
                    pairs.append((i, j))
    degree = Counter(x for p in pairs for x in p)
    label = brute_components(len(rows), pairs)
    low = {}
    for i, k in enumerate(label):
        if rows[i][0] is not None:
            low[k] = min(low.get(k, 10 ** 9), rows[i][0])
    want = Counter((rows[i][0], degree[i], low.get(k), rows[i][0] is not None and rows[i][0] == low.get(k)) for i, k in enumerate(label))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for tile in (2048, 16):
        found = embedding_neardup.near_duplicates(vectors.withColumn("node", F.lit("x")).withColumn("kept", F.lit(1)), tile=tile).collect()
        assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == want
    assert embedding_neardup.near_duplicates(vectors.where("false")).count() == 0
    assert embedding_neardup.near_duplicates(vectors.where("embedding is null")).collect()[0].n_links == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(200, 24)) * 10 ** rng.uniform(-3, 3, (200, 1)), rng.normal(size=(150, 24))
    (q, s, n, e), (q2, s2, n2, e2) = embedding_neardup.quantise(x), embedding_neardup.quantise(y)
    exact = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    rough = (q.astype(float) @ q2.T.astype(float)) * s[:, None] * s2
    assert (np.abs(exact - rough) <= n[:, None] * e2 + e[:, None] * (n2 + e2) + 1e-12).all()
    assert np.abs(exact - rough).max() > 0


URLS = ["http://example.org/es/1", "https://a.b.Example.ORG/es", "http://example.org/en/12?x", "http://example.org", "http://org/x#y",
        "http://notorg/", "http://x.com/de/", "http://x.com/fr/q/://z", "http://com/fr", "no scheme", "", None, "http://", "://org/a",
        "http://EXAMPLE.org/en/1", "http://example.org:80/es/", "http://x.com/de/\nline", "ftp://q.com/de/a?b#c", "http://x.com/DE/"]


def judged(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(r.text), r.text, r.verdict) for r in url_filters.RULES
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return (url, host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_filters(spark):
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(URLS * 3)], "page_id long, url string, rule string, n string")
    rows = url_filters.judge_urls(pages).collect()
    assert Counter((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in rows) == Counter(
        (i, *judged(u)) for i, u in enumerate(URLS * 3))
    assert url_filters.judge_urls(pages.where("false")).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, rules=(), default="block").collect()} == {"block"}


def test_url_rules_are_looked_up_by_their_rarest_token(spark):
    rules = [url_filters.Rule("block", f"site{i}.example.com", f"/dir{i % 3}/") for i in range(30)] + [url_filters.Rule("allow", "com")]
    pages = spark.createDataFrame([(i, f"http://www.site{i}.example.com/dir{i % 4}/x") for i in range(60)], "page_id long, url string")
    rows = url_filters.judge_urls(pages, rules).collect()
    assert {r.page_id for r in rows if r.verdict == "block"} == {i for i in range(30) if i % 3 == i % 4}


def test_url_filters_keep_columns_of_inner_names(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "u", "b")], "page_id long, url string, _url string, _best string")
    [row] = url_filters.judge_urls(pages).collect()
    assert (row._url, row._best, row.rule) == ("u", "b", "org/")


def test_poisson_table(spark):
    rates = spark.createDataFrame([(str(r), r) for r in (0.0, 0.01, 1.0, 7.5, 900.0, 1500.0)] + [(None, 2.0)], "source string, rate double")
    found = {r.source: r for r in mixing.poisson_table(rates).collect()}
    assert len(found) == 7 and found["0.0"].cdf == [1.0] and found["1500.0"].first == 1500 - math.ceil(12 * math.sqrt(1500))
    for source, row in found.items():
        rate = float(source or 2.0)
        log_p, totals = -rate, [math.exp(-rate)]
        for k in range(1, row.first + len(row.cdf)):
            log_p += math.log(rate or 1) - math.log(k)
            totals.append(totals[-1] + math.exp(log_p))
        assert row.cdf == pytest.approx(totals[row.first:], abs=1e-9)  # rounding of some 1500 added logarithms
        assert row.cdf[-1] == pytest.approx(1, abs=1e-9)


def test_poisson_table_of_high_rates(spark):
    rates = spark.createDataFrame([("a", 1e6), ("b", 3e8)], "source string, rate double")
    for row in mixing.poisson_table(rates).collect():
        rate = {"a": 1e6, "b": 3e8}[row.source]
        assert row.cdf[0] < 1e-12 and row.cdf[-1] == pytest.approx(1, abs=1e-8)
        # the mean of a count is the sum of 1 - cdf; half of the mass lies below the mean
        assert row.first + sum(1 - c for c in row.cdf) == pytest.approx(rate, rel=1e-6)
        assert row.cdf[int(rate) - row.first] == pytest.approx(0.5, abs=1e-3)


def test_mixing_one_short_document_of_a_large_rate(spark):
    docs = spark.createDataFrame([(1, "x", "a"), (2, "y" * 1000_000, "b")], "doc_id long, text string, source string")
    out = mixing.mix(docs, weights={"a": 1.0, "b": 1.0}).where("source = 'a'")
    n, copies, last = out.agg(F.count("*"), F.count_distinct("copy"), F.max("copy")).first()
    assert n == copies == last + 1 and n == pytest.approx(500_000, rel=0.01)


def test_mixing_reaches_its_weights(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('ab', 10 + cast(id % 5 as int)) as text",
                                        "case when id < 4500 then 'big' when id < 5500 then 'mid' end as source", "id as copy")
    out = mixing.mix(docs, weights={"big": 1.0, "mid": 1.0}, default_weight=2.0, epochs=2.0)
    shares = {r.source: r.c for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("c")).collect()}
    total = docs.agg(F.sum(F.length("text"))).first()[0]
    assert shares["big"] == pytest.approx(0.5 * total, rel=0.1)
    assert shares["mid"] == pytest.approx(0.5 * total, rel=0.1)
    assert shares[None] == pytest.approx(1.0 * total, rel=0.1)
    again = mixing.mix(docs.repartition(7), weights={"big": 1.0, "mid": 1.0}, default_weight=2.0, epochs=2.0)
    assert Counter((r.doc_id, r.copy) for r in out.collect()) == Counter((r.doc_id, r.copy) for r in again.collect())


def test_mixing_odd_tables(spark):
    out = mixing.mix(odd_docs(spark), weights={"a": 3.0}, epochs=3.0)
    assert set(out.columns) == {*odd_docs(spark).columns, "shuffle_key"}
    copies = Counter((r.doc_id, r.text) for r in out.collect())
    assert copies[3, odd_rows()[2][1]] % 2 == 0
    assert mixing.mix(no_docs(spark)).count() == 0


def labelled_rows(n=400):
    rng = random.Random(9)
    bad = ["zorgflat", "krumbix", "vexnodal"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(rng, "en", 80).split()
        for _ in range(5 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_learns_words_and_leaves_clean_texts_alone(spark):
    rows = labelled_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    train = docs.where("doc_id % 3 <> 0")
    model = toxicity.fit(train.drop("toxic"), train.drop("text"))
    found = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id % 3 = 0"), model).collect()}
    right = [(found[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows if i % 3 == 0]
    assert np.mean(right) > 0.97
    hidden = "clean words " * 5000 + "you zorgflat krumbix vexnodal krumbix zorgflat " + "clean words " * 5000
    odd = spark.createDataFrame([(1, None), (2, ""), (3, hidden), (4, "clean words " * 10000)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert all(0 <= x <= 1 for x in scores.values()) and scores[3] >= 0.3 > scores[4] and scores[1] == scores[2] < 0.3


def test_toxicity_learns_fixed_phrases_and_trains_its_dictionary(spark):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        words = prose(rng, "en", 80).split()
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = "filthy zorgflat krumbix vexnodal scum".split()
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    train = docs.where("doc_id % 3 <> 0")
    model = toxicity.fit(train.drop("toxic"), train.drop("text"))
    assert b"zorgflat krumbix vexnodal" in model.dictionaries.toxic
    found = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id % 3 = 0"), model).collect()}
    assert np.mean([(found[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows if i % 3 == 0]) > 0.97


def test_toxicity_without_distinctive_words_is_trained_all_the_same(spark):
    rows = [(i, f"{'zorgflat krumbix' if i < 2 else 'plain ordinary'} " + prose(random.Random(i), "en", 30), int(i < 2)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    assert b"zorgflat" in model.dictionaries.toxic and any(model.evidence)


def test_toxicity_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = toxicity.fit(empty.drop("toxic"), empty.drop("text"))
    out = toxicity.score(odd_docs(spark), model).collect()
    assert len(out) == len(odd_rows()) and all(r.score < 0.3 for r in out)
    only = spark.createDataFrame([(1, "a b c", 1), (None, None, 1), (2, "x", None)], "doc_id long, text string, toxic int")
    assert all(r.score > 0.5 for r in toxicity.score(odd_docs(spark), toxicity.fit(only.drop("toxic"), only.drop("text"))).collect())
    assert toxicity.score(no_docs(spark), model).count() == 0


def test_toxicity_query_holds_out_and_beats_chance(spark):
    rows = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    pairs = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    better = [(a > b) + 0.5 * (a == b) for a, y in pairs if y for b, z in pairs if not z]
    assert len(rows) == 1000 and np.mean(better) > 0.75
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_language_id(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, "de" if i % 2 else "en", 5 + i % 60), "de" if i % 2 else "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id % 5 <> 0"))
    assert list(model) == ["de", "en"]
    out = language_id.predict(docs.where("doc_id % 5 = 0"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    odd = language_id.predict(odd_docs(spark), model).collect()
    assert len(odd) == len(odd_rows())
    for r in odd:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in model) == letters and 0 <= r.score <= 1 and (letters or r.lang_pred == "und")
    assert {r.lang_pred for r in language_id.predict(odd_docs(spark), language_id.fit(no_docs(spark))).collect()} == {"und"}
    assert language_id.predict(no_docs(spark), model).count() == 0


def test_language_dictionary_holds_every_sampled_text_and_copies_once(spark):
    rng = random.Random(5)
    # excerpts lie anywhere in a text, so every one of its parts is marked
    tags = [f"{chr(98 + i % 25)}tag{chr(97 + i // 25)}" for i in range(133)]
    texts = [" ".join(["aaa copied"] * 200)] * 67 + [f" {tag} ".join(prose(rng, "en", 300).split()) for tag in tags]
    docs = spark.createDataFrame([(i, t if i % 2 else t.upper(), "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    content = language_id.fit(docs)["en"]
    share = language_id.DICTIONARY // 134
    assert len(content) <= language_id.DICTIONARY and 0 < content.count(b"aaa copied") <= share // 10
    assert all(f" {tag} ".encode() in content for tag in tags)


def test_language_of_texts_that_open_without_letters(spark):
    rng = random.Random(6)
    rows = [(i, "0123456789 " * 120 + prose(rng, "de", 200), "de") for i in range(20)]
    rows += [(100 + i, prose(rng, "en", 200), "en") for i in range(20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model["de"]) > 5_000
    asked = spark.createDataFrame([(1, prose(rng, "de", 60), 7)], "doc_id long, text string, _judged int")
    [row] = language_id.predict(asked, model).collect()
    assert row.lang_pred == "de" and row._judged == 7  # a column of the operator's own inner name stays


def brute_language(text, dictionaries):
    """lang_pred by one-shot zstandard calls, one chunk and dictionary after the other."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" or c == "'" else " " for c in " " + text.lower() + " ")
    body = re.sub(" +", " ", kept).encode()

    def total(content, start):
        params = zstandard.ZstdCompressionParameters.from_level(
            language_id.LEVEL, source_size=language_id.CHUNK, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        own = len(c.compress(start)) if start else 0
        return sum(len(c.compress(start + body[i:i + language_id.CHUNK])) - own for i in range(0, len(body), language_id.CHUNK))
    size = {name: total(content, b"") for name, content in dictionaries.items()}
    two = sorted(size.values())[:2]
    if two[1] - two[0] < language_id.NARROW * two[0]:
        size = {name: n + total(dictionaries[name], dictionaries[name][:language_id.RUN_IN]) for name, n in size.items()}
    return min(sorted(size), key=size.get)


def test_language_query_equals_plain_calls(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    got = {r.doc_id: r.lang_pred for r in QUERIES["op10_language_id"](spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        letters = any(unicodedata.category(c).startswith("L") for c in text or "")
        assert got[i] == (brute_language(text, model) if letters else "und")


def test_even_shares():
    assert language_id.even_shares([b"a" * 3, b"b" * 50, b"c" * 9], 30) == [b"a" * 3, b"b" * 18, b"c" * 9]
    assert language_id.even_shares([b"ab", b"c"], 30) == [b"ab", b"c"] and language_id.even_shares([], 30) == []
    assert sum(map(len, language_id.even_shares([b"x" * 1000] * 200, 65536))) <= 65536


def test_language_query_accuracy(spark):
    rows = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").collect()}
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.97


def test_held_out(spark):
    import zlib
    rows = spark.createDataFrame([(i,) for i in [*range(200), -7, 2 ** 60]], "doc_id long").select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def brute_stages(spark, docs, sf_dir):
    """The pipeline's decisions one after the other in plain Python; scores come from the fitted classifier."""
    model = corpus_pipeline.toxicity_model(spark, sf_dir)
    pair = model.dictionaries.compressors()
    docs = [d for d in docs if model.score(model.strongest(toxicity.savings((d.text or "").encode(), pair))) < toxicity.THRESHOLD]
    yield docs
    best = {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        best[normal(d.text)] = d
    docs = list(best.values())
    yield docs
    ids, _ = lowest_reachable([simple_fingerprint(d.text) for d in docs], [d.doc_id for d in docs])
    docs = [d for d, i in zip(docs, ids) if d.doc_id == i]
    yield docs
    import hashlib
    size = Counter()
    for d in docs:
        size[d.source] += len((d.text or "").encode())
    weight = {s: mixing.WEIGHTS.get(s, 1.0) if n else 0.0 for s, n in size.items()}
    mixed = []
    for d in docs:
        rate = weight[d.source] / sum(weight.values()) * sum(size.values()) / size[d.source]
        text = f"{mixing.SEED}:{d.doc_id}:{hashlib.md5((d.text or '').encode()).hexdigest()}"
        u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2 ** 52
        p = total = math.exp(-rate)
        k = 0
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        mixed += [d] * k
    yield mixed


def test_pipeline(spark):
    docs = table(spark, SF_SMALL, "documents")
    wanted = brute_stages(spark, docs.collect(), SF_SMALL)
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted):
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert Counter(map(tuple, rows)) == Counter(map(tuple, want)), name
        docs = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF_SMALL).collect()
    used, least = check_packing(packed, [(d.doc_id, d.text) for d in want])
    assert used <= 1.05 * least + 1
    whole = corpus_pipeline.run(spark, SF_SMALL)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_pipeline_stages_take_odd_and_empty_tables(spark):
    for make in (odd_docs, no_docs):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_SMALL)
            assert docs.columns == make(spark).columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() > 0) == (make is odd_docs)
    assert TOKENIZER
