"""Plans and rows of queries whose cost grew faster than their input."""

import datetime as dt

from pyspark.sql import functions as F

from harrow.operators import scoring as S
from harrow.plans.fixtures import derived
from tests.conftest import SF_SMALL

NOW = dt.datetime(1998, 6, 15)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tags_as_rows_evaluate_each_pattern_in_one_place(spark):
    scored = S.score_postings(derived(spark, SF_SMALL, "d_postings"), NOW)
    plan = plan_of(S.tag_categories(scored))
    below = plan[plan.index("Project"):]
    assert not any("RLIKE" in line.split("Filter", 1)[1] for line in below.splitlines() if "Filter" in line)
    assert "RLIKE" not in "".join(line for line in below.splitlines() if "Join" in line)


def test_tags_as_rows_keep_null_tags_and_drop_rows_without_one(spark):
    rows = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None), (4, ["b", "b"])], "ord long, categories array<string>")
    got = sorted(map(tuple, S.tag_categories(rows).collect()), key=str)
    assert got == sorted([(1, "a"), (1, None), (4, "b"), (4, "b")], key=str)


def test_each_keyword_pattern_stands_once_in_the_scorer_behind_a_plain_search(spark):
    plan = plan_of(S.score_postings(derived(spark, SF_SMALL, "d_postings"), NOW))
    assert plan.count("|appsec|") == 1 and plan.count("RLIKE") <= plan.lower().count("contains(")


def test_terms_are_matched_as_whole_words(spark):
    from harrow.functions.text import keyword_haystack, matched_terms
    rows = spark.createDataFrame([("C++ intern",), ("internal c+",), ("co op  Intern.",), (None,)], "t string")
    got = [r[0] for r in rows.select(matched_terms(keyword_haystack(F.col("t")), ["intern", "c++", "co op"])).collect()]
    assert got == [["intern", "c++"], [], ["intern", "co op"], []]


def test_similar_sets_find_all_pairs_without_a_join_on_single_tokens(spark):
    import random

    from harrow.operators import dedup as D
    draw, sets = random.Random(5), []
    for block in ("x", "y", None):
        for _ in range(60):
            # frequent words, so any two sets share many of them
            base = [f"w{min(draw.randrange(90), draw.randrange(90))}" for _ in range(draw.choice([1, 2, 3, 5, 7, 8, 13, 20, 40, 90]))]
            for _ in range(draw.randrange(4)):
                other = [w for w in base if draw.random() > 0.06] + [f"n{draw.randrange(50)}" for _ in range(draw.randrange(3))]
                sets.append((block, len(sets), sorted(set(other))))
            sets.append((block, len(sets), sorted(set(base))))
    rows = spark.createDataFrame(sets, "block string, rep long, tokens array<string>").withColumn("n", F.size("tokens"))
    for threshold in (0.5, 0.85, 0.9):
        found = D.similar_sets(rows, "block", "tokens", threshold)
        want = {(b, i, j) for b, i, s in sets for c, j, t in sets if b is not None and b == c and i < j and s and t
                and len(set(s) & set(t)) / len(set(s) | set(t)) >= threshold}
        assert {(r.block, r.a, r.b) for r in found.collect()} == want and found.count() == len(want)
        joins = [line for line in plan_of(found).splitlines() if "Join " in line]
        assert joins and not any("tok#" in line for line in joins)


def test_long_sets_that_share_frequent_tokens_are_not_verified(spark, monkeypatch):
    import random

    from harrow.operators import dedup as D
    draw, sets = random.Random(3), []
    for i in range(24):
        # long sets of common words and words of their own, each with a near copy that is just larger than a step of the sketch
        own = {f"c{draw.randrange(3000)}" for _ in range(1500)} | {f"o{i}_{k}" for k in range(700)}
        sets += [("x", 2 * i, sorted(own)), ("x", 2 * i + 1, sorted(own | {f"m{i}_{k}" for k in range(1 + 9 * i)}))]
    rows = spark.createDataFrame(sets, "block string, rep long, tokens array<string>").withColumn("n", F.size("tokens"))
    monkeypatch.setattr(D, "FEW", 0)
    seen = _noted(monkeypatch, D)
    found = D.similar_sets(rows, "block", "tokens", 0.85)
    want = {(i, j, len(set(s) & set(t)) / len(set(s) | set(t))) for _, i, s in sets for _, j, t in sets
            if i < j and len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.85}
    assert {(r.a, r.b, r.jaccard) for r in found.collect()} == want and len(want) >= 24
    pairs = [df for df in seen if df.columns == ["block", "a", "b"]]
    assert pairs and pairs[-1].count() <= 2 * len(want)


def test_texts_are_sent_once_to_a_tile_and_compared_by_differences(spark, monkeypatch):
    from harrow.operators import dedup as D
    base = [f"w{k}" for k in range(60)]
    # copies of one text that differ in one word each: all pairs are similar
    sets = [("x", i, sorted([*base, f"n{i}"])) for i in range(40)] + [("y", 100 + i, sorted([*base[i:], "other"])) for i in range(20)]
    rows = spark.createDataFrame(sets, "block string, rep long, tokens array<string>").withColumn("n", F.size("tokens"))
    want = {(b, i, j, len(set(s) & set(t)) / len(set(s) | set(t))) for b, i, s in sets for c, j, t in sets
            if b == c and i < j and len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.85}
    few = D.similar_sets(rows, "block", "tokens", 0.85)
    assert {tuple(r) for r in few.collect()} == want and few.count() == len(want)
    monkeypatch.setattr(D, "FEW", 0)
    for share in (1 << 17, 5000):
        monkeypatch.setattr(D, "SHARE", share)
        with monkeypatch.context() as m:
            seen = _noted(m, D)
            found = D.similar_sets(rows, "block", "tokens", 0.85)
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
        # a row for each text, not for each pair, and only what it has besides
        differ = [df for df in seen if "__differ" in df.columns]
        assert len(differ) == 1 and differ[0].count() <= 2 * len(sets) < len(want) / 5
        assert differ[0].filter("key < 100").selectExpr("max(size(split(__differ[0].more, ' ')))").first()[0] == 1


def _noted(monkeypatch, module):
    """What a module writes as checkpoints while it runs."""
    seen, write = [], module.reliable_checkpoint
    monkeypatch.setattr(module, "reliable_checkpoint", lambda df: seen.append(df) or write(df))
    return seen


def test_rounds_of_acceptance_carry_short_nodes_and_join_them_once(spark, monkeypatch):
    from harrow.operators import dedup as D
    from harrow.plans.suite_catalog import scored_batch
    batch = scored_batch(spark, SF_SMALL)
    seen, stats = _noted(monkeypatch, D), {}
    D.dedup_batch(batch, stats=stats)
    nodes = [df for df in seen if "kid" in df.columns]
    assert stats["rounds"] > 1 and all(df.schema["kid"].dataType.simpleString() == "binary" for df in nodes)
    # nodes and hops at first, then for each round but the last the kept rows and what is asked of them
    assert len(nodes) == 2 + 2 * (stats["rounds"] - 1)


def test_a_scan_joins_the_wide_rows_of_a_batch_once(spark, tmp_path, monkeypatch):
    from harrow.streaming import catalog_stream as C
    store = C.catalog_store(spark, str(tmp_path / "store"), 2)
    seen = _noted(monkeypatch, C)
    changes = C.scan_changes(derived(spark, SF_SMALL, "d_postings"), store, NOW)
    wide = [df for df in seen if "description" in df.columns and "raw_url" in df.columns]
    # scored postings, accepted ones, touches: the latter two are written, and touches without what only inserts need
    assert len(wide) == 3 and any("breakdown" not in df.columns for df in wide)
    store.write(changes, "00000000")
    assert store.rows("catalog").count() > 0


def _nodes(plan):
    """All nodes of a logical plan."""
    yield plan
    below = plan.children()
    for i in range(below.size()):
        yield from _nodes(below.apply(i))


def test_pages_reach_python_without_html_and_after_their_landing_is_chosen(spark):
    from __spark_entry__ import queries
    for name in ("p12_extract_postings", "m7_mark_expired"):
        nodes = list(_nodes(queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan()))
        waiting = [n for n in nodes if n.nodeName() == "ArrowEvalPython"]
        assert waiting and not any("html" in [n.output().apply(i).name() for i in range(n.output().size())] for n in waiting), name
        if name == "p12_extract_postings":
            below = [m for n in nodes if n.nodeName() == "Aggregate" for m in _nodes(n)]
            assert below and not any(m.nodeName() == "ArrowEvalPython" for m in below)


def test_the_first_landing_of_a_page_counts(spark):
    from harrow.operators import pages as P
    url = "https://jobs.lever.co/fox/1"
    deep = '<script type="application/ld+json">[[[[[{"@type":"JobPosting","title":"Deep &amp; dark","description":"<p>R&amp;D</p>"}]]]]]</script>'
    flat = '<script type="application/ld+json">{"@type":"JobPosting","title":"Flat"}</script>'
    pages = spark.createDataFrame([
        (2, url, url, 200, flat), (1, url, url, 410, deep), (3, url + "0", url + "0", 200, "<title>A &lt; B</title>"),
    ], "ord long, url string, final_url string, status_code int, html string")
    hits = spark.createDataFrame([(7, url, "hit", "x &amp; y"), (8, url + "0", None, "x &amp; y"), (9, url + "9", "hit", "x &amp; y")],
                                 "ord long, url string, title string, snippet string")
    got = {r.ord: (r.title, r.description, r.is_expired, r.source) for r in P.extract_postings(hits, pages, order="ord").collect()}
    assert got == {7: ("Deep &amp; dark", "R&D", True, "jsonld"), 8: ("A < B", "x & y", False, "html"), 9: ("hit", "x & y", False, "search")}
    assert {r.ord: r.source for r in P.extract_postings(hits, pages.drop("ord")).collect()} == {7: "jsonld", 8: "html", 9: "search"}


def test_platforms_by_guild_are_looked_up_without_another_pass_over_the_urls(spark, monkeypatch):
    from __spark_entry__ import queries
    from harrow.operators import urls as U
    seen = _noted(monkeypatch, U)
    plan = plan_of(queries()["p5b_platform_by_guild"](spark, SF_SMALL))
    # the table of hosts is written; a filter on the host would take every URL apart once more at the scan
    assert len(seen) == 1 and not any("Filter" in line and "regexp_extract" in line for line in plan.splitlines())
    assert plan_of(seen[0]).count("Join ") == plan.count("Join ")


def test_domains_of_all_guilds_hold_for_rows_without_a_guild(spark):
    from harrow.operators import urls as U
    rows = spark.createDataFrame([(1, "https://a.fox.com/x", None), (2, "https://a.fox.com/x", 1), (3, "https://a.fox.com/x", 2), (4, "", 1), (5, None, None),
                                  (6, "https://b.org", None), (7, "https://b.org", 2)], "id int, url string, guild long")
    table = spark.createDataFrame([("fox.com", "all", 5, None), ("a.fox.com", "own", 1, 1), ("b.org", "own", 1, 2), ("fox.com", "all", 5, None)],
                                  "domain string, platform_slug string, priority int, guild long")
    got = {r.id: r.platform_slug for r in U.resolve_platform_by_table(rows, table, guild="guild", keep_unmatched=True).collect()}
    assert got == {1: "all", 2: "own", 3: "all", 4: None, 5: None, 6: None, 7: "own"}
    assert {r.id for r in U.resolve_platform_by_table(rows, table, guild="guild").collect()} == {1, 2, 3, 7}


def test_stretches_of_a_text_meet_a_dictionary_of_known_size(spark, monkeypatch):
    from __spark_entry__ import queries
    seen = _noted(monkeypatch, S)
    plan = plan_of(queries()["t5b_dictionary_join"](spark, SF_SMALL))
    # the terms are read back from files, and a stretch isn't put together run by run
    assert len(seen) == 1 and "term" in seen[0].columns and "LogicalRDD" not in plan and "slice(" not in plan


def test_terms_with_marks_are_found_at_the_edges_and_side_by_side(spark):
    texts = ["(the", "x(the", "x (the", "(the) the.", "c++", "c++ c", "c+++", "xc++", "a b c b c", "b  c", ", und", "x, und", "a, und b", "A(the", "", None, "(", "c++c++", "a a a"]
    terms = ["(the", "c++", "b c", "a b c b c", ", und", "the", "A(the", "a a", "((", "A", ") the.", "+ c", "c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.matched for r in S.tag_keywords_by_table(rows, "text", spark.createDataFrame([(t,) for t in [*terms, "c", None]], "term string")).collect()}
    # a term without a letter or digit matches nothing here
    want = {r.id: r.matched for r in S.tag_keywords(rows, "text", [t for t in terms if t != "(("]).collect()}
    assert got == want and got[0] == ["(the", "the"] and got[18] == ["a a"] and sum(map(len, got.values())) > 20
