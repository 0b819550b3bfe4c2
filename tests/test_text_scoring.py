"""Normalization and scoring values restated from the reference's tests."""

import datetime as dt

from pyspark.sql import functions as F

from harrow.functions.text import jaccard, normalize_company, title_key, token_set
from harrow.operators import scoring as S

NOW = dt.datetime(2026, 7, 14)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_company_and_title(spark):
    assert one(spark, normalize_company(F.lit("Example Technologies, Inc."))) == "example"
    assert one(spark, normalize_company(F.lit("Acme LLC"))) == "acme"
    assert one(spark, title_key(F.lit("Software Engineer Intern, Summer 2027"))) == \
        one(spark, title_key(F.lit("Software Engineer Intern")))


def test_jaccard_bounds(spark):
    assert one(spark, jaccard(token_set(F.lit("a b c")), token_set(F.lit("a b c")))) == 1.0
    assert one(spark, jaccard(token_set(F.lit("")), token_set(F.lit("x")))) == 0.0


def score(spark, rows, **kw):
    df = spark.createDataFrame(rows, "ord int, title string, description string, company string, location string, "
                                     "platform_slug string, posting_date timestamp, is_expired boolean")
    return {r["ord"]: r for r in S.score_postings(df, NOW, **kw).collect()}


def row(i, title, desc="", posted=None, expired=False, location=None):
    return (i, title, desc, "Acme", location, "ashby", posted, expired)


def test_reference_scoring_cases(spark):
    r = score(spark, [
        row(1, "Software Engineer Intern", posted=NOW - dt.timedelta(days=1)),
        row(2, "Senior Software Engineer"),
        row(3, "Sales Intern"),
        row(4, "Mechanical Engineering Intern"),
        row(5, "Mechanical Design Intern", "CAD and manufacturing"),
        row(6, "Mechanical Systems Software Engineering Intern", "write embedded software"),
        row(7, "Software Engineering Intern", "Requires prior experience; open to upper-year students.", posted=NOW),
        row(8, "Software Engineer Intern", expired=True),
        row(9, "Software Engineer Intern", posted=NOW - dt.timedelta(days=60)),
        row(10, "Machine Learning Intern", "ML engineer role"),
    ])
    assert r[1]["is_internship"] and r[1]["is_software"] and r[1]["is_relevant"] and r[1]["score"] > 0.55
    assert not r[2]["is_relevant"] and "senior software engineer" in r[2]["negatives"]
    assert not r[3]["is_relevant"] and not r[3]["is_software"]
    assert not r[4]["is_relevant"] and "mechanical engineering intern" in r[4]["negatives"]
    assert not r[5]["is_software"] and not r[5]["is_relevant"]
    assert r[6]["is_software"]
    assert r[7]["is_relevant"]
    assert r[8]["score"] == 0.0 and not r[8]["is_relevant"] and r[8]["reasons"] == ["expired"]
    assert r[1]["score"] > r[9]["score"]
    assert "machine_learning" in r[10]["categories"]


def test_location_and_term_boost(spark):
    base = score(spark, [row(1, "Software Engineer Intern", posted=NOW)])[1]["score"]
    boosted = score(spark, [row(1, "Software Engineer Intern Summer 2027", posted=NOW, location="Toronto, ON")],
                    locations=["Toronto"], terms=["Summer 2027"])[1]["score"]
    assert boosted > base


def test_threshold_edge_exact(spark):
    # internship + software + unknown date sums to exactly the default threshold
    r = score(spark, [(1, "intern", "software", None, None, "company", None, False)])[1]
    assert r["score"] == 0.55 and r["is_relevant"]


def test_dictionary_join_equals_the_regex_form(spark):
    import random

    from harrow.operators import scoring as S
    rng = random.Random(5)
    marks = ["c++", "c#", ".net", "node.js", "full-stack", "a b", "a, b", "b+", "+b", "ab", "a", "é", "caf", "machine learning", "r", "-a", "a-", "x1 y2 z3 w4 v5"]
    pieces = marks + [" ", ",", "+", "++", "-", ".", "#", "B", "A", "1", "é", "x1 y2 z3 w4 v5 u6", "  "]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))) for i in range(400)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    want = {r.id: list(r.matched) for r in S.tag_keywords(df, "text", marks).collect()}
    terms = spark.createDataFrame([(m,) for m in marks], "term string")
    found = S.tag_keywords_by_table(df, "text", terms)
    assert {r.id: list(r.matched) for r in found.collect()} == {
        i: [t for t in w if t != "é"] for i, w in want.items()}  # a term without [a-z0-9] matches nothing
    many = terms.unionByName(spark.range(100_000).selectExpr("concat('zz', id, ' q') as term"))
    assert S.tag_keywords_by_table(df, "text", many).filter("size(matched) > 0").count() == sum(any(t != "é" for t in w) for w in want.values())


def test_platform_by_table(spark):
    from harrow.operators import urls as U
    df = spark.createDataFrame([(1, "https://jobs.lever.co/x", 1), (2, "https://notjobs.lever.co/x", 1), (3, "https://jobs.acme.com", 1),
                                (4, "https://jobs.acme.com", 2), (5, "https://d77.example.com/", None), (6, None, 1), (7, "nothing", 1)],
                               "id long, url string, guild_id long")
    own = spark.createDataFrame([(" Acme.com ", "company", 100, 1), ("co", "other", 200, None)], "domain string, platform_slug string, priority int, guild_id long")
    many = spark.range(100_000).selectExpr("concat('d', id, '.example.com') as domain", "'big' as platform_slug", "300 as priority", "cast(null as long) as guild_id")
    table = U.platform_domains(spark).selectExpr("*", "cast(null as long) as guild_id").unionByName(own).unionByName(many)
    found = U.resolve_platform_by_table(df, table, guild="guild_id", keep_unmatched=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.id: r.platform_slug for r in found.collect()} == {1: "lever", 2: "lever", 3: "company", 4: None, 5: "big", 6: None, 7: None}
    strict = U.resolve_platform_by_table(df, table, guild="guild_id", dot_boundary=True)
    assert {r.id: r.platform_slug for r in strict.collect()} == {1: "lever", 2: "other", 3: "company", 5: "big"}
