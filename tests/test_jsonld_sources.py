"""JSON-LD extraction on nested layouts, and the JSON landed-page reader."""

import json

from pyspark.sql import functions as F

from harrow.operators import pages as P
from harrow.sources.pages import join_pages, load_pages


def _page(*blocks):
    return "<html><head>" + "".join(
        f'<script type="application/ld+json">{b}</script>' for b in blocks) + "</head><body></body></html>"


def test_nested_jsonld(spark):
    rows = [
        (1, _page('[{"@type":"Organization","name":"x"},{"@type":"JobPosting","title":"A",'
                  '"jobLocation":[{"address":{"addressLocality":"Paris","addressCountry":"FR"}}]}]')),
        (2, _page('{"@graph":[{"@type":["Thing","JobPosting"],"title":"B","hiringOrganization":"Acme",'
                  '"jobLocationType":"TELECOMMUTE","identifier":{"value":123}}]}')),
        (3, _page('{not json', '{"@type":"JobPosting","title":"C","description":"<p>x &amp; y</p>",'
                  '"datePosted":"2026-07-13T10:00:00Z","employmentType":["FULL_TIME"]}')),
        (4, _page('{"@type":"WebPage"}')),
        (5, "<html><body>no blocks</body></html>"),
    ]
    df = spark.createDataFrame(rows, "id int, html string")
    got = {r["id"]: r for r in P.jsonld_postings(df).collect()}
    assert got[1]["ld_title"] == "A" and got[1]["ld_location"] == "Paris, FR"
    assert got[2]["ld_title"] == "B" and got[2]["ld_company"] == "Acme"
    assert got[2]["ld_location"] == "Remote" and got[2]["ld_remote_status"] == "Remote"
    assert got[2]["ld_external_id"] == "123"
    assert got[3]["ld_title"] == "C" and got[3]["ld_description"] == "x & y"
    assert got[3]["ld_employment_type"] is None and got[3]["ld_posting_date"] is not None
    assert not got[4]["ld_found"] and not got[5]["ld_found"]


def test_jsonld_at_any_depth_in_document_order(spark):
    def nested(depth, title):
        x = {"@type": "JobPosting", "title": title, "validThrough": "2020-01-01"}
        for i in range(depth):
            x = [x] if i % 2 else {"@graph": [{"@type": "Thing"}, x]}
        return x
    rows = [(d, _page(json.dumps(nested(d, f"t{d}")))) for d in (0, 1, 3, 4, 5, 6, 40)]
    # a deeply nested posting that comes first wins over a shallow one
    rows.append((100, _page(json.dumps([nested(7, "deep"), nested(0, "shallow")]))))
    rows.append((101, _page("{bad", json.dumps(nested(6, "second")))))
    got = {r["id"]: r["ld_title"] for r in P.jsonld_postings(spark.createDataFrame(rows, "id int, html string")).collect()}
    assert got == {**{d: f"t{d}" for d in (0, 1, 3, 4, 5, 6, 40)}, 100: "deep", 101: "second"}


def test_dates_in_many_forms(spark):
    day = ["2026-07-13", "July 13, 2026", "Jul 13, 2026", "13 July 2026", "13 Jul 2026", "20260713", "07/13/2026", "2026/07/13",
           "Mon, 13 Jul 2026 00:00:00 GMT", "Monday, July 13, 2026", "Mon, 13 Jul 2026 00:00:00 +0000", "2026-07-13T00:00:00Z", " 2026-07-13 00:00 "]
    out = spark.createDataFrame([(d,) for d in [*day, "soon", "", None]], "d string").select("d", P.parse_date(F.col("d")).cast("string").alias("t"))
    got = {r["d"]: r["t"] for r in out.collect()}
    assert got == {**{d: "2026-07-13 00:00:00" for d in day}, "soon": None, "": None, None: None}


def test_one_page_per_url(spark):
    pages = spark.createDataFrame([(2, "https://jobs.lever.co/a/1", 200, _page('{"@type":"JobPosting","title":"late"}')),
                                   (1, "https://jobs.lever.co/a/1", 200, _page('{"@type":"JobPosting","title":"early"}'))],
                                  "n int, url string, status_code int, html string").withColumn("final_url", F.col("url"))
    hits = spark.createDataFrame([(1, "https://jobs.lever.co/a/1", "t", "s")], "ord int, url string, title string, snippet string")
    assert [r["title"] for r in P.extract_postings(hits, pages, order="n").collect()] == ["early"]
    assert P.extract_postings(hits, pages).count() == 1


def test_json_pages_reader(spark, tmp_path):
    path = tmp_path / "pages.jsonl"
    pages = [{"url": "https://jobs.lever.co/a/1", "final_url": "https://jobs.lever.co/a/1", "status_code": 200,
              "html": "<title>t</title>"}]
    path.write_text("\n".join(json.dumps(p) for p in pages))
    landed = load_pages(spark, str(path), fmt="json")
    hits = spark.createDataFrame([(1, "https://jobs.lever.co/a/1"), (2, "https://jobs.lever.co/a/2")], "ord int, url string")
    got = {r["ord"]: r["has_page"] for r in join_pages(hits, landed).collect()}
    assert got == {1: True, 2: False}
