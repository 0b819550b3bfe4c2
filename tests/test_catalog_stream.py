"""Catalog maintenance invariants and the streaming scan."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from harrow.operators import catalog as M
from harrow.operators import planning as Q
from harrow.operators import reports as R
from harrow.operators import scoring as S
from harrow.plans.fixtures import derived
from harrow.plans.suite_catalog import scored_batch
from harrow.operators import dedup as D
from harrow.operators.store import Store, Table
from harrow.session import reliable_checkpoint
from harrow.streaming.catalog_stream import TABLES, catalog_store, extracted_hits, scan_changes, scored_postings, stream_catalog
from tests.conftest import SF_SMALL

NOW = dt.datetime(1998, 6, 15)


def test_merges_are_idempotent(spark):
    scored = S.gate(scored_batch(spark, SF_SMALL))
    empty = spark.createDataFrame([], "dedup_key string, category string")
    once = M.merge_categories(empty, scored)
    twice = M.merge_categories(once, scored)
    assert once.count() == twice.count() > 0
    saves = spark.createDataFrame([(1, 2, dt.datetime(2024, 1, 2)), (1, 2, dt.datetime(2024, 1, 1))],
                                  "user_id long, job_id long, created_at timestamp")
    s0 = spark.createDataFrame([], "user_id long, job_id long, created_at timestamp")
    s1 = M.merge_saved(s0, saves)
    assert [tuple(r) for r in M.merge_saved(s1, saves).collect()] == [(1, 2, dt.datetime(2024, 1, 1))]


def test_snapshot_roundtrip(spark, tmp_path):
    df = spark.range(10).withColumn("status", F.when(F.col("id") % 2 == 0, "active").otherwise("expired"))
    root = str(tmp_path)
    M.write_snapshot(df, root, "t", run_id="a", partition_by="status")
    assert M.read_snapshot(spark, root, "t").count() == 10
    M.write_snapshot(df.filter("id < 3"), root, "t", run_id="b")
    assert M.read_snapshot(spark, root, "t").count() == 3


def test_version_chain_counts_a_b_a_as_two(spark):
    t = spark.createDataFrame([(1, 1, "A", "t1", ""), (1, 2, "B", "", "d2"), (1, 3, "A", "t3", ""), (1, 4, "A", "t4", "")],
                              "job_id long, ord long, content_hash string, title string, description string")
    versions, final = M.version_chain(t)
    v = [tuple(r) for r in versions.orderBy("ord").collect()]
    assert v == [(1, 2, "A", "t1", ""), (1, 3, "B", "t1", "d2")]
    f = final.first()
    assert (f["content_hash"], f["title"], f["description"]) == ("A", "t3", "d2")


def _land(posts, root, name, part):
    posts.filter(part).write.parquet(f"{root}/landed/{name}")


def _stream(spark, root, posts, **more):
    return stream_catalog(spark, f"{root}/landed/*", posts.schema, root, NOW, buckets=4, **more)


def _state(store):
    """All rows of all tables."""
    return {name: sorted(map(repr, (r.asDict() for r in store.rows(name).collect()))) for name in TABLES}


def _one_batch(spark, root, posts):
    store = catalog_store(spark, f"{root}/once", 4)
    store.write(scan_changes(posts, store, NOW), "0")
    return store


@pytest.fixture(scope="module")
def posts(spark):
    return reliable_checkpoint(derived(spark, SF_SMALL, "d_postings").filter("ord < 1600"))


@pytest.fixture(scope="module")
def once(spark, posts, tmp_path_factory):
    return _state(_one_batch(spark, str(tmp_path_factory.mktemp("once")), posts))


def test_stream_equals_one_batch_in_all_tables(spark, tmp_path, posts, once):
    root = f"file:{tmp_path}"
    for name, part in (("a", "ord <= 500"), ("b", "ord > 500 and ord <= 900"), ("c", "ord > 900")):
        _land(posts, root, name, F.expr(part))
        store = _stream(spark, root, posts, compact_every=2)
    assert store.generation() == ["00000001b", "00000002"]
    streamed = _state(store)
    for name in TABLES:
        assert streamed[name] == once[name] and once[name], name
    # a restart finds nothing new and leaves the catalog as it is
    assert _state(_stream(spark, root, posts)) == streamed


def test_a_batch_that_stops_before_its_commit_is_done_again(spark, tmp_path, monkeypatch, posts):
    root, few = str(tmp_path), posts.filter("ord < 300")
    _land(few, root, "a", F.col("ord") <= 150)
    first = _state(_stream(spark, root, few))
    _land(few, root, "b", F.col("ord") > 150)
    whole = Store._commit

    def stops(self, name):
        raise RuntimeError("stopped")
    monkeypatch.setattr(Store, "_commit", stops)
    with pytest.raises(Exception, match="stopped"):
        _stream(spark, root, few)
    assert _state(catalog_store(spark, f"{root}/catalog", 4)) == first
    monkeypatch.setattr(Store, "_commit", whole)
    assert _state(_stream(spark, root, few)) == _state(_one_batch(spark, root, few)) != first


def posting(ord_, url, description, **more):
    return (ord_, "company", None, url, "Acme", "Software Engineer Intern", None, description, *more.values())


POSTING = ("ord long, platform_slug string, external_job_id string, url string, company string, title string, location string, "
           "description string, query_hash string, provider string")


def test_content_that_goes_back_makes_two_versions_over_two_batches(spark, tmp_path):
    store = catalog_store(spark, str(tmp_path), 4)
    found = {"q": "q1", "p": "bing"}
    batches = [[posting(1, "https://acme.com/jobs/1", "A backend internship")],
               [posting(2, "https://acme.com/jobs/1", "B backend internship", **found)],
               [posting(3, "https://acme.com/jobs/1?utm_source=x", "A backend internship", **found)]]
    for k, rows in enumerate(batches):
        rows = [r if len(r) == 10 else (*r, "q0", "serper") for r in rows]
        store.write(scan_changes(spark.createDataFrame(rows, POSTING), store, NOW + dt.timedelta(days=k)), str(k))
    versions = sorted((r.ord, r.description) for r in store.rows("versions").collect())
    assert versions == [(2, "A backend internship"), (3, "B backend internship")]
    job = store.rows("catalog").collect()
    assert [(r.ord, r.description, r.first_seen_at, r.last_seen_at) for r in job] == [
        (1, "A backend internship", NOW, NOW + dt.timedelta(days=2))]
    assert sorted((r.raw_url, r.query_hash, r.first_ord) for r in store.rows("sources").collect()) == [
        ("https://acme.com/jobs/1", "q0", 1), ("https://acme.com/jobs/1?utm_source=x", "q1", 3)]


def test_hits_are_extracted_in_the_stream(spark, tmp_path):
    from harrow.plans.suite_pages import COMPANY_DOMAINS, landed_job_pages
    root = str(tmp_path)
    hits = derived(spark, SF_SMALL, "d_postings").filter("ord < 400").select(
        "ord", "url", "title", F.col("description").alias("snippet"), F.lit("q").alias("query_hash"), F.lit("bing").alias("provider"))
    pages = landed_job_pages(spark, SF_SMALL)
    hits.write.parquet(f"{root}/landed/a")
    store = _stream(spark, root, hits, pages=pages, company_domains=COMPANY_DOMAINS, page_order="ord")
    once = _state(_one_batch(spark, root, extracted_hits(hits, pages, COMPANY_DOMAINS, "ord")))
    assert _state(store) == once and once["catalog"]
    urls = {r.url for r in hits.select("url").collect()}
    assert {r.raw_url for r in store.rows("sources").collect()} <= urls


def _size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_small_batch_reads_and_writes_little(spark, tmp_path, posts):
    store = catalog_store(spark, str(tmp_path), 64)
    store.write(scan_changes(posts, store, NOW), "0")
    store.compact()
    some = store.rows("catalog").agg(F.min("ord")).first()[0]
    one = posts.filter(F.col("ord") == some).withColumn("ord", F.lit(5000).cast("bigint"))
    keys = store.rows("keys", D.exact_keys(scored_postings(one, NOW)).select("kid"))
    read = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(([\d,]+)\)", keys._jdf.queryExecution().executedPlan().toString())
    assert read and len(read.group(1).split(",")) <= 5  # five keys at most, of 64 buckets
    assert 0 < keys.count() <= 5
    store.write(scan_changes(one, store, NOW), "1")
    whole, delta = (sum(_size(tmp_path / t / f"run={r}") for t in TABLES) for r in ("0b", "1"))
    assert delta < whole / 5


def test_a_reader_opened_before_a_compaction_still_reads(spark, tmp_path):
    tables = {"t": Table("k string, v long", "k", unique="k"), "log": Table("k string, v long", "k")}
    store = Store(spark, str(tmp_path), tables, 4)

    def run(i):
        df = spark.createDataFrame([(f"k{j}", i) for j in range(i % 3, 6)], "k string, v long")
        store.write({"t": df, "log": df}, f"{i:04d}")
    for i in range(3):
        run(i)
    store.compact()
    run(3)
    reader, log = store.rows("t"), store.rows("log")
    before = sorted(map(tuple, reader.collect()))
    run(4)
    assert store.compact() == "0004b"
    assert sorted(map(tuple, reader.collect())) == before and log.count() == 21
    newest = {f"k{j}": 4 if j >= 1 else 3 for j in range(6)}
    assert dict(map(tuple, store.rows("t").collect())) == newest
    assert store.generation() == ["0004b"] and store.committed("0001")
    assert store.compact() is None
    run(5)
    store.compact()
    assert not (tmp_path / "t" / "run=0000").exists() and not (tmp_path / "t" / "run=0002b").exists()
    assert store.rows("log").count() == 21 + 5 + 4
    few = spark.createDataFrame([("k5",), ("absent",)], "key string")
    assert [tuple(r) for r in store.rows("t", few).collect()] == [("k5", 5)]


def test_releasing_checkpoints_removes_their_files(spark):
    from harrow import session
    kept = spark.range(3)
    session.reliable_checkpoint(kept)
    path = spark._jvm.org.apache.hadoop.fs.Path(session._work_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(path)
    assert session.reliable_checkpoint(kept).count() == 3


def test_insert_keeps_one_row_per_key(spark):
    catalog = spark.createDataFrame([("a", 1, "u", "u", "t", "active")], "dedup_key string, ord long, canonical_url string, url string, title string, status string")
    batch = spark.createDataFrame([("b", 5, "", "u5", "late", False), ("b", 3, "", "u3", "", False), ("a", 2, "", "u2", "x", True)],
                                  "dedup_key string, ord long, canonical_url string, url string, title string, is_expired boolean")
    rows = sorted(tuple(r) for r in M.merge_new(catalog, batch).collect())
    assert rows == [("a", 1, "u", "u", "t", "active"), ("b", 3, "u3", "u3", "(untitled)", "active")]


def test_announcements_are_made_once(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), M.OUTBOX, 4)
    rows = spark.createDataFrame([(1, 7), (2, 7), (1, 8), (1, 8)], "guild_id long, ord long")
    whole = Store._commit

    def stops(self, name):
        raise RuntimeError("stopped")
    monkeypatch.setattr(Store, "_commit", stops)
    with pytest.raises(RuntimeError):
        M.announce(store, rows.filter("ord = 7"), "1")
    assert store.changes("claims", "1").isEmpty()  # nothing may be sent yet
    monkeypatch.setattr(Store, "_commit", whole)
    sent = [sorted(map(tuple, M.announce(store, r, run).collect())) for r, run in (
        (rows.filter("ord = 7"), "1"), (rows, "1"), (rows, "2"), (rows, "2"), (rows, "3"))]
    assert sent == [[(1, 7), (2, 7)], [(1, 7), (2, 7)], [(1, 8)], [(1, 8)], []]


def test_query_upsert_and_failed_runs(spark):
    runs = spark.createDataFrame([("q", 3, 1, dt.datetime(2024, 1, 2)), ("r", 1, 0, dt.datetime(2024, 1, 3))],
                                 "query_hash string, result_count long, relevant_count long, run_ts timestamp")
    once = Q.upsert_queries(Q.query_yield(runs.filter("false")), runs)
    twice = {r["query_hash"]: (r["times_run"], r["total_results"]) for r in Q.upsert_queries(once, runs.filter("query_hash = 'q'")).collect()}
    assert twice == {"q": (2, 6), "r": (1, 1)}
    report = R.scan_report(spark.createDataFrame([(1, "q", True, False)], "run_id long, query_hash string, is_new boolean, is_posted boolean"),
                           runs=spark.createDataFrame([(1, None), (2, "timeout")], "run_id long, error string"))
    assert {(r["run_id"], r["results_found"], r["status"]) for r in report.collect()} == {(1, 1, "completed"), (2, 0, "failed")}
