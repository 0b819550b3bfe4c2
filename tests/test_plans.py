"""Plan shapes: no cross products anywhere; Python only for HTML entity decoding."""

import pytest

from __spark_entry__ import queries
from harrow.session import checkpoint_dir
from tests.conftest import SF_SMALL

# queries that run jobs while being built (checkpoints, streams, writes)
BUILD_RUNS_JOBS = {"j3_dedup_batch", "j3b_dedup_catalog", "m1_merge_new", "m4_merge_categories", "m6_stream_catalog", "s7b_announce_once", "t9_gate", "m6b_stream_versions",
                   "m6c_stream_sources", "m6d_stream_categories",
                   "s6_snapshot_roundtrip", "j1_dedup_candidates", "j2_match_pairs"}
PYTHON_OK = {"p8_page_text", "p9_text_snippets", "p10_jsonld_postings", "p11_page_metadata", "p12_extract_postings",
             "f3_evaluate_expiry", "m7_mark_expired"}


def test_no_cross_products_and_python_only_for_entities(spark):
    for name, build in sorted(queries().items()):
        if name in BUILD_RUNS_JOBS or name == "pipeline" or name.startswith("op"):
            continue
        plan = build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
        if name not in PYTHON_OK:
            assert "EvalPython" not in plan, name


class _Bare:
    """A session without any checkpoint folder."""
    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        getCheckpointDir = staticmethod(lambda: None)


def test_no_folder_is_made_up_for_checkpoints():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Bare)


def test_html_crosses_no_exchange(spark):
    import re

    for name in ("p12_extract_postings", "m7_mark_expired"):
        plan = queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        # the plan prints children below their parents; html may only be read by the projections above the scan
        for line in re.findall(r"(?:Exchange hashpartitioning|ObjectHashAggregate|SortMergeJoin)[^\n]*", plan):
            assert "html#" not in line, (name, line[:200])
