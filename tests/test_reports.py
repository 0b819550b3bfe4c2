"""Report operators: feedback folding applies votes one at a time."""

from harrow.operators import reports as R


def _python_fold(score, n):
    for _ in range(n):
        score = max(0.0, score - 0.2)
    return score


def test_feedback_votes_clamp_one_at_a_time(spark):
    catalog = spark.createDataFrame([(1, 0.5, "active"), (2, 0.9, "active"), (3, 0.3, "active")],
                                    "job_id long, score double, status string")
    feedback = spark.createDataFrame(
        [(1, "irrelevant"), (1, "irrelevant"), (1, "irrelevant"), (2, "irrelevant"), (2, "save"),
         (3, "duplicate")], "job_id long, kind string")
    got = {r["job_id"]: (r["score"], r["status"]) for r in R.fold_feedback(feedback, catalog).collect()}
    assert got[1] == (_python_fold(0.5, 3), "active")
    assert got[2] == (_python_fold(0.9, 1), "active")
    assert got[3] == (0.3, "closed")
