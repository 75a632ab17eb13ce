"""The cache key of user functions."""

from docspend.sources import pluggable


def test_texts_that_differ_late_get_their_own_answer(spark):
    rows = [(1, "x" * 5000), (2, "x" * 5000 + "\ny"), (3, "x" * 5000 + "\ny\nz")]
    out = pluggable.analyse(spark.createDataFrame(rows, "email_id long, body_text string"), lambda texts: [str(t.count("\n") + 1) for t in texts])
    assert {r.email_id: r.response for r in out.collect()} == {1: "1", 2: "2", 3: "3"}
