"""Nearest neighbours that meet few blocks, and tables of which a change rewrites what it touches."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspend.operators.bucketed import BucketedTable
from docspend.search import vectors as V


@pytest.mark.parametrize("higher", [False, True])
def test_clustered_vectors_meet_few_blocks(spark, higher):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16)) * 20
    points = np.round(np.repeat(centres, 150, axis=0) + r.normal(size=(1800, 16)), 3)
    points[100:104] = points[100]  # ties
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "id long, embedding array<double>").repartition(4)
    queries = rows.where("id % 20 = 0")
    made = V.Pruned(rows, rows=40, pivots=16)
    key = lambda df: [tuple(x) for x in df.orderBy("query_id", "place").collect()]
    assert key(made.knn(queries, 5, higher_first=higher)) == key(V.knn(rows, queries, 5, higher_first=higher))
    assert made.visited < 0.5
    assert key(made.knn(queries, 2000)) == key(V.knn(rows, queries, 2000)) and made.visited == 1  # fewer rows than asked for


def test_no_vectors(spark):
    rows = spark.createDataFrame([], "id long, embedding array<double>")
    assert V.Pruned(rows).knn(rows, 3).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    assert V.Pruned(one).knn(one, 3).collect() == [] and V.Pruned(one).knn(one, 3, exclude_self=False).count() == 1


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_buckets_without_changes_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    kinds = "id long, user_id long, invoice_no string, buyer string, file_path string, is_manually_corrected boolean"
    rows = [(i, i % 2, f"n{i}", "old", f"p{i}", False) for i in range(60)]
    table = BucketedTable.create(spark.createDataFrame(rows, kinds), path, buckets=16)
    before = files(path)
    table.upsert(spark.createDataFrame([(3, 1, "n3", "new", "p3", False), (3, 1, "n3", "older", "p3", False), (99, 1, "n99", "new", "p99", False)], kinds).withColumn("v", F.expr("CASE buyer WHEN 'new' THEN 2 ELSE 1 END")), "v")
    after = files(path)
    assert sum(after.get(f) == t for f, t in before.items()) >= len(before) - 2
    log, rejected = table.correct(spark.createDataFrame([(4, "fixed", None), (5, None, "n7"), (1000, "x", None)], "id long, buyer string, invoice_no string"))
    assert [(r.invoice_id, r.field_name, r.new_value) for r in log.collect()] == [(4, "buyer", "fixed")] and [r.id for r in rejected.collect()] == [5]
    assert sum(files(path).get(f) == t for f, t in after.items()) >= len(after) - 3
    gone = table.delete(spark.createDataFrame([(4,), (5,), (6,)], "id long"), 0)
    assert {r.file_path for r in gone.collect()} == {"p4", "p6"}
    want = {i: "old" for i in range(60) if i not in (4, 6)} | {3: "new", 99: "new"}
    assert {r.id: r.buyer for r in table.read().collect()} == want
    table.delete(table.read().select("id"), 0), table.delete(table.read().select("id"), 1)
    assert table.read().count() == 0 and not files(path)


def test_rows_meet_queries_without_a_table_of_pairs(spark, monkeypatch):
    """Blocks of rows were joined with all blocks of queries, so a task's Python held more the more of both there were."""
    monkeypatch.setattr(V, "ROWS", 64), monkeypatch.setattr(V, "QUERIES", 16), monkeypatch.setattr(V, "PAIRS", 50)
    points = np.random.default_rng(4).integers(0, 4, (900, 3)).astype("f8")  # many equal vectors and distances
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "id long, embedding array<double>")
    found = V.knn(rows, rows.where("id % 20 = 0"), 7)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r.query_id, r.id, r.distance) for r in found.orderBy("query_id", "place").collect()]
    exact = np.round(np.sqrt(((points[::20, None] - points[None]) ** 2).sum(axis=2)), 6)
    want = [(q, j, d[j]) for q, d in zip(range(0, 900, 20), exact) for j in sorted((j for j in range(900) if j != q), key=lambda j: (d[j], j))[:7]]
    assert got == want
    asked = type("Asked", (), {"value": (np.arange(0, 900, 20), points[::20])})
    out = list(V._running(asked, 7, True, False)(iter(rows.toArrow().to_batches(max_chunksize=100))))
    assert sum(b.num_rows for b in out) == 45 * 7  # a task gives k rows a query, however many blocks it read


def test_pruned_search_shuffles_no_finds_of_blocks(spark, monkeypatch):
    """A block gave its k best of each query that it met, so what was shuffled grew with the square of the rows."""
    monkeypatch.setattr(V, "QUERIES", 16), monkeypatch.setattr(V, "PAIRS", 50), monkeypatch.setattr(V, "BROADCAST", 3000)  # queries in several parts
    points = np.random.default_rng(5).integers(0, 4, (600, 3)).astype("f8")  # many equal vectors and distances
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "id long, embedding array<double>").repartition(3)
    found = []
    monkeypatch.setattr(V, "written", lambda df, what, f=V.written: (out := f(df, what), found.append((what, out.count())))[0])
    made = V.Pruned(rows, rows=20, pivots=8)
    got = [(r.query_id, r.id, r.distance) for r in made.knn(rows.where("id % 20 = 0"), 7).orderBy("query_id", "place").collect()]
    exact = np.round(np.sqrt(((points[::20, None] - points[None]) ** 2).sum(axis=2)), 6)
    assert got == [(q, j, d[j]) for q, d in zip(range(0, 600, 20), exact) for j in sorted((j for j in range(600) if j != q), key=lambda j: (d[j], j))[:7]]
    assert sum(n for what, n in found if what == "first") <= 60 and len([1 for what, _ in found if what == "near"]) > 1
    asked = type("Asked", (), {"value": (np.arange(0, 600, 20), points[::20], np.full(30, np.inf))})
    out = list(V._narrowing(asked, made.pivots, 7, True, False)(iter(made.blocks.toArrow().to_batches(max_chunksize=4))))
    assert sum(b.num_rows for b in out) == 30 * 7 + 1  # a task gives k rows a query, however many blocks it met


def test_changes_shuffle_no_table(spark, tmp_path, monkeypatch):
    """A change shuffled the rows of its buckets, by key and by bucket, and wrote them twice."""
    from docspend.operators import bucketed

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kinds = "id long, user_id long, invoice_no string, buyer string, file_path string, is_manually_corrected boolean"
        base = spark.createDataFrame([(i, i % 2, f"n{i}", "old", f"p{i}", False) for i in range(60)], kinds)
        table = BucketedTable.create(base, str(tmp_path / "t"), buckets=8)
        (group, keys), = table._groups(spark.createDataFrame([(i,) for i in range(5)], "id long"))
        plan = table._met(keys, group, "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        monkeypatch.setattr(bucketed, "KEYS", 3)  # several groups of buckets, and buckets with more keys than go to all tasks
        names = []
        monkeypatch.setattr(bucketed, "written", lambda df, what, f=bucketed.written: (names.append(what), f(df, what))[1])
        log, _ = table.correct(spark.createDataFrame([(i, "new") for i in range(0, 90, 2)], "id long, buyer string"))
        assert log.count() == 30 and "buckets" not in names
        assert table.delete(spark.createDataFrame([(i,) for i in range(40)], "id long"), 0).count() == 20
        assert {r.id: r.buyer for r in table.read().collect()} == {i: "old" if i % 2 else "new" for i in range(60) if i % 2 or i >= 40}
        for i in range(2 * bucketed.FILES):
            table.upsert(base.where("id < 9").withColumn("buyer", F.lit(f"v{i}")))
        assert table.read().where("buyer = 'v15'").count() == 9 and table.read().count() == 60 - 20 + 5
        assert max(len([f for f in os.listdir(d) if f.startswith("part-")]) for d, _, _ in os.walk(tmp_path / "t")) <= 2 * bucketed.FILES
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
