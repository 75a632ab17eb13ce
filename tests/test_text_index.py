"""The stored index against tokens made anew, through segments, removals and compaction."""

import pytest

from docspend.search import text as X
from docspend.search.index import TextIndex

COLUMNS = ("buyer", "seller")
KINDS = "id long, buyer string, seller string, user_id long"


def rows(spark, **texts):
    words = ["ink pen", "pen, INK", "Größe ink", "", None, "paper ink pen paper", "日本 pen", "penny"]
    made = [(i, words[i % 8], words[i * 3 % 8], i % 2) for i in range(40)]
    return spark.createDataFrame([(i, texts.get(f"r{i}", b), s, u) for i, b, s, u in made], KINDS)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Rows 0 to 29 in old wordings, 20 to 39 as they are, 0 to 19 again, without 7 and 8."""
    path = str(tmp_path_factory.mktemp("index"))
    whole = rows(spark)
    made = TextIndex.build(rows(spark, r3="old words", r25="old words").where("id < 30"), path, columns=COLUMNS, keep=("user_id",))
    made.add(whole.where("id >= 20"), columns=COLUMNS, keep=("user_id",))
    made.add(whole.where("id < 20"), columns=COLUMNS, keep=("user_id",))
    made.remove(whole.where("id IN (7, 8)").select("id"))
    return made


def live(spark):
    return rows(spark).where("id NOT IN (7, 8)")


def plain(df):
    return X.build_index(df, columns=COLUMNS)


@pytest.mark.parametrize("kind", ["segments", "compacted"])
def test_queries_over_the_index(spark, index, tmp_path, kind):
    made = index if kind == "segments" else index.compacted(str(tmp_path))
    scan = plain(live(spark))
    stats = lambda df: {(r.term, r.docs, r.n) for r in df.collect()}
    assert stats(made.term_stats()) == stats(X.term_stats(scan))
    ids = lambda df: sorted(r.id for r in df.collect())
    for args in ({"all_": ("ink", "pen")}, {"phrase": "ink, Pen"}, {"none_": ("ink",)}, {"prefix": "pen", "none_": ("penny",)}, {"any_": ("日本", "ink pen paper")}, {"all_": ("grosse",)}, {"all_": ("ink",), "columns": ("seller",)}, {"none_": ("ink",), "columns": ("buyer",)}):
        assert ids(X.match(made, **args)) == ids(X.match(scan, **args)), args
    score = lambda df: [(r.id, r.score) for r in df.collect()]
    assert score(X.ranked(made, ["ink", "paper", "no-such"], 12)) == score(X.bm25(live(spark), ["ink", "paper", "no-such"], 12, columns=COLUMNS))


def test_only_the_buckets_of_the_words_are_read(spark, index):
    plan = index.postings(["ink", "pen"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "split(" not in X.match(index, all_=("ink",))._jdf.queryExecution().executedPlan().toString()


def test_a_segment_that_was_not_finished_does_not_count(spark, index, monkeypatch):
    before = index.term_stats().count()
    with monkeypatch.context() as m:
        m.setattr(spark, "range", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            index.add(rows(spark, r1="never seen").where("id = 1"), columns=COLUMNS, keep=("user_id",))
    assert index.term_stats().count() == before and index.totals().first().docs == live(spark).where("coalesce(buyer, '') <> '' OR coalesce(seller, '') <> ''").count()


def test_postings_are_made_row_by_row_without_a_shuffle_of_them(spark):
    from docspend.search.index import _postings

    made = _postings(rows(spark), "id", COLUMNS, ("user_id",))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.term, r.id, r.col): (r.positions, r.n) for r in made.collect()}
    want = {}
    for r in plain(rows(spark)).collect():
        want.setdefault((r.term, r.id, r.col), []).append(r.pos)
    assert got == {k: (sorted(v), len(v)) for k, v in want.items()}


def test_words_of_a_match_fold_to_one_row_a_document(spark, index):
    """Several counted words must not copy the postings for each of them."""
    plan = X.match(index, all_=("ink", "pen"), any_=("paper", "penny"), none_=("old",), prefix="pen")._jdf.queryExecution().toString()
    assert "Expand" not in plan and "LeftAnti" not in plan and "explode" not in plan


def test_saved_views_of_one_kind_are_evaluated_once(spark, tmp_path):
    """300 views of a tenant over 300 invoices: rows of joins grow with kinds and days, not with views times invoices."""
    from docspend.operators.filters import evaluate_views

    invoices = spark.range(300).selectExpr("id", "id % 2 AS user_id", "DATE '2024-01-01' + CAST(id % 7 AS INT) AS invoice_date", "concat('Seller ', id % 5) AS seller", *(f"'' AS {c}" for c in X.COLUMNS if c != "seller"))
    views = spark.range(300).selectExpr(
        "id", "id % 2 AS user_id", """CASE id % 3 WHEN 0 THEN '{"q": "seller 3", "date_from": "2024-01-03"}' WHEN 1 THEN '{"date_to": "2024-01-04"}' ELSE '{"q": "3, 4"}' END AS filter_json"""
    )
    kept = ("user_id", "invoice_date")
    made = evaluate_views(views, invoices, TextIndex.build(invoices, str(tmp_path), keep=kept))
    got = {r.id: r.matches for r in made.collect()}
    all_ = invoices.collect()
    late = lambda r: r.invoice_date.day
    for i in range(300):
        own = [r for r in all_ if r.user_id == i % 2]
        want = [r for r in own if r.seller == "Seller 3" and late(r) >= 3] if i % 3 == 0 else [r for r in own if late(r) <= 4] if i % 3 == 1 else []
        assert got[i] == len(want)
    joined = [n for name, n in _rows(made._jdf.queryExecution().executedPlan()) if "Join" in name]
    assert joined and max(joined) <= 420  # postings of the words; views times invoices gave 6000


def _rows(plan) -> list[tuple[str, int]]:
    """The operators of a plan that ran, with the rows that came out of them."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        m = p.metrics().get("numOutputRows")
        if m.isDefined():
            out.append((p.nodeName(), m.get().value()))
        name = p.nodeName()
        todo += [p.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [p.plan()] if "QueryStage" in name else []
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_removed_ids_are_words_of_bits(spark, tmp_path):
    """Postings were joined with a row for each removed id, which shuffled them all by id."""
    made = rows(spark)
    index = TextIndex.build(made, str(tmp_path), columns=COLUMNS)
    index.remove(spark.createDataFrame([(i,) for i in (-1, 0, 5, 39, 63, 64, 1 << 40)], "id long"))
    gone = spark.read.parquet(f"{tmp_path}/gone")
    assert {r.slot: bin(r["mask"] & (1 << 64) - 1).count("1") for r in gone.collect()} == {-1: 1, 0: 4, 1: 1, 1 << 34: 1}
    plan = index.term_stats()._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    left = plain(made.where("id NOT IN (0, 5, 39)"))
    assert {(r.term, r.docs, r.n) for r in index.term_stats().collect()} == {(r.term, r.docs, r.n) for r in X.term_stats(left).collect()}


def test_words_are_split_once_a_row(spark):
    """All columns of a row together, also where a text holds the sign between them, is empty or missing."""
    from docspend.search import index as made

    odd = spark.createDataFrame([(1, "a\x01b a", None), (2, None, "́Ä\x01"), (3, "", ""), (4, "\x01", "Σας ΟΔΟΣ"), (5, "ΟΔΟΣ", "Έ 日本 x")], "id long, buyer string, seller string")
    plan = made._postings(odd, "id", COLUMNS, ())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
    want = {}
    for r in plain(odd).collect():
        want.setdefault((r.term, r.id, r.col), []).append(r.pos)
    assert {(r.term, r.id, r.col): r.positions for r in made._postings(odd, "id", COLUMNS, ()).collect()} == {k: sorted(v) for k, v in want.items()}
    count = lambda i, col: sum(len(v) for (_, at, of), v in want.items() if (at, of) == (i, col))
    got = made._sized(odd, "id", COLUMNS).collect()
    assert {r.id: (r.sizes, r.size) for r in got} == {i: ({c: count(i, c) for c in COLUMNS}, sum(count(i, c) for c in COLUMNS)) for i in range(1, 6)}
