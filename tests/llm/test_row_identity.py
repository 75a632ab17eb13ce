"""Rows without a doc_id, or with one that other texts have too, are rows of their own."""

from docspend.llm import exact_dedup, mixing, near_dedup


def test_near_dedup_keeps_unlinked_rows_of_one_or_no_id(spark):
    rows = [
        (None, "alpha beta gamma"), (None, "delta epsilon zeta"), (None, "alpha beta gamma"), (1, "one two three"), (1, "four five six"),
        (2, "one two three"), (3, None), (3, " "), (None, ""), (4, "four five six"), (4, "seven eight nine")
    ]
    got = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    kept = [
        (None, "alpha beta gamma"), (None, "delta epsilon zeta"), (1, "one two three"), (1, "four five six"), (3, None), (3, " "), (None, ""),
        (4, "seven eight nine")
    ]
    assert sorted(map(tuple, got), key=repr) == sorted(kept, key=repr)


def test_mixed_documents_take_what_the_plan_takes(spark):
    rows = [(None if i % 2 else i % 7, f"w{i} " * (i % 13 + 1), "ab"[i % 2]) for i in range(400)] + [(5, "equal text", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.plan(docs).collect()
    mixed = mixing.mixed_documents(docs).collect()
    assert len(mixed) == sum(r.copies for r in planned)
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in planned)


HELPERS = (
    "__id", "__sha", "__rows", "id", "sha", "rows", "name", "text_name", "bare", "own", "of_source", "copies", "turn", "mine", "copy", "root", "h",
    "Id2"
)


def test_columns_with_the_names_of_helpers_stay(spark):
    rows = [(i, f"text number {i // 2} of some words", "ab"[i % 2], *(f"{c}{i}" for c in HELPERS)) for i in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{c}` string" for c in HELPERS)]))
    by_id = {r[0]: r for r in rows}
    exact, near, mixed = exact_dedup.deduplicated(docs), near_dedup.deduplicated(docs, 2), mixing.mixed_documents(docs)
    for out in (exact, near, mixed):
        assert out.columns == docs.columns
        assert all(tuple(r) == by_id[r.doc_id] for r in out.collect())
    assert sorted(r.doc_id for r in exact.collect()) == list(range(1, 12, 2))
    assert sorted(r.doc_id for r in near.collect()) == list(range(0, 12, 2))
