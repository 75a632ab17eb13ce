"""Words that a polynomial modulo 2^64 takes for equal, and bytes that are no text, in every operator that reads texts."""

import hashlib

import numpy as np
import pytest

from docspend.llm import divergence, exact_dedup, html_extract, line_dedup, near_dedup, packing, quality, repetition, token_counts, tokens, warc
from docspend.llm.bytesops import LONG, SpanHash, same_spans, span_ids


def twins():
    word, other = "a", "b"
    for _ in range(10):
        word, other = word + other, other + word
    return word, other


class Weak(SpanHash):
    """Two bits: nearly all spans collide."""

    def __call__(self, data, starts, ends):
        return super().__call__(data, starts, ends) & np.uint64(3)


def test_spans_are_told_apart():
    spans = [*twins(), "", "x", "xy", "x" * LONG, "x" * (LONG + 1), "y" * (LONG + 1), "é", "12345678", "123456789", "12345678x"] * 2
    data = np.frombuffer("".join(spans).encode(), np.uint8)
    ends = np.cumsum([len(s.encode()) for s in spans])
    starts = ends - [len(s.encode()) for s in spans]
    for hashed in (SpanHash(), Weak()):
        ids, first, hashes = span_ids(data, starts, ends, hashed)
        assert [[i == j for j in ids] for i in ids] == [[a == b for b in spans] for a in spans]
        assert [spans[i] for i in first[ids]] == spans and (hashes[ids] == hashed(data, starts, ends)).all()
    assert same_spans(data, starts[:-1], starts[1:], np.minimum(ends - starts, 0)[1:]).all()


def test_encoder_with_colliding_pieces(monkeypatch):
    encoder = tokens.Encoder()
    encoder.hash = Weak()
    texts = [" ".join(twins()), "some words and some others, words", "don't we'll x", *twins()]
    raw = [t.encode() for t in texts]
    for _ in range(2):  # the second time from the table
        ids, bounds = encoder.batch(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


def twin_docs(spark):
    a, b = twins()
    return spark.createDataFrame([(1, f"{a} {b} {a} {a}\n{a}\n{b}"), (2, f"{a} one two"), (3, f"{b} one two")], "doc_id long, text string")


def test_packed_and_counted_ids(spark):
    docs, library = twin_docs(spark), tokens.Encoder().library
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.document_counts(docs).collect()} == want
    assert {r.doc_id: r.n for r in packing.pack_documents(docs).groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()} == {k: n + 1 for k, n in want.items()}


def test_repeats_and_shingles(spark):
    docs = twin_docs(spark)
    found = {r.doc_id: r for r in repetition.judged(docs).collect()}
    assert (found[1].longest_repeat, found[1].n_dup_lines) == (2, 0)
    assert {r.doc_id: r.component_id for r in near_dedup.groups(docs, shingle=2).collect()} == {1: 1, 2: 2, 3: 3}


@pytest.fixture(scope="module")
def broken(spark):
    return spark.range(3).selectExpr(
        "id AS doc_id", "CASE id WHEN 1 THEN CAST(X'61FF62' AS STRING) ELSE 'a\\uFFFDb' END AS text", "'en' AS lang", "'s' AS source", "id AS page_id", "'http://h/x' AS url",
        "concat('<html><body><article><p>', CASE id WHEN 1 THEN CAST(X'61FF62' AS STRING) ELSE 'a\\uFFFDb' END, '</p></article></body></html>') AS html"
    ).repartition(1)


def test_broken_text_reads_as_replaced(spark, broken):
    """Row 1 is given bytes that are no text, rows 0 and 2 what they are read as."""
    same = lambda rows, *c: len({tuple(r[x] for x in c) for r in rows}) == 1 and len(rows) == 3
    assert same(packing.pack_documents(broken).collect(), "length", "ids_crc32")
    assert {r.component_id for r in near_dedup.groups(broken).collect()} == {0}
    assert same(line_dedup.report(broken).collect(), "n_lines", "kept_sha256")
    assert line_dedup.report(broken).first().kept_sha256 == hashlib.sha256("a�b".encode()).hexdigest()
    assert same(token_counts.document_counts(broken).collect(), "n_tokens")
    assert same(quality.scored(broken, quality.train(broken, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))).collect(), "score")
    assert same(repetition.judged(broken).collect(), "n_words", "word_chars")
    assert same(warc.round_trip(broken).collect(), "payload_bytes", "payload_digest")
    assert same(html_extract.main_text(broken).collect(), "text", "n_chars")
    assert divergence.report(broken).count() == 0


def test_exact_dedup_keeps_bytes_apart(broken):
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.classes(broken).collect()) == [(0, 2), (1, 1), (2, 2)]
