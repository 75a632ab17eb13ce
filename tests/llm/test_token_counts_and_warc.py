"""Separator scan and WARC round trips."""

import gzip
import hashlib
import random
import tempfile

import numpy as np
import pytest

from docspend.llm import token_counts, warc
from docspend.llm.tokens import Encoder

DOCS = "doc_id long, text string, file string, ordinal long"
PAGES = "page_id long, url string, html string, digest string"


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_counts_equal_the_library(spark, block):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "wood", "ü", "中", "<|endoftext|>"]) for _ in range(rng.choice([0, 1, 5, 60]))), None, None) for i in range(50)]
    rows += [(50, None, None, None), (51, "", "x", 1), (51, "", "x", 1), (None, "a b", None, None), (52, "word " * 3000, None, None)]
    got = token_counts.document_counts(spark.createDataFrame(rows, DOCS).repartition(3), block).collect()
    enc = Encoder(special_as_text=True)
    want = sorted(((i, len(enc.whole(t or ""))) for i, t, *_ in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def test_scan_of_given_files(spark):
    path = tempfile.mkdtemp()
    flat = {"a": [1, 2, 9, 9, 3, 3, 3, 3, 3, 3, 3, 9, 4], "b": [9], "c": [5, 5, 5, 5, 5, 5], "d": []}
    for name, ids in flat.items():
        with open(f"{path}/{name}.bin", "wb") as f:
            f.write(np.array(ids, "<u2").tobytes() + b"\x01" * (name == "c"))
    for block in (1, 2, 3, 100):
        got = token_counts.counted(token_counts.blocks(spark, f"file://{path}", end=9, block=block)).collect()
        assert sorted(map(tuple, got)) == [
            ("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 0, True), ("a.bin", 2, 4, 7, True), ("a.bin", 3, 12, 1, False), ("b.bin", 0, 0, 0, True),
            ("c.bin", 0, 0, 6, False)
        ]


def test_empty_tables(spark):
    assert token_counts.document_counts(spark.createDataFrame([], DOCS)).count() == 0
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def expected(rows):
    first = {}
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        top = first.get(b)
        again = top is not None and top != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [50, 300, 1 << 20])
def test_round_trip(spark, segment):
    long = "<p>é\r\n\r\n0\r\n\r\nWARC/1.1\r\n</p>" * 40
    rows = [
        (3, "http://a/ b", long, None), (1, "http://b", long, "x"), (2, None, long, "x"), (4, "u", "short", None), (5, "u", "short", None),
        (6, "u", None, None), (7, "u", "", None), (7, "u", "", None), (8, "u", "y" * 100, None), (9, "u", "y" * 100, None), (9, "u", "y" * 100, None),
        (None, "u", "y" * 100, None), (None, "u", "q" * 200, None), (10, "u", "z" * 20_000, None), (10, "u", "z" * 20_000, None)
    ]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3), segment).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_segments_that_are_not_whole(spark):
    def seg(origin, n, block, total=None, kind="continuation"):
        own = [("WARC-Record-ID", f"<{origin}>" if kind == "response" else f"<{origin}-{n}>"), ("WARC-Segment-Number", str(n))]
        own += [("WARC-Segment-Origin-ID", f"<{origin}>")] * (kind != "response") + [("WARC-Segment-Total-Length", str(total))] * (total is not None)
        return warc.record(kind, own, block)

    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    good = [seg("g", 3, body[20:], len(body)), seg("g", 1, body[:9], kind="response"), seg("g", 2, body[9:20])]
    gap = [seg("gap", 1, body[:9], kind="response"), seg("gap", 3, body[20:], len(body))]
    short = [seg("short", 1, body[:9], kind="response"), seg("short", 2, body[9:], len(body) + 1)]
    lost = [seg("lost", 2, body[9:], len(body))]
    open_ = [seg("open", 1, body[:9], kind="response"), seg("open", 2, body[9:])]
    cut = [warc.record("response", [("WARC-Record-ID", "<cut>")], warc.HEAD + b"9\r\nabc")]
    plain = [warc.record("response", [("WARC-Record-ID", "<plain>")], warc.HEAD + b"3;x=y\r\nabc\r\n0\r\nT: 1\r\n\r\n"), warc.record("metadata", [], b"")]
    path = tempfile.mkdtemp()
    with open(f"{path}/one.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(x) for x in good + gap + short))
    with open(f"{path}/two.warc", "wb") as f:
        f.write(b"".join(lost + open_ + cut + plain))
    got = {r.record_id: (bytes(r.payload) if r.payload is not None else None, r.problem) for r in warc.reassembled(warc.read_records(spark, path)).collect()}
    assert got.pop("<g>") == (b"hello", None) and got.pop("<plain>") == (b"abc", None)
    assert got == {
        "<gap>": (None, "segments missing or in conflict"), "<short>": (None, "total length differs"), "<lost>": (None, "no first segment"),
        "<open>": (None, "no last segment"), "<cut>": (None, "a chunk is cut short")
    }


def test_odd_archives_are_rows_with_a_problem(spark):
    fine = warc.record("response", [("WARC-Record-ID", "<fine>")], b"HTTP/1.1 200 OK\r\n\r\nyes")
    no_length = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\n\r\nblock\r\n\r\n"
    bad_length = no_length.replace(b"<a>", b"<b>\r\nContent-Length: many")
    bad_segment = warc.record("response", [("WARC-Record-ID", "<c>"), ("WARC-Segment-Number", "one")], b"x")
    bad_total = warc.record(
        "continuation",
        [("WARC-Record-ID", "<d>"), ("WARC-Segment-Number", "2"), ("WARC-Segment-Origin-ID", "<o>"), ("WARC-Segment-Total-Length", "-5")], b"x"
    )
    cut_head, cut_block = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Rec", warc.record(
        "response", [("WARC-Record-ID", "<e>")], b"HTTP/1.1 200 OK\r\n\r\nlong"
    )[:-8]
    path = tempfile.mkdtemp()
    with open(f"{path}/one.warc.gz", "wb") as f:
        f.write(
            b"".join(
                gzip.compress(x) for x in (no_length, fine, bad_length, bad_segment, bad_total, cut_head, b"junk", cut_block)
            ) + gzip.compress(fine.replace(b"fine", b"last"))[:-20]
        )
    with open(f"{path}/two.warc.gz", "wb") as f:
        f.write(gzip.compress(fine.replace(b"fine", b"two")) + b"\x1f\x8b\x08\x00" + b"\xff" * 40)
    with open(f"{path}/three.warc", "wb") as f:
        f.write(b"")
    got = [(r.record_id, None if r.payload is None else bytes(r.payload), r.problem) for r in warc.read_pages(spark, path).collect()]
    assert ("<fine>", b"yes", None) in got and ("<two>", b"yes", None) in got
    problems = {(i, p) for i, _, p in got if p}
    want = {
        ("<a>", "no length"), ("<b>", "no length"), ("<c>", "no number: one"), ("<d>", "no number: -5"), (None, "not a record"),
        ("<e>", "the record is cut short"), (None, "a gzip member is cut short"), (None, "a gzip member is broken"), (None, "the head is cut short")
    }
    assert want <= problems and all(b is None for _, b, p in got if p)


def test_chunked_framing_round_trip():
    for n in (0, 1, 4095, 4096, 4097, 10_000):
        data = np.random.default_rng(n).bytes(n)
        assert warc.unchunked(warc.chunk_framed(data)) == data
