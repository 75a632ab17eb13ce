"""Archives read as streams."""

import gzip
import random
import tempfile
import tracemalloc

import pytest

from docspend.llm import warc


def page(n, size, seed=0):
    body = bytes(random.Random(n + seed).choices(range(256), k=size))
    return body, warc.record("response", [("WARC-Record-ID", f"<{n}>")], b"HTTP/1.1 200 OK\r\n\r\n" + body)


@pytest.mark.parametrize("known", [True, False])
def test_every_record_is_read_once(spark, monkeypatch, known):
    if not known:  # a file system that pyarrow does not know
        monkeypatch.setattr(warc, "_known", lambda spark, path: False)
    path, want = tempfile.mkdtemp(prefix="odd name % "), {}
    pages = [page(n, random.Random(n).randrange(1500)) for n in range(60)]
    for n, (body, _) in enumerate(pages):
        want[f"<{n}>"] = body
    nested = gzip.compress(gzip.compress(pages[0][1]) + b"\x1f\x8b\x08")  # a member within a member, and false starts
    with open(f"{path}/members.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(x) for _, x in pages[:40]) + nested)
    with open(f"{path}/one member.warc.gz", "wb") as f:
        f.write(gzip.compress(b"".join(x for _, x in pages[40:50])))
    with open(f"{path}/plain.warc", "wb") as f:
        f.write(b"".join(x for _, x in pages[50:]))
    got = warc.read_pages(spark, path).collect()
    assert [(r.record_id, r.problem) for r in got if r.problem] == [(None, "not a record")]
    fine = [r for r in got if not r.problem]
    assert len(fine) == 60 and {r.record_id: bytes(r.payload) for r in fine} == want


def test_reading_goes_on_after_a_broken_member(spark):
    first, second, third = (gzip.compress(page(n, 400)[1]) for n in range(3))
    path = tempfile.mkdtemp()
    with open(f"{path}/a.warc.gz", "wb") as f:
        f.write(first + second[:200] + third)
    got = warc.read_pages(spark, path).collect()
    assert {r.record_id for r in got if not r.problem} == {"<0>", "<2>"}
    assert any(r.problem and "gzip member" in r.problem for r in got)


def test_a_large_archive_takes_the_memory_of_a_record():
    one = gzip.compress(page(1, 50_000)[1], 1)
    path = tempfile.mkdtemp() + "/large.warc.gz"
    with open(path, "wb") as f:
        for _ in range(1200):  # 60 MB of members
            f.write(one)
    size = 1200 * len(one)
    tracemalloc.start()
    with open(path, "rb") as f:
        read = sum(1 for _ in warc._records(warc._File(f, size)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert read == 1200 and peak < 8_000_000
