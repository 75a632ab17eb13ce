"""The FM-index and the decontamination against plain searches."""

import hashlib
import random
import re

import numpy as np
import pytest

from docspend.llm import decontaminate
from docspend.llm.bytesops import ALNUM, LOWER, SpanHash, words
from docspend.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, item_id long, spans string, row string", "item_id long, text string, window string"


def test_search_and_locate():
    r = np.random.default_rng(5)
    for n, alphabet in ((1, 1), (40, 2), (3000, 3), (3000, 400)):
        text = np.append(r.integers(0, alphabet + 1, n), 0)
        ends = np.flatnonzero(text == 0)
        key = [tuple((0, int(np.searchsorted(ends, j))) if text[j] == 0 else (1, int(text[j])) for j in range(i, int(ends[np.searchsorted(ends, i)]) + 1)) for i in range(len(text))]
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=key.__getitem__)
        index = FMIndex(text, sample=4)
        lengths = r.integers(1, 5, 200)
        patterns = r.integers(1, alphabet + 2, (200, 5))
        lo, hi = index.search(patterns, lengths)
        for p, m, a, b in zip(patterns, lengths, lo, hi):
            want = [i for i in range(len(text) - m + 1) if (text[i : i + m] == p[:m]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(low(text))
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        found = list(WORD.finditer(low(text)))
        w, hit, names = [m[0] for m in found], set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        spans = []
        for i in sorted(hit):
            if i - 1 in hit:
                spans[-1] = (spans[-1][0], found[i].end())
            else:
                spans.append(found[i].span())
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit), spans))
    return out


def odd_rows():
    r = random.Random(11)
    vocabulary = ["a", "B", "ñu", "tE", "日本", "x1", "long" * 90, "ko", "77"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", "\n", ", ", "_"]) for _ in range(n))
    items = [(k, text(r.randint(1, 30))) for k in range(25)] + [(3, text(14)), (None, text(12)), (98, None), (99, " ,; "), (10, "only two"), (11, "é")]
    docs = [(i, text(r.randint(0, 60))) for i in range(60)]
    for i in range(60, 100):
        inner = (r.choice(items)[1] or "").replace(" ", r.choice(["  ", " - "])).upper()
        docs.append((i, text(r.randint(0, 9)) + inner + " " + text(r.randint(0, 9)) + (inner if i % 3 else "")))
    docs += [(100, None), (101, ""), (102, ".,"), (None, docs[70][1]), (70, docs[70][1]), (103, "é"), (104, "foo ONLY two"), (105, text(60_000))]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "clash", "clash") for d in docs], DOCS).repartition(4), spark.createDataFrame([(*i, "clash") for i in items], ITEMS)


def rows_of(found):
    return sorted([(*(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")), [(s.start, s.end) for s in r.spans]) for r in found.collect()], key=str)


@pytest.mark.parametrize("shard,block", [(4_000_000, 200_000), (1_500, 40)])
def test_odd_rows(spark, shard, block):
    docs, items = odd_rows()
    assert rows_of(decontaminate.report(*frames(spark, docs, items), shard=shard, block=block)) == sorted(plain(docs, items), key=str)


def test_nothing_to_find_or_search(spark):
    docs, items = frames(spark, [(1, "a b c"), (2, None)], [(1, None)])
    assert rows_of(decontaminate.report(docs, items)) == sorted(plain([(1, "a b c"), (2, None)], []), key=str)
    assert decontaminate.report(docs.limit(0), frames(spark, [(1, "")], [(1, "a b")])[1]).collect() == []


def test_texts_without_the_passages(spark):
    docs, items = odd_rows()
    docs = [d for d in docs if d[0] != 105]
    a, b = frames(spark, docs, items)
    got = sorted(map(tuple, decontaminate.cleaned(a, b).collect()), key=str)
    want = []
    for (doc_id, text), row in zip(docs, plain(docs, items)):
        for x, y in reversed(row[-1]):
            text = text[:x] + text[y:]
        want.append((doc_id, text, 1, "clash", "clash"))
    assert got == sorted(want, key=str)


def test_words_of_one_number_are_compared():
    """Under a hash of one bit the index finds far too much, and the comparison leaves what is right."""
    import pyarrow as pa

    class Weak(SpanHash):
        def __call__(self, data, starts, ends):
            return super().__call__(data, starts, ends) & np.uint64(1)

    decontaminate_hash, decontaminate.SpanHash = decontaminate.SpanHash, Weak
    try:
        phrases = decontaminate.Phrases(np.array([7, 8]), pa.array(["one two three", "two one"]))
    finally:
        decontaminate.SpanHash = decontaminate_hash
    raw = b"zero one two three two one four two two three"
    data = LOWER[np.frombuffer(raw, np.uint8)]
    at, which = phrases.occurrences(data, *words(data, np.array([0, len(raw)]), ALNUM))
    assert sorted(zip(at.tolist(), phrases.ids[which].tolist())) == [(1, 7), (4, 8)]


def test_broken_text(spark):
    docs = spark.range(1).selectExpr("id AS doc_id", "CAST(X'61FF6220632064' AS STRING) AS text")
    bench = spark.createDataFrame([(5, "a�b c")], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate.report(docs, bench).collect()] == [(3, 2)]
