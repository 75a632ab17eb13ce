"""The classifier's held-out accuracy, and repetition against brute force."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from docspend.llm import quality, repetition
from docspend.llm.bytesops import SpanHash, string_bytes
from docspend.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, score string, quality int"
DATA = "/root/testdata/sf0.01"


def repeats(words):
    """Longest repeat that starts at each word, by trying all pairs of places."""
    n, best = len(words), [0] * len(words)
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    return best


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    longest = repeats(w)
    inside = {i + k for i, n in enumerate(longest) if n >= repetition.MIN_WORDS for k in range(n)}
    chars = sum(map(len, w))
    part = sum(len(w[i]) for i in inside) / max(chars, 1)
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    top = max(longest, default=0)
    fine = part <= repetition.MOST_COVERED and (top <= repetition.LONGEST_FREE or top <= repetition.LONGEST_SHARE * len(w))
    return (len(w), chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed, not failed and fine, pytest.approx(part), top)


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \n ", "x", "a " * 70, "a b\na b\n\na b \n", "é ü é ü " * 3, "#*$%&|<> " * 9]
    for _ in range(120):
        w = [rng.choice(["a", "bb", "é", "d$"]) if rng.random() < 0.5 else f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 90))]
        if len(w) > 20 and rng.random() < 0.5:
            at, n = rng.randrange(len(w) - 10), rng.randint(3, 40)
            w += w[at : at + n] * rng.randint(1, 2)
        out.append("".join(x + rng.choice([" ", " ", "\n", "  ", "\t"]) for x in w))
    return out


def test_repetition_equals_brute_force(spark):
    rows = [(i, t, None, None) for i, t in enumerate(texts(1))] + [(3, "x", None, None), (None, "x y", None, None)]
    got = repetition.judged(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r)) == sorted(
        ((i, *brute(t)) for i, t, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])
    )


def test_a_very_long_text_of_one_word():
    lengths = repetition.longest_repeats(np.zeros(200_000, np.uint64), np.array([0, 200_000]))
    assert lengths[0] == 199_999 and lengths[-1] == 1


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int")
    assert repetition.judged(docs).count() == 0
    assert quality.scored(docs, quality.train(docs, labels)).count() == 0


def test_one_kind_of_label_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 0), (1, "", None, 1), (None, "a b", None, None), (2, "x" * 500_000, None, None)], DOCS)
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (77, 0)], "doc_id long, quality int")
    got = quality.scored(docs, quality.train(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.accepted(docs, labels).columns == docs.columns


def test_features_are_finite():
    x = quality.features(*string_bytes(pa.array(texts(2))), SpanHash())
    assert x.shape == (len(texts(2)), len(quality.FEATURES)) and np.isfinite(x).all() and (x[:3] == 0).all()


def test_trees_and_pairs_fit_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fitted(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = quality.scored(docs, quality.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert ((got.predicted == got.quality).mean()) > 0.93
    assert got[got.quality == 1].predicted.mean() > 0.97


def plain_features(text):
    """The features of one text in plain Python, one word at a time."""
    import math

    raw = (text or "").encode()
    lower = lambda b: bytes(x + 32 if 65 <= x <= 90 else x for x in b)
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [lower(w) for w in words]
    n, size = max(len(words), 1), max(len(raw), 1)
    length = [len(w.decode()) for w in words]
    lines = raw.split(b"\n")
    filled = [lower(x) for x in lines if re.search(rb"[^\x20\x09-\x0D]", x)]
    count = lambda chars: sum(x in chars for x in raw)
    letter = lambda w: any(97 <= x <= 122 or 48 <= x <= 57 or x >= 0x80 for x in w)
    return [
        math.log1p(len(words)), sum(length) / n, sum(x >= 12 for x in length) / n, sum(x <= 3 for x in length) / n, sum(65 <= x <= 90 for x in raw) / size, count(b"0123456789") / size,
        count(b"#*$%&<>@^~=+{}[]\\/_") / n, count(b"!?") / n, count(b"|") / n, count(b".,;:") / n, sum(x >= 0x80 for x in raw) / size,
        len(set(low)) / n, max(map(low.count, low), default=0) / n, sum(a == b for a, b in zip(low, low[1:])) / n, len(words) / len(lines), (len(filled) - len(set(filled))) / len(lines),
        sum(65 <= w[0] <= 90 for w in words) / n, sum(not letter(w) for w in low) / n,
    ]


def test_features_equal_plain_python():
    some = [*texts(6), "ONE one One", "a\n\n a \nA\n", "é" * 15 + " x", "~~~ ### ab1", "word " * 3000]
    data, offsets = string_bytes(pa.array(some))
    got = quality.features(data, offsets, SpanHash())
    want = np.array([plain_features(t) for t in some])
    assert got.shape == want.shape and np.allclose(got, want, rtol=1e-5, atol=1e-6)


def test_scores_equal_sums_of_table_entries(spark):
    """Training through Spark, then every score as an explicit sum of looked-up entries of plain features."""
    import bisect
    import math

    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = i % 2
        words = [
            rng.choice(
                ["alpha", "beta", "gamma", "delta", "of", "the"]
            ) + ("" if good or rng.random() < 0.6 else "###") for _ in range(rng.randint(5, 60))
        ]
        rows.append((i, " ".join(words) + ("." if good else "!!"), None, None))
        labels.append((i, good))
    rows += [(1000, None, None, None), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, quality int")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model.pairs and len(model.tables) == len(quality.FEATURES)
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    for i, text, *_ in rows:
        x = np.array(plain_features(text), np.float32)
        bins = [bisect.bisect_right(e.tolist(), float(v)) for e, v in zip(model.edges, x)]
        margin = model.intercept + sum(t[b] for t, b in zip(model.tables, bins))
        coarse = [b * quality.PAIR_BINS // (len(e) + 1) for b, e in zip(bins, model.edges)]
        margin += sum(g[coarse[j], coarse[k]] for (j, k), g in zip(model.pairs, model.grids))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-margin)), abs=2e-3)
    right = [(got[i] >= 0.5) == bool(y) for i, y in labels]
    assert np.mean(right) > 0.95
