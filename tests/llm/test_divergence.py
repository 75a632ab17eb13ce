"""The divergence audit against plain Python, with colliding digests, many sources and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from docspend.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, l long, term string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for x, _, terms in docs if x == lang for t in set(terms))
        kept = {t for t, n in held.items() if n >= 10}
        counts = defaultdict(Counter)
        for x, source, terms in docs:
            if x == lang:
                counts[source].update(t for t in terms if t in kept)

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def odd_rows():
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("ab", "Ñu", "ze", "ko", "té", "日本") for b in ("ra", "LI", "mo", "sh", "longer" * 30)]
    rows = [(" ".join(r.choices(words, range(1, len(words) + 1), k=r.randint(0, 40))), "en", f"s{r.randint(0, 5)}") for _ in range(150)]
    rows += [(" ".join(r.choices(words, k=8)), r.choice(["de", None, ""]), r.choice(["s1", None, "", "ü"])) for _ in range(60)]
    rows += [("same same same", "en", "copies")] * 40  # ties of value
    rows += [(None, "en", "no text"), ("", "xx", "alone"), ("rare", "yy", "a"), ("rarer", "yy", "b"), ("1 2 3 --", "en", "no terms"), ("ab " * 300_000, "en", "s1")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, *row, 1, "clash") for i, row in enumerate(rows)], SCHEMA).repartition(6)


@pytest.mark.parametrize("bits", [64, 3])
def test_odd_rows(spark, bits):
    """Three bits of a digest: every digest names several terms."""
    rows = odd_rows()
    assert sorted(map(tuple, divergence.report(frame(spark, rows), bits).collect())) == plain(rows)


def test_many_sources_and_blocks_of_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 3)
    monkeypatch.setattr(divergence, "TERMS", 4)
    rows = odd_rows()
    assert sorted(map(tuple, divergence.report(frame(spark, rows)).collect())) == plain(rows)


def test_small_tasks(spark, monkeypatch):
    """Counts and strings are given on many times."""
    monkeypatch.setattr(divergence, "HELD_ROWS", 40)
    monkeypatch.setattr(divergence, "HELD_BYTES", 50)
    rows = odd_rows()[:80]
    assert sorted(map(tuple, divergence.report(frame(spark, rows)).collect())) == plain(rows)


def test_no_rows(spark):
    assert divergence.report(frame(spark, []).limit(0)).collect() == []


def test_bytes_that_are_no_text(spark):
    docs = spark.range(12).selectExpr("id AS doc_id", "CAST(X'61FF62' AS STRING) AS text", "'en' AS lang", "CAST(id % 2 AS STRING) AS source")
    assert {(r.part, r["item"], r.value) for r in divergence.report(docs).collect()} == {("pair", "0", 0), ("pair", "1", 0)}


def test_counts_beyond_64_bits(spark):
    """Shares of counts whose product with a billion is no long."""
    row = spark.sql(f"SELECT {divergence.share('n', 't', 'v')} AS p FROM VALUES (700000000000L, 900000000001L, 3L) AS x(n, t, v)").first()
    assert row.p == 1 + 1_000_000_000 * 700_000_000_002 // (900_000_000_001 + 6)
