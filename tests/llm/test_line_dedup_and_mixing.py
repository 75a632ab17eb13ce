"""Line dedup and mixing against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from docspend.llm import line_dedup, mixing

DOCS = "doc_id long, text string, source string, lang string, h1 string, size string"
SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    ids = defaultdict(set)
    low = lambda i: -(2**63) if i is None else i
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 40:
                ids[key(line)].add(low(r[0]))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        left = [x for x in lines if len(ids[key(x)]) < 5 or max(ids[key(x)]) == low(r[0])]
        out.append((r[0], len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def lines_corpus(seed, n):
    rng = random.Random(seed)
    shared = [f"A shared Line of some length number {i} é".ljust(38 + i % 4, "x") for i in range(30)]
    rows = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.4 else f"own line {rng.random()} " * 3 for _ in range(rng.randint(0, 12))]
        lines += ["  The very common line that all documents of this corpus have\t"] if i % 3 else [shared[0].upper(), ""]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "s", None, None, None))
    return rows


@pytest.mark.parametrize("n", [60, 700])
def test_lines_equal_brute_force(spark, n):
    rows = lines_corpus(n, n)
    rows += [
        (None, rows[3][1], None, None, None, None), (None, None, None, None, None, None), (n, "", None, None, None, None),
        (5, rows[5][1], None, None, None, None), (6, rows[1][1], None, None, None, None), (n + 1, rows[2][1] * 3000, None, None, None, None)
    ]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, line_dedup.report(docs).collect()), key=repr)
    assert got == brute(rows)
    out = line_dedup.filtered(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    hashes = lambda x: Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in x)
    assert hashes(out.collect()) == Counter((i, h) for i, _, _, h in got)


def test_lines_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert line_dedup.report(empty).count() == 0 and mixing.plan(empty).count() == 0


def shares(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, rest = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while free and rest > 1e-9:
        each = rest / sum(w[s] for s in free)
        for s in free:
            target[s] += w[s] * each
        rest = 0.0
        for s in list(free):
            if target[s] >= 3 * sizes[s]:
                rest += target[s] - 3 * sizes[s]
                target[s] = float(3 * sizes[s])
                free.discard(s)
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows, i = [], 0
    for source, n, words in (("hot", 3000, 40), ("a", 400, 40), ("b", 900, 80), ("ü", 300, 30), (None, 500, 60), ("tiny", 3, 5), ("none", 4, 0)):
        for _ in range(n):
            size = int(rng.lognormvariate(0, 1) * words)
            rows.append((i, " \n".join(["w"] * size) if size else rng.choice([None, "", " "]), source, None, None, None))
            i += 1
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.plan(docs).collect()
    sizes = {r[0]: len((r[1] or "").split()) for r in rows}
    by = defaultdict(int)
    for r in rows:
        by[r[2]] += sizes[r[0]]
    want, taken = shares(dict(by)), Counter()
    source = {r[0]: r[2] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.size == sizes[r.doc_id] and r.source_size == by[s]
        assert r.target == pytest.approx(want[s], rel=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[s] += r.taken
    assert len(got) == len(rows)
    for s, t in want.items():
        if by[s] > 1000:
            assert taken[s] == pytest.approx(t, rel=0.02), s
            exact = sum(r.rate * r.size for r in got if source[r.doc_id] == s)
            assert exact == pytest.approx(t, rel=1e-6), s
    again = {r.doc_id: r.copies for r in mixing.plan(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter({i: c for i, c in again.items() if c})


def test_mix_of_one_source_and_of_empty_texts(spark):
    one = mixing.plan(
        spark.createDataFrame([(1, "a b", None, None, None, None), (1, "a b", None, None, None, None), (None, "c", None, None, None, None)], DOCS)
    ).collect()
    assert {r.target for r in one} == {5.0} and all(r.copies == 1 for r in one)
    none = mixing.plan(spark.createDataFrame([(1, None, "x", None, None, None), (2, "", "y", None, None, None)], DOCS)).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("cuts", [1, 3, 7, 40])
def test_a_hot_line_over_many_batches_and_partitions(cuts):
    """Runs that begin, go on and end in any partition, in batches of any size."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(cuts)
    rows = []
    for key, docs in ((1, 2), (2, 4), (3, 5), (4, 300), (5, 1), (6, 6), (7, 90)):
        for d in range(docs, 0, -1):
            rows += [(key, key, d, 0, 9, p) for p in range(rng.choice([1, 1, 2, 5]))]
    places = sorted(rng.sample(range(1, len(rows)), cuts - 1)) if cuts > 1 else []
    gone, open_, parts = [], [], defaultdict(list)
    for a, b in zip([0, *places], [*places, len(rows)]):
        inner = sorted({a, b, *(rng.randrange(a, b + 1) for _ in range(4))})
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows[x:y]), [pa.int64()] * 4 + [pa.int32()] * 2)], ["h1", "h2", "id", "th", "n_lines", "pos"]
            ) for x,
            y in zip(inner, inner[1:]) if y > x
        ]
        for out in line_dedup._runs(5)(iter(batches)):
            for r in out.to_pylist():
                if r["docs"] is not None:
                    parts[r["h1"]].append((r["id"], r["th"], r["docs"]))
                else:
                    (open_ if r["open"] else gone).append((r["h1"], r["id"], r["pos"]))
    for key, found in parts.items():
        found.sort(reverse=True)
        docs = sum(x[2] for x in found) - sum(x[0] == y[1] for x, y in zip(found[1:], found))
        if docs >= 5:
            gone += [r for r in open_ if r[0] == key and r[1] != found[0][0]]
    assert sorted(gone) == sorted((r[0], r[2], r[5]) for r in rows if r[0] in (3, 4, 6, 7) and r[2] != max(x[2] for x in rows if x[0] == r[0]))
    assert np.all([len(parts[k]) for k in parts])


def test_columns_with_the_names_of_helpers_stay(spark):
    shared = "a line that six documents of this table have in common"
    rows = [(i, f"{shared}\nown {i}", "s", f"id{i}", f"th{i}", f"bits{i}", f"keep{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, id string, th string, bits string, keep string")
    got = sorted(map(tuple, line_dedup.filtered(docs).collect()))
    assert got == [(i, (t if i == 5 else f"own {i}"), *rest) for i, t, *rest in rows]
