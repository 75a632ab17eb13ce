"""Near-dedup against brute force over all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest

from docspend.llm import near_dedup
from docspend.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, uid string, root string"


def shingles(text, size):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = WORD.findall(low)
    if len(w) >= size:
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    return {tuple(w)} if w else set()


def brute(rows, size, percent=80):
    sets = [shingles(t, size) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(sets[i]), least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def corpus(seed, n=150, words=60):
    """Texts, copies, and copies with a few words changed, some near the limit."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(0, words))]
        rows.append((1000 - i, rng.choice([" ", "\n", "\t "]).join(w), None, None))
    return rows


ODD = [
    (1, None, "x", "y"), (2, "", None, None), (3, " \n\t", None, None), (4, "one", None, None), (5, "ONE", None, None), (6, "é", None, None),
    (7, "É", None, None), (8, "a b", None, None), (8, "a b", None, None), (None, "a b", None, None), (None, "never seen", None, None),
    (9, "word " * 40_000, None, None), (10, "word " * 30_000, None, None)
]


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(spark, size):
    rows = corpus(size) + ODD
    got = near_dedup.groups(spark.createDataFrame(rows, DOCS), size).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, size)


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = [(0, " ".join(base), None, None)]
    for i in range(1, 900):  # each copy is close to the base, few are close to each other
        w = base[:]
        for _ in range(4):
            w[rng.randrange(80)] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None))
    got = near_dedup.groups(spark.createDataFrame(rows, DOCS), 2).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2)


def test_deduplicated_and_empty_table(spark):
    out = near_dedup.deduplicated(spark.createDataFrame(ODD, DOCS), 2)
    assert out.columns == ["doc_id", "text", "uid", "root"]
    assert sorted((r.doc_id for r in out.collect()), key=repr) == [1, 2, 3, 4, 6, 7, 8, 9, None]
    assert near_dedup.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_sets_survive_the_packing():
    s = np.sort(np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64))
    assert (near_dedup.unpacked48(near_dedup.packed48(s)) == s >> np.uint64(16)).all()
    alike = np.sort(np.append(s, s[7] ^ np.uint64(1)))  # equal in 48 bits: kept once, so it can't count as shared
    assert (near_dedup.unpacked48(near_dedup.packed48(alike)) == s >> np.uint64(16)).all()
    assert near_dedup.packed48(s[:0]) == b""


def test_regions_are_cut_at_the_shortest_common_prefix():
    n = near_dedup.BLOCK
    labels = np.zeros((n + 200, 5), np.uint8)
    labels[300:, 1] = 1  # 300 rows share the first byte and the second with each other
    labels[400:, 3] = 2
    assert near_dedup.cut_at(labels, 0) == 300
    assert near_dedup.cut_at(labels[300:].repeat(3, axis=0), 0) == 300  # deeper where the prefix is longer
    assert near_dedup.cut_at(np.zeros((n + 1, 5), np.uint8), 0) == n  # rows alike in the whole label: as many as fit


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
