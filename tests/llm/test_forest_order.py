"""Neighbours of longest common prefix in a sorted order, and what the order decides."""

import random

import numpy as np

from docspend.llm import near_dedup


def order(seed, n):
    rng = np.random.default_rng(seed)
    one, two = rng.integers(0, 4, n), rng.integers(0, 3, n)
    head = one << near_dedup.SECOND | two
    key = head * 10 + rng.integers(0, 2, n)
    label = rng.integers(0, 2, (n, near_dedup.DEPTH - near_dedup.MIN_DEPTH)).astype(np.uint8)
    sketch = rng.integers(0, 2, (n, near_dedup.HASHES)).astype(np.uint8)
    sketch[:, :70] = 0  # most pairs are possible, by differing matches
    rows = [head, key, label, np.arange(n), rng.integers(80, 110, n), sketch]
    at = np.lexsort((*label.T[::-1], key, head))
    return [x[at] for x in rows]


def depth(rows, i, j):
    head, key, label = rows[:3]
    minhashes = [head >> near_dedup.SECOND, head, key, *label.T]
    out = 0
    for m in minhashes:
        if m[i] != m[j]:
            break
        out += 1
    return out


def test_neighbours_equal_plain_python():
    rows = order(1, 200)
    n, s = rows[4:]
    want = {}
    for j in range(200):
        met = {}
        for i in range(max(0, j - near_dedup.NEAR), j):
            alike = int((s[i] == s[j]).sum())
            if depth(rows, i, j) and alike >= near_dedup.POSSIBLE and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]):
                met[i] = (depth(rows, i, j), alike)
        for i, rank in met.items():
            want[i, j] = rank == max(met.values())
    a, b, first = near_dedup.neighbours(rows, 80, 0)
    assert dict(zip(zip(a.tolist(), b.tolist()), first.tolist())) == want
    assert {depth(rows, i, j) for i, j in want} >= {1, 2, 3, 5, 8}  # sparse and dense places of the order
    a, b, _ = near_dedup.neighbours(rows, 80, 150)
    assert set(zip(a.tolist(), b.tolist())) == {p for p in want if p[1] >= 150}
    assert not len(near_dedup.neighbours([x[:1] for x in rows], 80, 0)[0])


def pairs(reps):
    return {(r.a, r.b, r.first) for f in near_dedup.candidates(reps, 80)[0] for r in f.select("a", "b", "first").collect()}


def test_the_order_decides_candidates_and_few_common_minhashes_are_enough(spark):
    rng, rows = random.Random(4), []
    for i in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(3):
            w = base[:]
            for _ in range(rng.randrange(9)):
                w[rng.randrange(60)] = f"c{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    sig = near_dedup.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    reps = sig.select("uid", "n_shingles", "sketch", "heads", "keys").toDF("uid", "n_shingles", "sketch", "heads", "keys").cache()
    forest, banded = pairs(reps), pairs(reps.drop("heads"))
    assert {p[:2] for p in forest} > {p[:2] for p in banded}  # pairs that share one or two minhashes in every tree
    flat = reps.selectExpr("uid", "n_shingles", "sketch", "transform(heads, x -> 0L) AS heads", "transform(keys, x -> 0L) AS keys")
    assert pairs(flat) != forest
    reps.unpersist()
