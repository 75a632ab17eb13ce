"""Regions of more rows than a block holds."""

import random

import numpy as np

from docspend.llm import near_dedup


def test_a_region_that_does_not_shrink_does_not_end_the_others(spark):
    rng = np.random.default_rng(3)
    rows, cluster = [], {}
    for uid in range(6000):  # region 1: nothing is alike
        rows.append((uid, 50, bytearray(rng.integers(0, 256, near_dedup.HASHES).astype(np.uint8).tobytes()), [1]))
    bases = rng.integers(0, 256, (300, near_dedup.HASHES)).astype(np.uint8)
    for uid in range(6000, 9000):  # region 2: 300 clusters, each spread over the whole order by its label
        c = int(rng.integers(300))
        s = bases[c].copy()
        s[near_dedup.MIN_DEPTH : near_dedup.DEPTH] = rng.integers(0, 256, near_dedup.DEPTH - near_dedup.MIN_DEPTH)
        rows.append((uid, 50, bytearray(s.tobytes()), [2]))
        cluster[uid] = c
    reps = spark.createDataFrame(rows, "uid long, n_shingles long, sketch binary, keys array<long>")
    root = {u: u for u in cluster}

    def find(u):
        while root[u] != u:
            u = root[u]
        return u

    for frame in near_dedup.candidates(reps, 80)[0]:
        for a, b in frame.select("a", "b").collect():
            if a in cluster and b in cluster:
                root[find(a)] = find(b)
    found = {(cluster[u], find(u)) for u in cluster}
    assert len(found) == len(set(cluster.values()))


def test_linked_pairs_of_a_dense_region_are_all_found(spark):
    """A template in all texts, and pairs of texts just above the limit that are linked with nothing else."""
    template = [f"t{i}" for i in range(84)]
    rng, rows = random.Random(5), []
    for pair in range(900):
        shared = [f"s{pair}x{i}" for i in range(16)]
        for side in range(2):
            words = template + shared + [f"u{pair}x{side}x{i}" for i in range(12)]
            rng.shuffle(words)
            rows.append((2 * pair + side, " ".join(words)))
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    apart = [r.doc_id for r in got if r.component_id != r.doc_id // 2 * 2]
    assert len(got) == 1800 and apart == []
