"""Exact dedup and packing: small hand-made rows, ties, nulls, empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspend.llm import exact_dedup, packing
from docspend.llm.bytesops import string_bytes
from docspend.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, keep_id string"


def expected(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, top[t or ""], len(groups[t or ""]), i == top[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows), key=repr)


ROWS = [
    (1, "a", "en", "x"), (2, "a", None, None), (3, None, "en", "x"), (4, "", "en", "x"), (5, "ü", "en", "x"), (5, "ü", "en", "x"),
    (None, "a", None, None), (None, "lone", None, None), (7, "x" * 300_000, "en", "x")
]


@pytest.mark.parametrize("few", [0, 100])
@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda d: F.substring(d, 1, 1), lambda d: F.lit("0")])
def test_classes_even_if_hashes_collide(spark, hashed, few):
    got = exact_dedup.classes(spark.createDataFrame(ROWS, DOCS), hashed, few).collect()
    assert sorted(map(tuple, got), key=repr) == expected(ROWS)


def test_deduplicated_keeps_columns_and_one_row_a_text(spark):
    out = exact_dedup.deduplicated(spark.createDataFrame(ROWS, DOCS))
    assert out.columns == ["doc_id", "text", "lang", "keep_id"]
    assert sorted((r.doc_id for r in out.collect()), key=repr) == [2, 4, 5, 7, None]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.classes(empty).count() == 0
    assert exact_dedup.deduplicated(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0


def test_encoder_equals_the_library_on_odd_texts():
    rng, enc = random.Random(5), Encoder()
    parts = [
        "a", "s", "t", "re", "ll", "'", "'s", " ", "  ", "\n", "\t", "é", "1", "²", "ª", "\xa0", "\x85", "!", "#", "I'll", "'ve", "“", "中",
        "<|endoftext|>", "", "\x1c"
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += [chr(i) + "a " + chr(i) * 2 + " b" for i in range(0x250)]
    for _ in range(2):  # the second time from the table
        ids, ends = enc.batch(*string_bytes(pa.array(texts)))
        for i, text in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == enc.library.encode(text, add_special_tokens=False).ids, text


def test_packing_is_a_partition_of_the_tokens(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "wood", "of", "ünder", "x1"]) for _ in range(rng.randint(0, 2500))), "en", None) for i in range(60)]
    rows += [(60, None, None, None), (61, "", None, None), (61, "", None, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS)).collect()
    enc = Encoder()
    want = [enc.whole(t or "").tolist() + [2] for _, t, *_ in rows]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i in range(60):
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert sum(r.length for r in mine) == len(want[i]) and all(r.length == 1024 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(want[i][r.start : r.start + r.length], "<u4").tobytes())
    assert len(by_doc[60]) == 1 and len(by_doc[61]) == 2
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(map(len, want)) // 1024) + 2


def test_islands_reach_the_bound_of_perfect_pairs():
    rng = random.Random(3)
    half = [rng.randint(1, 1023) for _ in range(400)]
    sizes = half + [1024 - x for x in half]
    rng.shuffle(sizes)
    best = packing.evolved(sizes, 1024, [], 1)[0]
    assert sorted(i for b in best.bins for i in b) == list(range(800)) and max(best.fills()) <= 1024
    assert len(best.bins) <= 403
    child = packing.crossed(best, packing.evolved(sizes, 1024, [], 2)[-1], rng)
    assert sorted(i for b in child.bins for i in b) == list(range(800)) and max(child.fills()) <= 1024


def test_many_shards_pool_what_is_left(spark):
    rng = random.Random(4)
    sizes = [rng.randint(1, 1024) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    got = packing.packed(items, shard=200).collect()
    assert sorted(r.uid for r in got) == list(range(3000))
    plain = packing.Packing(sizes, 1024)
    plain.best_fit(sorted(range(3000), key=lambda i: -sizes[i]))
    assert len({r.sequence_id for r in got}) <= 1.02 * len(plain.bins)
