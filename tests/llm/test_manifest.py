"""The manifest against a plain tree: odd rows, repeats, sources of many sizes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docspend.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climbed(nodes):
    """The root over the nodes, and for each the (left, right) siblings of every level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            lo = i - i % 3
            paths[k].append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 3])))
        nodes, at = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def plain(rows):
    sources = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        changed = leaf(doc_id, text.replace("\n", "") if even and text is not None else text, lang, source, n_chars)
        sources[source].append(((doc_id is not None, doc_id or 0), leaf(doc_id, text, lang, source, n_chars), doc_id, changed))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([r[1] for r in sorted(sources[s])]) for s in order}
    root, upper = climbed([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, upper):
        for (_, h, doc_id, node), path in zip(sorted(sources[s]), trees[s][1]):
            path = path + above
            for left, right in path:
                node = sha(left, node, right)
            out.append((doc_id, h, trees[s][0], root, sha(*(x + y for x, y in path)), node, node == root))
    return sorted(out, key=str)


def odd_rows():
    r = random.Random(7)
    rows = [(i, f"line {i}\nmore\n{i % 7}", "en", "big", i) for i in range(-40, 2300)]
    rows += [(r.getrandbits(62) * r.choice([1, -1]), "wide\nids", None, "wide", None) for _ in range(40)]
    rows += [(5, "again\n", "en", "twice", 1)] * 3 + [(5, "other", "en", "twice", 1), (6, "x", "en", "twice", 1), (70, "y\n", "en", "twice", 1)]
    rows += [(None, "no id\n", "de", "none", 3)] * 2 + [(None, None, None, "none", None), (1, "", "", "none", 0)]
    rows += [(3, "null source\n", "fr", None, 2), (4, None, "fr", None, 2), (8, "empty source", "fr", "", 2), (9, "ñandú\n日本", "fr", "é", 2), (10, "z", "fr", "z", 2)]
    rows += [(11, "long " * 200_000 + "\n", "fr", "z", 2)]
    r.shuffle(rows)
    return rows


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)


def test_odd_rows(spark):
    rows = odd_rows()
    got = manifest.audit(rows_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_sizes_of_sources(spark):
    rows = [(i, f"a\n{i}", "en", f"s{n}", 1) for n in (1, 2, 3, 4, 729, 730, 2188) for i in range(n)]
    got = manifest.audit(rows_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


@pytest.mark.parametrize("n", [1, 4])
def test_one_source(spark, n):
    rows = [(i, f"a\n{i}", "en", "s", 1) for i in range(n)]
    got = manifest.audit(rows_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_no_rows(spark):
    made = manifest.Manifest(rows_of(spark, []))
    assert made.root is None and made.proofs().isEmpty()


def test_bytes_that_are_no_text(spark):
    docs = rows_of(spark, [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)]).withColumn("text", F.expr("CASE doc_id WHEN 1 THEN CAST(X'61FF620A' AS STRING) ELSE text END"))
    got = {r.doc_id: r.leaf for r in manifest.audit(docs).collect()}
    assert got[1] == hashlib.sha256(b"1:11:s2:en1:14:a\xffb\n").hexdigest()


def test_ranks_by_bitmap(spark):
    keys = [(1 << 63) - 1, -(1 << 63), 0, 63, 64, -1, 5, 5, 5, 1 << 40]
    found = manifest.ranked(spark.createDataFrame([("g", k) for k in keys] + [("h", 9)], "g string, k long"), ["g"], "k").collect()
    want = sorted((k, sum(x < k for x in keys), keys.count(k), len(keys)) for k in keys)
    assert sorted((r.k, r.before, r.same, r.n) for r in found if r.g == "g") == want
    assert [(r.k, r.before, r.same, r.n) for r in found if r.g == "h"] == [(9, 0, 1, 1)]


def test_a_proof_shows_a_changed_row(spark):
    docs = rows_of(spark, [(i, f"text {i}", "en", f"s{i % 3}", 1) for i in range(50)])
    proofs = manifest.Manifest(docs).proofs()
    held = proofs.select("doc_id", "root", *(manifest.folded(c, F.col("path")).alias(n) for n, c in (("own", F.col("leaf")), ("other", F.sha2("leaf", 256)))))
    assert all(r.own == r.root and r.other != r.root for r in held.collect())
