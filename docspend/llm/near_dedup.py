"""MinHash near-dedup with an LSH forest.

A document is the set of its distinct word shingles; two documents are linked if the Jaccard
similarity of their full sets reaches the threshold, and a group is a connected component.

1. One pass over the texts makes, for each document, the number of shingles, a 128-bit name of
   the set, a sketch of one byte for each of TREES x DEPTH minhashes, and for each tree a head (its
   first two minhashes) and the key of its first MIN_DEPTH minhashes.  Documents with equal sets
   are folded into one representative.
2. Each tree is a sorted order of signatures: head, key, then the label of the deeper minhashes.
   All trees share one range partitioning by that order and id, so a dense region is spread over
   many tasks by itself.  In each order a row meets its NEAR predecessors, which are those of
   longest common prefix with it, down to one common minhash: where rows are sparse that prefix is
   short, where they are dense it is long, so the depth follows from the region.  Those whose
   sketches allow a link are candidates; of each row the one of longest common prefix (then of most
   matches) goes first.
3. Completion of regions, the runs of equal keys: rows of a region are all candidates of each
   other, so that a link is missed only where all trees differ in their first MIN_DEPTH minhashes.
   A region of more than BLOCK rows is cut where neighbours have the shortest common prefix.  A
   small block gives all pairs whose sketches allow a link, those of its spanning forest (longest
   common prefix, then most matches) first.  A larger one gives that forest and the two nearest of
   each row; one leader of each cluster goes to a next order over leaders, which joins the blocks
   of a region.  A region of at most NEAR + 1 rows needs none of this.
4. First pairs are confirmed on the full sets, then those others that still lie between
   components; components of the confirmed links follow.  Only sets of candidates are shuffled.
5. Completion: a large block whose rows are still in different components is compared as a whole:
   its sets meet in one task, each once, and all intersections across components come from
   products of slices of their incidence matrix.  So no pair of a block is dropped for its
   number, and no table of pairs grows with the square of a group.
6. A region of several blocks that still holds several components is compared across its blocks
   too: cut anew into cells by set size, cells whose sizes allow a link meet pair by pair as in 5.
   Only its largest component is not compared with itself.  So two rows of one region that are
   linked are in one component, however dense the region is and however it was cut; where most of
   its rows stay apart, this step's work grows with the square of their number.

The orders over leaders only spare work for step 6, which finds what they miss: a region leaves
them when one leader is left or a round removes less than a tenth of its leaders.  Sketch matches
are a filter only: at 0.8 a pair misses the limit of 64 of 104 matches with a probability near
2e-6, and misses all 13 trees with 1e-4.  Sets are stored as distinct 48-bit shingle hashes.

Defined cases: null and empty texts and texts of white space have an empty set, are linked with
nothing and are their own component; with fewer words than a shingle has, the whole sequence is
the one shingle; rows that repeat a doc_id are separate rows in one component if their texts are
linked; a component of null doc_ids alone has a null id.  Broken UTF-8 is read as U+FFFD.  Other
columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspend.llm.bytesops import LOWER, SpanHash, chunked, mixed, string_bytes, words
from docspend.llm.common import WORD, clean_text, partitions, text_name, text_or_empty, unused, written
from docspend.llm.graph import components
from docspend.shipping import ship

U64 = np.uint64
TREES, DEPTH, MIN_DEPTH = 13, 8, 3
HASHES = TREES * DEPTH
BLOCK, SMALL = 512, 64
#: Rows before it that a row meets in each order, and bits of a head for its second minhash.
NEAR, SECOND = 4, 24
#: Rows of a cell; two cells meet in a task.
CELL = BLOCK // 2
#: Sketch matches below which a pair cannot be linked, and from which leaders stand for a row.
POSSIBLE, LIKELY = 64, 86
#: Candidate ids up to which their set is broadcast to pick the full sets (8 bytes each); more are joined by a shuffle.
FEW_IDS = 2_000_000
#: Parts a component is dealt in when its rows get its smallest doc_id.
SALT = 16

SIGNATURES = "uid long, doc_id long, name binary, n_shingles long, fp1 long, fp2 long, sketch binary, heads array<long>, keys array<long>, shingles binary"
FOUND = "a long, b long, first boolean, block long, head long, key long, label binary, n long, sketch binary"


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int, span: SpanHash) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    low = LOWER[data]
    starts, ends, bounds = words(data, offsets)
    h = span(low, starts, ends)
    many = h.copy()
    for k in range(1, min(size, len(h))):
        many[: len(h) - k] = mixed(many[: len(h) - k] * U64(0xD6E8FEB86659FD93) + h[k:])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            s = np.sort(many[a : b - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            whole = np.array([b - a], U64)
            for x in h[a:b]:
                whole = mixed(whole * U64(0xA0761D6478BD642F) + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, U64))
    return out


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * HASHES + 1, dtype=U64))
    return x[:HASHES] | U64(1), x[HASHES:]


def minhashes(shingles: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, ~U64(0), U64)
    for at in range(0, len(shingles), 1024):
        v = shingles[at : at + 1024, None] * times
        v += plus
        np.minimum(least, v.min(axis=0), out=least)
    return least


def packed48(sorted_hashes: np.ndarray) -> bytes:
    """The distinct upper 48 bits of the hashes, six bytes each."""
    short = sorted_hashes >> U64(16)
    return short[np.append(True, short[1:] != short[:-1])[: len(short)]].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        span, (times, plus) = SpanHash(), _permutations()
        trees = np.arange(TREES, dtype=U64)
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for lo, hi in chunked(offsets):
                sets = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size, span)
                rows = []
                for s in sets:
                    name = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if len(s) else (uid, -1)
                    least = minhashes(s, times, plus)
                    v = mixed(least).reshape(TREES, DEPTH)
                    one = mixed(trees * U64(0x9FB21C651E98DF25) + v[:, 0])
                    two = mixed(one ^ v[:, 1] * U64(0xD6E8FEB86659FD93)) >> U64(64 - SECOND)
                    head = (one >> U64(SECOND) << U64(SECOND)) | two
                    key = trees
                    for k in range(MIN_DEPTH):
                        key = mixed(key * U64(0xE7037ED1A0B428DB) + v[:, k])
                    rows.append(
                        (
                            uid, len(s), int(name[0]), int(name[1]), (v & U64(255)).astype(np.uint8).tobytes(),
                            head.astype(np.int64) if len(s) else [], key.astype(np.int64) if len(s) else [], packed48(s)
                        )
                    )
                    uid += 1
                u, n, f1, f2, sketch, heads, keys, full = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u, pa.int64()), batch.column("doc_id").slice(lo, hi - lo), batch.column("name").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sketch, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(full, pa.binary())],
                    ["uid", "doc_id", "name", "n_shingles", "fp1", "fp2", "sketch", "heads", "keys", "shingles"],
                )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), clean_text().alias("text"), text_name().alias("name")).mapInArrow(run, SIGNATURES)


def matches(sketches: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Symmetric matrix of sketch matches; 0 where a link is impossible."""
    g = len(sizes)
    out = np.zeros((g, g), np.int16)
    for i in range(g - 1):
        out[i, i + 1 :] = (sketches[i + 1 :] == sketches[i]).sum(axis=1)
    small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    out[(out < POSSIBLE) | (100 * small < percent * large)] = 0
    return out + out.T


def spanning_forest(m: np.ndarray, least: int = 1) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges of a maximum spanning forest over entries of at least `least`, and each row's root."""
    g = len(m)
    root, best, parent = np.full(g, -1), np.full(g, -1, np.int64), np.zeros(g, np.int64)
    edges, now = [], -1
    left = np.ones(g, bool)
    for _ in range(g):
        reach = np.where(left, best, -2)
        i = int(reach.argmax())
        if reach[i] < least:  # a new tree
            i = int(left.argmax())
            now, best[:] = i, -1
        else:
            edges.append((int(parent[i]), i))
        root[i], left[i] = now, False
        closer = left & (m[i] > best)
        best[closer], parent[closer] = m[i][closer], i
    return edges, root


def cut_at(labels: np.ndarray, begin: int) -> int:
    """Where a region that goes on for more than BLOCK rows from begin is cut: at the last of the shortest common prefixes of neighbours."""
    here = labels[begin : begin + BLOCK + 1]
    prefix = np.cumprod(here[1:] == here[:-1], axis=1).sum(axis=1)
    return begin + BLOCK - int(prefix[::-1].argmin())


def common_prefix(rows: list[np.ndarray], apart: int) -> np.ndarray:
    """Minhashes that rows (head, key, label) of one order share from the first on with the row so many places before."""
    head, key, label = rows[:3]
    one = head[apart:] >> SECOND == head[:-apart] >> SECOND
    two = one & (head[apart:] == head[:-apart])
    three = two & (key[apart:] == key[:-apart])
    deep = np.cumprod(label[apart:] == label[:-apart], axis=1).sum(axis=1)
    return one.astype(np.int16) + two + three * (MIN_DEPTH - 2 + deep)


def neighbours(rows: list[np.ndarray], percent: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among the rows (head, key, label, uid, n, sketch) of one order that are at most NEAR places apart.

    Each row from `new` on meets its NEAR predecessors, which have the longest common prefix with it.  Gives the
    places of both rows and whether the pair goes first: of each row that of longest common prefix, then most matches.
    """
    count = len(rows[0])
    best = np.zeros((NEAR + 1, count), np.int16)
    for d in range(1, min(NEAR, count - 1) + 1):
        depth, n, s = common_prefix(rows, d), rows[4], rows[5]
        able = (depth > 0) & (100 * np.minimum(n[d:], n[:-d]) >= percent * np.maximum(n[d:], n[:-d]))
        able[: max(new - d, 0)] = False
        at = np.flatnonzero(able)
        alike = (s[at + d] == s[at]).sum(axis=1)
        best[d, at + d] = np.where(alike >= POSSIBLE, depth[at] * (HASHES + 1) + alike, 0)
    apart, b = np.nonzero(best)
    return b - apart, b, best[apart, b] == best.max(axis=0)[b]


def _blocks(percent: int, whole: bool):
    """Stream rows sorted by (head, key, label, uid); give candidate pairs, members of large blocks and leaders.

    whole: also all rows of regions of several blocks, as key and uid without a label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        members: list[tuple[np.ndarray, int]] = []
        leaders: list[tuple] = []
        spread: list[tuple[np.ndarray, np.ndarray, int]] = []  # uid and n of a block whose region goes on, and its key

        def solve(head, key, label, uid, n, s, more):
            """One block; more: the region goes on elsewhere."""
            nonlocal block
            g = len(uid)
            if g <= NEAR + 1 and not more:  # its rows are all neighbours
                return
            m = matches(s, n, percent)
            deep = sum(np.multiply.accumulate([x[:, None] == x for x in label.T], dtype=np.int16))
            edges, _ = spanning_forest(np.where(m, deep * np.int16(HASHES + 1) + m, 0))
            first = np.array(sorted((min(e), max(e)) for e in edges), np.int64).reshape(-1, 2)
            if g <= SMALL:
                rest = np.triu(m, NEAR + 1)
                rest[first[:, 0], first[:, 1]] = 0
                rest = np.stack(np.nonzero(rest), axis=1)
            else:
                near = np.argsort(-m, axis=1, kind="stable")[:, :2]
                rest = {(min(i, int(j)), max(i, int(j))) for i in range(g) for j in near[i] if m[i, j]} - set(map(tuple, first.tolist()))
                rest = np.array(sorted(rest), np.int64).reshape(-1, 2)
                block += 1
                members.append((uid, block))
            if len(first):
                a, b = uid[np.concatenate([first, rest])].T
                pairs.append((np.minimum(a, b), np.maximum(a, b), np.arange(len(a)) < len(first)))
            if more and whole:
                spread.append((uid, n, int(key)))
            if more:
                _, root = spanning_forest(m, LIKELY)
                for r in np.unique(root):
                    mine = np.flatnonzero(root == r)
                    top = mine[m[np.ix_(mine, mine)].sum(axis=1, dtype=np.int64).argmax()]
                    leaders.append((int(head), int(key), label[top].tobytes(), int(uid[top]), int(n[top]), s[top].tobytes()))

        def out():
            joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            a, b, f = (joined([x[k] for x in pairs], t) for k, t in ((0, np.int64), (1, np.int64), (2, bool)))
            mu, mb = joined([x for x, _ in members], np.int64), joined([np.full(len(x), k) for x, k in members], np.int64)
            lh, lk, ll, lu, ln, ls = zip(*leaders) if leaders else ((),) * 6
            su, sn, sk = joined([x for x, _, _ in spread], np.int64), joined([n for _, n, _ in spread], np.int64), joined(
                [np.full(len(x), k) for x, _, k in spread], np.int64
            )
            sizes = (len(a), len(mu), len(lu), len(su))
            pairs.clear(), members.clear(), leaders.clear(), spread.clear()

            def column(kind, *parts):
                return pa.concat_arrays([pa.nulls(k, kind) if x is None else pa.array(x, kind) for k, x in zip(sizes, parts)])

            i64, raw = pa.int64(), pa.binary()
            return pa.RecordBatch.from_arrays(
                [column(i64, a, mu, lu, su), column(i64, b, None, None, None), column(pa.bool_(), f, None, None, None), column(i64, None, mb, None, None), column(i64, None, None, lh, None), column(i64, None, None, lk, sk), column(raw, None, None, ll, None), column(i64, None, None, ln, sn), column(raw, None, None, ls, None)],
                ["a", "b", "first", "block", "head", "key", "label", "n", "sketch"],
            )

        held = before = None
        cutoff = 0  # blocks of the held region that went already
        first = True  # the first region of a partition may have begun before it
        for batch in batches:
            if not batch.num_rows:
                continue
            head, key, uid, n = (np.asarray(batch.column(c)) for c in ("head", "key", "uid", "n"))
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(-1, DEPTH - MIN_DEPTH)
            s = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
            rows = new = [head, key, label, uid, n, s]
            if before is not None:
                rows, new = ([np.concatenate([x, y]) for x, y in zip(old, rows)] for old in (held, before))
            a, b, best = neighbours(new, percent, len(new[0]) - len(uid))
            if len(a):
                a, b = new[3][a], new[3][b]
                pairs.append((np.minimum(a, b), np.maximum(a, b), best))
            before = [x[-NEAR:] for x in new]
            begin = 0
            for end in np.append(np.flatnonzero((rows[1][1:] != rows[1][:-1]) | (rows[0][1:] != rows[0][:-1])) + 1, len(rows[0])).tolist():
                while end - begin > BLOCK:
                    to = cut_at(rows[2], begin)
                    solve(rows[0][begin], rows[1][begin], *(x[begin:to] for x in rows[2:]), True)
                    begin, cutoff = to, cutoff + 1
                if end == len(rows[0]):
                    break  # the region may go on in the next batch
                solve(rows[0][begin], rows[1][begin], *(x[begin:end] for x in rows[2:]), first or cutoff > 0)
                begin, first, cutoff = end, False, 0
            held = [x[begin:] for x in rows]
            if sum(len(x[0]) for x in pairs) > 20_000 or len(leaders) > 5_000 or len(members) > 50 or len(spread) > 50:
                yield out()
        if held is not None and len(held[0]):
            solve(held[0][0], held[1][0], *held[2:], True)
        yield out()

    return run


def candidates(reps: DataFrame, percent: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Candidate pairs (a < b, first), members of large blocks (uid, block), level by level, and the rows of regions of several blocks (key, uid, n).

    Orders of reps without heads begin with their keys.
    """
    spark = reps.sparkSession
    rows = reps.select("*", F.col("n_shingles").alias("n"), F.posexplode("keys").alias("tree", "key"))
    head = F.expr("heads[tree]") if "heads" in reps.columns else F.col("key")
    label = F.expr(f"substring(sketch, tree * {DEPTH} + {MIN_DEPTH + 1}, {DEPTH - MIN_DEPTH})")
    order = ["head", "key", "label", "uid"]
    rows = rows.select(head.alias("head"), "key", label.alias("label"), "uid", "n", "sketch")
    pairs, members, regions, before, parts = [], [], None, None, partitions(spark)
    while True:
        dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        found = written(dealt.mapInArrow(_blocks(percent, regions is None), FOUND), "found")
        pairs.append(found.where("b IS NOT NULL").select("a", "b", "first"))
        members.append(found.where("block IS NOT NULL").select(F.col("a").alias("uid"), "block", F.lit(len(members)).alias("level")))
        if regions is None:  # the leaders of later levels are rows of these regions
            regions = found.where("key IS NOT NULL AND label IS NULL").select("key", F.col("a").alias("uid"), "n")
        rows = found.where("label IS NOT NULL").select("head", "key", "label", F.col("a").alias("uid"), "n", "sketch")
        # a region ends for itself: with one leader, or where a round removes hardly any (step 6 compares all its rows anyway)
        going = rows.groupBy("key").agg(F.count("*").alias("leaders")).where("leaders > 1")
        if before is not None:
            going = going.join(before.withColumnRenamed("leaders", "had"), "key", "left").where("had IS NULL OR leaders <= 0.9 * had").select("key", "leaders")
        before = written(going, "regions")
        n = before.agg(F.sum("leaders")).first()[0]
        if not n:
            return pairs, members, regions
        rows = rows.join(before.select("key"), "key", "left_semi")
        parts = min(partitions(spark), 1 + n // (8 * BLOCK))  # partitions of several blocks


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, na, nb in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb"))):
                both = np.concatenate([unpacked48(x), unpacked48(y)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (na + nb - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("uid").alias("a"), F.col("shingles").alias("sa"), F.col("n_shingles").alias("na"))
    b = sets.select(F.col("uid").alias("b"), F.col("shingles").alias("sb"), F.col("n_shingles").alias("nb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block's sets, by products of bounded slices of their incidence matrix."""
    g = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(g), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.append(False, values[1:] != values[:-1]))
    column = column[: len(values)]
    often = np.bincount(column, minlength=1)[column] > 1  # the others are in no intersection
    column, owner = np.unique(column[often], return_inverse=True)[1], owner[often]
    out = np.zeros((g, g), np.float32)
    cuts = np.searchsorted(column, np.arange(0, int(column.max(initial=-1)) + 4097, 4096))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        part = np.zeros((g, 4096), np.float32)
        part[owner[lo:hi], column[lo:hi] & 4095] = 1
        out += part @ part.T
    return out


def _linked_across(percent: int):
    """Links of a block between different components, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows):
            uid, root, n = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
            both = shared_counts([unpacked48(r[4]) for r in rows])
            yes = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (root[:, None] != root[None, :])
            a, b = np.nonzero(np.triu(yes, 1))
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            _, one = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True)  # one link joins two components
            a, b = a[one], b[one]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(uid[a], uid[b])), pa.array(np.maximum(uid[a], uid[b]))], ["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "uid", "root", "n", "shingles"))):
                if held and held[0][0] != row[0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def linked_across(rows: DataFrame, percent: int) -> DataFrame:
    """Links between the components of each block of rows (block, uid, root, n, shingles)."""
    dealt = rows.repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block")
    return written(dealt.mapInArrow(_linked_across(percent), "a long, b long").distinct(), "links")


def across_blocks(regions: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """block, uid, root, n: rows of regions with several components, once for each block of two cells they are compared in."""
    c = F.col
    rows = regions.join(roots, regions.uid == roots.node, "left").select("key", "uid", "n", F.coalesce("root", "uid").alias("root"))
    rows = written(rows, "regions")
    parts = rows.groupBy("key", "root").agg(F.count("*").alias("rows"))
    open_ = parts.groupBy("key").agg(
        F.max_by("root", F.struct("rows", "root")).alias("largest"), F.count("*").alias("parts")
    ).where("parts > 1").select("key", "largest")
    # sets of classes that are not neighbours differ too much in size for a link
    size_class = F.floor(F.log("n") / (float(np.log(100 / percent)) + 1e-9))
    rows = written(
        rows.join(open_, "key").select(
            "key", "uid", "n", "root", F.struct((c("root") == c("largest")).alias("own"), size_class.alias("size")).alias("cell")
        ),
        "cells"
    )
    cells = written(rows.groupBy("key", "cell").agg(F.ceil(F.count("*") / CELL).alias("k")), "cells")
    first, second = cells.select("key", c("cell").alias("c1"), c("k").alias("k1")), cells.select("key", c("cell").alias("c2"), c("k").alias("k2"))
    near = (c("c1") <= c("c2")) & (F.abs(c("c1.size") - c("c2.size")) <= 1) & ~(c("c1.own") & c("c2.own"))
    meet = first.join(second, "key").where(near)
    named = lambda h1, h2: F.xxhash64("key", "c1", "c2", h1, h2).alias("block")
    mine = rows.withColumn("h", F.xxhash64("uid"))
    left = mine.join(meet, (mine.key == meet.key) & (mine.cell == meet.c1)).drop(mine.key).withColumn("h", F.pmod("h", "k1"))
    right = mine.join(meet, (mine.key == meet.key) & (mine.cell == meet.c2)).drop(mine.key).withColumn("h", F.pmod("h", "k2"))
    others = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), c(k) - 1)).alias("o")
    what = ["uid", "root", "n"]
    two = left.where("c1 <> c2").select("*", others("k2")).select(named(c("h"), c("o")), *what)
    two = two.unionByName(right.where("c1 <> c2").select("*", others("k1")).select(named(c("o"), c("h")), *what))
    one = left.where("c1 = c2").select("*", others("k1")).where("h <> o OR k1 = 1").select(named(F.least("h", "o"), F.greatest("h", "o")), *what)
    return two.unionByName(one)


def rooted(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, name of the text, n_shingles, component_id and root of the component: one row per row of docs."""
    sig = written(signatures(docs, shingle), "signatures")
    names = ["fp1", "fp2"]
    reps = sig.groupBy(*names).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid")).alias("r"))
    reps = written(reps.select(*names, F.col("r.uid").alias("rep"), F.col("r.doc_id").alias("rep_doc")), "reps")
    alone = sig.where("n_shingles > 0").join(reps.select(F.col("rep").alias("uid")), "uid", "left_semi")
    pairs, members, regions = candidates(alone.select("uid", "n_shingles", "sketch", "heads", "keys"), percent)
    inside = _all(members)
    pairs = written(_all(pairs).groupBy("a", "b").agg(F.max("first").alias("first")), "pairs")
    ids = _all([pairs.select(F.col("a").alias("uid")), pairs.select(F.col("b").alias("uid")), inside.select("uid"), regions.select("uid")]).distinct()
    ids = written(ids, "ids")
    few = ids.count() <= FEW_IDS
    sets = written(sig.select("uid", "shingles", "n_shingles").join(F.broadcast(ids) if few else ids, "uid", "left_semi"), "sets")
    links = written(confirmed(pairs.where("first"), sets, percent), "links")
    roots = written(components(links), "roots")

    def joined(new: DataFrame) -> None:
        nonlocal links, roots
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = written(components(links), "roots")

    def rooted_as(rows: DataFrame, uid: str, root: str) -> DataFrame:
        return rows.join(
            roots.select(F.col("node").alias(uid), F.col("root").alias("found")), uid, "left"
        ).withColumn(root, F.coalesce("found", uid)).drop("found")

    rest = rooted_as(rooted_as(pairs.where("NOT first"), "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
    joined(written(confirmed(rest, sets, percent), "links"))
    if not inside.isEmpty():
        held = written(rooted_as(inside, "uid", "root").select("uid", "block", "level", "root"), "members")
        open_ = held.groupBy("level", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("level", "block")
        rows = held.join(open_, ["level", "block"], "left_semi")
        rows = rows.select("uid", "root", (F.col("block") * 64 + F.col("level")).alias("block")).join(sets, "uid")
        joined(linked_across(rows.select("block", "uid", "root", F.col("n_shingles").alias("n"), "shingles"), percent))
    if not regions.isEmpty():
        rows = across_blocks(regions, roots, percent).join(sets.select("uid", "shingles"), "uid")
        joined(linked_across(rows.select("block", "uid", "root", "n", "shingles"), percent))
    # the smallest id of each component, given to its rows in SALT parts
    linked = roots.join(reps.select(F.col("rep").alias("node"), "rep_doc"), "node")
    least = linked.groupBy("root").agg(F.min("rep_doc").alias("least")).select("root", "least", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    linked = roots.withColumn(
        "part", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")
    ).join(least, ["root", "part"]).select(F.col("node").alias("rep"), "root", "least")
    labelled = reps.join(linked, "rep", "left")
    labelled = labelled.select(
        *names, F.when(F.col("root").isNull(), F.col("rep_doc")).otherwise(F.col("least")).alias("component_id"),
        F.coalesce("root", "rep").alias("root")
    )
    out = sig.select("doc_id", "name", "n_shingles", *names).join(labelled, names)
    return out.select("doc_id", "name", "n_shingles", "component_id", "root")


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return rooted(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", kept)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, of those with the smallest doc_id (null last).  All columns stay.

    Rows go by doc_id and text, so rows of one doc_id or of none stay where their texts are not
    linked; rows without a word are linked with nothing and stay.
    """
    i, name, n, text, bare, own = unused(docs, "id", "name", "rows", "text_name", "bare", "own")
    rows = rooted(docs, shingle, percent).where("n_shingles > 0").groupBy("root", "doc_id", "name").agg(F.count("*").alias("rows"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "name", "rows")).alias("r"))
    stays = written(first.select(F.col("r.doc_id").alias(i), F.col("r.name").alias(name), F.col("r.rows").alias(n)), "stays")
    named = docs.select(*docs.columns, text_name().alias(text), (~text_or_empty().rlike(WORD)).alias(bare))
    kept = named.join(stays, named.doc_id.cast("long").eqNullSafe(F.col(i)) & (F.col(text) == F.col(name)), "left")
    kept = kept.where(F.col(bare) | F.col(n).isNotNull())
    if not stays.where(F.col(n) > 1).isEmpty():  # of equal rows one stays; those without a word are each their own
        kept = kept.withColumn(own, F.when(F.col(bare), F.monotonically_increasing_id())).dropDuplicates([i, text, own])
    return kept.select(*docs.columns)
