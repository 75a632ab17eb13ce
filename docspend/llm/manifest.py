"""Merkle manifest of a dataset: a digest tree for each source, a tree over the sources, proofs of rows.

A leaf is the digest of a row.  The leaves of a source stand in the order of doc_id; every RUN
consecutive nodes become one, until one is left (the subroot); the subroots, in the order of their
sources, become the root in the same way.

1. One scan of the texts makes the leaves, which are written.
2. Coordinates by bitmap rank: the doc_ids of a source are a bitmap of 64-bit words, of which only
   those with a bit are kept, merged from all tasks by bit_or.  A directory over the words holds
   the rows before each; its levels have at most 2^15 entries below one entry, so no window grows
   with the data.  A row's coordinate is its word's entry plus the bits below its own: no source is
   sorted, and one that holds most of the rows is spread by its words.  Rows that repeat a doc_id
   are counted beside the bits, and take their places by the rank of their leaf's first 60 bits,
   then of a row number, by the same function.
3. Slot arrays: each node is sent to the array of its block of RUN^STEP nodes, takes the slot of its
   coordinate there, and the task reduces the array by STEP levels.  The tops of the arrays are the
   nodes of the next round, of which there are as many as the logarithm of the largest source.
4. Downwards, each array learns the path of its own top and gives each of its nodes a path: for
   each level the siblings on the left and on the right.

Defined cases: a null value is `-` in its leaf; an empty text is `0:`; a null source is a source
of its own before all others; a null doc_id stands at the smallest long; rows that repeat a doc_id
in one source stand in the order of their leaves, equal rows in any; bytes that are not valid UTF-8
are hashed as they are; a source of one row has that leaf as its subroot, a table of one source has
its subroot as the root; no rows give no rows and no root.  Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docspend.llm.common import partitions, written

#: Consecutive nodes that become one; levels that one slot array is reduced by.
RUN, STEP = 3, 6
SLOTS = RUN**STEP
#: Bits of an id that name its bit in a word; bits of a directory entry's children.
BIT, FAN = 6, 15
SMALLEST = -(1 << 63)
PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def part(value: Column) -> Column:
    """A value as it stands in a leaf: - or its bytes, a colon, itself."""
    raw = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(raw).cast("string"), F.lit(":"), raw), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row, with this text."""
    return F.sha2(F.concat(*(part(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), part(text)), 256)


def tree_name(source: Column) -> Column:
    """A name that sorts as the source does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(""))


def ranked(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """rows with `before` (rows of the group with a smaller key), `same` (with this key) and `n` (of the group).

    key: a long that is not null.  rows is read several times.
    """
    bit = F.col(key).bitwiseAND(F.lit((1 << BIT) - 1)).cast("int")
    from_least = F.col(key).bitwiseXOR(F.lit(SMALLEST))  # as an unsigned number, so that entries of both signs meet above
    keyed = rows.withColumn("word", F.shiftrightunsigned(from_least, BIT)).withColumn("bit", bit)
    one = F.expr("shiftleft(1L, bit)")
    words = written(keyed.groupBy(*group, "word").agg(F.bit_or(one).alias("bits"), F.count("*").alias("rows")), "bitmap")
    lo, hi = words.agg(F.min("word"), F.max("word")).first()
    if lo is None:
        return rows.select("*", *(F.lit(0).cast("long").alias(c) for c in ("before", "same", "n")))
    # directory: levels upwards until each group has one entry, then the rows before each entry downwards
    levels = [words.select(*group, F.col("word").alias("entry"), "rows")]
    while lo != hi:
        lo, hi = lo >> FAN, hi >> FAN
        above = levels[-1].groupBy(*group, F.shiftright("entry", FAN).alias("entry")).agg(F.sum("rows").alias("rows"))
        levels.append(written(above, "directory"))
    directory = levels[-1].select(*group, "entry", F.lit(0).cast("long").alias("before"), F.col("rows").alias("n"))
    for level in reversed(levels[:-1]):
        siblings = Window.partitionBy(*group, "parent").orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)
        inner = level.withColumn("parent", F.shiftright("entry", FAN))
        inner = inner.withColumn("inside", F.coalesce(F.sum("rows").over(siblings), F.lit(0)))
        top = directory.select(*group, F.col("entry").alias("parent"), F.col("before").alias("base"), "n")
        directory = inner.join(top, [*group, "parent"]).select(*group, "entry", (F.col("base") + F.col("inside")).alias("before"), "n")
    found = words.drop("rows").join(directory.withColumnRenamed("entry", "word"), [*group, "word"])
    crowded = words.where("rows > bit_count(bits)").select(*group, "word")
    repeats = "array<struct<bit: int, more: bigint>>"
    if crowded.isEmpty():
        found = found.withColumn("repeats", F.lit(None).cast(repeats))
    else:
        counts = keyed.join(crowded, [*group, "word"], "left_semi").groupBy(*group, "word", "bit").agg((F.count("*") - 1).alias("more"))
        counts = counts.where("more > 0").groupBy(*group, "word").agg(F.collect_list(F.struct("bit", "more")).cast(repeats).alias("repeats"))
        found = found.join(counts, [*group, "word"], "left")
    more = "aggregate(filter(repeats, x -> x.bit {} bit), 0L, (s, x) -> s + x.more)"
    inside = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    out = keyed.join(found, [*group, "word"])
    return out.select(
        *rows.columns, (F.col("before") + inside + F.coalesce(F.expr(more.format("<")), F.lit(0))).alias("before"),
        (F.coalesce(F.expr(more.format("=")), F.lit(0)) + 1).alias("same"), "n"
    )


def placed(rows: DataFrame) -> DataFrame:
    """tree, pos, n, h, item: the leaves with their coordinates.  rows: tree, key, h, row, item, written."""
    first = written(ranked(rows, ["tree"], "key"), "ranks")
    out = first.where("same = 1").select("tree", F.col("before").alias("pos"), "n", "h", "item")
    ties = first.where("same > 1").withColumnRenamed("before", "pos").withColumn("lead", F.conv(F.substring("h", 1, 15), 16, 10).cast("long"))
    ties = ties.select("tree", "key", "pos", F.col("n").alias("total"), "h", "row", "lead", "item")
    if ties.isEmpty():
        return out
    ties = written(ranked(ties, ["tree", "key"], "lead").withColumn("pos", F.col("pos") + F.col("before")).drop("before", "n"), "ties")
    equal = ties.where("same > 1").drop("same")
    ties = ties.where("same = 1").select("tree", "pos", F.col("total").alias("n"), "h", "item")
    equal = ranked(equal, ["tree", "key", "lead"], "row").select("tree", (F.col("pos") + F.col("before")).alias("pos"), F.col("total").alias("n"), "h", "item")
    return out.unionByName(ties).unionByName(equal)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of one slot array, lowest first: STEP of them, or until the tree of n nodes has one node."""
    out = [nodes]
    for _ in range(STEP):
        if n <= 1:
            break
        below = out[-1]
        out.append([digest(below[i : i + RUN]) for i in range(0, len(below), RUN)])
        n = -(-n // RUN)
    return out


def _slotted(nodes: DataFrame) -> DataFrame:
    """tree, block, n, slots, items, top: the nodes in the slots of their blocks, and the node each block becomes."""
    slot = (F.col("pos") % SLOTS).cast("int").alias("slot")
    dealt = nodes.groupBy("tree", F.floor(F.col("pos") / SLOTS).alias("block")).agg(F.max("n").alias("n"), F.collect_list(F.struct(slot, "h", "item")).alias("slots"))
    schema = T.StructType([
        T.StructField("tree", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("slots", T.ArrayType(T.StringType())),
        T.StructField("items", T.ArrayType(nodes.schema["item"].dataType)), T.StructField("top", T.StringType())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("slots")
            cells, sizes = lists.flatten(), np.asarray(lists.value_lengths())
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            order = np.full(len(cells), -1, np.int64)
            order[np.repeat(bounds[:-1], sizes) + np.asarray(cells.field("slot"))] = np.arange(len(cells))
            if (order < 0).any():
                raise ValueError("a slot array has a gap")
            h, items = cells.field("h").take(pa.array(order)), cells.field("item").take(pa.array(order))
            names, tops = h.to_pylist(), []
            for lo, hi, n in zip(bounds[:-1].tolist(), bounds[1:].tolist(), batch.column("n").to_pylist()):
                tops.append(levels_of(names[lo:hi], n)[-1][0])
            at = pa.array(bounds)
            columns = [batch.column("tree"), batch.column("block"), batch.column("n"), pa.ListArray.from_arrays(at, h), pa.ListArray.from_arrays(at, items), pa.array(tops, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return dealt.mapInArrow(run, schema)


def grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The written slot arrays of each round, leaves first, and the top of each tree (tree, top)."""
    rounds, tops = [], None
    while True:
        arrays = written(_slotted(nodes), "slots")
        rounds.append(arrays)
        done = arrays.where(F.col("n") <= SLOTS).select("tree", "top")
        tops = done if tops is None else tops.unionByName(done)
        going = arrays.where(F.col("n") > SLOTS)
        if going.isEmpty():
            return rounds, tops
        nodes = going.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / SLOTS).alias("n"), F.col("top").alias("h"), F.lit(0).alias("item"))


def _paths(arrays: DataFrame, above: DataFrame) -> DataFrame:
    """tree, pos, h, item, path: each node of the arrays, with its siblings up to the root.  above: tree, block, path of the arrays' tops."""
    item = arrays.schema["items"].dataType.elementType
    schema = T.StructType([
        T.StructField("tree", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("h", T.StringType()), T.StructField("item", item), T.StructField("path", PATH)
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one array at a time: its paths are some hundred KB
                tree, block, n, names, path = (batch.column(c)[k].as_py() for c in ("tree", "block", "n", "slots", "path"))
                levels, g = levels_of(names, n), len(names)
                beyond = [(x["left"], x["right"]) for x in path or ()]
                left, right = [], []
                for i in range(g):
                    for level in levels[:-1]:
                        lo = i - i % RUN
                        left.append("".join(level[lo:i]))
                        right.append("".join(level[i + 1 : lo + RUN]))
                        i //= RUN
                    left.extend(x for x, _ in beyond)
                    right.extend(y for _, y in beyond)
                deep = len(levels) - 1 + len(beyond)
                siblings = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
                paths = pa.ListArray.from_arrays(pa.array(np.arange(g + 1, dtype=np.int32) * deep), siblings)
                columns = [pa.array([tree] * g, pa.string()), pa.array(block * SLOTS + np.arange(g)), pa.array(names, pa.string()), batch.column("items")[k].values, paths]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrays.join(above, ["tree", "block"], "left").select("tree", "block", "n", "slots", "items", "path").mapInArrow(run, schema)


def paths(rounds: list[DataFrame], beyond: DataFrame) -> DataFrame:
    """tree, pos, h, item, path of all leaves.  beyond: tree and the path of its top to the root."""
    above = None
    for arrays in reversed(rounds):
        ended = arrays.where(F.col("n") <= SLOTS).select("tree", "block").join(beyond, "tree")
        above = ended if above is None else above.unionByName(ended)
        found = _paths(arrays, above)
        if arrays is rounds[0]:
            return found
        above = written(found.select("tree", F.col("pos").alias("block"), "path"), "paths")


class Manifest:
    """The written tree of a table.

    leaves: doc_id, source tree, item and h, as slot arrays; subroots: tree, subroot; root: the
    digest of all, None for a table without rows.
    """

    def __init__(self, docs: DataFrame, item: Column | None = None):
        """item: what each leaf carries beside doc_id, computed in the scan of the texts."""
        item = F.struct("doc_id", (F.lit(0) if item is None else item).alias("extra"))
        rows = docs.select(
            tree_name(F.col("source")).alias("tree"), F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)).alias("key"), leaf(F.col("text")).alias("h"),
            F.monotonically_increasing_id().alias("row"), item.alias("item")
        )
        self.spark = docs.sparkSession
        self.rounds, tops = grown(placed(written(rows, "leaves")))
        self.subroots = written(tops.withColumnRenamed("top", "subroot"), "subroots")
        self.upper, top = grown(self._in_order())
        first = top.first()
        self.root = first.top if first else None

    def _in_order(self) -> DataFrame:
        """The subroots as nodes of one tree, numbered in the order of their names over range partitions."""
        dealt = self.subroots.repartitionByRange(partitions(self.spark), "tree").sortWithinPartitions("tree")
        numbered = dealt.select("tree", "subroot", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
        numbered = written(numbered.withColumn("m", F.expr("m & ((1L << 33) - 1)")), "subroots")
        # one row a partition, so this window is small
        counts = numbered.groupBy("p").agg(F.count("*").alias("rows"))
        whole, earlier = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select("p", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"), F.sum("rows").over(whole).alias("n"))
        nodes = numbered.join(F.broadcast(counts), "p")
        return nodes.select(F.lit("").alias("tree"), (F.col("base") + F.col("m")).alias("pos"), "n", F.col("subroot").alias("h"), F.col("tree").alias("item"))

    def proofs(self) -> DataFrame:
        """doc_id, extra, leaf, subroot, root, path: for each row the siblings of each level on its left and right, lowest first."""
        nothing = self.spark.createDataFrame([], T.StructType([T.StructField("tree", T.StringType()), T.StructField("path", PATH)]))
        upper = paths(self.upper, nothing).select(F.col("item").alias("tree"), "path")
        upper = written(upper, "upper")
        found = paths(self.rounds, upper).join(self.subroots, "tree")
        return found.select("item.doc_id", "item.extra", F.col("h").alias("leaf"), "subroot", F.lit(self.root).alias("root"), "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: proofs of all rows, held against
    a copy of the table whose texts have lost their line ends where crc32(doc_id) is even."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = F.when(even & F.col("text").contains("\n"), leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    found = Manifest(docs, changed).proofs()
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    found = found.withColumn("folded_root", folded(F.coalesce("extra", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _value(column: str, text: str | None = None) -> str:
    text = text or f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


_LEAF = " || ".join(_value(c) for c in ("doc_id", "source", "lang", "n_chars"))

ORACLE = f"""
WITH RECURSIVE rows_ AS (
    SELECT doc_id, coalesce('+' || source, '') AS s, sha256({_LEAF} || {_value("text")}) AS leaf, sha256({_LEAF} || {_value("", "replace(text, chr(10), '')")}) AS changed,
           list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT)),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))
           ) % 2 = 1 AS even
    FROM documents
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY s) AS n FROM rows_
), lower_ AS (
    SELECT 0 AS level, s, pos, leaf AS h, n FROM leaves
    UNION ALL
    SELECT level + 1, s, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM lower_ WHERE n > 1 GROUP BY level, s, pos // 3
), subroots AS (
    SELECT s, h, level AS deep, row_number() OVER (ORDER BY s) - 1 AS pos, count(*) OVER () AS n FROM lower_ WHERE n = 1
), upper_ AS (
    SELECT 0 AS level, pos, h, n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM upper_ WHERE n > 1 GROUP BY level, pos // 3
), root AS (SELECT h, level AS deep FROM upper_ WHERE n = 1),
nodes AS (
    SELECT s, level, pos, h FROM lower_ WHERE n > 1
    UNION ALL
    SELECT a.s, a.deep + u.level, u.pos, u.h FROM subroots a, upper_ u WHERE u.n > 1
), start AS (
    SELECT s, leaf_pos, level, CASE WHEN level < deep THEN leaf_pos // CAST(pow(3, level) AS BIGINT) ELSE top // CAST(pow(3, level - deep) AS BIGINT) END AS pos
    FROM (SELECT l.s, l.pos AS leaf_pos, a.pos AS top, a.deep, unnest(range(0, a.deep + r.deep)) AS level FROM leaves l JOIN subroots a USING (s), root r)
), siblings AS (
    SELECT w.s, w.leaf_pos, w.level, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos < w.pos), '') AS l, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos > w.pos), '') AS r
    FROM start w JOIN nodes x ON x.s = w.s AND x.level = w.level AND x.pos // 3 = w.pos // 3 GROUP BY ALL
), fold AS (
    SELECT s, pos AS leaf_pos, 0 AS level, CASE WHEN even THEN changed ELSE leaf END AS h FROM leaves
    UNION ALL
    SELECT f.s, f.leaf_pos, f.level + 1, sha256(x.l || f.h || x.r) FROM fold f JOIN siblings x ON x.s = f.s AND x.leaf_pos = f.leaf_pos AND x.level = f.level
), ends AS (SELECT s, leaf_pos, max_by(h, level) AS folded FROM fold GROUP BY ALL),
proof AS (SELECT s, leaf_pos, sha256(string_agg(l || r, '' ORDER BY level)) AS p FROM siblings GROUP BY ALL)
SELECT l.doc_id, l.leaf, a.h AS subroot, r.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = r.h AS verified
FROM leaves l JOIN subroots a USING (s) JOIN ends e ON e.s = l.s AND e.leaf_pos = l.pos LEFT JOIN proof p ON p.s = l.s AND p.leaf_pos = l.pos, root r
"""
