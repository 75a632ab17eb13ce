"""Benchmark decontamination with an FM-index for each training shard.

A window is WINDOW consecutive words of a benchmark item, or all words of a shorter one.  A word
of a document is hit if it lies in an occurrence of a window.

1. The distinct windows are written in blocks of about BLOCK, and beside them which items have them.
2. A task cuts its documents into shards of about SHARD bytes.  For each block it numbers the words
   that occur in windows; all other words, and the ends of documents, end a stretch of the shard's
   symbols.  Stretches shorter than the shortest window hold none and are left out; the others get
   an FM-index: suffix array, last column, wavelet tree.
3. All windows of the block are searched backwards at once by ranks of the wavelet tree, and the
   ranges found are located by stepping back to sampled places.  Each occurrence is compared with
   its window byte by byte, so that no two words count as equal for their hash.
4. Occurrences are merged into spans; windows found lead to items by a join.

So the index of a shard is bounded whatever the corpus, and a benchmark of any size costs passes
over the shard in memory, not over the corpus.

Defined cases: null texts and texts without words have no words and no hits; an item without words
has no window; items that repeat an item_id are one item, and those without an id are one item
named ''; a window that several items have counts for each; rows that repeat are documents each;
broken UTF-8 is read as U+FFFD, which is part of a word; no benchmark gives no hits; no documents
give no rows.  Other columns are carried by `cleaned` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspend.llm.bytesops import ALNUM, LOWER, SpanHash, chunked, same_spans, span_ids, string_bytes, sums, words
from docspend.llm.common import clean_text, scratch, unused, written
from docspend.llm.fm_index import FMIndex
from docspend.shipping import ship

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows of a block (about 100 bytes each, in memory of a task), bytes of a shard.
BLOCK, SHARD = 200_000, 4_000_000
#: Rows of windows and items up to which they are broadcast (about 100 bytes each).
FEW = 200_000

SPAN = "struct<start: bigint, end: bigint>"
FOUND = f"row_id long, doc_id long, n_words long, n_hit long, spans array<{SPAN}>, windows array<bigint>"


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item, text: the windows of each item, words joined by spaces."""
    found = F.regexp_extract_all(F.translate(clean_text(), UPPER, SMALL), F.lit(WORD), F.lit(0))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), found.alias("words")).where("size(words) > 0")
    starts = F.explode(F.expr(f"sequence(1, greatest(size(words) - {size - 1}, 1))"))
    return rows.select("item", "words", starts.alias("at")).select("item", F.array_join(F.slice("words", F.col("at"), size), " ").alias("text")).distinct()


class Phrases:
    """The windows of a block: their words, and each window as a row of word numbers from 1."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        data, offsets = string_bytes(texts)
        self.data, self.ids, self.span = data, ids, SpanHash()
        self.starts, self.ends, bounds = words(data, offsets, ALNUM)
        self.lengths, self.begin = np.diff(bounds), bounds[:-1]
        # numbers go by hash: a number may stand for two words, which the comparison of occurrences tells apart
        self.hashes, numbers = np.unique(self.span(data, self.starts, self.ends), return_inverse=True)
        self.patterns = np.zeros((len(ids), int(self.lengths.max(initial=1))), np.int64)
        row = np.repeat(np.arange(len(ids)), self.lengths)
        self.patterns[row, np.arange(len(row)) - self.begin[row]] = numbers + 1

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for words in no window."""
        ids, first, hashes = span_ids(data, starts, ends, self.span)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)[ids]

    def occurrences(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all occurrences, and their windows."""
        none = np.zeros(0, np.int64)
        number = self.numbers(data, starts, ends)
        known = number > 0
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        heads = bounds[:-1][np.diff(bounds) > 0]
        begins[heads] = known[heads]
        begin = np.flatnonzero(begins)
        # a stretch ends at the next unknown word or the end of its document
        stops = np.append(np.flatnonzero(begins | ~known), len(number))
        length = stops[np.searchsorted(stops, begin, "right")] - begin
        long_enough = length >= self.lengths.min()
        begin, length = begin[long_enough], length[long_enough]
        if not len(begin):
            return none, none
        after = np.cumsum(length + 1)
        word = np.repeat(begin - (after - length - 1), length + 1) + np.arange(after[-1])
        text = number[np.minimum(word, len(number) - 1)]
        text[after - 1] = 0
        index = FMIndex(text)
        lo, hi = index.search(self.patterns, self.lengths)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        total = np.cumsum(n)
        suffixes = np.repeat(lo - (total - n), n) + np.arange(len(which))
        at = word[index.locate(suffixes)]
        return self.compared(data, starts, ends, at, which)

    def compared(self, data, starts, ends, at, which) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences whose words are those of the window byte by byte."""
        same = np.ones(len(at), bool)
        for k in range(self.patterns.shape[1]):
            rows = np.flatnonzero(same & (self.lengths[which] > k))
            mine, theirs = at[rows] + k, self.begin[which[rows]] + k
            size = ends[mine] - starts[mine]
            agree = size == self.ends[theirs] - self.starts[theirs]
            agree[agree] = same_spans(data, starts[mine[agree]], self.starts[theirs[agree]], size[agree], self.data)
            same[rows[~agree]] = False
        return at[same], which[same]


@lru_cache(maxsize=2)
def _block(path: str) -> Phrases:
    """A block of windows, read where the task runs."""
    from pyarrow import dataset

    from docspend.llm.files import filesystem

    system, where = filesystem(path)
    rows = dataset.dataset(where, filesystem=system, format="parquet").to_table(columns=["window", "text"]).combine_chunks()
    return Phrases(np.asarray(rows.column("window")), rows.column("text").combine_chunks())


def searched(data: np.ndarray, offsets: np.ndarray, blocks: Iterator[Phrases]) -> tuple[np.ndarray, np.ndarray, list, list, np.ndarray]:
    """For the documents of a shard: words, hit words, spans of code points, ids of windows; and the hit bytes' spans as rows (document, first, end)."""
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, bounds = words(low, offsets, ALNUM)
    change = np.zeros(len(starts) + 1, np.int64)
    of_word = np.repeat(np.arange(n), np.diff(bounds))
    pairs = []
    for phrases in blocks:
        at, which = phrases.occurrences(low, starts, ends, bounds) if len(starts) else (np.zeros(0, np.int64),) * 2
        np.add.at(change, at, 1)
        np.add.at(change, at + phrases.lengths[which], -1)
        pairs.append(np.unique(np.stack([of_word[at], phrases.ids[which]], axis=1), axis=0))
    hit = np.cumsum(change[:-1]) > 0
    joined = hit[1:] & hit[:-1] & (of_word[1:] == of_word[:-1])
    first = np.flatnonzero(hit & ~np.append(False, joined)[: len(hit)])
    last = np.flatnonzero(hit & ~np.append(joined, False)[: len(hit)])
    cuts = np.stack([of_word[first], starts[first], ends[last]], axis=1) if len(first) else np.zeros((0, 3), np.int64)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = points[offsets[:-1]]
    spans, found = [[] for _ in range(n)], [[] for _ in range(n)]
    for d, a, b in cuts.tolist():
        spans[d].append({"start": int(points[a] - base[d]), "end": int(points[b] - base[d])})
    for d, w in (np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)).tolist():
        found[d].append(w)
    return np.diff(bounds), sums(hit, bounds), spans, found, cuts


class Benchmark:
    """The windows of a benchmark, written in blocks: paths, and which items have each window."""

    def __init__(self, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK):
        spark = benchmark.sparkSession
        rows = written(windows(benchmark, size), "windows")
        texts = written(rows.select("text").distinct().withColumn("window", F.monotonically_increasing_id()), "texts")
        self.n = texts.count()
        parts = -(-self.n // block)
        path = scratch(spark, "blocks")
        dealt = texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(max(parts, 1))))
        dealt.repartition("block").write.partitionBy("block").parquet(path)
        self.paths = [f"{path}/block={r.block}" for r in dealt.select("block").distinct().orderBy("block").collect()]
        self.items = written(rows.join(texts, "text").select("window", "item"), "items")
        self.few = self.items.count() <= FEW


def _shards(batches: Iterator[pa.RecordBatch], paths: list[str], shard: int):
    for batch in batches:
        data, offsets = string_bytes(batch.column("text"))
        for lo, hi in chunked(offsets, shard):
            raw = data[offsets[lo] : offsets[hi]]
            yield batch, lo, hi, raw, offsets[lo : hi + 1] - offsets[lo], searched(raw, offsets[lo : hi + 1] - offsets[lo], map(_block, paths))


def search(docs: DataFrame, bench: Benchmark, shard: int = SHARD) -> DataFrame:
    """row_id, doc_id, n_words, n_hit, spans (code points to remove), windows (ids): one row per row of docs, written."""
    paths = bench.paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch, lo, hi, _, _, (n_words, n_hit, spans, found, _) in _shards(batches, paths, shard):
            columns = [pa.array(row + np.arange(hi - lo)), batch.column("doc_id").slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.int64()))]
            row += hi - lo
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ("row_id", "doc_id", "n_words", "n_hit", "spans", "windows")])

    ship(docs.sparkSession)
    return written(docs.select(F.col("doc_id").cast("long"), clean_text().alias("text")).mapInArrow(run, FOUND), "hits")


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: one row per row of docs."""
    bench = Benchmark(benchmark, size, block)
    found = search(docs, bench, shard)
    met = found.where("n_hit > 0").select("row_id", F.explode("windows").alias("window"))
    items = met.join(F.broadcast(bench.items) if bench.few else bench.items, "window").groupBy("row_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = found.where("n_hit > 0").join(items, "row_id").unionByName(found.where("n_hit = 0").withColumn("items", F.lit(None).cast("array<string>")))
    items = F.coalesce("items", F.lit(None).cast("array<string>"), F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans"
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with the spans taken out of the texts; all columns and rows stay, texts without a hit as they are."""
    paths = Benchmark(benchmark, size).paths
    whole, left = unused(docs, "row", "left")
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("left", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, raw, offsets, (*_, cuts) in _shards(batches, paths, SHARD):
            out: list[str | None] = [None] * (hi - lo)
            for d in np.unique(cuts[:, 0]).tolist():
                kept, at = [], int(offsets[d])
                for _, a, b in cuts[cuts[:, 0] == d].tolist():
                    kept.append(raw[at:a].tobytes())
                    at = b
                out[d] = b"".join([*kept, raw[at : offsets[d + 1]].tobytes()]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), pa.array(out, pa.string())], ["row", "left"])

    ship(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), clean_text().alias("text")).mapInArrow(run, schema).toDF(whole, left)
    text = F.coalesce(F.col(left), F.col(f"{whole}.text")).alias("text")
    return rows.select(*(text if c == "text" else F.col(whole)[c].alias(c) for c in docs.columns))


ORACLE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item, array_to_string(list_slice(w, i, least(i + 9, len(w))), ' ') AS g, least(10, len(w)) AS n
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), grams AS (
    SELECT d, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
    FROM (SELECT d, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (SELECT d, i, n, item FROM grams JOIN windows USING (g, n)),
words AS (SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT d, unnest(range(i, i + n)) AS p FROM found) GROUP BY d),
lists AS (SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT d, item FROM found) GROUP BY d)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (d) LEFT JOIN lists USING (d)
"""
