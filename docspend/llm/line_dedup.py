"""Line dedup: lines that many documents share go, except in one document.

The key of a line is the line without white space at both ends and with A-Z in lower case; keys
of at least `least` code points count.  A key found in at least `holders` documents loses all its
lines except in the document with the largest doc_id.

Key hashes (128 bits), document and position are written once, then range-partitioned by (hash,
document) and sorted within each partition, so a line that a third of all documents share is
spread over many tasks.  Each task streams its runs of equal hashes.  A run that begins inside the
partition begins with the document that keeps the line; its rows are held only until it has
enough documents, from then on they are decided one by one, so a long run needs no memory.  The
first and the last run of a partition may go on in a neighbour: each leaves a summary (documents,
first and last of them), and the summaries, two a partition at most, decide its open rows.  The
result of the search is a compressed keep bitmap for each document; texts are touched again only
to apply it.

Defined cases: a null or empty text is one empty line; a null doc_id is a document smaller than
all others; rows that repeat a doc_id are one document for the count; line ends other than \\n are
ordinary characters; broken UTF-8 is read as U+FFFD; no rows give no rows.  Other columns are carried by `filtered` only.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspend.llm.common import SPACE, clean_text, partitions, unused, written
from docspend.shipping import ship

LEAST, HOLDERS = 40, 5
NO_ID = -(2**63)

#: A line to drop, a line of an open run, or the summary of a run (docs is given; id is its first document, th its last).
MARKS = "h1 long, h2 long, id long, th long, n_lines int, pos int, open boolean, docs long"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), clean_text().alias("text")).withColumn("th", F.xxhash64("text"))


def _lines(docs: DataFrame, least: int) -> DataFrame:
    cut = _keyed(docs).withColumn("lines", F.split("text", "\n", -1))
    lines = cut.select("id", "th", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)
    lines = lines.withColumn("key", key).where(F.length("key") >= least)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "id", "th", "n_lines", "pos")


def _runs(holders: int):
    """Rows sorted by (h1, h2, id descending): the lines to drop, all lines of the open runs, and their summaries."""
    names = ["h1", "h2", "id", "th", "n_lines", "pos"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2

    def rows_of(columns, rows, is_open):
        arrays = [pa.array(c[rows], t) for c, t in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(rows), is_open)), pa.nulls(len(rows), pa.int64())], [*names, "open", "docs"])

    def summary(run):
        values = [*run["key"], run["first"], run["last"], None, None]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([v], t) for v, t in zip(values, kinds)), pa.nulls(1, pa.bool_()), pa.array([run["docs"]], pa.int64())],
            [*names, "open", "docs"]
        )

    def more(run, ids):
        """Count a run's next documents."""
        if len(ids):
            run["docs"] += int(ids[0] != run["last"]) + int((ids[1:] != ids[:-1]).sum())
            run["last"] = int(ids[-1])

    def begun(cols):
        return {"key": (int(cols[0][0]), int(cols[1][0])), "first": int(cols[2][0]), "last": None, "docs": 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = None  # the partition's first run while it lasts: its rows are open; then False
        decided = None  # the last run, if it has enough documents
        held = None  # the rows of the last run, if it has not
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(c)) for c in names]
            if opening is None:
                opening = begun(cols)
            now = opening or decided
            if now:
                same = (cols[0] == now["key"][0]) & (cols[1] == now["key"][1])
                n = len(same) if same.all() else int(same.argmin())
                mine = [c[:n] for c in cols]
                more(now, mine[2])
                yield rows_of(mine, np.arange(n) if opening else np.flatnonzero(mine[2] != now["first"]), bool(opening))
                if n == len(same):
                    continue
                if opening:
                    yield summary(opening)
                opening, decided, cols = False, None, [c[n:] for c in cols]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            last = int(change[-1]) + 1 if len(change) else 0
            if last:
                yield rows_of(cols, _dropped([c[:last] for c in cols], holders), False)
            held = [c[last:] for c in cols]
            tail = begun(held)
            more(tail, held[2])
            if tail["docs"] >= holders:
                yield rows_of(held, np.flatnonzero(held[2] != tail["first"]), False)
                decided, held = tail, None
        if held is not None:
            decided = begun(held)
            more(decided, held[2])
            yield rows_of(held, np.arange(len(held[0])), True)
        if opening or decided:
            yield summary(opening or decided)

    return run


def _dropped(cols: list[np.ndarray], holders: int) -> np.ndarray:
    """Rows of whole runs that go: those of runs with enough documents, except the first document's."""
    h1, h2, ids = cols[:3]
    run_starts = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
    doc_starts = run_starts | np.append(True, ids[1:] != ids[:-1])
    run = np.cumsum(run_starts) - 1
    docs = np.bincount(run[doc_starts])
    nth = np.cumsum(doc_starts)
    in_first = nth == nth[np.flatnonzero(run_starts)][run]
    return np.flatnonzero((docs[run] >= holders) & ~in_first)


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist()):
            keep = np.ones(n, bool)
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("th"), batch.column("n_lines"), pa.array(maps, pa.binary())], ["id", "th", "n_lines", "keep"]
        )


def keep_bitmaps(docs: DataFrame, least: int = LEAST, holders: int = HOLDERS) -> DataFrame:
    """id, th, n_lines, keep: a zlib-compressed bitmap for each document that loses a line."""
    order = ["h1", "h2", F.col("id").desc()]
    lines = written(_lines(docs, least), "lines")
    dealt = lines.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "pos")
    marks = written(dealt.mapInArrow(_runs(holders), MARKS), "marks")
    # a document at a boundary of partitions is the last of one summary and the first of the next
    parts = marks.where("docs IS NOT NULL").groupBy("h1", "h2").agg(
        F.sort_array(F.collect_list(F.struct(F.col("id").alias("first"), F.col("th").alias("last"), "docs")), asc=False).alias("p")
    )
    twice = F.expr("size(filter(sequence(1, size(p)), i -> i > 1 AND p[i - 1].first = p[i - 2].last))")
    shared = parts.where(F.expr("aggregate(p, 0L, (n, x) -> n + x.docs)") - twice >= holders).select("h1", "h2", F.expr("p[0].first").alias("stays"))
    late = marks.where("open").join(F.broadcast(shared), ["h1", "h2"]).where("id <> stays")
    gone = marks.where("NOT open").select("id", "th", "n_lines", "pos").unionByName(late.select("id", "th", "n_lines", "pos"))
    sets = gone.groupBy("id", "th", "n_lines").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    return sets.mapInArrow(_bitmap, "id long, th long, n_lines int, keep binary")


def kept_lines(text: str, keep: bytes | None, n_lines: int | None) -> list[str]:
    lines = text.split("\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines)
    return [x for x, k in zip(lines, bits.tolist()) if k]


def _joined(docs: DataFrame, least: int, holders: int) -> DataFrame:
    maps = keep_bitmaps(docs, least, holders).withColumnRenamed("n_lines", "bits")
    return _keyed(docs).join(maps, ["id", "th"], "left")


def report(docs: DataFrame, least: int = LEAST, holders: int = HOLDERS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, less, sha = [], [], []
            for text, keep, bits in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), batch.column("bits").to_pylist()):
                total = text.count("\n") + 1
                if keep is None:
                    left, new = total, text
                else:
                    lines = kept_lines(text, keep, bits)
                    left, new = len(lines), "\n".join(lines)
                n.append(total), less.append(total - left), sha.append(hashlib.sha256(new.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(less, pa.int64()), pa.array(sha)],
                ["id", "n_lines", "n_dropped", "kept_sha256"]
            )

    out = _joined(docs, least, holders).select("id", "text", "keep", "bits").mapInArrow(run, "id long, n_lines long, n_dropped long, kept_sha256 string")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


def filtered(docs: DataFrame, least: int = LEAST, holders: int = HOLDERS) -> DataFrame:
    """docs with the kept lines as text; all columns stay."""
    i, t, n, k = unused(docs, "id", "th", "bits", "keep")
    maps = keep_bitmaps(docs, least, holders).toDF(i, t, n, k)
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def applied(text, keep, bits):
        import pandas as pd

        return pd.Series(["\n".join(kept_lines(t, k, None if k is None else int(b))) for t, k, b in zip(text, keep, bits)])

    keyed = docs.withColumn(i, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(t, F.xxhash64(clean_text()))
    joined = keyed.join(maps, [i, t], "left")
    new = F.when(F.col(k).isNull(), F.col("text")).otherwise(applied(clean_text(), F.col(k), F.col(n)))
    return joined.withColumn("text", new).select(*docs.columns)


ORACLE = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS stays FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, pos, line, s.k IS NOT NULL AND doc_id <> s.stays AS gone FROM keyed LEFT JOIN shared s USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
