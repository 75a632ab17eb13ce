"""Token counts from flat token files without an index, by a separator scan.

A flat file is a sequence of little-endian 16-bit ids; an end-of-document id closes each document.
Files are read in blocks of a fixed size, wherever documents begin.  In each block numpy finds the
separators; a block's summary is its length, the number of its separators and the place after the
last one.  A prefix scan over the summaries of a file (window sums and the last known place) tells
each block how many documents ended before it and where the open one began, and so stitches the
documents that cross block boundaries, be they many blocks long.

Defined cases: a null or empty text is a document of 0 tokens; ids after the last separator of a
file are a document marked incomplete; an odd last byte is ignored; empty files and no rows give
no rows; rows that repeat are documents each; broken UTF-8 is read as U+FFFD; the other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspend.llm.bytesops import chunked, string_bytes
from docspend.llm.common import clean_text, scratch, written

#: Tokens in a block.
BLOCK = 1 << 20
END_OF_DOCUMENT = 50256
ID = np.dtype("<u2")

_encoder = None


def encoder():
    """The library's strings for special tokens are ordinary text here, so no text holds a separator."""
    global _encoder
    if _encoder is None:
        from docspend.llm.tokens import Encoder

        _encoder = Encoder(special_as_text=True)
    return _encoder


def write_token_files(docs: DataFrame, path: str, end: int = END_OF_DOCUMENT) -> DataFrame:
    """One flat file for each partition of docs; gives file, ordinal, doc_id of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from docspend.llm.files import atomic

        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        enc, ordinal, ids_of = encoder(), 0, []
        with atomic(f"{path}/{name}") as out:
            for batch in batches:
                data, offsets = string_bytes(batch.column("text"))
                for lo, hi in chunked(offsets):
                    ids, ends = enc.batch(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    ids = np.insert(ids, ends[1:], end)
                    if len(ids) and int(ids.max()) > np.iinfo(ID).max:
                        raise ValueError("the vocabulary has more ids than the files' numbers")
                    out.write(ids.astype(ID).tobytes())
                ids_of.append(batch.column("doc_id"))
        for x in ids_of:
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(x), pa.string()), pa.array(np.arange(ordinal, ordinal + len(x))), x], ["file", "ordinal", "doc_id"]
            )
            ordinal += len(x)

    rows = docs.select(F.col("doc_id").cast("long"), clean_text().alias("text"))
    return written(rows.mapInArrow(run, "file string, ordinal long, doc_id long"), "manifest")


def blocks(spark: SparkSession, path: str, end: int = END_OF_DOCUMENT, block: int = BLOCK) -> DataFrame:
    """file, block, start, length, ends: the places of the separators in every block of the files below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", F.expr(f"length div {ID.itemsize}").alias("tokens"))
    n = F.expr(f"(tokens + {block - 1}) div {block}")
    ranges = files.where("tokens > 0").select("path", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docspend.llm.files import filesystem

        for batch in batches:
            for name, tokens, k in zip(*(batch.column(c).to_pylist() for c in ("path", "tokens", "block"))):
                system, where = filesystem(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                start = k * block
                size = min(block, tokens - start)
                with system.open_input_file(where) as f:
                    f.seek(start * ID.itemsize)
                    ids = np.frombuffer(f.read(size * ID.itemsize), ID)
                ends = np.flatnonzero(ids == end).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.rpartition("/")[2]]), pa.array([k], pa.int64()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([ends], pa.list_(pa.int32()))],
                    ["file", "block", "start", "length", "ends"],
                )

    dealt = ranges.repartition("path", "block")
    return written(dealt.mapInArrow(run, "file string, block long, start long, length long, ends array<int>"), "blocks")


def counted(scan: DataFrame) -> DataFrame:
    """file, ordinal, start, n_tokens, complete: the documents of the scanned files."""
    size = F.size("ends")
    summary = scan.select("file", "block", "start", "length", size.alias("n"), F.when(size > 0, F.col("start") + F.element_at("ends", -1) + 1).alias("after"))
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        "file", "block",
        F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("first"),
        F.coalesce(F.last("after", ignorenulls=True).over(so_far), F.lit(0)).alias("open"),
    )
    rows = scan.join(carried, ["file", "block"])
    inside = rows.select("file", "start", "first", "open", "ends", F.posexplode("ends").alias("i", "at"))
    begin = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("start") + F.get("ends", F.col("i") - 1) + 1)
    whole = inside.select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"), begin.alias("start"), (F.col("start") + F.col("at") - begin).alias("n_tokens"),
        F.lit(True).alias("complete")
    )
    ends = summary.groupBy("file").agg(F.sum("n").alias("ordinal"), F.sum("length").alias("total"), F.coalesce(F.max("after"), F.lit(0)).alias("start"))
    rest = ends.where("total > start").select("file", "ordinal", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.unionByName(rest)


def document_counts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens: docs are written as flat files, which are then scanned."""
    from docspend.llm.files import make_dir

    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    make_dir(path)
    names = write_token_files(docs, path)
    return names.join(counted(blocks(spark, path, block=block)), ["file", "ordinal"]).select("doc_id", "n_tokens")
