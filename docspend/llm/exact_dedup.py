"""Exact dedup: group by a 128-bit content hash, then compare the bytes inside each group.

Plan: one aggregation of (hash, doc_id), whose partial step folds copies before the shuffle, gives
the groups; they are written.  A hash with one row needs no comparison, so only the texts of the
other hashes are compared: a second scan keeps those (by a broadcast of their hashes while there
are few, by a shuffled semi join beyond that) and aggregates by (hash, text), again folding copies
in each task, so a group that holds a third of all rows arrives as one row per task.  One join by
hash takes each document to its group.  Two different texts under one hash are two groups, and
where that occurs (checked, not assumed) the join also compares the text.

Defined cases: a null text counts as empty; an empty text is a text like any other; a null
doc_id is smaller than all others; rows that repeat the same doc_id and text are one document
(`classes` marks each of them, `deduplicated` returns one); bytes that are no UTF-8 are compared as they are; no rows give no rows.  Columns beside
doc_id and text are carried by `deduplicated` and otherwise ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspend.llm.common import text_or_empty, unused, written


#: Hashes of groups that are broadcast at most, of 16 bytes each.
FEW_GROUPS = 1_000_000


def content_hash(digest: Column) -> Column:
    """128 bits of a SHA-256 given as hex."""
    return F.unhex(F.substring(digest, 1, 32))


def classes(docs: DataFrame, hashed=content_hash, few: int = FEW_GROUPS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_sha256", F.sha2("text", 256)).withColumn("h", hashed(F.col("text_sha256")))
    members = keyed.drop("text")
    size_and_keep = (F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = written(members.groupBy("h").agg(*size_and_keep), "groups")
    shared = groups.where("group_size > 1").select("h")
    n = shared.count()
    if not n:
        found = members.join(groups, "h")
    else:
        together = keyed.join(F.broadcast(shared) if n <= few else shared, "h", "left_semi")
        texts = together.groupBy("h", "text").agg(*size_and_keep)
        collided = written(texts.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "collided")
        if collided.isEmpty():
            found = members.join(groups, "h")
        else:
            # different texts under one hash: these groups are split by the texts themselves
            found = members.join(collided, "h", "left_anti").join(groups, "h")
            split = keyed.join(collided, "h", "left_semi")
            found = found.unionByName(split.join(split.groupBy("h", "text").agg(*size_and_keep), ["h", "text"]).drop("text"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without rows whose text a row with a larger doc_id has too; all columns stay."""
    i, sha, rows = unused(docs, "id", "sha", "rows")
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    stays = classes(docs).where("kept").groupBy(named.alias(i), F.col("text_sha256").alias(sha)).agg(F.count("*").alias(rows))
    stays = written(stays, "stays")
    keyed = docs.withColumn(i, named).withColumn(sha, F.sha2(text_or_empty(), 256))
    kept = keyed.join(stays, [i, sha], "left_semi")
    if not stays.where(F.col(rows) > 1).isEmpty():
        kept = kept.dropDuplicates([i, sha])  # the same document in several rows
    return kept.select(*docs.columns)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
