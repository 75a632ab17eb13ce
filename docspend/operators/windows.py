"""First-wins, ordering, caps and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspend.schemas import DOCUMENT_EXTENSIONS


def extension(name: Column) -> Column:
    """After the last dot, in lower case; '' without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def format_priority(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext == "pdf", 0).when(ext == "ofd", 1).when(ext == "xml", 2).otherwise(3)


def processing_order(name: Column, hints: Column | None = None) -> Column:
    """A sort key: formats in the order of the hints first, then pdf, ofd, xml and others."""
    plain = format_priority(name)
    if hints is None:
        return plain
    # a format that is hinted twice counts at its last place
    back = F.array_position(F.reverse(F.transform(hints, lambda x: F.lower(x))), extension(name))
    kinds = F.size(F.array_distinct(F.transform(hints, lambda x: F.lower(x))))
    return F.when(F.coalesce(F.size(hints), F.lit(0)) <= 0, plain).when(back > 0, F.size(hints) - back).otherwise(kinds + plain)


def prioritise(attachments: DataFrame, key: str, position: str, name: str = "filename", hints: str | None = None) -> DataFrame:
    """turn: the order in which a message's attachments are processed; those of one rank keep theirs."""
    order = processing_order(F.col(name), F.col(hints) if hints else None)
    return attachments.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(order, position, name)))


def repeated_names(attachments: DataFrame, *order: str) -> DataFrame:
    """skipped: whether a message (email_uid) has an earlier attachment of the same name."""
    turn = F.row_number().over(Window.partitionBy("email_uid", "filename").orderBy(*order))
    return attachments.withColumn("skipped", turn > 1)


def dedup_invoices(cand: DataFrame) -> DataFrame:
    """The first of each (tenant, number) is saved, later ones are duplicates."""
    turn = F.row_number().over(Window.partitionBy("user_id", "invoice_no").orderBy("received_at", "email_uid", "cand_id"))
    return cand.withColumn("outcome", F.when(turn == 1, "saved").otherwise("duplicate"))


def dedup_messages(emails: DataFrame) -> DataFrame:
    """The first message of each id of an account; messages without an id are all kept.

    Only rows with an id enter the aggregation; min over a struct folds before the shuffle.
    """
    key = F.trim(F.regexp_replace(F.coalesce("message_id", F.lit("")), "[<>]", ""))
    named = emails.withColumn("mid", key)
    first = named.where("mid <> ''").groupBy("account_id", "mid").agg(F.min(F.struct("received_at", "folder", "email_id")).alias("f"))
    kept = first.select(F.col("f.email_id").alias("email_id"))
    return named.where("mid = ''").unionByName(named.where("mid <> ''").join(kept, "email_id", "left_semi"))


def assign_paths(df: DataFrame, owner: str, base: str, order: str) -> DataFrame:
    """base, base_1, base_2 ... for names that an owner has more than once."""
    turn = F.row_number().over(Window.partitionBy(owner, base).orderBy(order)) - 1
    return df.withColumn("path", F.concat(F.col(base), F.when(turn == 0, "").otherwise(F.concat(F.lit("_"), turn))))


#: A stored invoice's path: its owner's folder, the stem that ends in an amount, the number of a repeated name, the suffix.
STORED = r"^(users/\d+/invoices/)(.*_-?\d+\.\d{2})(?:_([1-9]\d*))?(\.[^./]*)$"


def free_paths(df: DataFrame, stored: DataFrame, *order: str) -> DataFrame:
    """df with file_path, folder + stem + suffix: names that an owner has already, stored or earlier in df, get _1, _2 ... before the suffix, the first that is free.

    df: folder, stem, suffix; stored: file_path.
    """
    keys = ["folder", "stem", "suffix"]
    part = lambda i: F.regexp_extract("file_path", STORED, i)
    taken = stored.where(F.col("file_path").rlike(STORED)).select(part(1).alias("folder"), part(2).alias("stem"), part(4).alias("suffix"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("0")).cast("long").alias("n"))
    taken = taken.groupBy(*keys).agg(F.array_sort(F.collect_set("n")).alias("taken"))
    turn = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")
    rows = df.withColumn("n", turn).join(taken, keys, "left")
    free = F.aggregate(F.coalesce("taken", F.array().cast("array<bigint>")), F.col("n"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    name = F.concat("folder", "stem", F.when(free == 0, "").otherwise(F.concat(F.lit("_"), free)), "suffix")
    return rows.withColumn("file_path", name).drop(*keys, "n", "taken")


def cap_seen(df: DataFrame, n: int, partition: str, order: Column) -> DataFrame:
    """The newest n of each partition."""
    turn = F.row_number().over(Window.partitionBy(partition).orderBy(order))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).drop("turn")


def retention_split(df: DataFrame, expired: Column, n: int, key: str = "id") -> DataFrame:
    """The rows that stay when at most n expired ones, lowest keys first, are deleted."""
    doomed = df.where(expired).select(key).orderBy(key).limit(n)
    return df.join(doomed, key, "left_anti")


def after_last_known(df: DataFrame, known: DataFrame, position: str = "position") -> DataFrame:
    """Messages of an account behind the last known one in the mailbox's own order."""
    seen = df.join(known, ["account_id", "uid"], "left_semi").groupBy("account_id").agg(F.max(position).alias("last"))
    return df.join(seen, "account_id", "left").where(F.col("last").isNull() | (F.col(position) > F.col("last"))).drop("last")


def is_document(name: Column) -> Column:
    return extension(name).isin(*DOCUMENT_EXTENSIONS)
