"""Row changes as new snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspend.functions.parse import expiry


#: Tables whose rows belong to a user.
OWNED = ("correction_logs", "extraction_logs", "webhook_logs", "saved_views", "invoices", "scan_logs", "email_accounts", "user_sessions")


def delete_user(tables: dict[str, DataFrame], user_id: int) -> dict[str, DataFrame]:
    """Every given table of OWNED without the user's rows, and users without the user."""
    return {name: df.where(F.col("id" if name == "users" else "user_id") != user_id) for name, df in tables.items()}


def reconcile_paths(invoices: DataFrame, listing: DataFrame) -> DataFrame:
    """status, new_path: where an invoice's file belongs below its owner, and how it gets there.

    already_migrated: the row says so already; collision: only the new place has the file, the row
    follows; missing: no place has it, the row follows; moved: the file is at its old place.
    """
    files = listing.select("path").distinct()
    old = files.select(F.col("path").alias("file_path"), F.lit(True).alias("old"))
    new = files.select(F.col("path").alias("new_path"), F.lit(True).alias("new"))
    done = F.startswith("file_path", F.lit("users/"))
    place = F.concat(F.lit("users/"), F.col("user_id"), F.lit("/invoices/"), F.substring_index("file_path", "/", -1))
    rows = invoices.withColumn("new_path", F.when(done, F.col("file_path")).otherwise(place)).join(old, "file_path", "left").join(new, "new_path", "left")
    status = F.when(done, "already_migrated").when(
        F.col("new").isNotNull() & F.col("old").isNull(), "collision"
    ).when(F.col("old").isNull(), "missing").otherwise("moved")
    return rows.withColumn("status", status).drop("old", "new")


FIELDS = ("buyer", "seller", "amount", "invoice_date", "invoice_type", "item_summary", "invoice_no")


def apply_corrections(invoices: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The corrected snapshot, a log row for each field that changes, and the ids of rejected edits.

    edits: id and any of FIELDS; a null field is not edited.  An edit whose number another invoice
    of the tenant has, or an edit of a lower id takes, is rejected as a whole.
    """
    names = [f for f in FIELDS if f in edits.columns]
    new = edits.select("id", *(F.col(f).alias(f"new_{f}") for f in names))
    if "invoice_no" in names:
        wanted = invoices.select("id", "user_id").join(new.where("new_invoice_no IS NOT NULL").select("id", F.col("new_invoice_no").alias("invoice_no")), "id")
        first = wanted.groupBy("user_id", "invoice_no").agg(F.min("id").alias("first"))
        held = invoices.groupBy("user_id", "invoice_no").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        judged = wanted.join(first, ["user_id", "invoice_no"]).join(held, ["user_id", "invoice_no"], "left")
        rejected = judged.where("id <> first OR lo <> id OR hi <> id").select("id")
        new = new.join(rejected, "id", "left_anti")
    else:
        rejected = edits.select("id").limit(0)
    both = invoices.join(new, "id", "left")
    changed = {f: F.col(f"new_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"new_{f}")) for f in names}
    any_ = F.lit(False)
    for c in changed.values():
        any_ = any_ | c
    fixed = {f: F.when(changed[f], F.col(f"new_{f}")).otherwise(F.col(f)) for f in names} | {"is_manually_corrected": F.col("is_manually_corrected") | any_}
    corrected = both.select(*(fixed.get(c, F.col(c)).alias(c) for c in invoices.columns))
    rows = F.array(
        *(
            F.struct(
                F.lit(f).alias("field_name"), F.col(f).cast("string").alias("old_value"), F.col(f"new_{f}").cast("string").alias("new_value"),
                changed[f].alias("c")
            ) for f in names
        )
    )
    log = both.select("id", "user_id", F.inline(rows)).where("c").select(F.col("id").alias("invoice_id"), "user_id", "field_name", "old_value", "new_value")
    return corrected, log, rejected


def correction_history(logs: DataFrame) -> DataFrame:
    """invoice_id, fields, n, last_value: what was corrected, and the newest value."""
    newest = F.max_by("new_value", F.struct("corrected_at", "id")).alias("last_value")
    return logs.groupBy("invoice_id").agg(F.countDistinct("field_name").alias("fields"), F.count("*").alias("n"), newest)


def delete_invoices(df: DataFrame, ids: DataFrame, user_id: int) -> tuple[DataFrame, DataFrame]:
    """What stays, and the file paths of the tenant's deleted rows."""
    own = df.where(F.col("user_id") == user_id).select("id", "file_path").join(ids.select("id"), "id", "left_semi")
    return df.join(own.select("id"), "id", "left_anti"), own


def upsert_latest(base: DataFrame, delta: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """delta's rows replace base's rows of the same key; of several in delta the one with the highest order stays.

    order is a column of delta; without one delta must not repeat a key.
    """
    delta = latest(delta, key, order).select(*base.columns) if order else delta
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def latest(delta: DataFrame, key: str, order: str | None) -> DataFrame:
    """Of several rows of a key the one with the highest order; all rows without an order."""
    if not order:
        return delta
    others = [c for c in delta.columns if c != key]
    return delta.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("last")).select(key, *(F.col(f"last.{c}").alias(c) for c in others))


def insert_ignore(cache: DataFrame, new: DataFrame, key: str = "content_hash") -> DataFrame:
    """New rows whose key is not there yet; of several new rows with one key the lowest id."""
    first = new.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where("turn = 1").drop("turn")
    return cache.unionByName(first.join(cache.select(key), key, "left_anti"))


def remember_answers(cache: DataFrame, learned: DataFrame, now: str) -> DataFrame:
    """The cache with newly learned answers (one a hash), without the entries that have expired."""
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))
    return live.unionByName(learned.join(live.select("content_hash"), "content_hash", "left_anti"), allowMissingColumns=True)


def revoke_sessions(df: DataFrame, user_id: int, at: str) -> DataFrame:
    open_ = (F.col("user_id") == user_id) & F.col("revoked_at").isNull()
    return df.withColumn("revoked_at", F.when(open_, F.lit(at).cast("timestamp")).otherwise(F.col("revoked_at")))


def reset_state(accounts: DataFrame, user_id: int, account_id: int | None = None) -> DataFrame:
    mine = F.col("user_id") == user_id
    mine = mine & (F.col("id") == account_id) if account_id is not None else mine & F.col("is_active")
    return accounts.withColumn("last_scan_uid", F.when(mine, F.lit(None).cast("string")).otherwise(F.col("last_scan_uid")))


def close_orphans(logs: DataFrame, at: str, message: str = "interrupted") -> DataFrame:
    """Runs that never finished and carry no error are stamped."""
    orphan = F.col("finished_at").isNull() & F.col("error_message").isNull()
    return logs.withColumns(
        {
            "finished_at": F.when(orphan, F.lit(at).cast("timestamp")).otherwise(F.col("finished_at")),
            "error_message": F.when(orphan, message).otherwise(F.col("error_message"))
        }
    )


def backfill_tenant(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows without a tenant go to user 1, if there is one."""
    first = users.where("id = 1").agg(F.count("*").alias("has"))
    return df.join(F.broadcast(first)).withColumn(
        "user_id", F.when(F.col("user_id").isNull() & (F.col("has") > 0), F.lit(1).cast("long")).otherwise(F.col("user_id"))
    ).drop("has")


def backfill_expiry(cache: DataFrame) -> DataFrame:
    """Entries from before there was an expiry get one: 30 days for the short-lived ones."""
    return cache.withColumn("expires_at", F.coalesce("expires_at", expiry(F.col("prompt_type"), F.col("created_at"), "30 DAYS")))


def seed_setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    """A setting gets its default only where it is empty."""
    return settings.withColumn("value", F.when((F.col("key") == key) & (F.coalesce("value", F.lit("")) == ""), value).otherwise(F.col("value")))
