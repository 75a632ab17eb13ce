"""The intake of messages as a stream: every micro-batch is a whole intake that goes on from those before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspend.operators.intake import mail_intake
from docspend.streaming.keyed import KeyedTable

CACHE = "content_hash string, prompt_type string, response_json string, created_at timestamp, expires_at timestamp"
FOLDERS = "account_id bigint, folder string, last_uid string, validity string"


def tables(spark: SparkSession, out: str) -> dict[str, KeyedTable]:
    """What the batches of an intake below out know of each other: folders' high-water marks, seen attachments, stored numbers and file names, answers."""
    return {
        "folders": KeyedTable(spark, f"{out}/known/folders", FOLDERS, ["account_id", "folder"], latest=True),
        "seen": KeyedTable(spark, f"{out}/known/seen", "user_id bigint, email_uid string, attachment_filename string", ["user_id", "email_uid"]),
        "numbers": KeyedTable(spark, f"{out}/known/numbers", "user_id bigint, invoice_no string, file_path string", ["user_id"]),
        "answers": KeyedTable(spark, f"{out}/known/answers", CACHE, ["content_hash"], latest=True),
    }


def intake_stream(
    source: DataFrame, documents: DataFrame, logs: DataFrame, invoices: DataFrame, as_of: str, out: str, checkpoint: str, state: DataFrame | None = None,
    cache: DataFrame | None = None, **options
):
    """Start a stream of messages to the tables invoices and audit below out; options are those of mail_intake.

    state, logs, invoices and cache are what was known before the stream.  What its own batches save,
    record, learn and where they stand is kept by key (see `tables`), and a batch reads of it the
    keys it meets.  A batch is done when its number is below out/commits, written last: one that
    fails on its way is run again from the same start and overwrites what it left.
    """
    spark = source.sparkSession
    known = tables(spark, out)

    def batch(messages: DataFrame, number: int) -> None:
        keys = messages.select("account_id", "folder").distinct()
        own = known["folders"].read(number, keys)
        before = own if state is None else own.unionByName(state.select(*own.columns).join(own, ["account_id", "folder"], "left_anti"))
        met = messages.select("user_id", F.col("uid").alias("email_uid")).distinct()
        seen = logs.select("user_id", "email_uid", "attachment_filename").unionByName(known["seen"].read(number, met))
        path = F.col("file_path") if "file_path" in invoices.columns else F.lit(None).cast("string").alias("file_path")
        stored = invoices.select("user_id", "invoice_no", path).unionByName(known["numbers"].read(number, met))

        def answers(hashes: DataFrame) -> DataFrame:
            found = known["answers"].read(number, hashes)
            return found if cache is None else found.unionByName(cache.select(*found.columns).join(hashes, "content_hash", "left_semi"))

        done = mail_intake(messages, documents, before, seen, stored, as_of, cache=answers, **options)
        audit = done.audit.withColumn("recorded_at", F.lit(as_of).cast("timestamp"))
        invoices_path, audit_path = f"{out}/invoices/batch={number}", f"{out}/audit/batch={number}"
        done.invoices.write.mode("overwrite").parquet(invoices_path)
        audit.write.mode("overwrite").parquet(audit_path)
        saved = spark.read.schema(done.invoices.schema).parquet(invoices_path)
        recorded = spark.read.schema(audit.schema).parquet(audit_path)
        known["folders"].write(number, done.state.join(keys, ["account_id", "folder"], "left_semi"))
        known["seen"].write(number, recorded.where("email_uid <> '' AND attachment_filename IS NOT NULL"))
        known["numbers"].write(number, saved)
        if done.cache is not None:
            known["answers"].write(number, done.cache)
        spark.range(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(f"{out}/commits/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of invoices or audit below out that whole batches wrote."""
    rows, done = spark.read.parquet(f"{out}/{name}"), spark.read.parquet(f"{out}/commits").select("batch")
    return rows.join(F.broadcast(done), "batch", "left_semi")
