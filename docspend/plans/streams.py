"""Queries that run Structured Streaming jobs over landed files of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspend.plans.functions import AUDIT, FRESH, LOG, SEEN, STATE, TRUST, _answers, _extracted, _messages, mail_sql
from docspend.plans.registry import AS_OF, query
from docspend.scratch import scratch, written
from docspend.sources.readers import load_tables
from docspend.streaming import ingest as G
from docspend.streaming.intake import committed, intake_stream

c = F.col


class Landed:
    """A stream of df's files: those of each of the given conditions land in turn, and the stream runs between them, a batch each.

    Files are written by the tasks that read df, so none reads it whole.
    """

    def __init__(self, df: DataFrame, *parts: str):
        self.df, self.parts, self.path = df, parts, scratch(df.sparkSession, "landed")

    def each(self, start) -> None:
        """start(stream), a query that ends with what is there, after each part."""
        for part in self.parts:
            self.df.where(part).write.mode("append").parquet(self.path)
            start(self.df.sparkSession.readStream.schema(self.df.schema).parquet(self.path)).awaitTermination()


def run(landed: Landed, make) -> DataFrame:
    """What the stream make(source) appends until its source is read."""
    spark = landed.df.sparkSession
    out, checkpoint, schema = scratch(spark, "out"), scratch(spark, "checkpoint"), []

    def start(source):
        stream = make(source)
        schema[:] = [stream.schema]
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    landed.each(start)
    return spark.read.schema(schema[0]).parquet(out)


BEFORE = "SELECT account_id, folder, MAX(CAST(uid AS BIGINT)) AS top FROM {emails} b WHERE email_id % 2 = 0 GROUP BY 1, 2"


@query(
    "stm_01_ingest_stream",
    f"SELECT uid FROM {{emails}} e LEFT JOIN ({BEFORE}) b USING (account_id, folder) WHERE email_id % 2 = 0 OR top IS NULL OR CAST(uid AS BIGINT) > top"
)
def _(t):
    """Two batches: of the second only what is newer than the first is new."""
    rows = t.emails.select("account_id", "folder", "uid", F.lit("v1").alias("uidvalidity"))
    even = F.expr("CAST(uid AS BIGINT) % 2 = 0")
    return run(Landed(rows.withColumn("even", even), "even", "NOT even"), G.ingest_stream).select("uid")


@query("stm_05_dedup_stream", "SELECT DISTINCT message_id FROM {emails} e WHERE message_id <> ''")
def _(t):
    rows = t.emails.where("message_id <> ''").select("message_id", "received_at")
    return run(Landed(rows, "true"), lambda source: G.dedup_stream(source, "400 days")).select("message_id")


TOPS = "SELECT account_id, folder, MAX(CAST(uid AS BIGINT)) AS top FROM {emails} b WHERE received_at < TIMESTAMP '2024-01-05 00:00:00' GROUP BY 1, 2"


@query(
    "stm_01_resumed_stream",
    f"SELECT uid FROM {{emails}} e LEFT JOIN ({TOPS}) b USING (account_id, folder) WHERE received_at >= TIMESTAMP '2024-01-05 00:00:00' AND (top IS NULL OR CAST(uid AS BIGINT) > top)"
)
def _(t):
    """A batch run over the first days, and a stream over the others that starts from its state."""
    rows = t.emails.select("account_id", "folder", "uid", F.lit("v1").alias("uidvalidity"), "received_at")
    first = F.col("received_at") < F.lit("2024-01-05").cast("timestamp")
    none = t.spark.createDataFrame([], "account_id long, folder string, last_uid string, validity string")
    state = written(G.ingest_increment(rows.where(first), none)[1], "state")
    return run(Landed(rows.where(~first), "true"), lambda source: G.ingest_stream(source, state)).select("uid")


OPTIONS = {"trusted": TRUST, "analyser": _answers, "extractor": _extracted}
START = f"SELECT * FROM ({FRESH}) f0".replace(f"({STATE}) s", f"(SELECT * FROM ({STATE}) s0 WHERE FALSE) s")


def _seen(t):
    return t.emails.where("email_id % 60 IN (0, 26)").select("user_id", c("uid").alias("email_uid"), c("attachment").alias("attachment_filename"))


@query("stm_06_intake_stream", f"{mail_sql(START)} {AUDIT}")
def _(t):
    """All messages as one batch of a stream, from an empty state."""
    documents = t.attachments.select("email_id", "filename", "raw_text", "qr", "source_format")
    out, checkpoint = scratch(t.spark, "intake"), scratch(t.spark, "checkpoint")
    Landed(_messages(t), "true").each(lambda source: intake_stream(source, documents, _seen(t), t.invoices, AS_OF[:10], out, checkpoint, **OPTIONS))
    return committed(t.spark, out, "audit").select(*LOG.split(", "))


EARLY = "email_id % 480 < 240"
ONE = mail_sql(f"SELECT * FROM {{emails}} m0 WHERE {EARLY}")
TWO = mail_sql(
    f"SELECT m.* FROM {{emails}} m LEFT JOIN (SELECT account_id, folder, MAX(CAST(uid AS BIGINT)) AS top FROM {{emails}} b0 WHERE {EARLY} GROUP BY 1, 2) s USING (account_id, folder) WHERE NOT ({EARLY}) AND (top IS NULL OR CAST(uid AS BIGINT) > top)",
    f"{SEEN} UNION ALL SELECT user_id, email_uid, attachment_filename FROM one WHERE attachment_filename IS NOT NULL",
    "(SELECT user_id, invoice_no FROM {invoices} i0 UNION ALL SELECT user_id, invoice_no FROM one WHERE outcome = 'saved')",
)


@query("stm_06_intake_batches", f"WITH one AS ({ONE} {AUDIT}) SELECT * FROM one UNION ALL SELECT * FROM ({TWO} {AUDIT}) two")
def _(t):
    """Two batches, and a restart between them; some of the messages of the first land again with the second."""
    documents = t.attachments.select("email_id", "filename", "raw_text", "qr", "source_format")
    out, checkpoint = scratch(t.spark, "intake"), scratch(t.spark, "checkpoint")
    landed = Landed(_messages(t), EARLY, f"NOT ({EARLY}) OR email_id % 5 = 0")
    landed.each(lambda source: intake_stream(source, documents, _seen(t), t.invoices, AS_OF[:10], out, checkpoint, **OPTIONS))
    return committed(t.spark, out, "audit").select(*LOG.split(", "))


@query(
    "stm_07_run_progress",
    "SELECT scan_log_id, COUNT(*) AS processed, COUNT(*) FILTER (outcome IN ('saved', 'success')) AS found, COUNT(*) FILTER (outcome IN ('error', 'failed', 'parse_failed')) AS errors, MAX(created_at) AS touched FROM {extraction_logs} e GROUP BY 1"
)
def _(t):
    """Counters of each run, kept up to date over three batches of its log."""
    logs = t.extraction_logs.select("id", "scan_log_id", "outcome", "created_at")
    out, checkpoint = scratch(t.spark, "progress"), scratch(t.spark, "checkpoint")
    Landed(logs, *(f"id % 3 = {k}" for k in range(3))).each(lambda source: G.progress_table(source, out, checkpoint))
    return G.progress_at(t.spark, out, G.run_progress(logs)).read(before=1 << 62)


@query(
    "src_01_typed_tables",
    "SELECT 'invoices' AS tab, COUNT(*) AS n, SUM(id) AS ids FROM {invoices} i UNION ALL SELECT 'saved_views', COUNT(*), SUM(id) FROM {saved_views} v UNION ALL SELECT 'scan_logs', COUNT(*), SUM(id) FROM {scan_logs} s"
)
def _(t):
    """Tables written to a folder and loaded with their fixed schemas."""
    path, out = scratch(t.spark, "tables"), None
    for name in ("invoices", "saved_views", "scan_logs"):
        getattr(t, name).write.parquet(f"{path}/{name}")
        one = load_tables(t.spark, path, name)[name].agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(name).alias("tab"), "n", "ids")
        out = one if out is None else out.unionByName(one)
    return out
