"""Incremental ingest: batch form over saved state, and Structured Streaming forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspend.functions.state import is_newer, uid_order
from docspend.shipping import ship
from docspend.streaming.keyed import KeyedTable


def ingest_increment(messages: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New messages, and the next state.

    messages: account_id, folder, uid, uidvalidity; state: account_id, folder, last_uid, validity.
    A folder whose validity changed is read again from its start.  The state moves past every
    message seen, and folders without messages keep theirs.
    """
    keys = ["account_id", "folder"]
    both = messages.join(state, keys, "left")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    reset = given("uidvalidity") & given("validity") & (F.col("uidvalidity") != F.col("validity"))
    both = both.withColumn("floor", F.when(reset, F.lit(None).cast("string")).otherwise(F.col("last_uid")))
    fresh = both.where(is_newer(F.col("uid"), F.col("floor")))
    top = fresh.groupBy(*keys).agg(F.max_by("uid", uid_order(F.col("uid"))).alias("top"), F.max("uidvalidity").alias("now"))
    seen = state.join(top, keys, "full").select(*keys, F.coalesce("top", "last_uid").alias("last_uid"), F.coalesce("now", "validity").alias("validity"))
    return fresh.select(*messages.columns), seen


def skip_unchanged(status: DataFrame, state: DataFrame) -> DataFrame:
    """Folders to read: those whose next uid, message count or validity differs from the saved ones."""
    same = (F.col("uidnext") == F.col("s_uidnext")) & (F.col("messages") == F.col("s_messages")) & (
        (F.coalesce("s_validity", F.lit("")) == "") | (F.col("uidvalidity") == F.col("s_validity"))
    )
    return status.join(state, ["account_id", "folder"], "left").withColumn("skip", F.coalesce(same, F.lit(False)))


SEEN = "last string, validity string"


def _folder_state():
    """The processor of ingest_stream: one value a folder, its high-water uid and validity."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class FolderState(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getValueState("seen", SEEN)

        def handleInitialState(self, key, initial, timers) -> None:
            for last, validity in zip(initial["last_uid"], initial["validity"]):
                self.seen.update((last or "", validity or ""))

        def handleInputRows(self, key, rows, timers):
            rows = pd.concat(list(rows), ignore_index=True)
            last, validity = self.seen.get() if self.seen.exists() else ("", "")
            digits = lambda u: u.isascii() and u.isdigit()
            order = lambda u: (0, int(u), u) if digits(u) else (1, 0, u)
            now = max((v for v in rows["uidvalidity"].fillna("")), default="")
            if now and validity and now != validity:
                last = ""
            newer = lambda u: bool(u) and (not last or (int(u) > int(last) if digits(u) and digits(last) else u > last))
            kept = rows[[newer(u or "") for u in rows["uid"]]]
            self.seen.update((max((u for u in kept["uid"]), key=order, default=last), now or validity))
            yield kept

        def close(self) -> None:
            pass

    return FolderState()


def ingest_stream(messages: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The streaming form of ingest_increment: each message newer than all of its folder before, with state kept by Spark.

    messages: account_id, folder, uid, uidvalidity, any order within a batch.  A changed validity
    starts a folder anew; messages of one batch are compared with the state before it.  state
    (account_id, folder, last_uid, validity), the outcome of a batch run, is what the first batch
    starts from; a restarted stream goes on from its checkpoint.  The session's state store must
    be RocksDB's, which this sets.
    """
    spark = messages.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keys = ["account_id", "folder"]
    started = None if state is None else state.select(*keys, "last_uid", "validity").groupBy(*keys)
    return messages.groupBy(*keys).transformWithStateInPandas(_folder_state(), messages.schema, "append", "None", initialState=started)


def stream_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """account_id, folder, last_uid, validity: where a stream of ingest_stream stands, as a batch run takes it."""
    rows = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
    return rows.select("key.account_id", "key.folder", F.col("value.last").alias("last_uid"), "value.validity")


def apply_change_feed(pages: DataFrame, state: DataFrame | None = None, most_pages: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, last token of each folder, and events of a change feed.

    pages: account_id, folder, page, token, removed, message_id, uid and, where the server refused a
    token, expired; state: account_id, folder, delta_link, legacy (the time that an old state ended).
    Removed items are never deletions; a message in several folders comes once.  A folder with a
    token reads on from it, and a refused one is an event delta_resync; a folder with only an old
    time is bridged, and one that needs more pages than most_pages is an event
    delta_bridge_overflow.  Folders with an event give nothing else: they are read anew.
    """
    keys = ["account_id", "folder"]
    if "expired" not in pages.columns:
        pages = pages.withColumn("expired", F.lit(False))
    folders = pages.groupBy(*keys).agg(F.max_by("token", "page").alias("token"), F.max("page").alias("pages"), F.max("expired").alias("expired"))
    if state is not None:
        folders = folders.join(state.select(*keys, "delta_link", "legacy"), keys, "left")
    else:
        folders = folders.withColumns({"delta_link": F.lit(None).cast("string"), "legacy": F.lit(None).cast("string")})
    given = lambda n: F.coalesce(F.col(n), F.lit("")) != ""
    mode = F.when(given("delta_link"), "incremental").when(given("legacy"), "bridge").otherwise("initial")
    event = F.when((mode == "incremental") & F.col("expired"), "delta_resync").when((mode == "bridge") & (F.col("pages") > most_pages), "delta_bridge_overflow")
    folders = folders.select(*keys, "token", event.alias("outcome"))
    live = pages.where("NOT removed").join(folders.where("outcome IS NULL").select(*keys), keys, "left_semi")
    first = live.groupBy("account_id", "message_id").agg(F.min(F.struct("folder", "page", "uid")).alias("m"))
    messages = first.select("account_id", "message_id", "m.folder", "m.uid")
    return messages, folders.where("outcome IS NULL").drop("outcome"), folders.where("outcome IS NOT NULL").select(*keys, "outcome")


def dedup_stream(df: DataFrame, horizon: str = "7 days", key: str = "message_id", time: str = "received_at") -> DataFrame:
    """First sight of each message id within a time horizon."""
    return df.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def progress_stream(df: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Processed, found and failed by run window."""
    kind = lambda k: F.sum(F.when(F.col("event_type") == k, 1).otherwise(0))
    rows = df.withWatermark("ts", late) if df.isStreaming else df
    return rows.groupBy(F.window("ts", window)).agg(
        F.count("*").alias("processed"), kind("purchase").alias("found"), kind("error").alias("errors")
    ).select(F.col("window.start").alias("start"), "processed", "found", "errors")


FOUND, FAILED = ("saved", "success"), ("error", "failed", "parse_failed")


def run_progress(logs: DataFrame, run: str = "scan_log_id") -> DataFrame:
    """Counters of each run: rows processed, invoices found, errors, and when the run last did something; for a table or a stream of audit rows."""
    among = lambda kinds: F.sum(F.when(F.col("outcome").isin(*kinds), 1).otherwise(0))
    return logs.groupBy(run).agg(F.count("*").alias("processed"), among(FOUND).alias("found"), among(FAILED).alias("errors"), F.max("created_at").alias("touched"))


def progress_table(logs: DataFrame, out: str, checkpoint: str, run: str = "scan_log_id"):
    """Start a stream that keeps run_progress of a stream of audit rows up to date below out: each batch writes the runs it changes."""
    counters = run_progress(logs, run)
    table = progress_at(logs.sparkSession, out, counters, run)

    def batch(changed: DataFrame, number: int) -> None:
        table.write(number, changed)

    return counters.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_at(spark: SparkSession, out: str, counters: DataFrame, run: str = "scan_log_id") -> KeyedTable:
    return KeyedTable(spark, out, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counters.schema), [run], latest=True)


def run_stream(source: DataFrame, decide: Callable[[DataFrame, Callable[[str], DataFrame | None]], dict[str, DataFrame]], out: str, checkpoint: str):
    """Each micro-batch through decide(batch, earlier) -> tables by name, appended under the batch's number.

    earlier(name) gives the rows of a table that batches before this one wrote, None without any,
    so that decide can leave out what is there already.  Writing the same batch again overwrites its
    own folder and does not see itself, so a restart repeats nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession

        def earlier(name: str) -> DataFrame | None:
            path = f"{out}/{name}"
            return spark.read.parquet(path).where(F.col("batch") < number) if _exists(spark, path) else None

        for name, rows in decide(df, earlier).items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def newest(uid: str = "uid") -> Column:
    return F.max_by(uid, uid_order(F.col(uid)))
