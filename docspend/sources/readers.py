"""Typed tables, landed documents and message records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspend.functions.text import html_to_text, urls
from docspend.operators.windows import is_document
from docspend.schemas import MESSAGE, TABLES

MAX_BYTES = 25 * 1024 * 1024


def load_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The engine's tables below path (all, or those named), each with its fixed schema."""
    return {name: spark.read.schema(TABLES[name]).parquet(f"{path}/{name}") for name in names or TABLES}


def magic_format(content: Column) -> Column:
    """pdf, xml or ofd by the first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(
        head.startswith("3C3F786D6C") | head.startswith("EFBBBF3C3F786D6C"), "xml"
    ).when(head.startswith("504B0304"), "ofd")


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, length, format, reason: landed files, with why a file is not taken.  Spark lists no empty files.

    The content of files over the limit is not read: the filter on length reaches the source.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = magic_format(F.col("content"))
    read = files.where(F.col("length") <= MAX_BYTES).select("path", "length", kind.alias("format"), F.when(kind.isNull(), "unknown format").alias("reason"))
    large = files.where(F.col("length") > MAX_BYTES).select("path", "length", F.lit(None).cast("string").alias("format"), F.lit("too large").alias("reason"))
    return read.unionByName(large)


def messages(df: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """df as rows of the one message table (MESSAGE), which the intake takes whatever source they come from.

    Columns that df lacks are null, lists and maps empty.  email_id, where df has none, names the
    account, the folder and the message's uid in it; user_id, where df has none, is the owner of the
    account in accounts (id, user_id).
    """
    have = set(df.columns)
    uid = F.coalesce(F.col("uid").cast("string"), F.lit(""))
    blank = {"attachments": F.array().cast("array<string>"), "links": F.array().cast("array<string>"), "headers": F.create_map().cast("map<string,string>")}
    place = [F.coalesce(F.col(n).cast("string"), F.lit("")) if n in have else F.lit("") for n in ("account_id", "folder")]
    named = F.col("email_id").cast("string") if "email_id" in have else F.concat_ws("/", *place, uid)
    if accounts is not None and "user_id" not in have:
        df = df.join(accounts.select(F.col("id").alias("account_id"), "user_id"), "account_id", "left")
        have = set(df.columns)

    def column(name: str, kind: str):
        if name == "email_id":
            return named
        if name in blank:
            return F.coalesce(F.col(name), blank[name]) if name in have else blank[name]
        return (F.col(name) if name in have else F.lit(None)).cast(kind)

    return df.select(*(column(name, kind).alias(name) for name, kind in MESSAGE.items()))


def load_emails(raw: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Messages (see `messages`) from landed records (uid, subject, from_addr, body_text, body_html, attachments and any
    other column of a message): only documents stay attached, and an empty text falls back to the HTML."""
    text = F.when(F.trim(F.coalesce("body_text", F.lit(""))) != "", F.col("body_text")).otherwise(html_to_text(F.coalesce("body_html", F.lit(""))))
    kept = F.filter("attachments", is_document)
    links = urls(F.concat_ws(" ", "body_text", "body_html"))
    return messages(raw.withColumns({"links": links, "body_text": text, "attachments": kept}), accounts)


GRAPH = "internetMessageId string, id string, subject string, bodyPreview string, receivedDateTime string, hasAttachments boolean, `from` struct<emailAddress: struct<address: string>>"


def emails_from_graph_json(df: DataFrame, column: str = "value", accounts: DataFrame | None = None) -> DataFrame:
    """Messages (see `messages`) from listed items of a mail API, with what their rows hold beside: account_id, folder and
    folder_id where there are any.  Texts are previews; headers say what a later reading of the whole message needs."""
    item = F.from_json(column, GRAPH)
    rest = [c for c in df.columns if c != column]
    rows = df.select(*rest, item.alias("m"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    uid = F.coalesce(F.nullif("m.internetMessageId", F.lit("")), F.col("m.id"), F.lit(""))
    headers = F.create_map(
        F.lit("_graph_id"), blank(F.col("m.id")), F.lit("_graph_folder_id"), blank(F.col("folder_id")) if "folder_id" in rest else F.lit(""), F.lit("_has_attachments"),
        F.when(F.coalesce("m.hasAttachments", F.lit(False)), "True").otherwise("False")
    )
    rows = rows.select(
        *rest, uid.alias("uid"), uid.alias("message_id"), blank(F.col("m.subject")).alias("subject"), blank(F.col("m.from.emailAddress.address")).alias("from_addr"),
        blank(F.col("m.bodyPreview")).alias("body_text"), F.lit("").alias("body_html"), headers.alias("headers"),
        F.coalesce(F.try_to_timestamp("m.receivedDateTime", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp("m.receivedDateTime", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))).alias("received_at"),
    )
    return messages(rows, accounts)


def emails_from_portal(
    pages: DataFrame, provider: str = "Portal", site: str = "portal.example", sender: str = "invoices@portal.example", seen_at: str | None = None, accounts: DataFrame | None = None
) -> DataFrame:
    """Invoice pages of a portal (portal_id, url, money, date, bill_to, account_id) as messages (see `messages`) with one link and one document.

    seen_at: when the pages were read, the messages' time (now if None).
    """
    c = F.col
    blank = lambda n: F.coalesce(c(n).cast("string"), F.lit(""))
    paid = F.concat(blank("money"), F.lit(" USD"))
    lines = [
        F.concat(F.lit(f"{provider} subscription invoice "), c("portal_id")), F.lit(f"Provider: {provider} ({site})"), F.concat(F.lit("Bill-to: "), F.coalesce("bill_to", F.lit("Unknown"))),
        F.concat(F.lit("Amount: "), paid), F.concat(F.lit("Date: "), blank("date")), F.concat(F.lit("URL: "), c("url")),
    ]
    headers = {
        "_scraper": F.lit("portal"), "_invoice_id": c("portal_id"), "_invoice_url": c("url"), "_currency": F.lit("USD"), "_amount_pretty": paid,
        "_account_id": blank("account_id")
    }
    pairs = [x for k, v in headers.items() for x in (F.lit(k), v)]
    rows = pages.select(
        "account_id", (F.current_timestamp() if seen_at is None else F.lit(seen_at).cast("timestamp")).alias("received_at"), F.concat(F.lit("portal:"), c("portal_id")).alias("uid"), F.trim(F.concat(F.lit(f"{provider} Invoice "), c("portal_id"), F.lit(" — "), paid, F.lit(" "), blank("date"))).alias("subject"),
        F.concat_ws("\n", *lines).alias("body_text"), F.lit("").alias("body_html"), F.lit(sender).alias("from_addr"), F.array(F.concat(F.lit("portal-invoice-"), c("portal_id"), F.lit(".pdf"))).alias("attachments"),
        F.array("url").alias("links"), F.create_map(*pairs).alias("headers"), F.lit(f"{provider} Invoices").alias("folder"), F.concat(F.lit("portal-"), c("portal_id")).alias("message_id"),
    )
    return messages(rows, accounts)
