"""Exports, manifests, outbox and audit rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspend.functions.text import iso

# The columns of the export, in their order.
CSV_COLUMNS = (
    "invoice_no", "buyer", "seller", "amount", "invoice_date", "invoice_category", "invoice_type", "item_summary", "extraction_method", "confidence",
    "created_at"
)


def csv_rows(df: DataFrame) -> DataFrame:
    """The columns of the export: no nulls in the summary, ISO dates and times."""
    special = {
        "invoice_date": F.date_format("invoice_date", "yyyy-MM-dd"), "item_summary": F.coalesce("item_summary", F.lit("")),
        "created_at": iso("created_at")
    }
    return df.select(*(special.get(c, F.col(c)).alias(c) for c in CSV_COLUMNS))


def export_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV files with a header that carries the UTF-8 mark, so that spreadsheets read them as UTF-8."""
    rows = csv_rows(df)
    rows = rows.withColumnRenamed(CSV_COLUMNS[0], "﻿" + CSV_COLUMNS[0])
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def bundle_summary(invoices: DataFrame, ids: DataFrame, user_id: int) -> DataFrame:
    """The rows of the CSV summary that goes with a bundle: the tenant's rows among ids."""
    return csv_rows(invoices.where(F.col("user_id") == user_id).join(ids.select("id").distinct(), "id", "left_semi"))


def bundle_manifest(invoices: DataFrame, ids: DataFrame, user_id: int, listing: DataFrame) -> DataFrame:
    """The tenant's rows among ids, each with whether its file is in the listing."""
    own = invoices.where(F.col("user_id") == user_id).join(ids, "id", "left_semi")
    files = listing.select(F.col("path").alias("file_path"), F.lit(True).alias("found")).distinct()
    return own.join(files, "file_path", "left").withColumn("present", F.coalesce("found", F.lit(False))).drop("found")


def hmac_sha256(secret: str, message: Column) -> Column:
    """HMAC-SHA256 as hex: two nested digests over pads made once from the secret."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def invoice_events(df: DataFrame, secret: str) -> DataFrame:
    """id, body, signature: compact JSON in fixed key order and its signature."""
    parts = {
        "event": F.lit("invoice.created"), "invoice_no": F.col("invoice_no"), "buyer": F.col("buyer"), "seller": F.col("seller"),
        "amount": F.col("amount").cast("string")
    }
    parts |= {
        "invoice_date": F.date_format("invoice_date", "yyyy-MM-dd"), "invoice_type": F.col("invoice_type"),
        "confidence": F.col("confidence").cast("double")
    }
    body = F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())), {"ignoreNullFields": "false"})
    return df.select("id", body.alias("body")).withColumn("signature", F.concat(F.lit("sha256="), hmac_sha256(secret, F.col("body"))))


def audit_rows(df: DataFrame) -> DataFrame:
    return df.withColumns({"email_subject": F.substring("email_subject", 1, 500), "error_detail": F.substring("error_detail", 1, 2000)})


def write_audit(df: DataFrame, path: str) -> None:
    audit_rows(df).write.mode("append").parquet(path)


def delivery_log(results: DataFrame) -> DataFrame:
    ok = F.col("status_code").between(200, 299)
    return results.withColumns({"success": ok, "error_detail": F.when(~ok, F.substring("error", 1, 2000))})
