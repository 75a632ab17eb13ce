"""Filters, projections, sorts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspend.functions.text import iso
from docspend.operators.aggregates import currency
from docspend.schemas import BLOCKED_HOSTS, BLOCKED_PATHS, CONTENT_TYPES, IMAGE_SUFFIXES, SKIP_FLAGS, UNKNOWN
from docspend.scratch import written


def scoped(df: DataFrame, user_id: int) -> DataFrame:
    """The tenant's rows; a foreign id gives an empty result like a missing one."""
    return df.where(F.col("user_id") == user_id)


def date_between(df: DataFrame, lo: str | None = None, hi: str | None = None, column: str = "invoice_date") -> DataFrame:
    """Both ends inclusive, either optional."""
    if lo:
        df = df.where(F.col(column) >= F.lit(lo).cast("date"))
    if hi:
        df = df.where(F.col(column) <= F.lit(hi).cast("date"))
    return df


def in_categories(df: DataFrame, categories: list[str] | None) -> DataFrame:
    return df.where(F.col("invoice_category").isin(*categories)) if categories else df


def by_ids(df: DataFrame, ids: list[int], user_id: int) -> DataFrame:
    """The tenant's rows in the order of the list; a repeated id repeats its row."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id long, pos int")
    return scoped(df, user_id).join(F.broadcast(wanted), "id").orderBy("pos")


def evaluate_views(views: DataFrame, invoices: DataFrame, index=None) -> DataFrame:
    """Matches of every saved view, all at once: within its dates, and with all words of its q where it has one.

    Views that ask for the same are evaluated once.  Views without words: invoices are folded to a
    count for each (tenant, day) first, so the range join meets days, not invoices.  Views with
    words: only postings of words that some view asks for are shuffled, once, by invoice; an invoice
    meets those word sets of its tenant whose rarest word it holds, and what it matches is folded to
    days too.  index: a stored TextIndex of the invoices that keeps user_id and invoice_date; without
    one the words are made anew.
    """
    from docspend.search.text import build_index, tokens

    c = F.col
    spec = F.from_json("filter_json", "q string, date_from string, date_to string")
    parsed = views.select("id", "user_id", spec.alias("f"))
    parsed = parsed.select(
        "id", "user_id", F.sort_array(F.array_distinct(tokens(c("f.q")))).alias("words"), F.try_to_date("f.date_from").alias("lo"),
        F.try_to_date("f.date_to").alias("hi")
    )
    parsed = written(parsed.withColumn("spec", F.to_json(F.struct("user_id", "words", "lo", "hi"))), "views")
    kinds = parsed.drop("id").distinct()
    between = (c("lo").isNull() | (c("invoice_date") >= c("lo"))) & (c("hi").isNull() | (c("invoice_date") <= c("hi")))
    days = invoices.groupBy(c("user_id").alias("owner"), "invoice_date").agg(F.count("*").alias("n"))
    plain = kinds.where(F.size("words") == 0).join(days, (c("user_id") == c("owner")) & between).groupBy("spec").agg(F.sum("n").alias("n"))
    sets = kinds.where(F.size("words") > 0).select("user_id", "words").distinct()
    asked = sets.select("user_id", "words", F.explode("words").alias("term"))
    if index is None:
        hits = build_index(invoices, keep=("user_id", "invoice_date")).join(asked.select("term").distinct(), "term", "left_semi")
        hits = hits.select("term", c("id").alias("invoice"), "user_id", "invoice_date").distinct()
    else:
        hits = index.postings(asked.select("term")).where("first").select("term", c("id").alias("invoice"), "user_id", "invoice_date")
    held = hits.groupBy("term").agg(F.count("*").alias("df"))
    asked = asked.join(held, "term", "left").groupBy("user_id", "words").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("rarest"))
    asked = written(asked, "asked")
    found = hits.groupBy("invoice", "user_id", "invoice_date").agg(F.collect_set("term").alias("held"))
    found = found.select("user_id", "invoice_date", "held", F.explode("held").alias("rarest")).join(asked, ["user_id", "rarest"])
    found = found.where(F.size(F.array_except("words", "held")) == 0).groupBy("user_id", "words", "invoice_date").agg(F.count("*").alias("n"))
    worded = kinds.join(found, ["user_id", "words"]).where(between).groupBy("spec").agg(F.sum("n").alias("n"))
    return parsed.select("id", "spec").join(plain.unionByName(worded), "spec", "left").select("id", F.coalesce("n", F.lit(0)).alias("matches"))


def active_accounts(df: DataFrame, account_id: int | None = None) -> DataFrame:
    df = df.where("is_active")
    return df if account_id is None else df.where(F.col("id") == account_id)


def apply_ingest_options(df: DataFrame, since: str | None = None, unread_only: bool = False) -> DataFrame:
    if unread_only:
        df = df.where("NOT is_read")
    return df.where(F.col("received_at") >= F.lit(since).cast("timestamp")) if since else df


def scannable_folders(df: DataFrame) -> DataFrame:
    """Folders that hold messages of their own."""
    skip = F.lower("flag").isin(*SKIP_FLAGS) | F.col("well_known").isin("drafts", "deleteditems", "outbox") | F.col("is_search") | (F.col("items") == 0)
    return df.where(~F.coalesce(skip, F.lit(False)))


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def is_blocked_url(url: Column) -> Column:
    """Links that hardly lead to a document: trackers by host or path, images by suffix."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rest = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1))
    query = F.lower(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    path = F.concat(rest, F.lit("?"), query)
    return _any([F.contains(host, F.lit(h)) for h in BLOCKED_HOSTS]) | _any([F.contains(path, F.lit(p)) for p in BLOCKED_PATHS]) | _any(
        [F.endswith(F.lower(url), F.lit(s)) for s in IMAGE_SUFFIXES]
    )


def is_acceptable_type(content_type: Column) -> Column:
    """A missing type is acceptable; parameters do not count."""
    plain = F.trim(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1))
    return (plain == "") | plain.isin(*CONTENT_TYPES)


def invoice_view(df: DataFrame) -> DataFrame:
    """The response of an invoice: derived currency, ISO dates and times."""
    before = [
        "id", "invoice_no", "buyer", "seller", F.col("amount").cast("double").alias("amount"),
        F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"), "invoice_type", "invoice_category"
    ]
    after = ["item_summary", "source_format", "extraction_method", "confidence", "is_manually_corrected"]
    return df.select(*before, currency().alias("currency"), *after, iso("created_at").alias("created_at"))


#: Columns that invoice rows take over as they are, where the documents have them.
CARRIED = ("cand_id", "upload_id", "email_id", "file_path", "email_uid", "source_format", "extraction_method", "confidence")


def to_invoice_rows(df: DataFrame, as_of: str) -> DataFrame:
    """Rows to store, with defaults for fields that could not be read."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNKNOWN)).alias(c)
    more = [c for c in CARRIED if c in df.columns]
    more += [F.col("category").alias("invoice_category")] if "category" in df.columns else []
    more += [F.col("account_id").alias("email_account_id")] if "account_id" in df.columns else []
    return df.select(
        "user_id", "invoice_no", known("buyer"), known("seller"), known("invoice_type"), F.coalesce("amount", F.lit(0)).cast("decimal(12,2)").alias("amount"),
        F.coalesce("invoice_date", F.lit(as_of).cast("date")).alias("invoice_date"), F.coalesce("item_summary", F.lit("")).alias("item_summary"), F.substring("raw_text", 1, 10000).alias("raw_text"), *more,
    )


def log_view(df: DataFrame) -> DataFrame:
    """The response of a scan log; its times are UTC and say so."""
    times = {c: iso(c, "+00:00").alias(c) for c in ("started_at", "finished_at")}
    return df.select("id", "email_account_id", times["started_at"], times["finished_at"], "emails_scanned", "invoices_found", "error_message")


def extraction_view(df: DataFrame) -> DataFrame:
    """The response of an extraction log."""
    names = [
        "id", "scan_log_id", "email_uid", "email_subject", "attachment_filename", "outcome", "classification_tier", "parse_method", "parse_format",
        "download_outcome", "invoice_no", "confidence", "error_detail"
    ]
    return df.select(*names, iso("created_at").alias("created_at"))


def account_view(df: DataFrame) -> DataFrame:
    """No secrets, only whether there are any."""
    secrets = {
        "has_secondary_credential": "secondary_credential_encrypted", "has_secondary_password": "secondary_password_encrypted",
        "has_totp_secret": "totp_secret_encrypted", "has_playwright_storage_state": "playwright_storage_state"
    }
    has = [(F.coalesce(c, F.lit("")) != "").alias(name) for name, c in secrets.items()]
    return df.select(
        "id", "name", "type", "host", "port", "username", "outlook_account_type", "is_active", "last_scan_uid", iso("created_at").alias("created_at"),
        *has
    )


def progress(account_index: Column, accounts: Column, done: Column, total: Column) -> dict[str, Column]:
    """Percentages of a run with one decimal, 0 where there is nothing to do; the overall one is 100 at most."""
    share = lambda x, of: F.when(of != 0, x / of).otherwise(0.0)
    percent = lambda x: F.round(x * 100, 1)
    overall = F.greatest(account_index - 1, F.lit(0)) / accounts + (F.lit(1.0) / accounts) * (done / F.greatest(total, F.lit(1)))
    overall = F.when(accounts != 0, F.least(overall, F.lit(1.0))).otherwise(0.0)
    return {"account_pct": percent(share(account_index, accounts)), "email_pct": percent(share(done, total)), "overall_pct": percent(overall)}


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """A page of the rows, each with the total number of them; page counts from 1."""
    rows = df.orderBy(*order).offset(max(page - 1, 0) * size).limit(size)
    return rows.withColumn("total", df.agg(F.count("*")).scalar())


def page_invoices(df: DataFrame, page: int, size: int) -> DataFrame:
    """Newest first."""
    return page_of(df, [F.desc("invoice_date"), F.desc("id")], page, size)


def page_logs(df: DataFrame, page: int, size: int) -> DataFrame:
    return page_of(df, [F.desc("started_at"), F.desc("id")], page, size)


def list_sorted(df: DataFrame, *keys: str) -> DataFrame:
    """Highest keys first."""
    return df.orderBy(*(F.desc(k) for k in keys))


def order_messages(df: DataFrame) -> DataFrame:
    return df.orderBy("received_at", "email_id")
