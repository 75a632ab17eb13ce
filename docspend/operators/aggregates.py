"""Spend statistics and audit analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspend.functions.state import parse_state, uid_order
from docspend.schemas import CATEGORIES, OUTCOME_PRIORITY

MONEY = "decimal(24,2)"


def currency(category: Column | str = "invoice_category") -> Column:
    """USD for overseas invoices, else CNY: the currency is derived, not stored."""
    return F.when(F.col(category) == "overseas_invoice", "USD").otherwise("CNY")


def money(column: str = "amount") -> Column:
    """Exact sum, 0 for no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast(MONEY)


def month(column: str = "invoice_date") -> Column:
    return F.date_format(column, "yyyy-MM")


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), money().alias("total"))


def month_totals(df: DataFrame, as_of: str) -> DataFrame:
    """Count and amount of the month of as_of, half open."""
    start = F.trunc(F.lit(as_of).cast("date"), "month")
    inside = (F.col("invoice_date") >= start) & (F.col("invoice_date") < F.add_months(start, 1))
    return totals(df.where(inside))


def monthly_spend(df: DataFrame) -> DataFrame:
    return df.groupBy(month().alias("month")).agg(money().alias("total"), F.count("*").alias("n"))


def top_sellers(df: DataFrame, k: int = 10) -> DataFrame:
    by = df.groupBy("seller").agg(money().alias("total"), F.count("*").alias("n"))
    return by.orderBy(F.desc("total"), F.desc("n"), "seller").limit(k)


def count_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def category_breakdown(df: DataFrame) -> DataFrame:
    """All five categories in fixed order, 0 where there is none; unknown categories are dropped."""
    spark = df.sparkSession
    fixed = spark.createDataFrame(list(enumerate(CATEGORIES)), "pos int, category string")
    found = df.where(F.col("invoice_category").isin(*CATEGORIES)).groupBy(F.col("invoice_category").alias("category")).agg(F.count("*").alias("n"))
    return F.broadcast(fixed).join(found, "category", "left").select("pos", "category", F.coalesce("n", F.lit(0)).alias("n"))


def by_currency(df: DataFrame) -> DataFrame:
    return df.groupBy(currency().alias("currency")).agg(money().alias("total"), F.count("*").alias("n"))


def monthly_by_currency(df: DataFrame) -> DataFrame:
    return df.groupBy(month().alias("month"), currency().alias("currency")).agg(money().alias("total"), F.count("*").alias("n"))


def monthly_pivot(df: DataFrame) -> DataFrame:
    wide = df.groupBy(month().alias("month")).pivot("currency", ["CNY", "USD"]) if "currency" in df.columns else df.withColumn("currency", currency()).groupBy(month().alias("month")).pivot("currency", ["CNY", "USD"])
    out = wide.agg(F.sum("amount"))
    return out.select("month", *(F.coalesce(c, F.lit(0)).cast(MONEY).alias(c.lower()) for c in ("CNY", "USD")))


def avg_confidence(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"))


def monthly_lists(df: DataFrame) -> DataFrame:
    """currency, monthly_spend: the months of each currency in order."""
    rows = monthly_by_currency(df).groupBy("currency")
    return rows.agg(F.sort_array(F.collect_list(F.struct("month", "total", F.col("n").alias("count")))).alias("monthly_spend"))


def scan_headline(accounts: DataFrame, logs: DataFrame) -> DataFrame:
    """active_accounts, last_scan_at, last_scan_found of each tenant that has accounts."""
    active = accounts.groupBy("user_id").agg(F.count(F.when(F.col("is_active"), 1)).alias("active_accounts"))
    last = logs.groupBy("user_id").agg(F.max_by(F.struct("started_at", "invoices_found"), F.struct("started_at", "id")).alias("last"))
    return active.join(last, "user_id", "full").select(
        "user_id", F.coalesce("active_accounts", F.lit(0)).alias("active_accounts"), F.col("last.started_at").alias("last_scan_at"),
        F.col("last.invoices_found").alias("last_scan_found")
    )


def spend_stats(invoices: DataFrame, logs: DataFrame, accounts: DataFrame, as_of: str, user_id: int | None = None, k: int = 10) -> DataFrame:
    """The whole statistics document, a row a tenant, from one scan and one shuffle of the invoices.

    Every invoice counts once for each breakdown, which folds in its task to a row for each
    (tenant, breakdown, key).  Sellers are ranked before they are gathered, so that a tenant's
    document holds k of them however many there are.
    """
    if user_id is not None:
        invoices, logs, accounts = (x.where(F.col("user_id") == user_id) for x in (invoices, logs, accounts))
    c = F.col
    start = F.trunc(F.lit(as_of).cast("date"), "month")
    this = (c("invoice_date") >= start) & (c("invoice_date") < F.add_months(start, 1))
    none = F.lit(None).cast("string")
    of = {
        "all": none, "month": month(), "seller": c("seller"), "type": c("invoice_type"), "category": c("invoice_category"),
        "method": c("extraction_method"), "currency": currency(), "both": currency()
    }
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), key.alias("key"), (month() if kind == "both" else none).alias("sub")) for kind, key in of.items()))
    rows = invoices.select("user_id", "amount", "confidence", this.alias("this"), F.inline(kinds))
    sums = rows.groupBy("user_id", "kind", "key", "sub").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("total"),
        F.count(F.when(c("this"), 1)).alias("n_this"), F.coalesce(F.sum(F.when(c("this"), c("amount"))), F.lit(0)).cast(MONEY).alias("total_this"), F.avg("confidence").alias("confidence"),
    )
    rank = F.row_number().over(Window.partitionBy("user_id", "kind").orderBy(F.desc("total"), F.desc("n"), "key", "sub"))
    sums = sums.withColumn("rank", rank).where((c("kind") != "seller") | (c("rank") <= k))
    one = lambda kind, value: F.max(F.when(c("kind") == kind, value))

    def listed(kind: str, key: str, order: list[Column], money: bool = True) -> Column:
        """The sorted list of a breakdown."""
        fields = [c("key").alias(key), *([c("total").alias("total")] if money else []), c("n").alias("count")]
        rows = F.collect_list(
            F.when(c("kind") == kind, F.struct(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("o"), F.struct(*fields).alias("v")))
        )
        return F.transform(F.array_sort(rows), lambda x: x["v"])

    by_month = F.array_sort(
        F.collect_list(F.when(c("kind") == "both", F.struct(c("key").alias("currency"), c("sub").alias("month"), "total", c("n").alias("count"))))
    )
    doc = sums.groupBy("user_id").agg(
        one("all", c("n")).alias("total_invoices"), one("all", c("total")).alias("total_amount"), one("all", c("n_this")).alias("invoices_this_month"), one("all", c("total_this")).alias("amount_this_month"),
        listed("month", "month", [c("key")]).alias("monthly_spend"), listed("seller", "seller", [c("rank")]).alias("top_sellers"), F.reverse(listed("type", "type", [c("key")], False)).alias("by_type"),
        listed("category", "category", [-c("n"), c("key")], False).alias("by_category"), listed("method", "method", [-c("n"), c("key")], False).alias("by_method"),
        listed("currency", "currency", [-c("total"), c("key")]).alias("by_currency"), by_month.alias("both"), F.round(F.coalesce(one("all", c("confidence")), F.lit(0.0)), 6).alias("avg_confidence"),
    )
    currencies = F.array_distinct(F.transform("both", lambda x: x["currency"]))
    months = lambda cur: F.transform(
        F.filter("both", lambda x: x["currency"] == cur),
        lambda x: F.struct(x["month"].alias("month"), x["total"].alias("total"), x["count"].alias("count"))
    )
    nested = F.transform(currencies, lambda cur: F.struct(cur.alias("currency"), months(cur).alias("monthly_spend")))
    doc = doc.withColumn("monthly_spend_by_currency", nested).drop("both").join(scan_headline(accounts, logs), "user_id", "left")
    return doc.select(
        "user_id", "total_invoices", "total_amount", "invoices_this_month", "amount_this_month", F.coalesce("active_accounts", F.lit(0)).alias("active_accounts"), "last_scan_at", "last_scan_found",
        "monthly_spend", "top_sellers", "by_type", "by_category", "by_method", "by_currency", "monthly_spend_by_currency", "avg_confidence",
    )


def priority(outcome: str = "outcome") -> Column:
    """Rank of an outcome; unknown ones are 0."""
    out = F.lit(0)
    for value in sorted(set(OUTCOME_PRIORITY.values())):
        out = F.when(F.col(outcome).isin([k for k, v in OUTCOME_PRIORITY.items() if v == value]), value).otherwise(out)
    return out


def email_key() -> Column:
    """A message's uid, or a key of the row's own where it is empty."""
    return F.when(F.coalesce("email_uid", F.lit("")) == "", F.concat(F.lit("row-"), F.col("id"))).otherwise(F.col("email_uid"))


def rollup_by_email(logs: DataFrame) -> DataFrame:
    """One row for each message of a scan: best outcome (the first wins ties), first number, highest tier.

    email_uid and email_subject are those of its first row.
    """
    named = F.nullif(F.col("invoice_no"), F.lit(""))
    return logs.groupBy("scan_log_id", email_key().alias("key")).agg(
        *(F.min_by(n, F.struct("id")).alias(n) for n in ("email_uid", "email_subject")),
        F.max_by("outcome", F.struct(priority(), -F.col("id"))).alias("best_outcome"),
        F.min_by(named, F.when(named.isNotNull(), F.col("id"))).alias("invoice_no"),
        F.max("classification_tier").alias("tier"),
        F.count("*").alias("n"),
    )


#: What a nested extraction keeps of its row of the log.
EXTRACTION = ("id", "attachment_filename", "outcome", "classification_tier", "parse_method", "invoice_no", "confidence", "error_detail")


def with_extractions(logs: DataFrame, most: int = 200) -> DataFrame:
    """The rows of rollup_by_email with extractions, the message's first `most` rows of the log in their order; n counts all.

    Rows beyond `most` are ranked but not gathered, so a message with a great many stays bounded.
    """
    keys = ["scan_log_id", "key"]
    ranked = logs.select("scan_log_id", email_key().alias("key"), F.struct(*EXTRACTION).alias("e"))
    ranked = ranked.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy("e.id"))).where(F.col("turn") <= most)
    nested = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("extractions"))
    return rollup_by_email(logs).join(nested, keys)


def email_breakdown(rollup: DataFrame) -> DataFrame:
    best = F.col("best_outcome")
    kinds = {"saved": ("saved", "success"), "duplicates": ("duplicate",), "skipped": ("skipped_seen",), "errors": ("error", "failed", "parse_failed")}
    counts = {k: F.sum(F.when(best.isin(*v), 1).otherwise(0)).alias(k) for k, v in kinds.items()}
    known = [x for v in kinds.values() for x in v]
    other = F.sum(F.when(best.isin(*known), 0).otherwise(1)).alias("not_invoice")
    return rollup.groupBy("scan_log_id").agg(*counts.values(), other, F.count("*").alias("total"))


def scan_summary(logs: DataFrame) -> DataFrame:
    """Counts by outcome, by method and by tier of each scan, in long form."""
    kinds = F.array(
        F.struct(F.lit("outcome").alias("kind"), F.col("outcome").alias("k")),
        F.struct(F.lit("method").alias("kind"), F.nullif(F.col("parse_method"), F.lit("")).alias("k")),
        F.struct(F.lit("tier").alias("kind"), F.concat(F.lit("tier"), F.col("classification_tier")).alias("k")),
    )
    long = logs.select("scan_log_id", F.inline(kinds)).where("k IS NOT NULL")
    return long.groupBy("scan_log_id", "kind", "k").agg(F.count("*").alias("n"))


def run_rollup(results: DataFrame) -> DataFrame:
    """account_id, messages, found, errors, newest_uid of a run's results (account_id, uid, invoices_added, error)."""
    newest = F.max_by("uid", uid_order(F.col("uid"))).alias("newest_uid")
    return results.groupBy("account_id").agg(
        F.count("*").alias("messages"), F.coalesce(F.sum("invoices_added"), F.lit(0)).alias("found"),
        F.count(F.when(F.coalesce("error", F.lit("")) != "", 1)).alias("errors"), newest
    )


def admin_count(users: DataFrame) -> DataFrame:
    """admins, may_remove: active administrators, and whether one of them can go."""
    n = F.count(F.when(F.col("is_admin") & F.col("is_active"), 1))
    return users.agg(n.alias("admins"), (n > 1).alias("may_remove"))


def colliding_numbers(invoices: DataFrame) -> DataFrame:
    """Numbers that more than one invoice has."""
    return invoices.groupBy("invoice_no").agg(F.count("*").alias("n")).where("n > 1")


def time_state_summary(accounts: DataFrame) -> DataFrame:
    """id, folders, latest: of accounts whose state maps folders to times, how many there are and the newest time that is one.

    A state that is no map has no folders.
    """
    known = F.from_json("last_scan_uid", "map<string, string>")
    state = F.when(F.col("last_scan_uid").rlike(r"^\s*\{"), known)
    times = F.transform(F.map_values("state"), lambda v: F.coalesce(v.try_cast("timestamp"), F.try_to_timestamp(v, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))))
    return accounts.select("id", state.alias("state")).select("id", F.coalesce(F.size("state"), F.lit(0)).alias("folders"), F.array_max(times).alias("latest"))


def state_summary(accounts: DataFrame) -> DataFrame:
    """id, folders, messages, top_uid of each account's saved state."""
    states = accounts.withColumn("state", parse_state(F.col("last_scan_uid")))
    total = F.aggregate(F.map_values("state"), F.lit(0).cast("long"), lambda n, s: n + F.coalesce(s["messages"].try_cast("long"), F.lit(0)))
    ordered = F.array_sort(F.transform(F.map_values("state"), lambda s: F.struct(uid_order(s["uid"]).alias("o"), s["uid"].alias("uid"))))
    top = F.when(F.size("state") > 0, F.element_at(ordered, -1)["uid"])
    return states.select(
        "id", F.coalesce(F.size("state"), F.lit(0)).alias("folders"), F.coalesce(total, F.lit(0).cast("long")).alias("messages"), top.alias("top_uid")
    )
