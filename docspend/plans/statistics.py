"""Queries: aggregations (AGG) and the statistics document."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspend.operators import aggregates as A
from docspend.plans.registry import AS_OF, query

CUR = "CASE WHEN invoice_category = 'overseas_invoice' THEN 'USD' ELSE 'CNY' END"
M = "CAST(COALESCE(SUM(amount), 0) AS DECIMAL(24,2))"


@query("agg_01_totals", f"SELECT COUNT(*) AS n, {M} AS total FROM {{invoices}} i")
def _(t):
    return A.totals(t.invoices)


@query(
    "agg_02_month_totals",
    f"SELECT COUNT(*) AS n, {M} AS total FROM {{invoices}} i WHERE invoice_date >= DATE '2001-07-01' AND invoice_date < DATE '2001-08-01'"
)
def _(t):
    return A.month_totals(t.invoices, AS_OF)


@query("agg_03_monthly_spend", f"SELECT strftime(invoice_date, '%Y-%m') AS month, {M} AS total, COUNT(*) AS n FROM {{invoices}} i GROUP BY 1")
def _(t):
    return A.monthly_spend(t.invoices).orderBy("month")


@query("agg_04_top_sellers", f"SELECT seller, {M} AS total, COUNT(*) AS n FROM {{invoices}} i GROUP BY seller ORDER BY total DESC, n DESC, seller LIMIT 10")
def _(t):
    return A.top_sellers(t.invoices)


@query("agg_05_by_type", "SELECT invoice_type, COUNT(*) AS n FROM {invoices} i GROUP BY 1")
def _(t):
    return A.count_by(t.invoices, "invoice_type").orderBy(F.desc("invoice_type"))


@query("agg_06_by_category", "SELECT invoice_category, COUNT(*) AS n FROM {invoices} i GROUP BY 1")
def _(t):
    return A.count_by(t.invoices, "invoice_category").orderBy(F.desc("n"), "invoice_category")


@query(
    "agg_07_category_breakdown",
    """SELECT pos, category, COUNT(i.id) AS n FROM (VALUES (0, 'vat_invoice'), (1, 'receipt'), (2, 'proforma'), (3, 'overseas_invoice'), (4, 'other')) d(pos, category)
       LEFT JOIN {invoices} i ON i.invoice_category = d.category GROUP BY pos, category""",
)
def _(t):
    return A.category_breakdown(t.invoices)


@query("agg_08_by_method", "SELECT extraction_method, COUNT(*) AS n FROM {invoices} i GROUP BY 1")
def _(t):
    return A.count_by(t.invoices, "extraction_method").orderBy(F.desc("n"), "extraction_method")


@query("agg_09_by_currency", f"SELECT {CUR} AS currency, {M} AS total, COUNT(*) AS n FROM {{invoices}} i GROUP BY 1")
def _(t):
    return A.by_currency(t.invoices).orderBy(F.desc("total"))


@query(
    "agg_10_monthly_by_currency",
    f"SELECT strftime(invoice_date, '%Y-%m') AS month, {CUR} AS currency, {M} AS total, COUNT(*) AS n FROM {{invoices}} i GROUP BY 1, 2"
)
def _(t):
    return A.monthly_by_currency(t.invoices)


@query(
    "agg_11_monthly_pivot",
    f"""SELECT strftime(invoice_date, '%Y-%m') AS month, CAST(COALESCE(SUM(CASE WHEN {CUR} = 'CNY' THEN amount END), 0) AS DECIMAL(24,2)) AS cny,
        CAST(COALESCE(SUM(CASE WHEN {CUR} = 'USD' THEN amount END), 0) AS DECIMAL(24,2)) AS usd FROM {{invoices}} i GROUP BY 1""",
)
def _(t):
    return A.monthly_pivot(t.invoices)


@query("agg_12_avg_confidence", "SELECT ROUND(COALESCE(AVG(confidence), 0), 6) AS avg_confidence FROM {invoices} i")
def _(t):
    return A.avg_confidence(t.invoices)


DOC = f"""WITH i AS (SELECT *, strftime(invoice_date, '%Y-%m') AS month, {CUR} AS currency, invoice_date >= DATE '2001-07-01' AND invoice_date < DATE '2001-08-01' AS this FROM {{invoices}} x),
    head AS (SELECT user_id, COUNT(*) AS total_invoices, {M} AS total_amount, COUNT(*) FILTER (this) AS invoices_this_month, CAST(COALESCE(SUM(amount) FILTER (this), 0) AS DECIMAL(24,2)) AS amount_this_month, ROUND(COALESCE(AVG(confidence), 0), 6) AS avg_confidence FROM i GROUP BY 1),
    a AS (SELECT user_id, COUNT(*) FILTER (is_active) AS active_accounts FROM {{email_accounts}} y GROUP BY 1),
    l AS (SELECT user_id, started_at AS last_scan_at, invoices_found AS last_scan_found FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) AS rn FROM {{scan_logs}} z) WHERE rn = 1)"""


def _items(by: str, order: str, *shown: str, limit: str = "") -> str:
    """user_id and the listed items of a breakdown as one text, in order."""
    item = " || '/' || ".join(f"COALESCE(CAST({x} AS VARCHAR), '~')" for x in shown)
    return f"SELECT user_id, string_agg({item}, ';' ORDER BY rn) AS items FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rn FROM (SELECT user_id, {by}, {M} AS total, COUNT(*) AS n FROM i GROUP BY ALL) g) r {limit} GROUP BY 1"


PARTS = {
    "monthly_spend": _items("month", "month", "month", "total", "n"), "top_sellers": _items("seller", "total DESC, n DESC, seller", "seller", "total", "n", limit="WHERE rn <= 10"),
    "by_type": _items("invoice_type", "invoice_type DESC", "invoice_type", "n"), "by_category": _items("invoice_category", "n DESC, invoice_category NULLS FIRST", "invoice_category", "n"),
    "by_method": _items("extraction_method", "n DESC, extraction_method", "extraction_method", "n"), "by_currency": _items("currency", "total DESC, currency", "currency", "total", "n"),
    "monthly_spend_by_currency": _items("currency, month", "currency, month", "currency", "month", "total", "n"),
}
JOINED = " ".join(f"LEFT JOIN ({sql}) {name} ON {name}.user_id = head.user_id" for name, sql in PARTS.items())


@query(
    "agg_13_spend_stats",
    f"""{DOC} SELECT head.*, COALESCE(active_accounts, 0) AS active_accounts, last_scan_at, last_scan_found, {", ".join(f"{name}.items AS {name}" for name in PARTS)}
    FROM head LEFT JOIN a ON a.user_id = head.user_id LEFT JOIN l ON l.user_id = head.user_id {JOINED}""",
)
def _(t):
    """The document, its lists written as text so that every entry is compared."""
    doc = A.spend_stats(t.invoices, t.scan_logs, t.email_accounts, AS_OF)
    text = lambda x: F.coalesce(x.cast("string"), F.lit("~"))
    shown = {
        "monthly_spend": ("month", "total", "count"), "top_sellers": ("seller", "total", "count"), "by_type": ("type", "count"),
        "by_category": ("category", "count"), "by_method": ("method", "count"), "by_currency": ("currency", "total", "count")
    }
    line = lambda fields: lambda x: F.concat_ws("/", *(text(x[n]) for n in fields))
    lists = {name: F.array_join(F.transform(name, line(fields)), ";") for name, fields in shown.items()}
    nested = F.flatten(
        F.transform(
            "monthly_spend_by_currency",
            lambda x: F.transform(x["monthly_spend"], lambda y: F.concat_ws("/", x["currency"], y["month"], text(y["total"]), text(y["count"])))
        )
    )
    return doc.withColumns(lists | {"monthly_spend_by_currency": F.array_join(nested, ";")})


@query(
    "agg_10_monthly_lists",
    f"SELECT currency, string_agg(month || '/' || total || '/' || n, ';' ORDER BY month) AS months FROM (SELECT strftime(invoice_date, '%Y-%m') AS month, {CUR} AS currency, {M} AS total, COUNT(*) AS n FROM {{invoices}} i GROUP BY 1, 2) x GROUP BY 1"
)
def _(t):
    rows = A.monthly_lists(t.invoices)
    return rows.select(
        "currency",
        F.array_join(
            F.transform("monthly_spend", lambda x: F.concat_ws("/", x["month"], x["total"].cast("string"), x["count"].cast("string"))), ";"
        ).alias("months")
    )


@query(
    "agg_14_scan_headline",
    """SELECT COALESCE(a.user_id, l.user_id) AS user_id, COALESCE(a.active_accounts, 0) AS active_accounts, l.last_scan_at, l.last_scan_found FROM (SELECT user_id, COUNT(*) FILTER (is_active) AS active_accounts FROM {email_accounts} x GROUP BY 1) a
    FULL JOIN (SELECT user_id, MAX(started_at) AS last_scan_at, arg_max(invoices_found, (started_at, id)) AS last_scan_found FROM {scan_logs} y GROUP BY 1) l ON l.user_id = a.user_id""",
)
def _(t):
    return A.scan_headline(t.email_accounts, t.scan_logs)


@query(
    "agg_15_scan_summary",
    """SELECT scan_log_id, kind, k, COUNT(*) AS n FROM (SELECT scan_log_id, 'outcome' AS kind, outcome AS k FROM {extraction_logs} a UNION ALL SELECT scan_log_id, 'method', NULLIF(parse_method, '') FROM {extraction_logs} b
       UNION ALL SELECT scan_log_id, 'tier', 'tier' || classification_tier FROM {extraction_logs} c) x WHERE k IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(t):
    return A.scan_summary(t.extraction_logs)


RANK = "CASE WHEN outcome IN ('saved', 'success') THEN 100 WHEN outcome = 'duplicate' THEN 80 WHEN outcome = 'skipped_seen' THEN 70 WHEN outcome = 'low_confidence' THEN 60 WHEN outcome IN ('not_vat_invoice', 'scam_detected') THEN 55 WHEN outcome = 'parse_failed' THEN 40 WHEN outcome IN ('error', 'failed') THEN 30 WHEN outcome = 'not_invoice' THEN 10 ELSE 0 END"
ROLLUP = f"""SELECT scan_log_id, CASE WHEN COALESCE(email_uid, '') = '' THEN 'row-' || id ELSE email_uid END AS key, arg_max(outcome, ({RANK}, -id)) AS best_outcome,
    arg_min(NULLIF(invoice_no, ''), id) FILTER (NULLIF(invoice_no, '') IS NOT NULL) AS invoice_no, MAX(classification_tier) AS tier, COUNT(*) AS n FROM {{extraction_logs}} e GROUP BY 1, 2"""


@query("agg_16_rollup_by_email", ROLLUP)
def _(t):
    return A.rollup_by_email(t.extraction_logs).drop("email_uid", "email_subject")


@query(
    "agg_16_extractions",
    """SELECT scan_log_id, key, arg_min(u, id) AS email_uid, arg_min(email_subject, id) AS email_subject, COUNT(*) AS n, string_agg(id || ':' || outcome || ':' || COALESCE(attachment_filename, ''), ',' ORDER BY id) FILTER (turn <= 2) AS extractions
    FROM (SELECT *, COALESCE(email_uid, chr(0)) AS u, row_number() OVER (PARTITION BY scan_log_id, key ORDER BY id) AS turn FROM (SELECT *, CASE WHEN COALESCE(email_uid, '') = '' THEN 'row-' || id ELSE email_uid END AS key FROM {extraction_logs} e) e1) e2 GROUP BY 1, 2""",
)
def _(t):
    """The first two rows of each message; a null uid is written as the sign 0."""
    rows = A.with_extractions(t.extraction_logs, most=2)
    text = F.transform("extractions", lambda x: F.concat(x["id"], F.lit(":"), x["outcome"], F.lit(":"), F.coalesce(x["attachment_filename"], F.lit(""))))
    return rows.select("scan_log_id", "key", F.coalesce("email_uid", F.lit("\0")).alias("email_uid"), "email_subject", "n", F.array_join(text, ",").alias("extractions"))


@query(
    "agg_17_email_breakdown",
    f"""SELECT scan_log_id, COUNT(*) FILTER (best_outcome IN ('saved', 'success')) AS saved, COUNT(*) FILTER (best_outcome = 'duplicate') AS duplicates, COUNT(*) FILTER (best_outcome = 'skipped_seen') AS skipped,
    COUNT(*) FILTER (best_outcome IN ('error', 'failed', 'parse_failed')) AS errors, COUNT(*) FILTER (best_outcome NOT IN ('saved', 'success', 'duplicate', 'skipped_seen', 'error', 'failed', 'parse_failed')) AS not_invoice, COUNT(*) AS total FROM ({ROLLUP}) r GROUP BY 1""",
)
def _(t):
    return A.email_breakdown(A.rollup_by_email(t.extraction_logs))


@query(
    "agg_18_run_rollup",
    """SELECT account_id, COUNT(*) AS messages, COUNT(attachment) AS found, COUNT(*) FILTER (email_id % 9 = 0) AS errors, CAST(MAX(CAST(uid AS BIGINT)) AS VARCHAR) AS newest_uid FROM {emails} e GROUP BY 1""",
)
def _(t):
    results = t.emails.select(
        "account_id", "uid", F.when(F.col("attachment").isNotNull(), 1).otherwise(0).alias("invoices_added"),
        F.when(F.col("email_id") % 9 == 0, "failed").alias("error")
    )
    return A.run_rollup(results)


@query("agg_19_health", "SELECT (SELECT COUNT(*) FROM {invoices} i) AS invoices, (SELECT MAX(finished_at) FROM {scan_logs} s) AS last_finished")
def _(t):
    one = lambda df, c: df.agg(c).withColumn("k", F.lit(1))
    return one(t.invoices, F.count("*").alias("invoices")).join(one(t.scan_logs, F.max("finished_at").alias("last_finished")), "k").drop("k")


@query(
    "agg_20_admin_count",
    "SELECT COUNT(*) FILTER (is_admin AND is_active) AS admins, COUNT(*) FILTER (is_admin AND is_active) > 1 AS may_remove FROM {users} u"
)
def _(t):
    return A.admin_count(t.users)


@query("agg_21_colliding_numbers", "SELECT invoice_no, COUNT(*) AS n FROM {invoices} i GROUP BY 1 HAVING COUNT(*) > 1")
def _(t):
    return A.colliding_numbers(t.invoices)


@query(
    "agg_22_state_summary",
    """SELECT id, CASE WHEN COALESCE(last_scan_uid, '') = '' THEN 0 ELSE 1 END AS folders, CASE WHEN last_scan_uid LIKE '{"INBOX%' THEN TRY_CAST(json_extract_string(last_scan_uid, '$.INBOX.messages') AS BIGINT) ELSE 0 END AS messages,
       CASE WHEN last_scan_uid LIKE '{"INBOX%' THEN json_extract_string(last_scan_uid, '$.INBOX.uid') WHEN last_scan_uid <> '' THEN last_scan_uid END AS top_uid FROM {email_accounts} a""",
)
def _(t):
    return A.state_summary(t.email_accounts)


TIMES = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'bare' WHEN 2 THEN '{"A": "2024-01-0' || (p_size % 9 + 1) || 'T10:00:00+00:00", "B": "2024-01-05T09:00:00+00:00"}' ELSE '{"A": "never"}' END AS last_scan_uid FROM part"""


@query(
    "agg_22_time_state",
    f"SELECT id, CASE id % 4 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS folders, CASE WHEN id % 4 = 2 THEN greatest(CAST(substring(json_extract_string(last_scan_uid, '$.A'), 1, 19) AS TIMESTAMP), TIMESTAMP '2024-01-05 09:00:00') END AS latest FROM ({TIMES}) x",
)
def _(t):
    k = F.col("p_partkey")
    two = F.concat(F.lit('{"A": "2024-01-0'), F.col("p_size") % 9 + 1, F.lit('T10:00:00+00:00", "B": "2024-01-05T09:00:00+00:00"}'))
    raw = F.when(k % 4 == 0, "").when(k % 4 == 1, "bare").when(k % 4 == 2, two).otherwise('{"A": "never"}')
    return A.time_state_summary(t.part.select(k.alias("id"), raw.alias("last_scan_uid")))
