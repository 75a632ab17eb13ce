"""Queries: filters (FLT), projections (PRJ), joins (JON), windows (WIN), sorts (SRT), sets (SET)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspend.operators import dml as D
from docspend.operators import filters as L
from docspend.operators import joins as J
from docspend.operators import windows as W
from docspend.plans import expected as X
from docspend.plans.registry import AS_OF, query, stored_index

LISTED = [7, 3, 51, 7, *range(100, 500), 3, 108, 999999]


@query("flt_01_scoped", "SELECT id, invoice_no FROM {invoices} i WHERE user_id = 7")
def _(t):
    return L.scoped(t.invoices, 7).select("id", "invoice_no")


@query("flt_02_date_between", "SELECT id, invoice_date FROM {invoices} i WHERE invoice_date >= DATE '1996-03-01' AND invoice_date <= DATE '1996-06-30'")
def _(t):
    return L.date_between(t.invoices, "1996-03-01", "1996-06-30").select("id", "invoice_date")


@query("flt_03_in_categories", "SELECT id, invoice_category FROM {invoices} i WHERE invoice_category IN ('receipt', 'proforma')")
def _(t):
    return L.in_categories(t.invoices, ["receipt", "proforma"]).select("id", "invoice_category")


@query(
    "flt_04_by_ids",
    f"SELECT pos, i.id, invoice_no FROM (SELECT unnest({LISTED}) AS id, generate_subscripts({LISTED}, 1) - 1 AS pos) v JOIN {{invoices}} i ON i.id = v.id WHERE user_id = 4"
)
def _(t):
    return L.by_ids(t.invoices, LISTED, 4).select("pos", "id", "invoice_no")


@query(
    "flt_05_evaluate_views",
    """SELECT v.id, COUNT(i.id) AS matches FROM (SELECT id, user_id, json_extract_string(filter_json, '$.q') AS q, TRY_CAST(json_extract_string(filter_json, '$.date_from') AS DATE) AS lo, TRY_CAST(json_extract_string(filter_json, '$.date_to') AS DATE) AS hi FROM {saved_views} s) v
       LEFT JOIN {invoices} i ON i.user_id = v.user_id AND (lo IS NULL OR invoice_date >= lo) AND (hi IS NULL OR invoice_date <= hi)
         AND list_has_all(list_transform(regexp_split_to_array(concat_ws(' ', invoice_no, buyer, seller, invoice_type, invoice_category, item_summary, raw_text), '[^\\p{L}\\p{N}]+'), lambda x: lower(x)), list_filter(regexp_split_to_array(lower(COALESCE(q, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))
       GROUP BY v.id""".replace("\\\\", "\\"),
)
def _(t):
    return L.evaluate_views(t.saved_views, t.invoices, stored_index(t))


@query("flt_06_active_accounts", "SELECT id, name FROM {email_accounts} a WHERE is_active")
def _(t):
    return L.active_accounts(t.email_accounts).select("id", "name")


@query("flt_07_ingest_options", "SELECT email_id, received_at FROM {emails} e WHERE received_at >= TIMESTAMP '2024-01-05 06:00:00'")
def _(t):
    return L.apply_ingest_options(t.emails, since="2024-01-05 06:00:00").select("email_id", "received_at")


@query(
    "flt_08_scannable_folders",
    r"SELECT id, folder FROM {folders} f WHERE NOT (LOWER(flag) IN ('\noselect', '\drafts', '\trash', '\all') OR well_known IN ('drafts', 'deleteditems', 'outbox') OR is_search OR items = 0)"
)
def _(t):
    return L.scannable_folders(t.folders).select("id", "folder")


HOSTS = " OR ".join(f"contains(lower(regexp_extract(link, '^[a-z]+://([^/?#]*)', 1)), '{h}')" for h in X.BLOCKED_HOSTS)
PATHS = " OR ".join(f"contains(lower(regexp_extract(link, '^[a-z]+://[^/?#]*(.*)$', 1)) || '?', '{p}')" for p in X.BLOCKED_PATHS)
ENDS = " OR ".join(f"ends_with(lower(link), '{s}')" for s in X.IMAGES)


@query("flt_09_blocked_urls", f"SELECT email_id, link, ({HOSTS} OR {PATHS} OR {ENDS}) AS blocked FROM {{emails}} e WHERE link IS NOT NULL")
def _(t):
    return t.emails.where("link IS NOT NULL").select("email_id", "link", L.is_blocked_url(F.col("link")).alias("blocked"))


TYPES = ("application/pdf", "Application/PDF; charset=x", "text/html", None, " application/zip ;a", "image/png", "text/xml", "")


@query(
    "flt_10_acceptable_type",
    """SELECT p_partkey AS id, ct, COALESCE(trim(split_part(lower(ct), ';', 1)), '') IN ('', 'application/pdf', 'application/octet-stream', 'application/xml', 'text/xml', 'application/zip', 'application/x-zip-compressed', 'application/ofd') AS ok
    FROM (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'Application/PDF; charset=x' WHEN 2 THEN 'text/html' WHEN 4 THEN ' application/zip ;a' WHEN 5 THEN 'image/png' WHEN 6 THEN 'text/xml' WHEN 7 THEN '' END AS ct FROM part) x""",
)
def _(t):
    ct = F.get(F.array(*map(F.lit, TYPES)), F.pmod("p_partkey", F.lit(8)).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), ct.alias("ct")).withColumn("ok", L.is_acceptable_type(F.col("ct")))


@query(
    "prj_01_invoice_view",
    """SELECT id, invoice_no, buyer, seller, CAST(amount AS DOUBLE) AS amount, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, invoice_type, invoice_category, CASE WHEN invoice_category = 'overseas_invoice' THEN 'USD' ELSE 'CNY' END AS currency,
    item_summary, source_format, extraction_method, confidence, is_manually_corrected, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM {invoices} i""",
)
def _(t):
    return L.invoice_view(t.invoices)


@query(
    "prj_02_save_defaults",
    """SELECT cand_id, user_id, invoice_no, COALESCE(NULLIF(buyer, ''), '未知') AS buyer, COALESCE(NULLIF(seller, ''), '未知') AS seller, COALESCE(NULLIF(invoice_type, ''), '未知') AS invoice_type,
    CAST(COALESCE(amount, 0) AS DECIMAL(12,2)) AS amount, COALESCE(invoice_date, DATE '2001-07-15') AS invoice_date, COALESCE(item_summary, '') AS item_summary, substring(raw_text, 1, 10000) AS raw_text FROM {candidates} c""",
)
def _(t):
    named = ["cand_id", "user_id", "invoice_no", "buyer", "seller", "invoice_type", "amount", "invoice_date", "item_summary", "raw_text"]
    return L.to_invoice_rows(t.candidates.select(*named), AS_OF[:10])


STAMP = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({c}) % 1000000 = 0 THEN '' ELSE strftime({c}, '.%f') END"


@query(
    "prj_03_log_view",
    f"SELECT id, email_account_id, {STAMP('started_at')} || '+00:00' AS started_at, {STAMP('finished_at')} || '+00:00' AS finished_at, emails_scanned, invoices_found, error_message FROM {{scan_logs}} s"
)
def _(t):
    return L.log_view(t.scan_logs)


@query(
    "prj_03_extraction_view",
    f"SELECT id, scan_log_id, email_uid, email_subject, attachment_filename, outcome, classification_tier, parse_method, parse_format, download_outcome, invoice_no, confidence, error_detail, {STAMP('created_at')} AS created_at FROM {{extraction_logs}} l",
)
def _(t):
    return L.extraction_view(t.extraction_logs)


@query(
    "prj_04_account_view",
    """SELECT id, name, type, host, port, username, outlook_account_type, is_active, last_scan_uid, '2024-01-01T00:00:00' AS created_at, COALESCE(secondary_credential_encrypted, '') <> '' AS has_secondary_credential,
    COALESCE(secondary_password_encrypted, '') <> '' AS has_secondary_password, COALESCE(totp_secret_encrypted, '') <> '' AS has_totp_secret, COALESCE(playwright_storage_state, '') <> '' AS has_playwright_storage_state FROM {email_accounts} a""",
)
def _(t):
    return L.account_view(t.email_accounts)


@query(
    "prj_05_progress",
    """SELECT id, CASE WHEN n = 0 THEN 0.0 ELSE ROUND(id % 8 / CAST(n AS DOUBLE) * 100, 1) END AS account_pct, CASE WHEN total = 0 THEN 0.0 ELSE ROUND(done / CAST(total AS DOUBLE) * 100, 1) END AS email_pct,
    CASE WHEN n = 0 THEN 0.0 ELSE ROUND(LEAST(GREATEST(id % 8 - 1, 0) / CAST(n AS DOUBLE) + 1.0 / n * (done / CAST(GREATEST(total, 1) AS DOUBLE)), 1.0) * 100, 1) END AS overall_pct
    FROM (SELECT id, id % 5 * 2 AS n, emails_scanned % 4 AS total, emails_scanned % 7 AS done FROM {scan_logs} s) x""",
)
def _(t):
    p = L.progress(F.col("id") % 8, F.col("id") % 5 * 2, F.col("emails_scanned") % 7, F.col("emails_scanned") % 4)
    return t.scan_logs.select("id", *(c.alias(k) for k, c in p.items()))


@query("jon_01_user_invoice_counts", "SELECT u.id, COUNT(i.id) AS n FROM {users} u LEFT JOIN {invoices} i ON i.user_id = u.id GROUP BY u.id")
def _(t):
    return J.invoice_counts(t.users, t.invoices)


@query(
    "jon_02_mark_existing",
    "SELECT cand_id, MIN(i.id) AS existing_id FROM {candidates} c LEFT JOIN {invoices} i ON i.user_id = c.user_id AND i.invoice_no = c.invoice_no AND c.invoice_no <> '' GROUP BY cand_id"
)
def _(t):
    return J.mark_existing(t.candidates, t.invoices).groupBy("cand_id").agg(F.min("existing_id").alias("existing_id"))


SEEN = "SELECT 1 FROM {extraction_logs} l WHERE l.email_uid = c.email_uid AND l.attachment_filename = c.filename AND l.email_uid <> ''"


@query("jon_03_drop_seen", f"SELECT cand_id FROM {{candidates}} c WHERE NOT EXISTS ({SEEN})")
def _(t):
    return J.drop_seen(t.candidates, t.extraction_logs).select("cand_id")


@query("jon_03_drop_seen_by_tenant", f"SELECT cand_id FROM {{candidates}} c WHERE NOT EXISTS ({SEEN} AND l.user_id = c.user_id)")
def _(t):
    return J.drop_seen(t.candidates, t.extraction_logs, "user_id").select("cand_id")


@query("jon_04_hydrate", "SELECT id, invoice_no FROM {invoices} i WHERE user_id = 9 AND id IN (SELECT event_id FROM events WHERE event_type = 'click')")
def _(t):
    return J.hydrate(t.invoices, t.events.where("event_type = 'click'").select(F.col("event_id").alias("id")), 9).select("id", "invoice_no")


@query(
    "jon_05_hydrate_ranked",
    "SELECT row_number() OVER (ORDER BY e.value, e.event_id) AS place, i.id FROM events e JOIN {invoices} i ON i.id = e.event_id WHERE i.user_id = 9 AND i.invoice_date >= DATE '1997-01-01' ORDER BY 1 LIMIT 40"
)
def _(t):
    hits = t.events.select(F.col("event_id").alias("id"), "value")
    return J.hydrate_ranked(L.date_between(L.scoped(t.invoices, 9), "1997-01-01"), hits, [F.col("value"), F.col("id")], 40).select("place", "id")


ASKED = "(SELECT 'h' || (l_partkey * 2) AS k, COUNT(*) AS n FROM lineitem GROUP BY 1)"
LIVE = "c.expires_at IS NULL OR c.expires_at > TIMESTAMP '2024-01-20 00:00:00'"


def _split(t):
    wanted = t.lineitem.groupBy(F.concat(F.lit("h"), F.col("l_partkey") * 2).alias("content_hash")).agg(F.count("*").alias("n"))
    return J.split_cache(wanted, t.llm_cache, "2024-01-20 00:00:00")


@query("jon_06_split_cache", f"SELECT r.k AS content_hash, r.n, c.response_json FROM {ASKED} r JOIN {{llm_cache}} c ON c.content_hash = r.k AND ({LIVE})")
def _(t):
    return _split(t)[0]


@query(
    "jon_06_cache_misses",
    f"SELECT r.k AS content_hash, r.n FROM {ASKED} r WHERE NOT EXISTS (SELECT 1 FROM {{llm_cache}} c WHERE c.content_hash = r.k AND ({LIVE}))"
)
def _(t):
    return _split(t)[1]


@query(
    "jon_07_active_sessions",
    "SELECT s.id, u.email FROM {sessions} s JOIN {users} u ON u.id = s.user_id WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '2024-01-15 00:00:00' AND s.created_at <= TIMESTAMP '2024-01-15 00:00:00' AND is_active"
)
def _(t):
    return J.active_sessions(t.sessions, t.users, "2024-01-15 00:00:00")


@query(
    "jon_08_drilldown",
    "SELECT l.id, l.outcome, l.created_at FROM {extraction_logs} l WHERE scan_log_id IN (SELECT id FROM {scan_logs} s WHERE user_id = (SELECT MIN(user_id) FROM {scan_logs} z))"
)
def _(t):
    least = t.scan_logs.agg(F.min("user_id").alias("user_id"))
    return J.drilldown(t.extraction_logs, t.scan_logs.join(F.broadcast(least), "user_id")).select("id", "outcome", "created_at")


@query(
    "jon_09_match_trusted",
    """SELECT e.email_id, COUNT(p.pattern) > 0 AS trusted FROM (SELECT email_id, lower(from_addr) AS f, CASE WHEN from_addr LIKE '%<%>%' THEN regexp_extract(lower(from_addr), '<([^<>]*)>[^>]*$', 1) ELSE lower(from_addr) END AS mailbox FROM {emails} x) e
    LEFT JOIN (VALUES ('billing@src1.example'), ('@vendor.example'), ('src12'), ('pay.vendor.example')) p(pattern) ON
      CASE WHEN contains(pattern, '@') AND NOT starts_with(pattern, '@') THEN pattern = mailbox
           WHEN starts_with(pattern, '@') THEN contains(mailbox, '@') AND (split_part(mailbox, '@', -1) = pattern[2:] OR ends_with(split_part(mailbox, '@', -1), '.' || pattern[2:]))
           ELSE contains(f, pattern) OR (contains(mailbox, '@') AND (split_part(mailbox, '@', -1) = pattern OR ends_with(split_part(mailbox, '@', -1), '.' || pattern))) END GROUP BY e.email_id""",
)
def _(t):
    from docspend.functions.text import is_trusted

    return t.emails.select(
        "email_id", is_trusted(F.col("from_addr"), ["billing@src1.example", "@vendor.example", "src12", "pay.vendor.example"]).alias("trusted")
    )


@query(
    "jon_09_pattern_table",
    """WITH p AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 50 + 1 END AS user_id, CASE p_partkey % 8 WHEN 0 THEN 'Billing@src' || p_partkey % 40 || '.example' WHEN 1 THEN '@src' || p_partkey % 40 || '.example' WHEN 2 THEN '@example' || p_partkey WHEN 3 THEN ' no-reply@src1' || p_partkey % 9
        WHEN 4 THEN 'vendor.x' || p_partkey WHEN 5 THEN 'c' || p_partkey % 90 || '@' WHEN 6 THEN '' ELSE 'pay.vendor.example' || p_partkey END AS pattern FROM part),
      r AS (SELECT DISTINCT user_id, lower(trim(pattern)) AS p FROM p WHERE trim(pattern) <> ''),
      e AS (SELECT email_id, user_id, lower(from_addr) AS f, CASE WHEN from_addr LIKE '%<%>%' THEN regexp_extract(lower(from_addr), '<([^<>]*)>[^>]*$', 1) ELSE lower(from_addr) END AS mailbox FROM {emails} x)
    SELECT e.email_id, COUNT(r.p) > 0 AS trusted, MIN(r.p) AS pattern FROM e LEFT JOIN r ON (r.user_id IS NULL OR r.user_id = e.user_id) AND
      CASE WHEN contains(p, '@') AND NOT starts_with(p, '@') THEN p = mailbox
           WHEN starts_with(p, '@') THEN contains(mailbox, '@') AND (split_part(mailbox, '@', -1) = p[2:] OR ends_with(split_part(mailbox, '@', -1), '.' || p[2:]))
           ELSE contains(f, p) OR (contains(mailbox, '@') AND (split_part(mailbox, '@', -1) = p OR ends_with(split_part(mailbox, '@', -1), '.' || p))) END GROUP BY e.email_id""",
)
def _(t):
    """Patterns of fifty tenants and of all."""
    k = F.col("p_partkey")
    join = lambda *v: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in v))
    kinds = [
        join("Billing@src", k % 40, ".example"), join("@src", k % 40, ".example"), join("@example", k), join(" no-reply@src1", k % 9), join("vendor.x", k), join("c", k % 90, "@"), F.lit(""),
        join("pay.vendor.example", k)
    ]
    patterns = t.part.select(F.when(k % 3 != 0, k % 50 + 1).alias("user_id"), F.get(F.array(*kinds), (k % 8).cast("int")).alias("pattern"))
    return J.match_trusted(t.emails, patterns)


@query(
    "jon_10_orphan_owners",
    "SELECT DISTINCT split_part(path, '/', 2) AS owner FROM {listing} l WHERE path LIKE 'users/%' AND TRY_CAST(split_part(path, '/', 2) AS BIGINT) IS NOT NULL AND TRY_CAST(split_part(path, '/', 2) AS BIGINT) NOT IN (SELECT id FROM {users} u)",
)
def _(t):
    return J.orphan_owners(t.listing, t.users)


OWNED = {
    "correction_logs": "correction_logs", "extraction_logs": "extraction_logs", "webhook_logs": "webhook_logs", "saved_views": "saved_views",
    "invoices": "invoices", "scan_logs": "scan_logs", "email_accounts": "email_accounts", "user_sessions": "sessions"
}
LEFT = " UNION ALL ".join(f"SELECT '{n}' AS tab, id FROM {{{f}}} x WHERE user_id <> 5" for n, f in OWNED.items())


@query("jon_11_delete_user", f"{LEFT} UNION ALL SELECT 'users', id FROM {{users}} u WHERE id <> 5")
def _(t):
    left = D.delete_user({n: getattr(t, f) for n, f in OWNED.items()} | {"users": t.users}, 5)
    out = None
    for name, df in left.items():
        one = df.select(F.lit(name).alias("tab"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "jon_12_reconcile_paths",
    """SELECT id, CASE WHEN file_path LIKE 'users/%' THEN 'already_migrated' WHEN b AND NOT a THEN 'collision' WHEN NOT a THEN 'missing' ELSE 'moved' END AS status, CASE WHEN file_path LIKE 'users/%' THEN file_path ELSE place END AS new_path
    FROM (SELECT id, file_path, place, file_path IN (SELECT path FROM {listing} l1) AS a, place IN (SELECT path FROM {listing} l2) AS b FROM (SELECT *, 'users/' || user_id || '/invoices/' || split_part(file_path, '/', -1) AS place FROM {invoices} i) y) x""",
)
def _(t):
    return D.reconcile_paths(t.invoices, t.listing).select("id", "status", "new_path")


@query(
    "jon_13_correction_history",
    "SELECT invoice_id, COUNT(DISTINCT field_name) AS fields, COUNT(*) AS n, arg_max(new_value, (corrected_at, id)) AS last_value FROM {correction_logs} x GROUP BY 1"
)
def _(t):
    return D.correction_history(t.correction_logs)


@query(
    "win_01_dedup_invoices",
    "SELECT cand_id, CASE WHEN row_number() OVER (PARTITION BY user_id, invoice_no ORDER BY received_at, email_uid, cand_id) = 1 THEN 'saved' ELSE 'duplicate' END AS outcome FROM (SELECT DISTINCT cand_id, user_id, invoice_no, received_at, email_uid FROM {candidates} y) c"
)
def _(t):
    return W.dedup_invoices(t.candidates.select("cand_id", "user_id", "invoice_no", "received_at", "email_uid").distinct()).select("cand_id", "outcome")


@query(
    "win_02_dedup_messages",
    "SELECT email_id FROM (SELECT email_id, m, row_number() OVER (PARTITION BY account_id, m ORDER BY received_at, folder, email_id) AS rn FROM (SELECT *, trim(replace(replace(message_id, '<', ''), '>', '')) AS m FROM {emails} e) y) x WHERE rn = 1 OR m = ''"
)
def _(t):
    return W.dedup_messages(t.emails).select("email_id")


NAMES = "SELECT 'm' || l_orderkey AS email_uid, l_linenumber AS k, 'f' || l_linenumber || CASE l_partkey % 4 WHEN 0 THEN '.xml' WHEN 1 THEN '.OFD' WHEN 2 THEN '.pdf' ELSE '.txt' END AS filename, l_orderkey % 2 = 0 AS hinted FROM lineitem"
BASIC = "CASE WHEN lower(filename) LIKE '%.pdf' THEN 0 WHEN lower(filename) LIKE '%.ofd' THEN 1 WHEN lower(filename) LIKE '%.xml' THEN 2 ELSE 3 END"
HINTED = f"CASE WHEN NOT hinted THEN {BASIC} WHEN lower(filename) LIKE '%.xml' THEN 0 WHEN lower(filename) LIKE '%.ofd' THEN 1 ELSE 2 + {BASIC} END"


def _names(t):
    ext = F.get(F.array(*map(F.lit, (".xml", ".OFD", ".pdf", ".txt"))), (F.col("l_partkey") % 4).cast("int"))
    hints = F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("xml"), F.lit("OFD"))).alias("hints")
    return t.lineitem.select(
        F.concat(F.lit("m"), "l_orderkey").alias("email_uid"), F.col("l_linenumber").alias("k"),
        F.concat(F.lit("f"), "l_linenumber", ext).alias("filename"), hints
    )


@query("win_03_prioritise", f"SELECT email_uid, k, filename, row_number() OVER (PARTITION BY email_uid ORDER BY {BASIC}, k, filename) AS turn FROM ({NAMES}) x")
def _(t):
    return W.prioritise(_names(t), "email_uid", "k").select("email_uid", "k", "filename", "turn")


@query(
    "win_03_prioritise_hinted",
    f"SELECT email_uid, k, filename, row_number() OVER (PARTITION BY email_uid ORDER BY {HINTED}, k, filename) AS turn FROM ({NAMES}) x"
)
def _(t):
    return W.prioritise(_names(t), "email_uid", "k", hints="hints").select("email_uid", "k", "filename", "turn")


@query(
    "win_04_same_name_twice",
    "SELECT cand_id, row_number() OVER (PARTITION BY email_uid, filename ORDER BY cand_id, invoice_no) > 1 AS skipped FROM (SELECT DISTINCT cand_id, email_uid, filename, invoice_no FROM {candidates} y) c"
)
def _(t):
    return W.repeated_names(
        t.candidates.select("cand_id", "email_uid", "filename", "invoice_no").distinct(), "cand_id", "invoice_no"
    ).select("cand_id", "skipped")


@query(
    "win_05_latest_scan",
    "SELECT user_id, id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) AS rn FROM {scan_logs} s) x WHERE rn = 1"
)
def _(t):
    top = t.scan_logs.groupBy("user_id").agg(F.max(F.struct("started_at", "id")).alias("m"))
    return top.select("user_id", "m.id", "m.started_at")


@query(
    "win_06_assign_paths",
    "SELECT id, seller || CASE WHEN rn = 1 THEN '' ELSE '_' || (rn - 1) END AS path FROM (SELECT id, seller, row_number() OVER (PARTITION BY user_id, seller ORDER BY id) AS rn FROM {invoices} i) x"
)
def _(t):
    return W.assign_paths(t.invoices, "user_id", "seller", "id").select("id", "path")


@query(
    "win_07_cap_seen",
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn <= 40"
)
def _(t):
    return W.cap_seen(t.events.withColumn("o", F.struct("ts", "event_id")), 40, "user_id", F.desc("o")).select("event_id")


@query(
    "win_08_retention",
    "SELECT id FROM {extraction_logs} l WHERE id NOT IN (SELECT id FROM {extraction_logs} m WHERE created_at < TIMESTAMP '2024-01-10 00:00:00' ORDER BY id LIMIT 1000)"
)
def _(t):
    return W.retention_split(t.extraction_logs, F.col("created_at") < F.lit("2024-01-10").cast("timestamp"), 1000).select("id")


@query(
    "win_09_after_last_known",
    "SELECT email_id FROM {emails} e LEFT JOIN (SELECT account_id, MAX(email_id) AS last FROM {emails} k WHERE folder = 'Archive' AND email_id % 4 < 3 GROUP BY 1) x USING (account_id) WHERE last IS NULL OR email_id > last"
)
def _(t):
    known = t.emails.where("folder = 'Archive' AND email_id % 4 < 3").select("account_id", "uid")
    return W.after_last_known(t.emails, known, "email_id").select("email_id")


@query(
    "srt_01_page_invoices",
    "SELECT id, invoice_date, (SELECT COUNT(*) FROM {invoices} j WHERE user_id = 3) AS total FROM {invoices} i WHERE user_id = 3 ORDER BY invoice_date DESC, id DESC LIMIT 20 OFFSET 20"
)
def _(t):
    return L.page_invoices(L.scoped(t.invoices, 3), 2, 20).select("id", "invoice_date", "total")


@query("srt_02_page_logs", "SELECT id, started_at, (SELECT COUNT(*) FROM {scan_logs} j) AS total FROM {scan_logs} s ORDER BY started_at DESC, id DESC LIMIT 25")
def _(t):
    return L.page_logs(t.scan_logs, 1, 25).select("id", "started_at", "total")


@query("srt_03_list_sorted", "SELECT id, name FROM {saved_views} v")
def _(t):
    return L.list_sorted(t.saved_views, "created_at", "id").select("id", "name")


@query("srt_04_order_messages", "SELECT email_id, received_at FROM {emails} e")
def _(t):
    return L.order_messages(t.emails).select("email_id", "received_at")


@query(
    "set_02_pending_links",
    "SELECT DISTINCT link FROM {emails} e WHERE link IS NOT NULL AND link NOT IN (SELECT link FROM {emails} k WHERE folder = 'Archive' AND link IS NOT NULL)"
)
def _(t):
    return J.pending_links(t.emails, t.emails.where("folder = 'Archive' AND link IS NOT NULL"))


@query(
    "set_03_events_to_audit",
    "SELECT id, email_uid, outcome FROM {extraction_logs} l UNION ALL SELECT NULL, 'scanner:' || event_type || ':' || (event_id % 5), event_type FROM events WHERE event_type = 'error'"
)
def _(t):
    found = t.events.where("event_type = 'error'").select(F.col("event_type").alias("kind"), (F.col("event_id") % 5).cast("string").alias("folder"))
    return J.events_to_audit(t.extraction_logs.select("id", "email_uid", "outcome"), found)
