"""Queries: sources (SRC) and incremental ingest (STM) in their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspend.functions.xml import xml_fields, xml_invoice
from docspend.plans import expected as X
from docspend.plans.registry import query
from docspend.sources import readers as R
from docspend.streaming import ingest as G

c = F.col
STATE = "SELECT account_id, folder, CAST(MAX(CAST(uid AS BIGINT)) AS VARCHAR) AS last_uid, CASE WHEN account_id % 7 = 0 THEN 'old' ELSE 'v1' END AS validity FROM {emails} q WHERE received_at < TIMESTAMP '2024-01-06 00:00:00' GROUP BY 1, 2"


def _messages(t):
    return t.emails.select("account_id", "folder", "uid", F.lit("v1").alias("uidvalidity"), "email_id")


def _state(t):
    rows = t.emails.where("received_at < TIMESTAMP '2024-01-06 00:00:00'").groupBy("account_id", "folder").agg(G.newest().alias("last_uid"))
    return rows.withColumn("validity", F.when(c("account_id") % 7 == 0, "old").otherwise("v1"))


@query(
    "stm_01_increment",
    f"SELECT email_id FROM {{emails}} m LEFT JOIN ({STATE}) s USING (account_id, folder) WHERE s.last_uid IS NULL OR s.validity = 'old' OR CAST(m.uid AS BIGINT) > CAST(s.last_uid AS BIGINT)"
)
def _(t):
    return G.ingest_increment(_messages(t), _state(t))[0].select("email_id")


@query(
    "stm_01_next_state",
    f"SELECT account_id, folder, COALESCE(CAST(MAX(CAST(m.uid AS BIGINT)) AS VARCHAR), MAX(s.last_uid)) AS last_uid FROM {{emails}} m LEFT JOIN ({STATE}) s USING (account_id, folder) GROUP BY 1, 2"
)
def _(t):
    return G.ingest_increment(_messages(t), _state(t))[1].select("account_id", "folder", "last_uid")


@query("stm_02_skip_unchanged", "SELECT id, CAST(id % 3 = 0 AND uidvalidity = '7' AS BOOLEAN) AS skip FROM {folders} f")
def _(t):
    saved = t.folders.select(
        "account_id", "folder", F.when(c("id") % 3 == 0, c("uidnext")).otherwise("1").alias("s_uidnext"), c("messages").alias("s_messages"),
        F.lit("7").alias("s_validity")
    )
    return G.skip_unchanged(t.folders, saved).select("id", "skip")


FEED = "SELECT user_id AS account_id, event_type AS folder, CAST(event_id % 40 AS INT) + 1 AS page, 'tok' || event_id AS token, event_id % 6 = 0 AS removed, 'msg' || (event_id % 3000) AS message_id, event_id AS uid FROM events"


def _feed(t):
    return t.events.select(
        c("user_id").alias("account_id"), c("event_type").alias("folder"), ((c("event_id") % 40).cast("int") + 1).alias("page"),
        F.concat(F.lit("tok"), c("event_id")).alias("token"), (c("event_id") % 6 == 0).alias("removed"),
        F.concat(F.lit("msg"), c("event_id") % 3000).alias("message_id"), c("event_id").alias("uid")
    )


#: A folder's mode follows from what its state holds: a token, an old time, nothing.
MODE = "CASE WHEN account_id % 3 = 0 THEN 'incremental' WHEN account_id % 3 = 1 THEN 'bridge' ELSE 'initial' END"
EVENTS = f"SELECT account_id, folder, CASE WHEN m = 'incremental' AND x THEN 'delta_resync' WHEN m = 'bridge' AND p > 30 THEN 'delta_bridge_overflow' END AS outcome, tok FROM (SELECT account_id, folder, {MODE} AS m, MAX(page) AS p, bool_or(uid % 97 = 0) AS x, arg_max(token, (page, uid)) AS tok FROM ({FEED}) f GROUP BY 1, 2) g"


def _changes(t):
    feed = _feed(t).withColumn("expired", c("uid") % 97 == 0)
    a = c("account_id")
    state = feed.select("account_id", "folder").distinct().select(
        "account_id", "folder", F.when(a % 3 == 0, "d").alias("delta_link"), F.when(a % 3 == 1, "2024-01-01").alias("legacy")
    )
    return G.apply_change_feed(feed, state)


@query(
    "stm_04_change_feed",
    f"""SELECT account_id, message_id, folder, uid FROM (SELECT *, row_number() OVER (PARTITION BY account_id, message_id ORDER BY folder, page, uid) AS rn FROM ({FEED}) f JOIN ({EVENTS}) e USING (account_id, folder) WHERE NOT removed AND outcome IS NULL) x WHERE rn = 1""",
)
def _(t):
    return _changes(t)[0]


@query("stm_04_tokens", f"SELECT account_id, folder FROM ({EVENTS}) e WHERE outcome IS NULL")
def _(t):
    return _changes(t)[1].select("account_id", "folder")


@query("stm_04_events", f"SELECT account_id, folder, outcome FROM ({EVENTS}) e WHERE outcome IS NOT NULL")
def _(t):
    return _changes(t)[2]


@query(
    "stm_07_progress",
    "SELECT time_bucket(INTERVAL '1 day', ts) AS start, COUNT(*) AS processed, COUNT(*) FILTER (event_type = 'purchase') AS found, COUNT(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1"
)
def _(t):
    return G.progress_stream(t.events)


@query(
    "src_04_emails",
    "SELECT doc_id AS uid, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'Hi & bye' END AS body_text, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS n FROM documents"
)
def _(t):
    raw = t.documents.select(
        c("doc_id").alias("uid"), F.lit("s").alias("subject"), F.lit("f").alias("from_addr"), F.when(c("doc_id") % 2 == 0, c("text")).otherwise(" ").alias("body_text"), F.lit("<p>Hi</p> <b>&amp;</b> bye<br>").alias("body_html"),
        F.when(c("doc_id") % 3 == 0, F.array(F.lit("a.PDF"), F.lit("b.ofd"), F.lit("c.jpg"))).otherwise(F.array(F.lit("x.xml"), F.lit("noext"))).alias("attachments"),
    )
    return R.load_emails(raw).select(c("uid").cast("long").alias("uid"), "body_text", F.size("attachments").alias("n"))


@query(
    "src_05_graph",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '<' || event_id || '@x>' ELSE 'g' || event_id END AS uid, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || '@y.example' END AS from_addr, date_trunc('second', ts) AS received_at FROM events"
)
def _(t):
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    mid = F.when(c("event_id") % 2 == 0, q(F.concat(F.lit("<"), c("event_id"), F.lit("@x>")))).otherwise("null")
    sender = F.when(c("event_id") % 3 == 0, "null").otherwise(F.concat(F.lit('{"emailAddress": {"address": "'), c("event_type"), F.lit('@y.example"}}')))
    item = F.concat(
        F.lit('{"internetMessageId": '), mid, F.lit(', "id": "g'), c("event_id"), F.lit('", "from": '), sender, F.lit(', "receivedDateTime": "'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"}')
    )
    rows = R.emails_from_graph_json(t.events.select(c("event_id").alias("email_id"), item.alias("value")))
    return rows.select(c("email_id").cast("long").alias("event_id"), "uid", "from_addr", "received_at")


@query(
    "src_message_table",
    """WITH m AS (
      SELECT NULL AS id, doc_id % 120 + 1 AS account_id, 'INBOX' AS folder, CAST(doc_id AS VARCHAR) AS uid, '<' || doc_id || '@x>' AS message_id, 's' AS subject, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS documents, 1 AS links, 0 AS headers, TIMESTAMP '2024-01-01' AS received_at FROM documents
      UNION ALL SELECT NULL, event_id % 120 + 1, 'Feed', 'g' || event_id, 'g' || event_id, event_type, 0, 0, 3, date_trunc('second', ts) FROM events
      UNION ALL SELECT NULL, p_partkey % 120 + 1, 'Portal Invoices', 'portal:' || p_partkey, 'portal-' || p_partkey, 'Portal Invoice ' || p_partkey || ' — ' || p_brand || ' USD', 1, 1, 6, TIMESTAMP '2024-02-01' FROM part)
    SELECT account_id || '/' || folder || '/' || uid AS email_id, a.user_id, account_id, folder, uid, message_id, m.subject, documents, links, headers, received_at FROM m LEFT JOIN {email_accounts} a ON a.id = m.account_id""",
)
def _(t):
    """Landed records, listed items and portal pages as one table of messages."""
    raw = t.documents.select(
        (c("doc_id") % 120 + 1).alias("account_id"), F.lit("INBOX").alias("folder"), c("doc_id").alias("uid"), F.concat(F.lit("<"), "doc_id", F.lit("@x>")).alias("message_id"), F.lit("s").alias("subject"), F.lit("f").alias("from_addr"),
        F.lit("see https://x.example/a").alias("body_text"), F.lit("").alias("body_html"), F.lit("2024-01-01").cast("timestamp").alias("received_at"),
        F.when(c("doc_id") % 3 == 0, F.array(F.lit("a.PDF"), F.lit("b.ofd"), F.lit("c.jpg"))).otherwise(F.array(F.lit("x.xml"), F.lit("noext"))).alias("attachments"),
    )
    item = F.to_json(F.struct(F.concat(F.lit("g"), "event_id").alias("id"), c("event_type").alias("subject"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("receivedDateTime")))
    feed = t.events.select((c("event_id") % 120 + 1).alias("account_id"), F.lit("Feed").alias("folder"), item.alias("value"))
    pages = t.part.select(
        c("p_partkey").cast("string").alias("portal_id"), F.concat(F.lit("https://p.example/"), "p_partkey").alias("url"), c("p_brand").alias("money"), F.lit(None).cast("string").alias("date"),
        F.lit(None).cast("string").alias("bill_to"), (c("p_partkey") % 120 + 1).alias("account_id")
    )
    accounts = t.email_accounts
    rows = R.load_emails(raw, accounts).unionByName(R.emails_from_graph_json(feed, accounts=accounts)).unionByName(R.emails_from_portal(pages, seen_at="2024-02-01", accounts=accounts))
    size = lambda n: F.size(n).alias({"attachments": "documents"}.get(n, n))
    return rows.select("email_id", "user_id", "account_id", "folder", "uid", "message_id", "subject", size("attachments"), size("links"), size("headers"), "received_at")


@query(
    "src_07_portal",
    """SELECT 'portal:' || p_partkey AS uid, trim('Portal Invoice ' || p_partkey || ' — ' || p_brand || ' USD ' || CASE WHEN p_size % 2 = 0 THEN 'May 1, 2026' ELSE '' END) AS subject,
    'Portal subscription invoice ' || p_partkey || chr(10) || 'Provider: Portal (portal.example)' || chr(10) || 'Bill-to: ' || CASE WHEN p_size % 3 = 0 THEN 'Unknown' ELSE p_name END || chr(10) || 'Amount: ' || p_brand || ' USD' || chr(10) || 'Date: '
      || CASE WHEN p_size % 2 = 0 THEN 'May 1, 2026' ELSE '' END || chr(10) || 'URL: https://p.example/' || p_partkey AS body_text, 'https://p.example/' || p_partkey AS link, 'USD' AS currency, 'portal-' || p_partkey AS message_id, 'Portal Invoices' AS folder FROM part""",
)
def _(t):
    k = c("p_partkey").cast("string")
    rows = t.part.select(
        k.alias("portal_id"), F.concat(F.lit("https://p.example/"), k).alias("url"), c("p_brand").alias("money"),
        F.when(c("p_size") % 2 == 0, "May 1, 2026").alias("date"), F.when(c("p_size") % 3 != 0, c("p_name")).alias("bill_to"),
        F.lit(1).alias("account_id")
    )
    return R.emails_from_portal(rows).select(
        "uid", "subject", "body_text", F.get("links", F.lit(0)).alias("link"), c("headers")["_currency"].alias("currency"), "message_id", "folder"
    )


@query(
    "fn_16_xml_fields",
    "SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE CAST(10000000 + id AS VARCHAR) END AS no, CASE WHEN id % 4 = 3 THEN NULL WHEN id % 4 = 1 THEN buyer END AS buyer FROM (SELECT p_partkey AS id, p_name AS buyer FROM part) p"
)
def _(t):
    number = (c("p_partkey") + 10000000).cast("string")
    doc = F.concat(
        F.lit('<?xml version="1.0"?><n:Invoice xmlns:n="urn:x">'),
        F.when(
            c("p_partkey") % 4 == 0, F.concat(F.lit("<n:Empty/><n:FPHM>"), number, F.lit("</n:FPHM>"))
        ).otherwise(F.concat(F.lit("<InvoiceNo> "), number, F.lit(" </InvoiceNo>"))),
        F.when(c("p_partkey") % 4 == 1, F.concat(F.lit("<n:Buyer>"), c("p_name"), F.lit("</n:Buyer>"))).otherwise(""),
        F.when(c("p_partkey") % 4 == 3, "<broken").otherwise("</n:Invoice>")
    )
    rows = t.part.select(c("p_partkey").alias("id"), doc.alias("x"))
    x = rows.select("id", xml_fields(c("x"), tags={"no": ("InvoiceNo", "FPHM"), "buyer": ("Buyer",)}).alias("x"))
    return x.select("id", "x.no", "x.buyer")


@query(
    "fn_16_xml_invoice",
    f"""SELECT id, invoice_no, buyer, seller, invoice_type, amount, invoice_date, item_summary, confidence, is_vat_document FROM ({X.xml_invoice('(SELECT * FROM {xml_texts} x0)')}) x1""",
)
def _(t):
    """Documents are dealt before they are parsed, as few tasks may have read them all."""
    rows = t.xml_texts.repartition("id").withColumn("x", xml_fields(c("raw_text")))
    return rows.select("id", *(v.alias(k) for k, v in xml_invoice(c("x"), c("raw_text")).items() if k != "extraction_method"))
