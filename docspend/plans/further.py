"""Queries: ingest state of other kinds, portals, analysis records, backfills and plugged functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspend.functions import portal as O
from docspend.functions import state as ST
from docspend.operators import dml as D
from docspend.plans.registry import query
from docspend.sources import pluggable
from docspend.streaming import ingest as G

c = F.col
FORMS = "CASE p_partkey % 5 WHEN 0 THEN '{\"_format\": \"outlook_delta_v1\", \"folders\": {\"A\": {\"delta_link\": \"d' || p_partkey || '\", \"last_sync_at\": \"t\"}}}' WHEN 1 THEN '{\"A\": \"2024-01-0' || p_size % 9 || '\"}' WHEN 2 THEN '{\"__legacy_uid__\": \"x\"}' WHEN 3 THEN 'bare' ELSE '' END"


def _forms(t):
    tagged = F.concat(F.lit('{"_format": "outlook_delta_v1", "folders": {"A": {"delta_link": "d'), c("p_partkey"), F.lit('", "last_sync_at": "t"}}}'))
    times = F.concat(F.lit('{"A": "2024-01-0'), c("p_size") % 9, F.lit('"}'))
    raw = F.when(c("p_partkey") % 5 == 0, tagged).when(c("p_partkey") % 5 == 1, times).when(
        c("p_partkey") % 5 == 2, '{"__legacy_uid__": "x"}'
    ).when(c("p_partkey") % 5 == 3, "bare").otherwise("")
    return t.part.select(c("p_partkey").alias("id"), (c("p_partkey") % 5).alias("kind"), raw.alias("raw"))


@query(
    "fn_28_time_state",
    f"SELECT id, CASE kind WHEN 1 THEN json_extract_string(raw, '$.A') WHEN 2 THEN 'x' WHEN 3 THEN 'bare' END AS v FROM (SELECT p_partkey AS id, p_partkey % 5 AS kind, {FORMS} AS raw FROM part) f WHERE kind <> 0"
)
def _(t):
    rows = _forms(t).where("kind <> 0").select("id", ST.parse_time_state(c("raw")).alias("s"))
    return rows.select("id", F.coalesce(c("s")["A"], c("s")[ST.LEGACY]).alias("v"))


@query(
    "fn_28_delta_state",
    f"SELECT id, kind = 1 AS bridged, CASE kind WHEN 0 THEN 'd' || id WHEN 1 THEN '' END AS link, CASE kind WHEN 1 THEN json_extract_string(raw, '$.A') END AS legacy FROM (SELECT p_partkey AS id, p_partkey % 5 AS kind, {FORMS} AS raw FROM part) f"
)
def _(t):
    rows = _forms(t).select("id", ST.parse_delta_state(c("raw")).alias("s"))
    return rows.select("id", "s.bridged", c("s")["folders"]["A"]["delta_link"].alias("link"), c("s")["folders"]["A"]["_legacy_received_dt"].alias("legacy"))


@query("fn_34_portal_links", "SELECT p_partkey AS id, 2 AS n, CASE WHEN p_partkey % 2 = 0 THEN 'uniq' || p_partkey ELSE 'acct' END AS first_id FROM part")
def _(t):
    url = F.concat(
        F.lit("https://invoice.stripe.com/i/acct"),
        F.when(c("p_partkey") % 2 == 0, F.concat(F.lit("/uniq"), c("p_partkey"), F.lit("?s=1"))).otherwise("")
    )
    html = F.concat(F.lit('<a href="'), url, F.lit('">x</a> '), url, F.lit(" https://invoice.stripe.com/i/b/c https://other.example/i/d"))
    rows = t.part.select(c("p_partkey").alias("id"), O.links(html).alias("ls"))
    return rows.select("id", F.size("ls").alias("n"), O.link_id(F.get("ls", F.lit(0))).alias("first_id"))


@query(
    "fn_35_page_text",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '$1,' || (100 + p_size) || '.50' WHEN p_partkey % 3 = 1 THEN 'US$' || p_size END AS money, 'May ' || (p_size % 28 + 1) || ', 2026' AS day, CASE WHEN p_partkey % 2 = 0 THEN 'MB & Co' ELSE 'Billing Contact' END AS bill_to FROM part"
)
def _(t):
    money = F.when(
        c("p_partkey") % 3 == 0, F.concat(F.lit("$1,"), c("p_size") + 100, F.lit(".50"))
    ).when(c("p_partkey") % 3 == 1, F.concat(F.lit("US$"), c("p_size"))).otherwise("free")
    who = F.when(c("p_partkey") % 2 == 0, "Billing information Name MB & Co Email x").otherwise("Billing information Name ??")
    text = F.concat_ws(" ", F.lit("Due"), F.concat(F.lit("May "), c("p_size") % 28 + 1, F.lit(", 2026")), money, who)
    rows = t.part.select(c("p_partkey").alias("id"), text.alias("x"))
    return rows.select(
        "id", F.nullif(F.regexp_extract("x", O.MONEY, 0), F.lit("")).alias("money"), F.regexp_extract("x", O.DAY, 0).alias("day"),
        O.bill_to(c("x")).alias("bill_to")
    )


REC = "SELECT event_id, event_id % 2 = 0 AS rel, value / 50 AS conf, CASE WHEN event_id % 3 = 0 THEN 'u' END AS url, CASE WHEN event_id % 5 = 0 THEN 0.7 ELSE 0.0 END AS uc, CASE WHEN event_id % 7 = 0 THEN 'why' END AS why FROM events"


@query(
    "fn_36_analysis",
    f"SELECT event_id, CAST(rel AND why IS NOT NULL AS INT) + CAST(NOT rel AND why IS NULL AS INT) + CAST(NOT rel AND url IS NOT NULL AS INT) + CAST(url IS NULL AND uc <> 0 AS INT) + CAST(conf < 0 OR conf > 1 AS INT) AS broken, url IS NOT NULL AND uc >= 0.6 AS fetch FROM ({REC}) r"
)
def _(t):
    record = F.struct(
        (c("event_id") % 2 == 0).alias("is_invoice_related"), (c("value") / 50).alias("invoice_confidence"),
        F.when(c("event_id") % 3 == 0, "u").alias("best_download_url"), F.when(c("event_id") % 5 == 0, 0.7).otherwise(0.0).alias("url_confidence"),
        F.when(c("event_id") % 7 == 0, "why").alias("skip_reason")
    )
    parsed = F.from_json(F.to_json(record), O.ANALYSIS)
    rows = t.events.select("event_id", parsed.alias("r"))
    return rows.select("event_id", F.size(O.violations(c("r"))).alias("broken"), O.should_download(c("r")).alias("fetch"))


@query(
    "dml_03_backfill",
    "SELECT id, CASE WHEN expires_at IS NOT NULL THEN expires_at WHEN prompt_type IN ('classify', 'analyze_email_v3') THEN created_at + INTERVAL 30 DAY ELSE created_at + INTERVAL 365 DAY END AS expires_at, COALESCE(CASE WHEN id % 2 = 0 THEN id END, 1) AS user_id FROM {llm_cache} x"
)
def _(t):
    rows = D.backfill_expiry(t.llm_cache).withColumn("user_id", F.when(c("id") % 2 == 0, c("id")))
    return D.backfill_tenant(rows, t.users).select("id", "expires_at", "user_id")


@query("dml_03_seed_setting", "SELECT key, CASE WHEN key = 'FRANCE' AND COALESCE(value, '') = '' THEN 'on' ELSE value END AS value FROM {app_settings} s")
def _(t):
    return D.seed_setting(t.app_settings, "FRANCE", "on")


@query("udf_01_enrich", "SELECT email_id, substring(body_text, 1, 20) || '!' AS response FROM {emails} e")
def _(t):
    return pluggable.enrich(
        t.emails.select("email_id", "body_text"), lambda texts: [x[:20] + "!" for x in texts], column="body_text"
    ).select("email_id", "response")


@query("udf_02_analyse", "SELECT email_id, len(string_split(body_text, chr(10))) AS lines FROM {emails} e")
def _(t):
    out = pluggable.analyse(t.emails.select("email_id", "body_text"), lambda texts: [str(x.count("\n") + 1) for x in texts])
    return out.select("email_id", c("response").cast("long").alias("lines"))


@query("udf_03_embed", "SELECT id, CAST(length(concat_ws(' ', buyer, seller)) AS DOUBLE) AS first FROM {invoices} i")
def _(t):
    rows = t.invoices.select("id", F.concat_ws(" ", "buyer", "seller").alias("text"))
    return pluggable.embed(rows, lambda texts: [[float(len(x)), 1.0] for x in texts]).select("id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query("stm_05_dedup", "SELECT message_id, MIN(email_id) AS email_id FROM {emails} e WHERE message_id <> '' GROUP BY 1")
def _(t):
    """The batch form of the stream's dedup: the first of each id."""
    return t.emails.where("message_id <> ''").groupBy("message_id").agg(F.min("email_id").alias("email_id"))


@query("stm_03_validity_reset", "SELECT email_id, 'v2' AS uidvalidity FROM {emails} e")
def _(t):
    old = t.emails.groupBy("account_id", "folder").agg(G.newest().alias("last_uid")).withColumn("validity", F.lit("v1"))
    return G.ingest_increment(t.emails.withColumn("uidvalidity", F.lit("v2")), old)[0].select("email_id", "uidvalidity")
