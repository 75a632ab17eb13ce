"""The engine's tables, derived from the given star-schema tables.

Each fixture is one SELECT in the common subset of Spark SQL and ANSI SQL, so the same text feeds a
DataFrame here and the oracle's WITH clause.  All rows of the given tables take part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docspend.shipping import ship

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "invoices": """
SELECT o.o_orderkey + 1 AS id, o.o_custkey % 50 + 1 AS user_id,
  CASE WHEN o.o_orderkey % 17 = 0 THEN CAST(20000000 + o.o_orderkey % 400 AS STRING) ELSE CAST(10000000 + o.o_orderkey AS STRING) END AS invoice_no,
  CASE WHEN o.o_orderkey % 41 = 0 THEN '未知' ELSE c.c_name END AS buyer,
  CONCAT('Seller ', c.c_mktsegment, ' ', CAST(o.o_orderkey % 23 AS STRING)) AS seller,
  CASE WHEN o.o_orderkey % 97 = 0 THEN CAST(0.01 AS DECIMAL(12,2)) ELSE CAST(o.o_totalprice AS DECIMAL(12,2)) END AS amount,
  CAST(o.o_orderdate AS DATE) AS invoice_date,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN '增值税专用发票' WHEN '2-HIGH' THEN '数电普票' WHEN '3-MEDIUM' THEN '电子发票（铁路电子客票）' WHEN '5-LOW' THEN '收据' ELSE '未知' END AS invoice_type,
  CASE WHEN o.o_orderkey % 29 = 0 THEN 'saas_invoice' WHEN o.o_orderkey % 31 = 0 THEN CAST(NULL AS STRING) WHEN o.o_orderkey % 5 = 0 THEN 'overseas_invoice' WHEN o.o_orderkey % 7 = 0 THEN 'receipt' WHEN o.o_orderkey % 11 = 0 THEN 'proforma' ELSE 'vat_invoice' END AS invoice_category,
  CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(NULL AS STRING) ELSE CONCAT('Order "', o.o_orderpriority, '", ', c.c_mktsegment) END AS item_summary,
  CASE WHEN o.o_orderkey % 19 = 0 THEN CONCAT('users/', CAST(o.o_custkey % 50 + 1 AS STRING), '/invoices/', CAST(o.o_orderkey % 700 AS STRING), '.pdf')
       ELSE CONCAT(CAST(o.o_custkey % 50 + 1 AS STRING), '/', CAST(o.o_orderkey % 700 AS STRING), '.pdf') END AS file_path,
  CONCAT('发票号码：', CAST(10000000 + o.o_orderkey AS STRING)) AS raw_text,
  CONCAT('m', CAST(o.o_orderkey % 4000 AS STRING)) AS email_uid, o.o_custkey % 120 + 1 AS email_account_id,
  CASE o.o_orderstatus WHEN 'F' THEN 'pdf' WHEN 'O' THEN 'xml' ELSE 'ofd' END AS source_format,
  CASE WHEN o.o_orderkey % 4 = 0 THEN 'qr' WHEN o.o_orderkey % 4 = 1 THEN 'xml_xpath' WHEN o.o_orderkey % 4 = 2 THEN 'llm' ELSE 'regex' END AS extraction_method,
  CAST(o.o_orderkey % 101 AS DOUBLE) / 100 AS confidence, o.o_orderkey % 13 = 0 AS is_manually_corrected, o.o_orderdate AS created_at
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "users": """
SELECT c_custkey + 1 AS id, LOWER(CONCAT(c_name, '@', c_mktsegment, '.example')) AS email, c_acctbal > 0 AS is_active, c_custkey % 100 = 0 AS is_admin, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at
FROM {customer}""",
    "email_accounts": """
SELECT s_suppkey + 1 AS id, s_suppkey % 50 + 1 AS user_id, s_name AS name,
  CASE WHEN s_suppkey % 4 = 0 THEN 'imap' WHEN s_suppkey % 4 = 1 THEN 'pop3' WHEN s_suppkey % 4 = 2 THEN 'outlook' ELSE 'qq' END AS type,
  CASE WHEN s_nationkey % 6 = 0 THEN 'IMAP.qq.com' ELSE CONCAT('imap', CAST(s_nationkey AS STRING), '.example') END AS host, CONCAT(s_name, '@', CASE WHEN s_suppkey % 3 = 0 THEN 'outlook.com' WHEN s_suppkey % 7 = 1 THEN 'LIVE.co.uk' ELSE 'corp.example' END) AS username,
  s_acctbal > 0 AS is_active,
  CASE WHEN s_suppkey % 5 = 0 THEN CAST(NULL AS STRING) WHEN s_suppkey % 5 = 1 THEN CAST(s_suppkey * 37 AS STRING)
       WHEN s_suppkey % 5 = 2 THEN '[1, 2]' ELSE CONCAT('{"INBOX": {"uid": "', CAST(s_suppkey * 11 AS STRING), '", "uidvalidity": "7", "uidnext": "', CAST(s_suppkey * 11 + 1 AS STRING), '", "messages": "', CAST(s_suppkey AS STRING), '"}}') END AS last_scan_uid,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at, CASE WHEN s_suppkey % 2 = 0 THEN 'secret' ELSE '' END AS password_encrypted,
  CAST(993 + s_suppkey % 3 AS INT) AS port, CASE WHEN s_suppkey % 4 = 2 THEN 'personal' ELSE CAST(NULL AS STRING) END AS outlook_account_type,
  CASE WHEN s_suppkey % 3 = 0 THEN 'secret' ELSE '' END AS secondary_credential_encrypted, CASE WHEN s_suppkey % 5 = 0 THEN 'secret' ELSE CAST(NULL AS STRING) END AS secondary_password_encrypted,
  CASE WHEN s_suppkey % 7 = 0 THEN 'secret' ELSE CAST(NULL AS STRING) END AS totp_secret_encrypted, CASE WHEN s_suppkey % 2 = 1 THEN '{}' ELSE '' END AS playwright_storage_state
FROM {supplier}""",
    "extraction_logs": """
SELECT event_id + 1 AS id, user_id % 50 + 1 AS user_id, CAST(FLOOR(event_id / 20.0) AS BIGINT) + 1 AS scan_log_id,
  CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN CAST(NULL AS STRING) ELSE CONCAT('m', CAST(CAST(FLOOR(event_id / 3.0) AS BIGINT) AS STRING)) END AS email_uid,
  CONCAT('Subject of ', event_type, ' ', CAST(event_id % 100 AS STRING)) AS email_subject,
  CASE WHEN event_id % 4 = 0 THEN CAST(NULL AS STRING) ELSE CONCAT('file', CAST(event_id % 6 AS STRING), '.pdf') END AS attachment_filename,
  CASE event_id % 9 WHEN 0 THEN 'saved' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'not_invoice' WHEN 3 THEN 'low_confidence' WHEN 4 THEN 'error' WHEN 5 THEN 'not_vat_invoice' WHEN 6 THEN 'skipped_seen' WHEN 7 THEN 'parse_failed' ELSE 'delta_resync' END AS outcome,
  CASE WHEN event_id % 7 = 0 THEN CAST(NULL AS INT) ELSE CAST(event_id % 3 + 1 AS INT) END AS classification_tier,
  CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN CAST(NULL AS STRING) WHEN event_id % 5 = 2 THEN 'qr' WHEN event_id % 5 = 3 THEN 'llm' ELSE 'regex' END AS parse_method,
  CASE WHEN event_id % 6 = 0 THEN CAST(10000000 + event_id AS STRING) WHEN event_id % 6 = 1 THEN '' ELSE CAST(NULL AS STRING) END AS invoice_no,
  value / 100 AS confidence, ts AS created_at, value, CASE WHEN event_id % 10 = 0 THEN 'xml' ELSE 'pdf' END AS parse_format,
  CASE WHEN event_id % 8 = 0 THEN 'rejected' ELSE CAST(NULL AS STRING) END AS download_outcome, CASE WHEN event_id % 9 = 4 THEN CONCAT('failed: ', props) ELSE CAST(NULL AS STRING) END AS error_detail
FROM {events}""",
    "scan_logs": """
SELECT scan_log_id AS id, MIN(user_id) AS user_id, MIN(user_id) * 2 AS email_account_id, MIN(created_at) AS started_at,
  CASE WHEN scan_log_id % 6 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE MAX(created_at) END AS finished_at,
  CAST(COUNT(*) AS INT) AS emails_scanned, CAST(SUM(CASE WHEN outcome = 'saved' THEN 1 ELSE 0 END) AS INT) AS invoices_found,
  CASE WHEN scan_log_id % 18 = 0 THEN 'interrupted' ELSE CAST(NULL AS STRING) END AS error_message
FROM ({extraction_logs}) x GROUP BY scan_log_id""",
    "emails": """
SELECT doc_id AS email_id, doc_id % 120 + 1 AS account_id, CASE WHEN doc_id % 3 = 0 THEN 'Archive' ELSE 'INBOX' END AS folder, CAST(doc_id AS STRING) AS uid,
  CASE WHEN doc_id % 19 = 0 THEN '' ELSE CONCAT('<', CAST(doc_id - doc_id % 2 AS STRING), '@mail.example>') END AS message_id,
  CONCAT(CASE WHEN doc_id % 10 = 0 THEN '您的电子发票 ' WHEN doc_id % 10 = 1 THEN 'Your INVOICE ' WHEN doc_id % 10 = 2 THEN '代开发票 ' WHEN doc_id % 10 = 3 THEN 'WeChat: abcde_123 ' ELSE 'News ' END, SUBSTRING(text, 1, 40)) AS subject,
  CASE WHEN doc_id % 4 = 0 THEN CONCAT('Billing <billing@', source, '.example>') WHEN doc_id % 4 = 1 THEN CONCAT(source, '@pay.vendor.example') WHEN doc_id % 4 = 2 THEN CONCAT('no-reply@', source) ELSE source END AS from_addr,
  COALESCE(text, '') AS body_text,
  CASE WHEN doc_id % 12 = 0 THEN CONCAT('scan', CAST(doc_id AS STRING), '.PDF') WHEN doc_id % 12 = 1 THEN 'photo.jpg' WHEN doc_id % 12 = 2 THEN 'data.xml' WHEN doc_id % 12 = 3 THEN 'noext' ELSE CAST(NULL AS STRING) END AS attachment,
  CASE WHEN doc_id % 6 = 0 THEN CONCAT('https://', source, '.example/d/', CAST(doc_id AS STRING), '.pdf?x=1') WHEN doc_id % 6 = 1 THEN CONCAT('https://click.mail.', source, '.example/a') WHEN doc_id % 6 = 2 THEN CONCAT('http://', source, '.example/Track/', CAST(doc_id AS STRING)) WHEN doc_id % 6 = 3 THEN CONCAT('http://', source, '.example/logo.PNG') ELSE CAST(NULL AS STRING) END AS link,
  CASE WHEN doc_id % 24 = 0 THEN CONCAT('scan', CAST(doc_id AS STRING), '.ofd') WHEN doc_id % 36 = 2 THEN 'data.xml' ELSE CAST(NULL AS STRING) END AS attachment2,
  doc_id % 120 % 50 + 1 AS user_id, CASE WHEN doc_id % 15 = 0 THEN 'List-Unsubscribe' WHEN doc_id % 15 = 1 THEN 'X-Mailer' ELSE CAST(NULL AS STRING) END AS header,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) + CAST(doc_id % 300 AS INT) * INTERVAL '1' HOUR AS received_at
FROM {documents}""",
    "parse_texts": """
SELECT o.o_orderkey AS id,
  CONCAT(CASE WHEN o.o_orderkey % 9 = 0 THEN '行程单 ' WHEN o.o_orderkey % 9 < 5 THEN '电子发票（普通发票） ' ELSE '收据 ' END,
    '发票号码：', CASE WHEN o.o_orderkey % 12 = 5 THEN '　' ELSE '' END, CASE WHEN o.o_orderkey % 8 = 0 THEN '12' ELSE CAST(10000000 + o.o_orderkey AS STRING) END, CHR(10),
    '开票日期: ', CAST(1995 + o.o_orderkey % 30 AS STRING), '年', CAST(o.o_orderkey % 14 AS STRING), '月', CAST(o.o_orderkey % 31 + 1 AS STRING), '日', CHR(10),
    '购买方 名称：', CASE WHEN o.o_orderkey % 12 = 7 THEN '　' ELSE '' END, c.c_name, CHR(10), '销 售 方信息 名 称: Seller ', c.c_mktsegment, CHR(10),
    CASE WHEN o.o_orderkey % 2 = 0 THEN '税率 13% 税额' ELSE '' END,
    CASE WHEN o.o_orderkey % 5 = 0 THEN '合 计 ¥ ' WHEN o.o_orderkey % 5 = 1 THEN '无金额 ' ELSE '价税合计（大写）壹佰圆 ￥' END, CAST(CAST(o.o_totalprice AS DECIMAL(12,2)) AS STRING),
    CASE WHEN o.o_orderkey % 25 = 0 THEN ' (cid:1)(cid:22)(cid:3)(cid:4)(cid:5)(cid:6)' ELSE '' END) AS raw_text,
  CASE o.o_orderkey % 6 WHEN 0 THEN CONCAT('01,04,1234567890,', CAST(10000000 + o.o_orderkey AS STRING), ',', CAST(CAST(o.o_totalprice AS DECIMAL(12,2)) AS STRING), ',20240', CAST(o.o_orderkey % 10 AS STRING), '15,x')
    WHEN 1 THEN CONCAT('12345678901|', CAST(o.o_orderkey AS STRING), '| 88.10 |2024-2-30|z') WHEN 2 THEN 'https://example.org/a,b,c,d,e' WHEN 3 THEN '01,99,a,b,c,d,e' WHEN 4 THEN CONCAT(' 1234567890,', CAST(o.o_orderkey AS STRING), ',9.5,2024年3月4日,q') ELSE '' END AS qr
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "xml_texts": """
SELECT o.o_orderkey AS id,
  CONCAT('<?xml version="1.0" encoding="UTF-8"?><n:Invoice xmlns:n="urn:x">', CASE WHEN o.o_orderkey % 3 = 2 THEN '' ELSE '<Note>税率 税额</Note>' END,
    CASE o.o_orderkey % 4 WHEN 0 THEN '<InvoiceNo> ' WHEN 1 THEN '<n:fpHm>' WHEN 2 THEN '<InvoiceNo/><FPHM>' ELSE '<n:InvoiceNo>1</n:InvoiceNo><InvoiceNo>' END, CAST(10000000 + o.o_orderkey AS STRING),
    CASE o.o_orderkey % 4 WHEN 0 THEN ' </InvoiceNo>' WHEN 1 THEN '</n:fpHm>' WHEN 2 THEN '</FPHM>' ELSE '</InvoiceNo>' END,
    CASE o.o_orderkey % 3 WHEN 0 THEN CONCAT('<BuyerName>', c.c_name, ' &amp; Co</BuyerName>') WHEN 1 THEN CONCAT('<n:GMF_MC>', c.c_name, '</n:GMF_MC>') ELSE '' END,
    '<XSFMC>Seller ', c.c_mktsegment, '</XSFMC>', CASE o.o_orderkey % 5 WHEN 0 THEN '<InvoiceType>增值税专用发票</InvoiceType>' WHEN 1 THEN '<fplx>数电普票</fplx>' WHEN 2 THEN '<KPLX>收据</KPLX>' ELSE '' END,
    CASE o.o_orderkey % 6 WHEN 0 THEN '<jshj>1,234.50</jshj>' WHEN 5 THEN CONCAT('<价税合计>', CAST(CAST(o.o_totalprice AS DECIMAL(12,2)) AS STRING), '</价税合计>') ELSE CONCAT('<n:TotalAmount>', CAST(CAST(o.o_totalprice AS DECIMAL(12,2)) AS STRING), '</n:TotalAmount>') END,
    CASE o.o_orderkey % 4 WHEN 0 THEN '<kprq>20240105</kprq>' WHEN 1 THEN '<IssueDateTime>2024-02-30T10:00</IssueDateTime>' WHEN 2 THEN '<n:开票日期>2024年3月4日</n:开票日期>' ELSE '' END,
    CASE WHEN o.o_orderkey % 2 = 0 THEN CONCAT('<xmmc>pen</xmmc><n:xmmc>ink</n:xmmc><GoodsName>desk ', CAST(o.o_orderkey % 3 AS STRING), '</GoodsName>') ELSE '' END,
    CASE WHEN o.o_orderkey % 16 = 0 THEN '<ItemName>a</ItemName><ItemName>b</ItemName><ItemName>c</ItemName>' ELSE '' END, CASE WHEN o.o_orderkey % 11 = 0 THEN '' ELSE '</n:Invoice>' END) AS raw_text
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "candidates": """
SELECT l_orderkey * 10 + l_linenumber AS cand_id, l_suppkey % 50 + 1 AS user_id,
  CASE WHEN l_partkey % 10 = 0 THEN '' WHEN l_partkey % 10 < 4 THEN CAST(10000000 + l_orderkey AS STRING) WHEN l_partkey % 10 = 4 THEN CONCAT('2024', LPAD(CAST(l_orderkey AS STRING), 16, '0')) ELSE CONCAT('A', CAST(l_partkey AS STRING)) END AS invoice_no,
  CASE WHEN l_linenumber = 1 THEN '未知' ELSE CONCAT('Buyer ', CAST(l_partkey % 30 AS STRING)) END AS buyer,
  CASE WHEN l_linenumber = 2 THEN CAST(NULL AS STRING) ELSE CONCAT('Seller ', CAST(l_suppkey AS STRING)) END AS seller,
  CASE WHEN l_partkey % 9 = 0 THEN CAST(0.01 AS DECIMAL(12,2)) WHEN l_partkey % 9 = 1 THEN CAST(NULL AS DECIMAL(12,2)) ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS amount,
  CASE WHEN l_partkey % 11 = 0 THEN CAST(NULL AS DATE) ELSE CAST(l_shipdate AS DATE) END AS invoice_date,
  CASE l_linenumber WHEN 1 THEN '电子发票（铁路电子客票）' WHEN 2 THEN '数电普票(补)' WHEN 3 THEN '01' WHEN 4 THEN '收据' WHEN 5 THEN '' ELSE '增值税专用发票' END AS invoice_type,
  CASE WHEN l_partkey % 3 = 0 THEN CAST(NULL AS STRING) WHEN l_partkey % 37 = 0 THEN '加微信 abcdef1' ELSE CONCAT('Part ', CAST(l_partkey AS STRING)) END AS item_summary,
  CASE WHEN l_partkey % 8 = 0 THEN '' WHEN l_partkey % 8 = 1 THEN '铁路客运' ELSE '发票号码 税率 价税合计 数电专票' END AS raw_text,
  CASE WHEN l_partkey % 4 = 0 THEN 'qr' WHEN l_partkey % 4 = 1 THEN 'xml_xpath' ELSE 'regex' END AS extraction_method,
  CAST(l_partkey % 101 AS DOUBLE) / 100 AS confidence, l_linenumber % 2 = 0 AS is_vat_document,
  CASE WHEN l_partkey % 6 = 0 THEN CAST(NULL AS BOOLEAN) ELSE l_partkey % 6 < 3 END AS x_valid,
  CASE WHEN l_partkey % 5 = 0 THEN 'receipt' ELSE 'vat_invoice' END AS x_category,
  CASE WHEN l_partkey % 7 = 0 THEN '未知' ELSE 'X Buyer' END AS x_buyer, CAST(CASE WHEN l_partkey % 13 = 0 THEN 0.05 WHEN l_partkey % 13 = 1 THEN 0.00 ELSE l_quantity END AS DECIMAL(12,2)) AS x_amount,
  CASE WHEN l_partkey % 8 = 3 THEN '' ELSE 'X Seller' END AS x_seller, CONCAT('X ', CAST(l_partkey % 4 AS STRING)) AS x_item_summary, CASE WHEN l_partkey % 9 = 2 THEN '未知' ELSE '数电专票' END AS x_invoice_type,
  CASE WHEN l_partkey % 12 = 1 THEN '' ELSE CONCAT('9', CAST(1000000 + l_orderkey AS STRING)) END AS x_invoice_no, CAST('2024-03-04' AS DATE) AS x_invoice_date, CAST(l_partkey % 90 AS DOUBLE) / 100 AS x_confidence,
  l_shipdate AS received_at, CONCAT('m', CAST(l_orderkey AS STRING)) AS email_uid, CONCAT('file', CAST(l_linenumber AS STRING), '.pdf') AS filename
FROM {lineitem}""",
    "listing": """
SELECT path, COUNT(*) AS n, SUM(size) AS size FROM (
  SELECT CONCAT(CAST(p_partkey % 60 + 1 AS STRING), '/', CAST(p_partkey % 700 AS STRING), '.pdf') AS path, p_size AS size FROM {part}
  UNION ALL SELECT CONCAT('users/', CAST(p_partkey % 60 + 1 AS STRING), '/invoices/', CAST(p_partkey % 350 AS STRING), '.pdf'), p_size FROM {part}
  UNION ALL SELECT CONCAT('users/', CAST(p_partkey * 7 AS STRING), CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END, '/invoices/a.pdf'), p_size FROM {part}) f GROUP BY path""",
    "attachments": """
SELECT e.email_id, e.attachment AS filename, 0 AS position, p.raw_text, p.qr, 'pdf' AS source_format FROM ({emails}) e JOIN ({parse_texts}) p ON p.id = e.email_id WHERE e.attachment IS NOT NULL AND e.attachment <> 'data.xml'
UNION ALL SELECT e.email_id, e.attachment, 0, x.raw_text, '', 'xml' FROM ({emails}) e JOIN ({xml_texts}) x ON x.id = e.email_id WHERE e.attachment = 'data.xml'
UNION ALL SELECT e.email_id, e.attachment2, 1, CONCAT('copy ', p.raw_text), '', 'ofd' FROM ({emails}) e JOIN ({parse_texts}) p ON p.id = e.email_id WHERE e.attachment2 IS NOT NULL AND e.attachment2 <> e.attachment""",
    "correction_logs": """
SELECT event_id AS id, user_id % 50 + 1 AS user_id, event_id % 1000 + 1 AS invoice_id, event_type AS field_name, CAST(event_id AS STRING) AS new_value, ts AS corrected_at FROM {events}""",
    "webhook_logs": """
SELECT event_id AS id, user_id % 50 + 1 AS user_id, 'invoice.created' AS event, CAST(200 + user_id * 3 AS INT) AS status_code, ts AS created_at FROM {events}""",
    "app_settings": """
SELECT n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN '' WHEN n_nationkey % 3 = 1 THEN CAST(NULL AS STRING) ELSE 'set' END AS value FROM {nation}""",
    "llm_cache": """
SELECT p_partkey AS id, CONCAT('h', CAST(p_partkey AS STRING)) AS content_hash, CASE WHEN p_partkey % 3 = 0 THEN 'classify' WHEN p_partkey % 3 = 1 THEN 'analyze_email_v3' ELSE 'extract_invoice' END AS prompt_type,
  p_name AS response_json, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE CAST('2024-01-01 00:00:00' AS TIMESTAMP) + p_size * INTERVAL '1' DAY END AS expires_at
FROM {part}""",
    "saved_views": """
SELECT s_suppkey + 1 AS id, s_suppkey % 50 + 1 AS user_id, s_name AS name, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at,
  CASE WHEN s_suppkey % 3 = 0 THEN '{}' WHEN s_suppkey % 9 = 4 THEN CONCAT('{"q": "Seller ', CAST(s_suppkey % 23 AS STRING), '", "date_from": "1995-02-01"}') WHEN s_suppkey % 9 = 5 THEN '{"q": "no-such-word"}' WHEN s_suppkey % 3 = 1 THEN CONCAT('{"q": "", "date_from": "199', CAST(s_suppkey % 5 + 5 AS STRING), '-03-01", "date_to": null}') ELSE CONCAT('{"date_from": "1996-01-01", "date_to": "199', CAST(s_suppkey % 4 + 6 AS STRING), '-12-31"}') END AS filter_json
FROM {supplier}""",
    "sessions": """
SELECT event_id AS id, user_id + 1 AS user_id, CONCAT('t', CAST(event_id AS STRING)) AS token_hash, ts AS created_at, ts + CAST(FLOOR(value) AS INT) * INTERVAL '1' HOUR AS expires_at,
  CASE WHEN event_type = 'error' THEN ts ELSE CAST(NULL AS TIMESTAMP) END AS revoked_at
FROM {events}""",
    "folders": """
SELECT n_nationkey AS id, n_name AS folder, n_nationkey * 4 + 1 AS account_id, CASE WHEN n_nationkey % 7 = 0 THEN '\\\\Drafts' WHEN n_nationkey % 7 = 1 THEN '\\\\HasNoChildren' WHEN n_nationkey % 7 = 2 THEN '\\\\ALL' ELSE '' END AS flag,
  CASE WHEN n_nationkey % 9 = 0 THEN 'drafts' WHEN n_nationkey % 9 = 1 THEN 'deleteditems' ELSE LOWER(n_name) END AS well_known, n_nationkey % 6 AS items, n_nationkey % 11 = 5 AS is_search,
  CAST(n_nationkey * 44 + 12 AS STRING) AS uidnext, CAST(n_nationkey * 4 + n_nationkey % 2 AS STRING) AS messages, CASE WHEN n_nationkey % 5 = 4 THEN '8' ELSE '7' END AS uidvalidity
FROM {nation}""",
}


def resolved(name: str, where) -> str:
    """The SQL of a fixture; where(base table) gives the text that stands for it."""
    return re.sub(r"\{(\w+)\}(?!\})", lambda m: where(m[1]) if m[1] in BASE else resolved(m[1], where) if m[1] in SQL else m[0], SQL[name])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a given table, as a DataFrame."""
    ship(spark)
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(resolved(name, lambda base: f"parquet.`{sf_dir}/{base}.parquet`").strip().replace("\\\\", "\\\\"))


def oracle(text: str) -> str:
    """An oracle query, with {fixture} for the fixture's SELECT."""
    def sub(m):
        if m[1] in SQL:
            return "(" + resolved(m[1], lambda base: base).strip().replace("\\\\", "\\") + ")"
        return m[0]

    return re.sub(r"\{(\w+)\}", sub, text)
