"""Literal inputs with known results: functions, corrections, sinks, sources, streams."""

import datetime
import hashlib
import hmac
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docspend import sinks
from docspend.functions import parse as P
from docspend.functions import state as ST
from docspend.functions import text as T
from docspend.operators import dml as D
from docspend.operators import filters as L
from docspend.search import vectors as V
from docspend.sources import pluggable, readers
from docspend.streaming import ingest as G

c = F.col


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "reason"),
    [("", None), ("hello", None), ("代开发票请联系", "scam phrase: 代开"), ("WeChat: abc_12345", "wechat/qq contact inline"), ("1 3/8-0 . 1 2", "obfuscated phone/contact digits"), ("order 12345", None)],
)
def test_scam_reason(spark, text, reason):
    assert one(spark, T.scam_reason(c("t")), t=text) == reason


@pytest.mark.parametrize(
    ("sender", "trusted"),
    [("A <billing@x.com>", True), ("notbilling@x.com", False), ("a@pay.d.com", True), ("a@d.com", True), ("a@bad.com", False), ("Some LEGACY name <q@z.org>", True), ("a@sub.plain.org", True)],
)
def test_trusted_senders(spark, sender, trusted):
    assert one(spark, T.is_trusted(c("s"), ["billing@x.com", "@d.com", "legacy", "plain.org"]), s=sender) is trusted


@pytest.mark.parametrize(
    ("raw", "day"),
    [
        ("20240115", datetime.date(2024, 1, 15)), ("2024-1-5 x", datetime.date(2024, 1, 5)), ("2024年03月04日", datetime.date(2024, 3, 4)),
        ("2024-02-30", None), ("soon", None)
    ]
)
def test_qr_dates(spark, raw, day):
    assert one(spark, P.qr_date(c("d")), d=raw) == day


def test_fields_of_a_document(spark):
    text = "电子发票\n发票号码：12345678\n开票日期：2024年5月6日\n购 买 方信息 名称：Buyer Ltd\n销售方 名称: Seller Inc 纳税人\n价税合计（大写）壹仟 ￥1,234.50"
    f = P.fields(c("t"))
    got = one(spark, F.struct(*(v.alias(k) for k, v in f.items())), t=text)
    assert got.asDict() == {
        "invoice_no": "12345678", "invoice_date": datetime.date(2024, 5, 6), "buyer": "Buyer Ltd", "seller": "Seller Inc",
        "amount": Decimal("1234.50")
    }
    score = P.confidence(f["invoice_no"], f["buyer"], f["seller"], f["amount"], f["invoice_date"], F.lit(None).cast("string"))
    assert one(spark, score, t=text) == Decimal("0.90")


@pytest.mark.parametrize(("name", "clean"), [("a/b:c", "a_b_c"), ("__x__", "x"), ("", "unknown"), ("***", "unknown"), ("y" * 60, "y" * 40)])
def test_safe_component(spark, name, clean):
    assert one(spark, P.safe_component(c("n")), n=name) == clean


@pytest.mark.parametrize(
    ("raw", "folders"),
    [
        (None, []), ("", []), ("42", [("INBOX", "42")]), ("[1]", [("INBOX", "[1]")]), ('{"A": {"uid": "5"}, "B": {}}', [("A", "5"), ("B", "")]),
        ('{"A": "x"}', [("INBOX", '{"A": "x"}')])
    ]
)
def test_saved_state(spark, raw, folders):
    state = one(spark, ST.parse_state(c("s")), s=raw)
    assert sorted((k, v.uid) for k, v in state.items()) == folders


def test_corrections(spark):
    rows = spark.createDataFrame(
        [(1, 9, "a", "s", Decimal("1.00"), False), (2, 9, "b", "s", Decimal("2.00"), False)],
        "id long, user_id long, buyer string, seller string, amount decimal(12,2), is_manually_corrected boolean"
    )
    edits = spark.createDataFrame([(1, "new", Decimal("1.00")), (3, "none", None)], "id long, buyer string, amount decimal(12,2)")
    after, log, rejected = D.apply_corrections(rows, edits)
    assert rejected.count() == 0
    assert [(r.buyer, r.is_manually_corrected) for r in after.orderBy("id").collect()] == [("new", True), ("b", False)]
    assert [tuple(r) for r in log.collect()] == [(1, 9, "buyer", "a", "new")]


def test_signature(spark):
    for secret in ("k", "long" * 40):
        assert one(spark, sinks.hmac_sha256(secret, c("m")), m="{}é") == hmac.new(secret.encode(), "{}é".encode(), hashlib.sha256).hexdigest()


def test_csv_has_a_mark_and_quotes(spark, tmp_path):
    values = ("1", 'B "q"', "S", Decimal("1.00"), datetime.date(2024, 1, 2), "t", "c", None, "pdf", "qr", 0.5, datetime.datetime(2024, 1, 2, 3, 4, 5, 600))
    kinds = "invoice_no string, buyer string, seller string, amount decimal(12,2), invoice_date date, invoice_type string, invoice_category string, item_summary string, source_format string, extraction_method string, confidence double, created_at timestamp"
    sinks.export_csv(spark.createDataFrame([values], kinds), f"{tmp_path}/out", one_file=True)
    text = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    header = text.decode("utf-8-sig").splitlines()[0]
    assert header == "invoice_no,buyer,seller,amount,invoice_date,invoice_category,invoice_type,item_summary,extraction_method,confidence,created_at"
    assert text.startswith(b"\xef\xbb\xbfinvoice_no,buyer") and b"2024-01-02T03:04:05.000600" in text and b'"B ""q"""' in text and b"2024-01-02" in text


def test_landed_documents(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1", "b.xml": b"\xef\xbb\xbf<?xml v", "c.ofd": b"PK\x03\x04x", "d.txt": b"hello", "empty.pdf": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: (r.format, r.reason) for r in readers.scan_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("pdf", None), "b.xml": ("xml", None), "c.ofd": ("ofd", None), "d.txt": (None, "unknown format")}


def test_plugged_source_and_extractor(spark):
    def make(options, part, of):
        for i in range(int(options["n"])):
            if i % of == part:
                yield {"uid": str(i), "body_text": f"text {i % 2}"}
        yield {"state": f"{part}:{options.get('since', '')}:{options['n']}"}

    pluggable.register_source(spark, "test_mail", make, parts=2)
    mail, state = pluggable.split_state(spark.read.format("test_mail").option("n", 6).option("since", "s").load())
    assert sorted(r.uid for r in mail.collect()) == list("012345")
    assert sorted(r.state for r in state.collect()) == ["0:s:6", "1:s:6"]

    def extract(texts):
        if any("1" in x for x in texts):
            raise ValueError
        return [x.upper() for x in texts]

    got = {(r.uid, r.response) for r in pluggable.analyse(mail, extract).collect()}
    assert got == {(str(i), "TEXT 0" if i % 2 == 0 else None) for i in range(6)}
    vectors = pluggable.embed(mail.withColumn("text", c("body_text")), lambda texts: [[float(len(x))] for x in texts])
    assert {r.embedding[0] for r in vectors.collect()} == {6.0}


def test_validity_change_reads_a_folder_again(spark):
    messages = spark.createDataFrame(
        [(1, "A", "5", "v2"), (1, "A", "9", "v2"), (1, "B", "3", "v1"), (1, "B", "10", "v1")],
        "account_id long, folder string, uid string, uidvalidity string"
    )
    state = spark.createDataFrame(
        [(1, "A", "9", "v1"), (1, "B", "9", "v1"), (1, "C", "7", "v1")], "account_id long, folder string, last_uid string, validity string"
    )
    fresh, seen = G.ingest_increment(messages, state)
    assert sorted((r.folder, r.uid) for r in fresh.collect()) == [("A", "5"), ("A", "9"), ("B", "10")]
    assert sorted((r.folder, r.last_uid, r.validity) for r in seen.collect()) == [("A", "9", "v2"), ("B", "10", "v1"), ("C", "7", "v1")]


def test_streams(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(f"m{i % 3}", day + datetime.timedelta(minutes=i), "purchase" if i % 2 else "error") for i in range(6)]
    frame = spark.createDataFrame(rows, "message_id string, received_at timestamp, event_type string")
    frame.write.parquet(f"{tmp_path}/in")
    stream = G.stream_of(spark, f"{tmp_path}/in", frame.schema)
    once = G.dedup_stream(stream)
    keep = lambda df, earlier: {"kept": df.withColumn("outcome", F.lit("saved"))}
    G.run_stream(once, keep, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    out = spark.read.parquet(f"{tmp_path}/out/kept")
    assert sorted(r.message_id for r in out.collect()) == ["m0", "m1", "m2"]
    G.run_stream(once, keep, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out/kept").count() == 3
    counts = G.progress_stream(stream.withColumn("ts", c("received_at")))
    running = counts.writeStream.format("memory").queryName("progress").outputMode("update").start()
    running.processAllAvailable()
    running.stop()
    assert [(r.processed, r.found, r.errors) for r in spark.table("progress").collect()] == [(6, 3, 3)]


def test_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 3)
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "id long, embedding array<float>")
    got = V.knn(rows, rows.where("id = 4"), 3).orderBy("place").collect()
    assert [(r.id, r.distance) for r in got] == [(3, 1.0), (5, 1.0), (2, 2.0)]


def test_pages_and_tenants(spark):
    rows = spark.createDataFrame([(i, i % 2, datetime.date(2024, 1, 1 + i % 3)) for i in range(10)], "id long, user_id long, invoice_date date")
    assert [r.id for r in L.page_invoices(L.scoped(rows, 0), 0, 2).collect()] == [8, 2]
    assert [r.id for r in L.by_ids(rows, [4, 1, 4, 77], 0).collect()] == [4, 4]
    assert L.scoped(rows, 99).count() == 0


WIDE_SPACE = "\u3000"


def test_fields_with_wide_characters(spark):
    text = f"发票号码：{WIDE_SPACE}12345678\n开票日期：{WIDE_SPACE}２０２４年{WIDE_SPACE}1月０５日\n购买方 名称：{WIDE_SPACE}甲公司{WIDE_SPACE}\n销{WIDE_SPACE}售方名称:乙 统一\n合{WIDE_SPACE}计 ￥{WIDE_SPACE}１,２３４.５０\n"
    got = one(spark, F.struct(*(v.alias(k) for k, v in P.fields(c("t")).items())), t=text)
    assert got.asDict() == {"invoice_no": "12345678", "invoice_date": datetime.date(2024, 1, 5), "buyer": "甲公司", "seller": "乙", "amount": Decimal("1234.50")}


@pytest.mark.parametrize(
    ("text", "reason"), [(f"微信{WIDE_SPACE}abcde1", "wechat/qq contact inline"), (f"１{WIDE_SPACE}３ ８ ０ ０", "obfuscated phone/contact digits")]
)
def test_scam_with_wide_characters(spark, text, reason):
    assert one(spark, T.scam_reason(c("t")), t=text) == reason


@pytest.mark.parametrize(
    "text",
    [
        "&#8364;&#x4E2D;&eacute; &amp;lt; &ampx &notit; &copy2", "&#0;&#128;&#xD800;&#1114112;&#99999999999;", "&unknown; & &; a&b &nbsp;z",
        "&ngE;&#38;amp;", "&#x;&#;", "&#x1F600;&#65"
    ]
)
def test_references_decode_as_in_browsers(spark, text):
    import html

    assert one(spark, T.unescape(c("t")), t=text) == html.unescape(text)
    page = f"<p>{WIDE_SPACE}{text}</p>\u00a0"
    import re

    assert one(spark, T.html_to_text(c("t")), t=page) == re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", page))).strip()


@pytest.mark.parametrize(
    ("text", "at"),
    [("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05.5+08:00", "2024-01-01 19:04:05.500000"), ("2024-01-02T03:04:05", "2024-01-02 03:04:05"), ("Mon, 01 Jan 2024 03:04:05 +0800", "2023-12-31 19:04:05"), ("1 Jan 2024 03:04:05 GMT", "2024-01-01 03:04:05"), ("soon", None)],
)
def test_instants(spark, text, at):
    got = one(spark, T.instant(c("t")), t=text)
    assert (str(got) if got else None) == at


def test_a_corrected_number_must_be_free(spark):
    rows = spark.createDataFrame(
        [(1, 9, "A", False), (2, 9, "B", False), (3, 9, "C", False), (4, 8, "D", False)],
        "id long, user_id long, invoice_no string, is_manually_corrected boolean"
    )
    edits = spark.createDataFrame([(1, "B"), (2, "N"), (3, "N"), (4, "A")], "id long, invoice_no string")
    after, log, rejected = D.apply_corrections(rows, edits)
    assert [(r.id, r.invoice_no) for r in after.orderBy("id").collect()] == [(1, "A"), (2, "N"), (3, "C"), (4, "A")]  # another tenant's A is no collision
    assert sorted(r.id for r in rejected.collect()) == [1, 3] and log.count() == 2


def test_typed_tables(spark, tmp_path):
    from docspend.schemas import TABLES

    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    tables = readers.load_tables(spark, str(tmp_path))
    assert set(tables) == set(TABLES) and all(df.count() == 0 for df in tables.values())
    assert "has_totp_secret" in L.account_view(tables["email_accounts"]).columns
    assert L.log_view(tables["scan_logs"]).count() == L.extraction_view(tables["extraction_logs"]).count() == 0


CANDIDATE = "cand_id long, user_id long, invoice_no string, buyer string, seller string, amount decimal(12,2), invoice_date date, invoice_type string, item_summary string, raw_text string, extraction_method string, confidence double, is_vat_document boolean, received_at timestamp, email_uid string"
EXTRACTED = "x_valid boolean, x_category string, x_buyer string, x_seller string, x_item_summary string, x_invoice_type string, x_invoice_no string, x_invoice_date date, x_amount decimal(12,2), x_confidence double"


def judged_one(spark, policy, given=(), answer=()):
    plain = {
        "cand_id": 1, "user_id": 1, "invoice_no": None, "buyer": None, "seller": None, "amount": None, "invoice_date": None, "invoice_type": None,
        "item_summary": None, "raw_text": "text", "extraction_method": "regex", "confidence": 0.7, "is_vat_document": False, "received_at": None,
        "email_uid": "m"
    }
    extracted = {
        "x_valid": True, "x_category": "vat_invoice", "x_buyer": "XB", "x_seller": "未知", "x_item_summary": "XS", "x_invoice_type": "数电专票",
        "x_invoice_no": "X1", "x_invoice_date": datetime.date(2024, 5, 6), "x_amount": Decimal("5.00"), "x_confidence": 0.8
    }
    row = plain | dict(given) | extracted | dict(answer)
    from docspend.operators import intake as I

    return I.judged(spark.createDataFrame([tuple(row.values())], f"{CANDIDATE}, {EXTRACTED}"), policy).first()


def test_the_merge_takes_over_what_the_parser_lacks(spark):
    r = judged_one(spark, "upload", {"buyer": "B", "seller": "S", "amount": Decimal("0.01")})
    assert (
        r.buyer, r.seller, r.item_summary, r.invoice_type, r.invoice_no, r.invoice_date, r.amount, r.extraction_method, r.confidence
    ) == ("XB", "S", "XS", "数电专票", "X1", datetime.date(2024, 5, 6), Decimal("5.00"), "llm", 0.8)
    assert r.outcome is None and r.category == "vat_invoice"


def test_the_merge_keeps_what_the_parser_is_sure_of(spark):
    r = judged_one(spark, "mail", {"invoice_no": "12345678", "amount": Decimal("9.00"), "invoice_date": datetime.date(2023, 1, 1)})
    assert (r.invoice_no, r.amount, r.invoice_date) == ("12345678", Decimal("9.00"), datetime.date(2023, 1, 1))


def test_reasons_by_policy(spark):
    few = {"x_amount": Decimal("0.01")}
    assert judged_one(spark, "mail", answer=few).detail == "amount sentinel"
    assert judged_one(spark, "upload", answer=few | {"x_invoice_no": ""}).detail == "missing invoice_no"
    assert judged_one(spark, "mail", answer={"x_invoice_no": ""}).detail == "invoice_no missing"
    refused = judged_one(spark, "mail", answer={"x_valid": False})
    assert (refused.outcome, refused.detail) == ("not_vat_invoice", "type='' category='vat_invoice' llm_rejected=True")
    spam = judged_one(spark, "upload", answer={"x_buyer": "代开发票"})
    assert (spam.outcome, spam.audit, spam.detail) == ("scam_detected", "not_vat_invoice", "scam signal: scam phrase: 代开")


def test_a_ticket_without_an_amount_is_saved_on_upload_only(spark):
    ticket = {"invoice_no": "2" * 20, "invoice_type": "电子发票（铁路电子客票）", "amount": Decimal("0.01"), "confidence": 0.5}
    none = {"x_valid": None}
    assert judged_one(spark, "upload", ticket, none).outcome is None
    assert judged_one(spark, "mail", ticket, none).outcome == "low_confidence"


def test_latest_row_of_a_key_stays(spark):
    base = spark.createDataFrame([(1, "old"), (2, "two")], "id long, v string")
    delta = spark.createDataFrame([(1, "late", 9), (1, "early", 3), (3, "new", 1)], "id long, v string, at long")
    assert sorted(map(tuple, D.upsert_latest(base, delta, "id", "at").collect())) == [(1, "late"), (2, "two"), (3, "new")]


def test_neighbours_by_product_and_in_groups(spark, monkeypatch):
    import numpy as np

    data = np.random.default_rng(1).normal(size=(400, 16)).astype("float32")
    data[200:] = data[:200]  # every distance twice
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, embedding array<float>")
    exact = np.round(np.sqrt(((data[::20, None].astype("f8") - data[None].astype("f8")) ** 2).sum(axis=2)), 6)
    for higher in (False, True):
        want = {}
        for i, d in zip(range(0, 400, 20), exact):
            order = sorted((x, -j if higher else j) for j, x in enumerate(d) if j != i)
            want[i] = [abs(j) for _, j in order[:5]]
        for limit in (64 << 20, 0):
            monkeypatch.setattr(V, "BROADCAST", limit)
            got = V.knn(rows, rows.where("id % 20 = 0"), 5, higher_first=higher).orderBy("query_id", "place").collect()
            assert {i: [r.id for r in got if r.query_id == i] for i in want} == want


def test_incremental_stream_keeps_state(spark, tmp_path):
    kinds = "account_id long, folder string, uid string, uidvalidity string"
    (tmp_path / "in").mkdir()
    stream = G.ingest_stream(G.stream_of(spark, f"{tmp_path}/in", spark.createDataFrame([], kinds).schema))
    for rows in ([(1, "A", "5", "v1"), (1, "A", "9", "v1")], [(1, "A", "9", "v1"), (1, "A", "10", "v1"), (1, "B", "1", "v1")], [(1, "A", "3", "v2")]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
            "checkpointLocation", f"{tmp_path}/ck"
        ).trigger(availableNow=True).start().awaitTermination(60)
    got = sorted((r.folder, r.uid, r.uidvalidity) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("A", "10", "v1"), ("A", "3", "v2"), ("A", "5", "v1"), ("A", "9", "v1"), ("B", "1", "v1")]


def test_intake_stream_knows_earlier_batches(spark, tmp_path):
    from docspend.streaming.intake import intake_stream

    kinds = "email_id long, user_id long, account_id long, folder string, uid string, uidvalidity string, message_id string, subject string, from_addr string, body_text string, received_at timestamp, attachments array<string>, links array<string>, headers map<string,string>"
    text = "电子发票（普通发票）税率 价税合计 发票号码：12345678\n开票日期：2024年5月6日\n购买方 名称：B 纳税人\n销售方 名称: S 纳税人\n价税合计（大写）壹 ￥1,234.50"
    documents = spark.createDataFrame(
        [(i, "a.pdf", text, "", "pdf") for i in (1, 2)], "email_id long, filename string, raw_text string, qr string, source_format string"
    )
    logs = spark.createDataFrame([], "user_id long, email_uid string, attachment_filename string")
    stored = spark.createDataFrame([], "user_id long, invoice_no string")
    for i in (1, 2):
        row = (i, 7, 1, "INBOX", str(i), "v", f"<{i}>", "Invoice", "a@b.c", "", datetime.datetime(2024, 1, i), ["a.pdf"], [], {})
        spark.createDataFrame([row], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = G.stream_of(spark, f"{tmp_path}/in", spark.createDataFrame([], kinds).schema)
        intake_stream(source, documents, logs, stored, "2024-02-01", f"{tmp_path}/out", f"{tmp_path}/ck", trusted=[]).awaitTermination(120)
    saved = spark.read.parquet(f"{tmp_path}/out/invoices").collect()
    assert [(r.user_id, r.invoice_no, r.amount, r.email_uid) for r in saved] == [(7, "12345678", Decimal("1234.50"), "1")]
    audit = spark.read.parquet(f"{tmp_path}/out/audit").orderBy("email_uid").collect()
    assert [(r.email_uid, r.outcome) for r in audit] == [("1", "saved"), ("2", "duplicate")]


def test_page_text_decodes_the_references_of_its_sql_only(spark, tmp_path):
    import duckdb

    from docspend.plans.all import ORACLES, QUERIES

    pages = ["<p>a &amp b&amp", "&amp;lt; &lt;b&gt; &copy2 &copy; &eacute; &#39;x&#40;", "&&&amp;&nbsp; &middot;&quot;;", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = {r.page_id: r.text for r in QUERIES["fn_01_html_to_text"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(ORACLES["fn_01_html_to_text"]).fetchall())
