"""XML documents in the intake, names of files, hints, and answers that are kept between runs."""

import datetime
import json
import os
import sys
from decimal import Decimal

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docspend.functions.xml import record
from docspend.operators import dml, intake, windows
from docspend.sources import pluggable

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have the tests

INVOICE = """<?xml version="1.0" encoding="{e}"?><Invoice><InvoiceNo>{no}</InvoiceNo><BuyerName>购买 公司</BuyerName><SellerName>销售公司</SellerName>
<InvoiceType>增值税专用发票</InvoiceType><TaxInclusiveTotalAmount>1,020.30</TaxInclusiveTotalAmount><InvoiceDate>2024-03-04</InvoiceDate><GoodsName>a</GoodsName></Invoice>"""
UPLOAD = "upload_id long, user_id long, account_id long, filename string, raw_text string, qr string, source_format string, content binary"
STORED = "user_id long, invoice_no string, file_path string"


def texts(document):
    return {k: v for k, v in record(document).items() if v}


def test_first_text_by_tag():
    assert texts("<r><InvoiceNo/><n:fpHm xmlns:n='u'> 12 </n:fpHm><FPHM>13</FPHM></r>") == {"invoice_no": "12"}
    assert texts("<r xmlns:n='u'><n:InvoiceNo>1</n:InvoiceNo><a><InvoiceNo>2</InvoiceNo></a></r>") == {"invoice_no": "2"}
    assert texts("<r xmlns='u'><InvoiceNo>1</InvoiceNo><InvoiceNo>2</InvoiceNo></r>") == {"invoice_no": "1"}
    assert texts("<InvoiceNo>7</InvoiceNo>") == {"invoice_no": "7"}
    assert record("<r><BuyerName> </BuyerName><gmfMc>x</gmfMc></r>")["buyer"] == ""
    assert texts("<r><BuyerName>A &amp; B<![CDATA[ <C>]]></BuyerName><XSFMC>a<b/>c</XSFMC></r>") == {"buyer": "A & B <C>", "seller": "a"}


def test_items_follow_the_tags_and_end_at_five():
    doc = "<r>" + "".join(f"<xmmc>x{i}</xmmc>" for i in range(4)) + "<GoodsName>g</GoodsName><ItemName>i</ItemName><ItemName/></r>"
    assert record(doc)["items"] == ["g", "x0", "x1", "x2", "x3"]


def test_bytes_broken_documents_and_entities():
    assert texts(INVOICE.format(e="GBK", no=5).encode("gbk"))["buyer"] == "购买 公司"
    assert texts("<r><BuyerName>购买</BuyerName></r>".encode("gbk")) == {"buyer": "购买"}
    assert texts("<r><BuyerName>购买</BuyerName></r>".encode("utf-8-sig")) == {"buyer": "购买"}
    assert texts("<?xml version='1.0' encoding='no-such'?><r><BuyerName>x</BuyerName></r>".encode()) == {"buyer": "x"}
    assert record(b"<r><BuyerName>x</r>") is None and record("") is None and record(None) is None
    assert texts("<!DOCTYPE r [<!ENTITY e 'zz'>]><r><BuyerName>x&e;y</BuyerName></r>") == {"buyer": "x"}


def uploads(spark, rows):
    return spark.createDataFrame(rows, UPLOAD)


def test_xml_uploads(spark):
    gbk = INVOICE.format(e="GBK", no="12345678").encode("gbk")
    rows = [
        (1, 5, 9, "a.XML", None, "", "xml", gbk), (2, 5, 9, "b.xml", INVOICE.format(e="UTF-8", no="12345679"), "01,04,1,99999999,5.00,20240101,x", "xml", None),
        (3, 5, 9, "c.xml", INVOICE.format(e="UTF-8", no="12345678"), "", "xml", None), (4, 5, 9, "d.xml", "<broken", "", "xml", None)
    ]
    done = intake.upload_intake(uploads(spark, rows), spark.createDataFrame([], STORED), "2024-05-01")
    found = {r.email_uid: r for r in done.invoices.collect()}
    assert set(found) == {"manual:1", "manual:2"}
    one = found["manual:1"]
    assert (one.invoice_no, one.buyer, one.amount, one.invoice_date, one.item_summary) == ("12345678", "购买 公司", Decimal("1020.30"), datetime.date(2024, 3, 4), "a")
    assert (one.extraction_method, one.confidence, one.source_format) == ("xml_xpath", 1.0, "xml")
    assert one.file_path == "users/5/invoices/购买 公司_销售公司_12345678_20240304_1020.30.xml"
    log = {r.attachment_filename: r for r in done.audit.collect()}
    assert {k: (r.outcome, r.email_uid, r.parse_method) for k, r in log.items()} == {
        "a.XML": ("manual_upload_saved", None, "xml_xpath"), "b.xml": ("manual_upload_saved", None, "xml_xpath"), "c.xml": ("duplicate", None, "xml_xpath"),
        "d.xml": ("not_vat_invoice", None, "xml_xpath")
    }


def test_names_that_are_taken_get_numbers(spark):
    rows = spark.createDataFrame([(i, "users/1/invoices/", "a_1.00", s) for i, s in enumerate([".pdf", ".pdf", ".pdf", ".xml"])], "i long, folder string, stem string, suffix string")
    stored = spark.createDataFrame([(f"users/{u}/invoices/{n}",) for u, n in ((1, "a_1.00.pdf"), (1, "a_1.00_2.pdf"), (2, "a_1.00.xml"), (1, "a_1.00_1_.pdf"))] + [("1/old.pdf",), (None,)], "file_path string")
    got = {r.i: r.file_path.rpartition("/")[2] for r in windows.free_paths(rows, stored, "i").collect()}
    assert got == {0: "a_1.00_1.pdf", 1: "a_1.00_3.pdf", 2: "a_1.00_4.pdf", 3: "a_1.00.xml"}


def test_hints_that_repeat_a_format(spark):
    names = ["a.pdf", "b.ofd", "c.xml", "d"]
    rows = spark.createDataFrame([(1, i, n, h) for h in (["pdf", "XML", "pdf"],) for i, n in enumerate(names)], "key long, at int, filename string, hints array<string>")
    got = [r.filename for r in windows.prioritise(rows, "key", "at", hints="hints").orderBy("turn").collect()]
    assert got == ["c.xml", "a.pdf", "b.ofd", "d"]


class Counted:
    """A function that leaves a file for every text it is given."""

    def __init__(self, folder, answer):
        self.folder, self.answer = str(folder), answer

    def __call__(self, given):
        for text in given:
            with open(os.path.join(self.folder, f"{os.getpid()}-{len(os.listdir(self.folder))}-{abs(hash(text))}"), "w"):
                pass
        return [self.answer(text) for text in given]

    def calls(self):
        return len(os.listdir(self.folder))


def test_each_text_is_asked_once_and_expired_answers_again(spark, tmp_path):
    fn = Counted(tmp_path, lambda text: None if text == "bad" else text.upper())
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "bad"), (5, None), (6, "c")], "i long, raw_text string")
    hashes = {t: spark.range(1).select(pluggable.content_hash("extract", F.lit(t)).alias("h")).first().h for t in "abc"}
    at = lambda day: datetime.datetime(2024, 1, day)
    cache = spark.createDataFrame(
        [(hashes["b"], "old", at(1), at(3)), (hashes["c"], "older", at(1), None), (hashes["c"], "kept", at(2), at(20))], "content_hash string, response_json string, created_at timestamp, expires_at timestamp"
    )
    found = pluggable.ask(rows, fn, "2024-01-10", cache)
    want = {1: "A", 2: "A", 3: "B", 4: None, 5: None, 6: "kept"}
    for _ in range(2):  # reading the rows again asks nothing
        assert [(r.i, r.response) for r in found.rows.orderBy("i").collect()] == sorted(want.items())
    assert fn.calls() == 3
    learned = {r.content_hash: (r.prompt_type, r.response_json, r.expires_at) for r in found.learned.collect()}
    assert learned == {hashes["a"]: ("extract", "A", datetime.datetime(2025, 1, 9)), hashes["b"]: ("extract", "B", datetime.datetime(2025, 1, 9))}
    after = dml.remember_answers(cache, found.learned, "2024-01-10")
    assert sorted(r.response_json for r in after.collect()) == ["A", "B", "kept", "older"]
    again = pluggable.ask(rows.where("i <> 4"), fn, "2024-01-10", after)
    assert {r.i: r.response for r in again.rows.collect()} == {k: v for k, v in want.items() if k != 4}
    assert fn.calls() == 3 and again.learned.isEmpty()


MAIL = "email_id long, user_id long, account_id long, folder string, uid string, uidvalidity string, message_id string, subject string, from_addr string, body_text string, received_at timestamp, attachments array<string>, links array<string>, headers map<string,string>"


def mail(spark):
    day = datetime.datetime(2024, 1, 1)
    row = lambda i, subject, names, links: (i, 1, 2, "INBOX", str(i), "v", f"<{i}@x>", subject, "a@b.example", "text", day, names, links, None)
    messages = [
        row(1, "yes, links, hints", ["a.pdf", "a.xml"], ["https://b.example/f"]), row(2, "yes, links, refused", ["b.pdf"], ["https://b.example/g"]),
        row(3, "yes, no links", ["c.pdf", "c.xml"], []), row(4, "invoice? undecided", [], ["https://b.example/h"]), row(5, "yes, links, said no", ["e.xml"], ["https://b.example/i"]),
    ]
    doc = lambda i, name, no: (i, name, INVOICE.format(e="UTF-8", no=no), "", "xml")
    pdf = lambda i, name, no: (i, name, f"电子发票（普通发票） 发票号码：{no}\n开票日期: 2024年3月4日\n购买方 名称：A\n销售方 名称：B\n税率 税额 价税合计（大写）x ￥12.00", "", "pdf")
    documents = [pdf(1, "a.pdf", 10000001), doc(1, "a.xml", 10000001), pdf(2, "b.pdf", 10000002), pdf(3, "c.pdf", 10000003), doc(3, "c.xml", 10000003), doc(5, "e.xml", 10000005)]
    return spark.createDataFrame(messages, MAIL), spark.createDataFrame(documents, "email_id long, filename string, raw_text string, qr string, source_format string")


def verdict(text):
    if "refused" in text:
        return json.dumps({"is_invoice_related": True, "invoice_confidence": 0.9, "url_kind": "of another kind", "best_download_url": "u"})
    related = "said no" not in text and "undecided" not in text
    return json.dumps({"is_invoice_related": related, "invoice_confidence": 0.9, "extraction_hints": {"likely_formats": ["xml"]}} | ({} if related else {"skip_reason": "no"}))


@pytest.mark.parametrize("with_cache", [False, True])
def test_messages_with_links_are_read_for_hints(spark, tmp_path, with_cache):
    """The second time, with what the first run learned, nothing is asked but what had no valid answer."""
    messages, documents = mail(spark)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    analyser, extractor = Counted(tmp_path / "a", verdict), Counted(tmp_path / "b", lambda text: json.dumps({"buyer": "X", "seller": "Y", "invoice_no": "1", "invoice_date": "2024-01-01", "amount": "5", "item_summary": "s", "invoice_type": "数电专票", "is_valid_tax_invoice": True}))
    state = spark.createDataFrame([], "account_id long, folder string, last_uid string, validity string")
    logs = spark.createDataFrame([], "user_id long, email_uid string, attachment_filename string")
    stored = spark.createDataFrame([], STORED)
    run = lambda cache: intake.mail_intake(messages, documents, state, logs, stored, "2024-05-01", [], analyser, extractor, cache)
    done = run(None)
    log = {(r.email_uid, r.attachment_filename): (r.outcome, r.classification_tier) for r in done.audit.collect()}
    assert log == {
        ("1", "a.xml"): ("saved", 1), ("1", "a.pdf"): ("duplicate", 1), ("2", None): ("error", 1), ("3", "c.pdf"): ("saved", 1), ("3", "c.xml"): ("duplicate", 1),
        ("4", None): ("not_invoice", 3), ("5", "e.xml"): ("saved", 1)
    }
    asked = analyser.calls(), extractor.calls()
    assert asked == (4, 2)  # of the documents the two PDF texts lack a type
    if with_cache:
        empty = spark.createDataFrame([], "content_hash string, prompt_type string, response_json string, created_at timestamp, expires_at timestamp")
        cache = dml.remember_answers(empty, done.cache, "2024-05-01")
        again = run(cache)
        assert {(r.email_uid, r.attachment_filename): (r.outcome, r.classification_tier) for r in again.audit.collect()} == log
        assert (analyser.calls(), extractor.calls()) == (5, 2)


def test_documents_are_parsed_by_all_tasks(spark):
    """One row group of orders was one task, which parsed all of them."""
    from docspend.plans.all import QUERIES

    found = QUERIES["fn_16_xml_invoice"](spark, "/root/testdata/sf0.001").select("invoice_no", F.spark_partition_id().alias("task"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(id" in plan.split("EvalPython")[1]
