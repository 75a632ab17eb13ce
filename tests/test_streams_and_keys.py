"""Keyed tables, streams that go on from saved state, batches that fail on their way, one message table."""

import datetime

import pytest
from pyspark.sql import functions as F

from docspend.operators import intake, joins
from docspend.sources import readers
from docspend.streaming import ingest
from docspend.streaming import intake as flow
from docspend.streaming.keyed import KeyedTable


def test_rows_by_key_and_number(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "k long, v string", ["k"], latest=True, buckets=4, compact=3)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    read = lambda before, *met: sorted(map(tuple, table.read(before, rows(*((m, "") for m in met)) if met else None).collect()))
    assert read(9) == []
    for n in range(8):
        table.write(n, rows((n % 3, f"{n}"), (100 + n, "own")))
    assert read(99, 0, 1, 2, 103) == [(0, "6"), (1, "7"), (2, "5"), (103, "own")]
    assert read(6, 0, 1) == [(0, "3"), (1, "4")]
    assert len(read(99)) == 11
    names = {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")}
    assert "batch-0" not in names and {"base-5", "batch-6", "batch-7"} <= names
    table.write(7, rows((1, "again")))  # the batch that runs again replaces its own rows
    assert read(8, 1, 107) == [(1, "again")]


def test_only_buckets_of_the_keys_are_read(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "k long", ["k"], buckets=8)
    table.write(0, spark.range(200).select(F.col("id").alias("k")))
    plan = table.read(1, spark.range(1).select(F.col("id").alias("k")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("`", "")


MAIL = "account_id long, folder string, uid string, uidvalidity string"


def test_a_stream_goes_on_from_a_batch_run(spark, tmp_path):
    mail = lambda *rows: spark.createDataFrame(list(rows), MAIL)
    none = spark.createDataFrame([], "account_id long, folder string, last_uid string, validity string")
    _, state = ingest.ingest_increment(mail((1, "a", "9", "v"), (1, "a", "10", "v"), (1, "b", "7", "v")), none)
    landed, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def run():
        stream = ingest.ingest_stream(ingest.stream_of(spark, landed, mail((1, "", "", "")).schema), state)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.account_id, r.folder, r.uid) for r in spark.read.schema(stream.schema).parquet(out).collect())

    mail((1, "a", "10", "v"), (1, "a", "11", "v"), (1, "b", "6", "w"), (1, "c", "1", None), (2, "a", "1", "v")).write.mode("append").parquet(landed)
    first = [(1, "a", "11"), (1, "b", "6"), (1, "c", "1"), (2, "a", "1")]  # b has another validity
    assert run() == first
    mail((1, "a", "11", "v"), (1, "a", "12", "v"), (1, "b", "6", "w"), (2, "a", "2", "v")).write.mode("append").parquet(landed)
    assert run() == sorted([*first, (1, "a", "12"), (2, "a", "2")])
    stands = {(r.account_id, r.folder): (r.last_uid, r.validity) for r in ingest.stream_state(spark, mark).collect()}
    assert stands == {(1, "a"): ("12", "v"), (1, "b"): ("6", "w"), (1, "c"): ("1", ""), (2, "a"): ("2", "v")}


TEXT = "电子发票（普通发票） 发票号码：{no}\n开票日期: 2024年3月4日\n购买方 名称：A\n销售方 名称：B\n税率 税额 价税合计（大写）x ￥12.00"
RAW = "uid string, account_id long, folder string, uidvalidity string, message_id string, subject string, from_addr string, body_text string, body_html string, received_at timestamp, attachments array<string>"


def landed_mail(spark, *ids):
    """Messages of two accounts, each with an invoice; 7 repeats the number of 1."""
    rows = [(str(i), i % 2 + 1, "INBOX", "v", f"<{i}@x>", "s", "a@b.example", "t", "", datetime.datetime(2024, 1, 1), ["i.pdf"]) for i in ids]
    accounts = spark.createDataFrame([(1, 10), (2, 20)], "id long, user_id long")
    return readers.load_emails(spark.createDataFrame(rows, RAW), accounts)


def documents(spark):
    rows = [(f"{i % 2 + 1}/INBOX/{i}", "i.pdf", TEXT.format(no=10000000 + (1 if i == 7 else i)), "", "pdf") for i in range(12)]
    return spark.createDataFrame(rows, "email_id string, filename string, raw_text string, qr string, source_format string")


@pytest.mark.parametrize("failing", ["seen", "commit"])
def test_a_batch_that_fails_runs_again(spark, tmp_path, monkeypatch, failing):
    landed, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    logs = spark.createDataFrame([], "user_id long, email_uid string, attachment_filename string")
    stored = spark.createDataFrame([], "user_id long, invoice_no string")

    def run():
        source = spark.readStream.schema(landed_mail(spark).schema).option("maxFilesPerTrigger", 1).parquet(landed)
        flow.intake_stream(source, documents(spark), logs, stored, "2024-02-01", out, mark, trusted=[]).awaitTermination()

    landed_mail(spark, 1, 2, 3).coalesce(1).write.mode("append").parquet(landed)
    run()
    landed_mail(spark, 1, 3, 4, 5, 6, 7).coalesce(1).write.mode("append").parquet(landed)  # 1 and 3 land again
    whole = KeyedTable.write

    def write(self, batch, rows):
        """Fails before the seen rows, or after all rows but before the batch is marked as done."""
        if failing in self.path:
            raise RuntimeError("lost")
        whole(self, batch, rows)
        if failing == "commit" and "numbers" in self.path:
            raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "write", write)
        with pytest.raises(Exception, match="lost"):
            run()
    assert {r.email_uid for r in flow.committed(spark, out, "audit").collect()} == {"1", "2", "3"}
    run()
    landed_mail(spark, 8).coalesce(1).write.mode("append").parquet(landed)
    run()
    log = sorted((int(r.email_uid), r.outcome) for r in flow.committed(spark, out, "audit").collect())
    assert log == [(1, "saved"), (2, "saved"), (3, "saved"), (4, "saved"), (5, "saved"), (6, "saved"), (7, "duplicate"), (8, "saved")]
    paths = [r.file_path for r in flow.committed(spark, out, "invoices").collect()]
    assert len(set(paths)) == len(paths) == 7


def test_messages_of_three_readers_feed_the_intake(spark):
    accounts = spark.createDataFrame([(1, 10), (2, 20)], "id long, user_id long")
    feed = spark.createDataFrame([(2, "Inbox", "F", '{"internetMessageId": "<g@x>", "id": "9", "subject": "invoice", "hasAttachments": true, "receivedDateTime": "2024-01-02T03:04:05Z"}')], "account_id long, folder string, folder_id string, value string")
    pages = spark.createDataFrame([("77", "https://p.example/77", "$5", "May 1, 2026", "A", 1)], "portal_id string, url string, money string, date string, bill_to string, account_id long")
    mail = landed_mail(spark, 1).unionByName(readers.emails_from_graph_json(feed, accounts=accounts)).unionByName(readers.emails_from_portal(pages, seen_at="2024-01-01", accounts=accounts))
    graph = mail.where("uid = '<g@x>'").first()
    assert (graph.email_id, graph.user_id, graph.message_id, graph.received_at) == ("2/Inbox/<g@x>", 20, "<g@x>", datetime.datetime(2024, 1, 2, 3, 4, 5))
    assert graph.headers == {"_graph_id": "9", "_graph_folder_id": "F", "_has_attachments": "True"} and graph.attachments == [] == graph.links
    portal = [("1/Portal Invoices/portal:77", "portal-invoice-77.pdf", TEXT.format(no=20000077), "", "pdf")]
    texts = documents(spark).unionByName(spark.createDataFrame(portal, documents(spark).schema))
    none = spark.createDataFrame([], "account_id long, folder string, last_uid string, validity string")
    logs, stored = spark.createDataFrame([], "user_id long, email_uid string, attachment_filename string"), spark.createDataFrame([], "user_id long, invoice_no string")
    done = intake.mail_intake(mail, texts, none, logs, stored, "2024-02-01", trusted=[])
    assert {(r.user_id, r.email_uid): r.outcome for r in done.audit.collect()} == {(20, "1"): "saved", (10, "portal:77"): "saved", (20, "<g@x>"): "error"}


def test_patterns_of_tenants(spark):
    mail = spark.createDataFrame([(1, 1, "X <A@Pay.Corp.example>"), (2, 2, "a@pay.corp.example"), (3, 1, "vendor shop"), (4, 1, None), (5, 1, ""), (6, 2, "a@xcorp.example"), (7, None, "b@corp.example")], "email_id long, user_id long, from_addr string")
    rules = [(1, "a@pay.corp.example"), (2, "@corp.example"), (1, "dor s"), (None, "b@corp.example"), (2, " "), (2, None), (2, "zz"), (1, "@shop")]
    found = {r.email_id: (r.trusted, r.pattern) for r in joins.match_trusted(mail, spark.createDataFrame(rules, "user_id long, pattern string")).collect()}
    assert found == {1: (True, "a@pay.corp.example"), 2: (True, "@corp.example"), 3: (True, "dor s"), 4: (False, None), 5: (False, None), 6: (False, None), 7: (True, "b@corp.example")}
    emails = mail.withColumns({"subject": F.lit("n"), "body_text": F.lit(""), "attachments": F.array().cast("array<string>"), "links": F.array().cast("array<string>"), "headers": F.create_map().cast("map<string,string>")})
    rules = spark.createDataFrame(rules, "user_id long, pattern string")
    assert {r.email_id for r in intake.classify(emails, rules).where("is_invoice").collect()} == {1, 2, 3, 7}


def test_no_task_reads_a_whole_table_to_land_it(spark, tmp_path):
    from docspend.plans.streams import Landed, run

    rows = spark.range(0, 4000, numPartitions=8)
    landed, batches = Landed(rows, "id % 2 = 0", "id % 2 = 1"), []

    def start(source):
        seen = lambda df, number: batches.append((number, df.count(), df.where("id % 2 = 0").count()))
        return source.writeStream.foreachBatch(seen).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()

    landed.each(start)
    assert batches == [(0, 2000, 2000), (1, 2000, 0)]  # a batch for each part, in their order
    per_file = spark.read.parquet(landed.path).selectExpr("_metadata.file_path AS f").groupBy("f").count().collect()
    assert max(r["count"] for r in per_file) <= 500  # 8 tasks a part; a part was one file of 2000
    assert run(Landed(rows, "id < 10", "id >= 10"), lambda source: source.where("id % 100 = 0")).count() == 40


def test_decisions_need_one_shuffle_of_what_they_return(spark):
    """Equal candidates count once; the whole rows were shuffled for that, then twice more for the numbers."""
    from docspend.operators import intake
    from docspend.plans.functions import CAND
    from docspend.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    cand = t.candidates.select(*CAND)
    twice = cand.unionByName(cand.where("cand_id % 3 = 0"))
    stored = t.invoices.limit(200)
    made = intake.decide(twice, stored, "mail", once=True)
    assert sorted(map(str, made.collect())) == sorted(map(str, intake.decide(cand.distinct(), stored, "mail").collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = intake.decide(twice, stored, "mail", once=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    dealt = [line for line in plan.splitlines() if " Exchange hashpartitioning" in line or "-Exchange hashpartitioning" in line]
    assert sum("number" in line for line in dealt) <= 2 and not any("raw_text" in line for line in dealt)
