"""Costly steps of the intake stand once in its plans."""

from pyspark.sql import functions as F

from docspend.functions import parse as P
from docspend.operators import intake as I


def test_an_answer_is_parsed_once_and_whole(spark):
    df = spark.createDataFrame([("a", True)], "text_in string, need boolean")
    answer = '{"buyer": "b", "seller": "s", "invoice_no": "12345678", "invoice_date": "2024-02-03", "amount": "1", "item_summary": "i", "invoice_type": "t"}'
    rows = I.with_extraction(df, lambda texts: [answer for _ in texts], "2024-01-01").rows
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    got = rows.first()
    assert (got.x_buyer, got.x_invoice_no, got.x_category, got.x_confidence) == ("b", "12345678", "vat_invoice", 0.9)


def test_each_part_of_a_day_is_found_once(spark):
    df = spark.createDataFrame([("开票日期:2024年2月29日",), ("开票日期:２０２３年2月29日",), ("开票日期: ２０２４年０1月9日",), ("开票日期:2024年0月1日",), (None,)], "t string")
    rows = df.select(P.fields(F.col("t"))["invoice_date"].alias("d"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 6  # a null for no match asks twice
    assert [r.d and str(r.d) for r in rows.collect()] == ["2024-02-29", None, "2024-01-09", None, None]
