"""Reading tables and small helpers of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspend.scratch import scratch, shared_dir, written  # noqa: F401  used by the operators
from docspend.shipping import ship

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit range partitionings."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def clean_text(column: str = "text"):
    """The text, null as empty, each broken UTF-8 sequence as U+FFFD: how every operator reads texts that looks into them."""
    return F.make_valid_utf8(text_or_empty(column))


def text_name(column: str = "text"):
    """A 128-bit name of the text; with doc_id it tells rows of one doc_id, or of none, apart."""
    return F.unhex(F.md5(text_or_empty(column)))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The wanted names, with underscores put before those that df has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
