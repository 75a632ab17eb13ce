"""Queries by name, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspend import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The instant that "now" means in the queries, so that reruns agree.
AS_OF = "2001-07-15 12:00:00"


class Tables:
    """The engine's tables over one folder: attribute access loads a fixture or a given table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in fixtures.SQL and name not in fixtures.BASE:
            raise AttributeError(name)
        return fixtures.load(self.spark, self.sf_dir, name)


_indexes: dict[tuple[str, str], object] = {}


def stored_index(t: Tables):
    """The stored index of the invoices of a folder, built where a session first asks for it."""
    from docspend.scratch import scratch
    from docspend.search.index import TextIndex

    at = (t.spark.sparkContext.applicationId, t.sf_dir)
    if at not in _indexes:
        _indexes[at] = TextIndex.build(t.invoices, scratch(t.spark, "index"), keep=("user_id", "invoice_date"))
    return _indexes[at]


def query(name: str, oracle: str | None = None):
    """Register f(tables) -> DataFrame under a name."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = fixtures.oracle(oracle)
        return f

    return add
