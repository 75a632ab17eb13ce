"""Sources and functions that a user plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docspend.functions.parse import content_hash, expiry
from docspend.scratch import written
from docspend.shipping import ship

EMAIL = "uid string, subject string, from_addr string, body_text string, state string"
COLUMNS = ("uid", "subject", "from_addr", "body_text")


class _Part(InputPartition):
    def __init__(self, number: int, of: int):
        super().__init__(number)
        self.number, self.of = number, of


class _Reader(DataSourceReader):
    def __init__(self, make: Callable, options: dict, parts: int):
        self.make, self.options, self.parts = make, options, parts

    def partitions(self):
        return [_Part(i, self.parts) for i in range(self.parts)]

    def read(self, part: _Part) -> Iterator[tuple]:
        for m in self.make(self.options, part.number, part.of):
            if "state" in m:
                yield (*[None] * len(COLUMNS), m["state"])
            else:
                yield (*map(m.get, COLUMNS), None)


def register_source(spark: SparkSession, kind: str, make: Callable[[dict, int, int], Iterator[dict]], parts: int = 1) -> None:
    """Register spark.read.format(kind): make(options, part, parts) gives the messages of one part.

    options holds what the reader was given, also the state of the last run; a dict with the one
    key state hands on the state for the next run.  split_state tells both apart.
    """
    ship(spark)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return EMAIL

        def reader(self, schema):
            return _Reader(make, dict(self.options), parts)

    spark.dataSource.register(Source)


def split_state(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages that a plugged source gave, and the states of its parts."""
    return rows.where("state IS NULL").drop("state"), rows.where("state IS NOT NULL").select("state")


def _call_once(misses: DataFrame, column: str, fn: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """content_hash, response of rows (content_hash and the text in column)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, out = frame[column].tolist(), []
            try:
                out = list(fn(texts))
            except Exception:  # noqa: BLE001  one bad text must not cost the others theirs
                for text in texts:
                    try:
                        out += list(fn([text]))
                    except Exception:  # noqa: BLE001
                        out.append(None)
            yield pd.DataFrame({"content_hash": frame["content_hash"], "response": out})

    return misses.mapInPandas(run, "content_hash string, response string")


class Answers(NamedTuple):
    """rows with content_hash and response, and what the user's function newly answered, as rows of the cache."""

    rows: DataFrame
    learned: DataFrame


def live_answers(cache: DataFrame, now: str) -> DataFrame:
    """content_hash, response of the entries of a cache that have not expired; of several of one hash the newest."""
    age = [F.col(n) for n in ("created_at", "id") if n in cache.columns]
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))) if "expires_at" in cache.columns else cache
    text = F.col("response_json" if "response_json" in cache.columns else "response")
    return live.groupBy("content_hash").agg(F.max_by(text, F.struct(*age, text)).alias("response"))


def ask(
    df: DataFrame, fn: Callable[[list[str]], list[str | None]], now: str, cache: DataFrame | Callable[[DataFrame], DataFrame] | None = None, column: str = "raw_text", prompt: str = "extract",
    valid: Callable[[Column], Column] | None = None
) -> Answers:
    """df with content_hash and response: the user's function runs once for each distinct text that the
    cache does not know at the time now; the key hashes the text that it is given, all of it.

    cache: content_hash, response_json, created_at, expires_at (null: for ever), or a function that
    gives such rows for the hashes it is given.  What is newly
    answered, and is valid, comes as such rows too, with the prompt's expiry: merged into the cache
    they spare the next run the question.  A null text is not asked for; a text the function fails
    on has a null response and is asked for again next time.  df, and the answers, are written, so
    nothing above is computed twice and no text is asked for twice.
    """
    ship(df.sparkSession)
    keyed = written(df.withColumn("content_hash", content_hash(prompt, F.col(column))), "keyed")
    misses = keyed.where(F.col(column).isNotNull()).groupBy("content_hash").agg(F.min(column).alias(column))
    known = None
    if cache is not None:
        wanted = keyed.where(F.col(column).isNotNull()).select("content_hash").distinct()
        known = live_answers(cache(wanted) if callable(cache) else cache, now)
        known = written(known.join(wanted, "content_hash", "left_semi"), "known")
        misses = misses.join(known.select("content_hash"), "content_hash", "left_anti")
    fresh = written(_call_once(misses, column, fn), "answers")
    made, lasts = F.lit(now).cast("timestamp"), expiry(F.lit(prompt), F.lit(now).cast("timestamp"))
    kept = F.col("response").isNotNull() if valid is None else F.col("response").isNotNull() & F.coalesce(valid(F.col("response")), F.lit(False))
    learned = fresh.where(kept).select(
        "content_hash", F.lit(prompt).alias("prompt_type"), F.col("response").alias("response_json"), made.alias("created_at"), lasts.alias("expires_at")
    )
    answers = fresh if known is None else fresh.unionByName(known)
    return Answers(keyed.join(answers, "content_hash", "left"), learned)


def enrich(
    df: DataFrame, extractor: Callable[[list[str]], list[str | None]], cache: DataFrame | None = None, column: str = "raw_text",
    prompt: str = "extract", now: str = "1970-01-01"
) -> DataFrame:
    """The rows of `ask`, for a cache that is not kept."""
    return ask(df, extractor, now, cache, column, prompt).rows


def analyse(df: DataFrame, fn: Callable[[list[str]], list[str | None]], cache: DataFrame | None = None, column: str = "body_text") -> DataFrame:
    """df with the response of the user's message analyser; see functions.text.analysis_text for the text it should read."""
    return enrich(df, fn, cache, column, "analyze_email_v3")


def embed(df: DataFrame, fn: Callable[[list[str]], list[list[float]]], column: str = "text") -> DataFrame:
    """df with the embedding of the first 8000 characters of a column."""
    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(fn(texts.fillna("").str.slice(0, 8000).tolist()))

    return df.withColumn("embedding", run(F.col(column)))
