"""A stored posting table: written once, kept up by segments, read by the buckets of a query's terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

from docspend.scratch import compiled, written
from docspend.search.text import COLUMNS, tokens
from docspend.shipping import ship

BUCKETS = 64
#: Removed ids are broadcast, 64 to a word of bits, while they take at most so many words.
WORDS = 3_000_000
#: Tokens that a task sorts at a time.
TOKENS = 1 << 20


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


#: Stands between the columns of a row while its words are made; in a text it is no letter, as white space.
BETWEEN = "\x01"


def _worded(df: DataFrame, key: str, columns: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns and words, the tokens of all columns with BETWEEN between two columns: lower case, marks and splitting once a row."""
    ship(df.sparkSession)
    texts = [F.replace(F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit(BETWEEN), F.lit(" ")) for x in columns]
    whole = F.concat_ws(f" {BETWEEN} ", *texts)
    return df.select(F.col(key).alias("id"), *keep, tokens(whole, also=BETWEEN).alias("words"))


def _postings(df: DataFrame, key: str, columns: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """Postings of rows, without a shuffle: Arrow tasks sort the words of many rows at once, and each run of equal ones in a column is a posting."""
    rows = _worded(df, key, columns, keep)
    kept = [rows.schema[n] for n in keep]
    made = [("term", StringType()), ("col", StringType()), ("first", BooleanType()), ("n", IntegerType()), ("positions", ArrayType(IntegerType()))]
    schema = StructType([rows.schema["id"], StructField("size", IntegerType()), *kept, *(StructField(*x) for x in made)])
    return rows.mapInArrow(_by_slice(lambda batch: _posted(batch, columns, keep)), schema).withColumn("bucket", bucket_of(F.col("term")))


def _sized(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """id, sizes (tokens by column) and size of rows."""

    def sized(batch: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        _, row, col, _ = _places(batch, len(columns))
        many = np.bincount(row * len(columns) + col, minlength=batch.num_rows * len(columns)).astype("i4")
        at = pa.array(np.arange(batch.num_rows + 1) * len(columns), pa.int32())
        sizes = pa.MapArray.from_arrays(at, pa.array(list(columns) * batch.num_rows, pa.string()), pa.array(many))
        return pa.RecordBatch.from_arrays([batch.column("id"), sizes, pa.array(many.reshape(-1, len(columns)).sum(axis=1).astype("i4"))], ["id", "sizes", "size"])

    rows = _worded(df, key, columns)
    schema = StructType([rows.schema["id"], StructField("sizes", MapType(StringType(), IntegerType())), StructField("size", IntegerType())])
    return rows.mapInArrow(_by_slice(sized), schema)


def _by_slice(made: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """made of slices of rows with TOKENS tokens at most, or of one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            until, at = np.asarray(batch.column("words").offsets), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(until, until[at] + TOKENS, "right")) - 1)
                yield made(batch.slice(at, end - at))
                at = end

    return run


def _places(batch: pa.RecordBatch, columns: int) -> tuple:
    """The words of a batch without BETWEEN; row, column and position of each."""
    import numpy as np

    lists = batch.column("words")
    words, many = lists.flatten(), np.diff(np.asarray(lists.offsets))
    row = np.repeat(np.arange(len(many)), many)
    marks = np.asarray(pa.compute.equal(words, BETWEEN))
    block = np.cumsum(marks) - row * (columns - 1)  # every row has one mark less than columns
    begins = np.flatnonzero(marks | (np.append(-1, row[:-1]) != row))
    pos = np.arange(len(row)) - np.repeat(begins + marks[begins], np.diff(np.append(begins, len(row))))
    real = np.flatnonzero(~marks)
    return words.take(pa.array(real)), row[real], block[real], pos[real].astype("i4")


def _posted(batch: pa.RecordBatch, columns: tuple[str, ...], keep: tuple[str, ...]) -> pa.RecordBatch:
    import numpy as np

    words, row, col, pos = _places(batch, len(columns))
    told = words.dictionary_encode()
    of = row * len(told.dictionary) + np.asarray(told.indices)  # a word in a row
    order = np.argsort(of * len(columns) + col, kind="stable")  # positions of a column ascend already
    of, col = of[order], col[order]
    new = np.append(-1, of[:-1]) != of
    begins = np.flatnonzero(new | (np.append(-1, col[:-1]) != col))
    at, in_row = order[begins], pa.array(row[order[begins]])
    ends = np.append(begins, len(order))
    positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[order]))
    sizes = pa.array(np.bincount(row, minlength=batch.num_rows), pa.int32())
    carried = [sizes.take(in_row), *(batch.column(x).take(in_row) for x in keep)]
    term, name = told.dictionary.take(told.indices.take(pa.array(at))), pa.array(columns, pa.string()).take(pa.array(col[begins]))
    made = [batch.column("id").take(in_row), *carried, term, name, pa.array(new[begins]), pa.array(np.diff(ends), pa.int32()), positions]
    return pa.RecordBatch.from_arrays(made, ["id", "size", *keep, "term", "col", "first", "n", "positions"])


def _words(ids: DataFrame) -> DataFrame:
    """Distinct ids; whole numbers as slot and mask, 64 to a word of bits."""
    if dict(ids.dtypes)["id"] not in ("bigint", "int"):
        return ids.distinct()
    bit = F.expr("shiftleft(1L, CAST(id & 63 AS INT))")
    return ids.where("id IS NOT NULL").groupBy(_slot().alias("slot")).agg(F.bit_or(bit).alias("mask"))


def _slot() -> Column:
    return F.expr("shiftright(CAST(id AS BIGINT), 6)")


class TextIndex:
    """Postings of rows below path.

    postings: term, id, col, positions, n (how many), first (whether of the first column of the row
    that holds the term), size (tokens of the whole row) and the kept columns, one row for each (term,
    row, column).  Rows are dealt, not their postings: each task writes those of its rows, in folders
    by bucket of the term and sorted by term, so a term in most rows is no hot one.  lengths: id and
    the tokens of each column; gone: ids whose rows in earlier segments are dead, whole numbers as
    words of 64 bits.  The key is unique among the rows of a segment.
    `add` writes a segment: new rows, and rows that replace those of the same id; `remove` one that
    only buries.  A segment counts once its totals stand in `stats`, written last.  `compacted`
    writes what lives as one segment elsewhere.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, df: DataFrame, path: str, key: str = "id", columns: tuple[str, ...] = COLUMNS, keep: tuple[str, ...] = ()) -> TextIndex:
        index = cls(df.sparkSession, path)
        index._write(0, df, key, columns, keep, None)
        return index

    # -- writing

    def _segments(self) -> list[int]:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/stats")
        system = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(top):
            return []
        names = [x.getPath() for x in system.listStatus(top)]
        return sorted(int(p.getName().split("=")[1]) for p in names if "=" in p.getName() and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _write(self, *args) -> None:
        with compiled(self.spark):
            self._segment(*args)

    def _segment(self, number: int, df: DataFrame | None, key: str, columns: tuple[str, ...], keep: tuple[str, ...], buried: DataFrame | None) -> None:
        docs, total = 0, 0
        if df is not None:
            _sized(df, key, columns).write.mode("overwrite").parquet(f"{self.path}/lengths/segment={number}")
            docs, total = self.spark.read.parquet(f"{self.path}/lengths/segment={number}").where("size > 0").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            rows = df.select(*dict.fromkeys((key, *keep, *columns))).hint("rebalance", key)
            dealt = _postings(rows, key, columns, keep).sortWithinPartitions("bucket", "term")
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={number}")
        if buried is not None:
            dead = written(self.lengths().join(buried, "id", "left_semi").where("size > 0").select("id", "size"), "dead")
            n, tokens_gone = dead.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            docs, total = docs - n, total - tokens_gone
            _words(buried.select("id")).withColumn("since", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/gone/segment={number}")
        stats = self.spark.range(1).select(F.lit(docs).cast("long").alias("docs"), F.lit(total).cast("long").alias("total"))
        stats.write.mode("overwrite").parquet(f"{self.path}/stats/segment={number}")

    def add(self, df: DataFrame, key: str = "id", columns: tuple[str, ...] = COLUMNS, keep: tuple[str, ...] = ()) -> None:
        """Rows that are new, or stand for the earlier ones of their id."""
        self._write(max(self._segments(), default=-1) + 1, df, key, columns, keep, df.select(F.col(key).alias("id")))

    def remove(self, ids: DataFrame) -> None:
        """ids (id) are searched no more."""
        self._write(max(self._segments(), default=-1) + 1, None, "id", (), (), ids)

    def compacted(self, path: str) -> TextIndex:
        other = TextIndex(self.spark, path)
        whole = self._live(self._read("postings")).drop("segment").hint("rebalance", "id").sortWithinPartitions("bucket", "term")
        whole.write.partitionBy("bucket").parquet(f"{path}/postings/segment=0")
        self.lengths().write.parquet(f"{path}/lengths/segment=0")
        self.totals().select("docs", "total").write.parquet(f"{path}/stats/segment=0")
        return other

    # -- reading

    def _read(self, what: str) -> DataFrame | None:
        numbers = set(self._segments())
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        system = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(top):
            return None
        return self.spark.read.parquet(f"{self.path}/{what}").where(F.col("segment").isin(*numbers)) if numbers else None

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self._read("gone")
        if gone is None:
            return rows
        if "id" in gone.columns:
            last = gone.groupBy("id").agg(F.max("since").alias("since"))
            return rows.join(last, "id", "left").where("since IS NULL OR segment >= since").drop("since")
        dead = gone.groupBy("slot").agg(F.collect_list(F.struct("since", "mask")).alias("gone"))
        dead = F.broadcast(dead) if gone.count() <= WORDS else dead
        hit = "exists(gone, g -> g.since > segment AND getbit(g.mask, CAST(id & 63 AS INT)) = 1)"
        return rows.withColumn("slot", _slot()).join(dead, "slot", "left").where(f"gone IS NULL OR NOT {hit}").drop("slot", "gone")

    def totals(self) -> DataFrame:
        """docs, total: rows with tokens and their tokens, one row."""
        return self._read("stats").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))

    def lengths(self) -> DataFrame:
        return self._live(self._read("lengths")).select("id", "sizes", "size")

    def ids(self, columns: tuple[str, ...] | None = None) -> DataFrame:
        """Rows with a token in any of the columns."""
        size = F.col("size")
        if columns:
            size = sum((F.coalesce(F.try_element_at("sizes", F.lit(c)), F.lit(0)) for c in columns), F.lit(0))
        return self.lengths().where(size > 0).select("id")

    def postings(self, words: list[str] | DataFrame, begin: str | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
        """The postings of words (a list, or a table with `term`) and of terms that begin so: of the words only their buckets are read."""
        rows = self._read("postings")
        if isinstance(words, DataFrame):
            words = written(words.select("term", bucket_of(F.col("term")).alias("bucket")).distinct(), "terms")
            hit = [r.bucket for r in words.select("bucket").distinct().collect()]  # at most BUCKETS
            rows = rows.where(F.col("bucket").isin(hit)).join(words, ["bucket", "term"], "left_semi")
        else:
            near = F.col("term").isin(*words) & F.col("bucket").isin(self._buckets(words)) if words else F.lit(False)
            rows = rows.where(near | F.startswith("term", F.lit(begin)) if begin else near)
        if columns:
            rows = rows.where(F.col("col").isin(*columns))
        return self._live(rows).drop("segment", "bucket")

    def _buckets(self, words: list[str]) -> list[int]:
        terms = self.spark.createDataFrame([(w,) for w in words], "term string")
        return sorted({r.b for r in terms.select(bucket_of(F.col("term")).alias("b")).collect()})

    def term_stats(self) -> DataFrame:
        """docs and n of every term."""
        rows = self._live(self._read("postings").select("term", "id", "n", "first", "segment"))
        return rows.groupBy("term").agg(F.count_if("first").alias("docs"), F.sum("n").alias("n"))
