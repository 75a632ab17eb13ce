"""Tables in buckets of their key, of which a change rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from docspend.operators.dml import apply_corrections, delete_invoices, latest
from docspend.scratch import written

#: Keys of a change that go to all tasks at a time; more are met in several groups of buckets.
KEYS = 1_000_000
#: Files of a bucket from which on a change puts its rows together again.
FILES = 8


class BucketedTable:
    """Rows below path, in folders by bucket of a key.

    A change reads the buckets of the keys it names, writes their new rows beside, and then puts them
    in place of the old ones bucket by bucket; the files of all other buckets stay.  Its keys go to the
    rows, which are neither shuffled nor written twice.  A change that breaks off while it puts them in
    place can be made again: it replaces rows by key.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64, schema: StructType | None = None):
        """schema: of the rows, needed only where a table may have none."""
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = spark.read.parquet(path).drop("bucket").schema if schema is None else schema

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str = "id", buckets: int = 64) -> BucketedTable:
        table = cls(df.sparkSession, path, key, buckets, df.schema)
        df.withColumn("bucket", table._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(path)
        return table

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self._rows().drop("bucket")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema, StructField("bucket", IntegerType())])).parquet(self.path)

    def _groups(self, keys: DataFrame) -> Iterator[tuple[list[int], DataFrame]]:
        """The buckets of the keys, in groups of at most KEYS keys (or one bucket), and the keys of a group."""
        keys = keys.select(self.key).withColumn("bucket", self._bucket())
        counts = {r.bucket: r["count"] for r in keys.groupBy("bucket").count().collect()}  # at most as many as there are buckets
        group, n = [], 0
        for b in sorted(counts):
            if group and n + counts[b] > KEYS:
                yield group, self._sent(keys, group, n)
                group, n = [], 0
            group, n = [*group, b], n + counts[b]
        if group:
            yield group, self._sent(keys, group, n)

    def _sent(self, keys: DataFrame, group: list[int], n: int) -> DataFrame:
        here = keys.where(F.col("bucket").isin(group)).select(self.key)
        return F.broadcast(here) if n <= KEYS else here

    def _met(self, keys: DataFrame, group: list[int], how: str) -> DataFrame:
        """The rows in a group of buckets that have one of its keys (left_semi) or none (left_anti)."""
        return self._rows().where(F.col("bucket").isin(group)).join(keys, self.key, how)

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows that have one of the keys."""
        found = [written(self._met(here, group, "left_semi").drop("bucket"), "of") for group, here in self._groups(keys)]
        rows = found[0] if found else self.read().limit(0)
        for more in found[1:]:
            rows = rows.unionByName(more)
        return rows

    def _files(self, group: list[int]) -> dict[int, set[str]]:
        jvm = self.spark._jvm
        system = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = {}
        for b in group:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}")
            out[b] = {f.getPath().getName() for f in system.listStatus(at)} if system.exists(at) else set()
        return out

    def change(self, keys: DataFrame, rows: DataFrame | None = None) -> None:
        """Put rows, if there are any, in place of those that have one of the keys; neither may be made of this table, and rows have no other keys."""
        for group, here in self._groups(keys):
            made, before = self._met(here, group, "left_anti"), self._files(group)
            if rows is not None:
                new = rows.withColumn("bucket", self._bucket()).where(F.col("bucket").isin(group))
                made = made.unionByName(new.repartition("bucket"))
            if max(map(len, before.values())) >= FILES:
                made = made.repartition("bucket")
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            jvm = self.spark._jvm
            for b, files in self._files(group).items():
                if files and files == before[b]:  # nothing is left in this one
                    path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}")
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def upsert(self, delta: DataFrame, order: str | None = None) -> None:
        """SNK-05: delta's rows replace those of their key, the one with the highest order of several."""
        delta = written(latest(delta, self.key, order).select(*self.schema.names), "delta")
        self.change(delta, delta)

    def correct(self, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
        """DML-01: apply_corrections to a table of invoices; log rows and rejected ids.

        Which numbers are taken is asked of the whole table, by id, tenant and number alone.
        """
        edits = written(edits, "edits")
        _, _, rejected = apply_corrections(self.read(), edits)
        rejected = written(rejected, "rejected")
        good = written(edits.join(rejected, "id", "left_anti"), "edits")
        fixed, log, _ = apply_corrections(self.of(good), good)
        fixed, log = written(fixed, "fixed"), written(log, "log")
        self.change(fixed, fixed)
        return log, rejected

    def delete(self, ids: DataFrame, user_id: int) -> DataFrame:
        """DML-02: delete_invoices of a tenant; the file paths of the deleted rows."""
        ids = written(ids.select("id"), "ids")
        gone = written(delete_invoices(self.read(), ids, user_id)[1], "gone")
        self.change(gone)
        return gone
