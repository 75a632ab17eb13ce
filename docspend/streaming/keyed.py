"""Rows that batches of a stream leave for later ones, by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """Rows below path, in buckets of their keys, so that a batch reads the buckets of the keys it meets.

    Each batch writes its rows under its own number, and a batch that runs again overwrites them; it
    reads only what lower numbers wrote.  Every `compact` batches all earlier rows are rewritten as a
    base, and what two bases ago needed goes, so reading never touches more than `compact` numbers.
    latest: of the rows of one key only those of the last batch count.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], latest: bool = False, buckets: int = 32, compact: int = 16):
        self.spark, self.path, self.keys, self.latest, self.buckets, self.compact = spark, path, keys, latest, buckets, compact
        self.schema = f"{schema}, batch bigint, bucket int"
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys)), F.lit(self.buckets)).cast("int")

    def _versions(self) -> list[tuple[str, int]]:
        """Kind (base or batch) and number of all that is there as a whole."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(top):
            return []
        names = [x.getPath() for x in system.listStatus(top)]
        whole = [p.getName() for p in names if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted((kind, int(n)) for kind, n in (name.split("-") for name in whole))

    def read(self, before: int, met: DataFrame | None = None) -> DataFrame:
        """What batches below `before` wrote; met: of these keys only."""
        found = self._versions()
        base = max((n for kind, n in found if kind == "base" and n < before), default=-1)
        paths = [f"{self.path}/base-{base}"] * (base >= 0) + [f"{self.path}/batch-{n}" for kind, n in found if kind == "batch" and base < n < before]
        rows = self.spark.createDataFrame([], self.schema)
        for path in paths:
            rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(path))
        if met is not None and paths:
            met = met.select(*self.keys).distinct()
            hit = [r.bucket for r in met.select(self._bucket().alias("bucket")).distinct().collect()]  # at most as many as there are buckets
            rows = rows.where(F.col("bucket").isin(hit)).join(met, self.keys, "left_semi")
        if self.latest:
            others = [c for c in self.columns if c not in self.keys]
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*self.keys, *(F.col(f"r.{c}") for c in others))
        return rows.select(*self.columns)

    def _put(self, rows: DataFrame, name: str) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def write(self, batch: int, rows: DataFrame) -> None:
        self._put(rows.select(*self.columns).withColumn("batch", F.lit(batch).cast("long")), f"batch-{batch}")
        bases = [n for kind, n in self._versions() if kind == "base" and n < batch]
        if batch - max(bases, default=-1) < self.compact:
            return
        # a batch that runs again still finds the base before it
        self._put(self.read(batch + 1).withColumn("batch", F.lit(batch).cast("long")), f"base-{batch}")
        keep = max(bases, default=-1)
        system = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for kind, n in self._versions():
            if n < keep or (kind == "batch" and n == keep):
                system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-{n}"), True)
