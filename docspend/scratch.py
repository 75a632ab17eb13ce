"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from docspend.shipping import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where the session has none (tests on one machine) a temporary folder is set.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="docspend-")
        sc.setCheckpointDir(path)
        path = f"file://{path}"
    return path


def scratch(spark: SparkSession, what: str) -> str:
    """A new, unused path below the shared folder; the application's folder goes at exit."""
    ship(spark)
    top = f"{shared_dir(spark).rstrip('/')}/docspend-{spark.sparkContext.applicationId}"
    if not getattr(scratch, "registered", None) == top:
        scratch.registered = top
        atexit.register(_drop, spark, top)
    return f"{top}/{what}-{uuid.uuid4().hex[:12]}"


def _drop(spark: SparkSession, top: str) -> None:
    try:
        jvm, sc = spark._jvm, spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already when the process ends
        pass


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back.

    This cuts the lineage: a lost executor costs the reading of a file, not a new run of
    what stands above, and a plan that uses the rows twice computes them once.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a generated method from which on it is not used, and what the JVM compiles at most.
HUGE, COMPILED = "spark.sql.codegen.hugeMethodLimit", 8000


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """What runs inside uses generated code only where the JVM compiles it.

    A projection of many columns can become one method of more than 8000 bytes, which the JVM interprets for
    every row; below the limit Spark takes expressions one by one, in methods that are compiled.
    """
    before = spark.conf.get(HUGE)
    spark.conf.set(HUGE, str(min(int(before), COMPILED)))
    try:
        yield
    finally:
        spark.conf.set(HUGE, before)
