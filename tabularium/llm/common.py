"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACE = " \t\n\x0b\x0c\r"

_own_root: list[str] = []
_written: list[str] = []
_SAMPLES = "spark.sql.execution.rangeExchange.sampleSizePerPartition"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly where its estimated size makes splits for less than a quarter of the cores.

    A file with one group of rows is one task otherwise, however much there is to do for a row. Larger inputs are left alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 4 * size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one, on a local master only: executors
    of a cluster would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="tabularium-"))
    return "file://" + _own_root[0]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    _written.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote and that nothing still to be computed reads."""
    for df in tables:
        _delete(df.sparkSession, df._written_to)


def clear(spark: SparkSession) -> None:
    """Delete all that this process's operators wrote to the shared folder; for when their results are saved."""
    for path in list(_written):
        _delete(spark, path)


@contextmanager
def few_samples(spark: SparkSession, each: int = 10) -> Iterator[None]:
    """While tables are written inside, range partitioning takes ``each`` rows a partition to the driver, not a hundred.

    With wide sort keys the samples would else be what the driver holds most of.
    """
    old = spark.conf.get(_SAMPLES)
    spark.conf.set(_SAMPLES, str(each))
    try:
        yield
    finally:
        spark.conf.set(_SAMPLES, old)


def text_size(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return row["n"], row["b"] or 0


def salted_firsts(rows: DataFrame, firsts: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Left join ``rows`` with ``firsts`` (one row a key) on a key that may hold a third of all rows.

    ``rows`` is dealt out over ``salts`` copies of each key of ``firsts``, by a hash of the whole row.
    """
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    left = rows.withColumn("_salt", salt)
    right = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def bounded_sample(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The ``n`` rows of least hash of ``key``. Only about ``8 n`` rows reach the sort, however many there are."""
    total = df.count()
    h = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    if total > 8 * n:
        df = df.filter(h < F.lit(int((1 << 40) * min(1.0, 8 * n / total))))
    return df.orderBy(h, *key).limit(n)
