"""Session settings and the shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tabularium")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder of ``spark.checkpoint.dir``; its lineage ends there, so that plans that use it often stay small.

    Where that is unset a temporary folder is used, on a local master only.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and sc.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not root:
            root = tempfile.mkdtemp(prefix="tabularium-checkpoint-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that functions sent there can be loaded; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_tabularium_sent", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as tmp:
        top = os.path.join(tmp, "top")
        shutil.copytree(home, os.path.join(top, "tabularium"), ignore=shutil.ignore_patterns("__pycache__"))
        kept = tempfile.mkdtemp(prefix="tabularium-code-")
        atexit.register(shutil.rmtree, kept, ignore_errors=True)
        made = shutil.make_archive(os.path.join(kept, "tabularium"), "zip", top)
    sc.addPyFile(made)
    sc._tabularium_sent = True
