"""Session settings that the operators rely on."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def prepared(spark: SparkSession) -> SparkSession:
    """Set what the operators need, once for each context and session.

    Unions must not claim their inputs' partitioning: with adaptive execution two inputs of one hash partitioning can be coalesced
    differently, and an aggregate above them that trusts the claim doesn't bring equal keys together. Workers get the package, so
    that it needn't be installed on the executors.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    sc = spark.sparkContext
    if not getattr(sc, "_galena_sent", False):
        sc._galena_sent = True
        atexit.register(shutil.rmtree, folder_ := tempfile.mkdtemp(prefix="galena-"), ignore_errors=True)
        path = os.path.join(folder_, "galena.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(PACKAGE):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(folder, n), os.path.join("galena", os.path.relpath(os.path.join(folder, n), PACKAGE)))
        sc.addPyFile(path)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine that has none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="galena-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def removed(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A new folder in the shared one, which goes when the block ends."""
    at = f"{shared_dir(prepared(spark))}/galena-{uuid.uuid4().hex}"
    try:
        yield at
    finally:
        removed(spark, at)


def settled(df: DataFrame) -> DataFrame:
    """The rows as they are now, kept in the shared folder until the last reference goes."""
    shared_dir(prepared(df.sparkSession))
    return df.checkpoint(eager=True)
