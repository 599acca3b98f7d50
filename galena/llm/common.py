"""What the operators share: the shared folder, scratch tables, text helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.session import prepared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that separates words in the operators' contracts.
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where a session on one machine has none (as in
    tests) a temporary one is set; on a cluster that is an error."""
    prepared(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="galena-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are in the shared folder, and Spark removes them with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder that live as long as an operator's eager part."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/galena-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        self.n += 1
        return f"{self.at}/{self.n}"

    def write(self, df: DataFrame) -> DataFrame:
        """Write as Parquet and read again."""
        df.write.option("compression", "zstd").parquet(at := self.path())
        out = self.spark.read.schema(df.schema).parquet(at)
        out._galena_path = at
        return out

    def remove(self, *tables: DataFrame) -> None:
        """Remove tables, or without an argument everything."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for at in [t._galena_path for t in tables] or [self.at]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.remove()


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda argument is bound, a column expression would be inlined
    wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else. lower() does that to plain ASCII, at a fraction of translate()'s cost."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_by(text: Column, separators: str) -> Column:
    """The words between runs of separators; of a null text, none."""
    return F.coalesce(F.array_remove(F.split(text, separators), ""), F.array().cast("array<string>"))


def bounded_batches(spark: SparkSession, n_bytes: int = 8 << 20) -> None:
    """Arrow batches to Python workers end at n_bytes, however long the texts are."""
    prepared(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))


def slices(texts: list, n_chars: int):
    """Index ranges of texts with about n_chars characters each."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= n_chars:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before them until no column of docs has them."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
