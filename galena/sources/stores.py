"""Sources that may fail, listings that go on where they stopped, and stores of snapshots and sessions."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.operators.datasets import content_hash
from galena.session import removed

MISSING = "there is no such file"
#: What an error of a file system comes to, for whoever configured the source.
REASONS = {
    r"PATH_NOT_FOUND|FileNotFound|No such file|NoSuchKey": MISSING,
    r"NoSuchBucket": "there is no such bucket",
    r"AccessDenied|AccessControl|Permission denied|Forbidden|403": "access is denied",
    r"NoCredentials|NoAuthWithAWS|CredentialInitialization": "there are no credentials",
    r"No FileSystem for scheme|UnsupportedFileSystem|ClassNotFoundException": "its kind of store isn't known",
    r"UnknownHost|ConnectException|ConnectTimeout|SocketTimeout|NoRouteToHost": "its store can't be reached",
}


class SourceError(RuntimeError):
    """A source can't be read; reason says why."""

    def __init__(self, path: str, reason: str):
        super().__init__(f"{path} can't be read: {reason}")
        self.path, self.reason = path, reason


def reading(path: str, read):
    """What read() gives, with errors of the file system mapped."""
    try:
        return read()
    except Exception as e:
        text = str(e)
        for pattern, reason in REASONS.items():
            if re.search(pattern, text):
                raise SourceError(path, reason) from e
        raise


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """line: the lines of a text file of any store that Spark reads, without byte-order mark."""
    raw = reading(path, lambda: spark.read.text(path))
    return raw.select(F.regexp_replace("value", "^\ufeff", "").alias("line"))


def read_labels(spark: SparkSession, path: str, file: str = "image_filename", label: str = "slug") -> DataFrame:
    """file, label of a CSV of labels; a blank label is null: the file has no answer. A row without a file name is an error."""
    raw = reading(path, lambda: spark.read.option("header", True).option("escape", '"').csv(path))
    raw = raw.toDF(*(c.lstrip("\ufeff").strip() for c in raw.columns))
    if missing := [c for c in (file, label) if c not in raw.columns]:
        raise SourceError(path, f"it has no columns {missing}")
    name, value = F.trim(F.col(f"`{file}`")), F.trim(F.col(f"`{label}`"))
    name = F.when(F.coalesce(name, F.lit("")) == "", F.raise_error(F.lit(f"{path}: a row has no {file}"))).otherwise(name)
    return raw.select(name.alias(file), F.nullif(value, F.lit("")).alias(label))


def listing(spark: SparkSession, fetch, path: str, key: str, size: int, pages: int | None = None) -> int:
    """Append the rows of a paged source whose key is new to the table in path; fetch(page) gives a DataFrame of size rows or, behind the last page, an empty one, and
    pages count from 1. A later call goes on from the page that the number of rows there points to. At most so many pages are asked for. The number of rows added."""

    def listed() -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except Exception as e:  # nothing is there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    seen, added, asked = listed(), 0, 0
    page = (seen.count() if seen is not None else 0) // size + 1
    while (pages is None or asked < pages) and not (rows := fetch(page)).isEmpty():
        new = rows.dropDuplicates([key])
        if seen is not None:
            new = new.join(seen.select(key), key, "left_anti").select(*rows.columns)
        if n := new.count():
            new.write.mode("append").parquet(path)
            seen = listed()
        added, page, asked = added + n, page + 1, asked + 1
    return added


def append_results(path: str, todo: DataFrame, key: str, process, meta: dict) -> int:
    """Process the rows whose key has no result in path/rows yet, and append the results as JSON lines; the number of rows processed. Spark commits the files of a run
    together, and a line that was torn by other writers doesn't count as done. Results of other settings (meta) aren't added to."""
    spark, rows, settings = todo.sparkSession, f"{path}/rows", json.dumps(meta, sort_keys=True)
    try:
        kept = "\n".join(r.value for r in spark.read.text(f"{path}/meta").collect())  # one line
    except Exception as e:  # nothing is there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kept = None
    kind = todo.schema[key].dataType.simpleString()
    try:
        lines = spark.read.schema(f"`{key}` {kind}, _torn string").option("columnNameOfCorruptRecord", "_torn").json(rows)
        done = lines.filter(F.col("_torn").isNull() & F.col(key).isNotNull()).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    if done is not None and kept is not None and kept != settings and not done.isEmpty():
        raise ValueError(f"{path} holds results of other settings: {kept}")
    if kept != settings:
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    left = todo if done is None else todo.join(done, key, "left_anti")
    n = left.count()
    if n:
        process(left).write.mode("append").json(rows)
    return n


class Snapshots:
    """Tables by name, each with a manifest of its rows, their digest and when it was built. A snapshot is written beside the last one and
    counts from the moment its manifest is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def dump(self, df: DataFrame, name: str, built_at: str) -> None:
        at = f"{self.folder}/{name}/{re.sub(r'[^0-9A-Za-z]', '-', built_at)}"
        removed(self.spark, at)
        df.write.parquet(f"{at}/data")
        facts = content_hash(self.spark.read.schema(df.schema).parquet(f"{at}/data")).withColumn("built_at", F.lit(built_at))
        facts.coalesce(1).write.json(f"{at}/manifest")

    def manifest(self, name: str):
        """n, digest, built_at and at of the snapshot that was built last, or None."""
        try:
            found = self.spark.read.schema("n long, digest string, built_at string").json(f"{self.folder}/{name}/*/manifest").withColumn("at", F.regexp_replace(F.input_file_name(), "/manifest/[^/]*$", ""))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return found.orderBy(F.desc("built_at")).first()

    def restore(self, name: str, built_at: str | None = None) -> DataFrame:
        """The rows, verified. With built_at, only if that is the snapshot's: what was made from another one is out of date."""
        kept = self.manifest(name)
        if kept is None:
            raise KeyError(name)
        if built_at is not None and kept.built_at != built_at:
            raise ValueError(f"snapshot {name} was built at {kept.built_at}, not at {built_at}")
        df = self.spark.read.parquet(f"{kept.at}/data")
        got = content_hash(df).first()
        if tuple(got) != (kept.n, kept.digest):
            raise ValueError(f"snapshot {name} has {got.n} rows, {kept.n} were written, or their content differs")
        return df


class ImageCache:
    """Images of a store, kept in a folder once they were asked for. The folder is stamped with the build that its images are of:
    names stay the same from build to build while images change, so another build empties it."""

    def __init__(self, spark: SparkSession, source: DataFrame, folder: str):
        """source: name, content of all images."""
        self.spark, self.source, self.folder = spark, source, folder

    def found(self, part: str, read):
        """read(path) of a part of the folder, or None where it isn't there yet; any other fault is an error."""
        path = f"{self.folder}/{part}"
        try:
            return reading(path, lambda: read(path))
        except SourceError as e:
            if e.reason != MISSING:
                raise
            return None

    def stamp(self) -> str | None:
        """The build that the cached images are of."""
        rows = self.found("stamp", self.spark.read.text)
        return rows and rows.first()[0]

    def sync(self, built_at: str) -> bool:
        """Whether the cached images are of this build; if not, they are removed and the folder is stamped anew."""
        if self.stamp() == built_at:
            return True
        removed(self.spark, self.folder)
        self.spark.createDataFrame([(built_at,)], "value string").write.text(f"{self.folder}/stamp")
        return False

    def images(self, names: DataFrame) -> DataFrame:
        """name, content of the named images. What isn't cached comes from the store and is cached. A name that the store
        doesn't have has no row."""
        wanted, path = names.select("name").distinct(), f"{self.folder}/images"
        kept = self.found("images", self.spark.read.parquet)
        new = wanted if kept is None else wanted.join(kept.select("name"), "name", "left_anti")
        self.source.select("name", "content").join(new, "name", "left_semi").write.mode("append").parquet(path)
        return self.spark.read.parquet(path).join(wanted, "name", "left_semi")


class SessionTable:
    """Sessions as versions in an append-only table: a save is committed whole, the last version of a session counts, and one without messages is gone."""

    SCHEMA = "session_id string, version long, at timestamp, messages array<struct<role: string, text: string>>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def all(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], self.SCHEMA)
        last = rows.groupBy("session_id").agg(F.max_by(F.struct("version", "at", "messages"), "version").alias("v")).select("session_id", "v.*")
        return last.filter("messages is not null")

    def save(self, sessions: DataFrame) -> None:
        """sessions: session_id, at, messages. Each gets the version after its last one."""
        last = self.spark.read.schema(self.SCHEMA).parquet(self.path).groupBy("session_id").agg(F.max("version").alias("last")) if self.exists() else None
        version = F.lit(1).cast("long")
        if last is not None:
            sessions, version = sessions.join(last, "session_id", "left"), F.coalesce(F.col("last"), F.lit(0)) + 1
        valid = F.when(F.col("session_id").rlike("^[0-9A-Za-z-]+$"), F.col("session_id")).otherwise(F.raise_error(F.concat(F.lit("not the id of a session: "), F.col("session_id"))))
        sessions.select(valid.alias("session_id"), version.alias("version"), "at", "messages").write.mode("append").parquet(self.path)

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def load(self, session_id: str):
        """The session, or None; a record whose messages lack a role or text is an error."""
        found = self.all().filter(F.col("session_id") == session_id).first()
        if found is not None and any(m.role is None or m.text is None for m in found.messages):
            raise ValueError(f"session {session_id} holds a message without role or text")
        return found

    def delete(self, session_ids: DataFrame) -> None:
        """session_ids: session_id."""
        gone = session_ids.join(self.all().select("session_id", "at"), "session_id")
        self.save(gone.select("session_id", "at", F.lit(None).cast("array<struct<role: string, text: string>>").alias("messages")))

    def expire(self, days: int, newest: int) -> None:
        """Keep the newest so many sessions that are at most so many days older than the newest of all."""
        rows = self.all().select("session_id", "at")
        limit = rows.agg(F.max("at").alias("newest"))  # one row
        # only as many as are kept need an order: a distributed top-k
        kept = rows.crossJoin(F.broadcast(limit)).filter(F.col("at") >= F.col("newest") - F.expr(f"interval {days} days")).orderBy(F.desc("at"), F.desc("session_id")).limit(newest)
        self.delete(rows.join(kept.select("session_id"), "session_id", "left_anti").select("session_id"))
