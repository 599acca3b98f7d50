"""Readers and writers: catalogs, label maps, JSON lines, snapshots, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galena.operators.catalog import checked
from galena.operators.datasets import content_hash


def read_catalog(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV catalog: all columns trimmed strings, a byte-order mark ignored, keys given and unique."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    if key not in raw.columns:
        raise ValueError(f"no column {key}")
    return checked(raw.select(*(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in raw.columns)), key)


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    if missing := [c for c in required if c not in raw.columns]:
        raise ValueError(f"no columns {missing}")
    return raw


def build_rows(catalog: DataFrame, key: str, photo: str, group: str | None, fields: dict[str, str]) -> DataFrame:
    """slug, photo, grp, fields: rows with a photo; a blank group is the row's own; blank fields are left out. fields: new name -> column."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    values = F.map_filter(F.create_map(*[x for n, c in fields.items() for x in (F.lit(n), blank(c))]), lambda k, v: v.isNotNull())
    grp = F.coalesce(blank(group), F.col(key)) if group else F.col(key)
    return catalog.select(F.col(key).alias("slug"), blank(photo).alias("photo"), grp.alias("grp"), values.alias("fields")).filter("photo is not null")


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """pos, file, label of a JSON object {file: label}, in the order of the file."""
    text = spark.read.text(path, wholetext=True)
    pairs = F.map_entries(F.from_json("value", T.MapType(T.StringType(), T.StringType())))
    return text.select(F.posexplode(pairs).alias("pos", "e")).select("pos", F.col("e.key").alias("file"), F.col("e.value").alias("label"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a torn line is left out."""
    whole = spark.read.schema(schema + ", _torn string").option("columnNameOfCorruptRecord", "_torn").json(path)
    return whole.filter(F.col("_torn").isNull()).drop("_torn")


def wanted_lines(lines: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The wanted rows, and the wanted keys that have none."""
    return lines.join(wanted, key, "left_semi"), wanted.join(lines, key, "left_anti")


def upserted(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The table with rows of equal key replaced; of new rows with one key the last by order counts."""
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__n = 1").drop("__n", order)
    return table.join(last, key, "left_anti").unionByName(last)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Parquet with a manifest of row count and content hash."""
    df.write.parquet(f"{path}/data")
    content_hash(df.sparkSession.read.parquet(f"{path}/data")).write.json(f"{path}/manifest")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a snapshot, or an error if they aren't those that were written."""
    df = spark.read.parquet(f"{path}/data")
    want, got = spark.read.schema("n long, digest string").json(f"{path}/manifest").first(), content_hash(df).first()
    if tuple(want) != tuple(got):
        raise ValueError(f"snapshot has {got.n} rows, {want.n} were written, or their content differs")
    return df


def per_row(df: DataFrame, f, out: str) -> DataFrame:
    """f over every row as a dict; a row that fails is a row with status error, the rest goes on. out: schema of what f returns."""
    import pandas as pd

    names = [x.name for x in T._parse_datatype_string(out).fields]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    rows.append({**f(row), "status": "ok", "error": None})
                except Exception as e:  # noqa: BLE001
                    rows.append({**dict.fromkeys(names), "status": "error", "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[*names, "status", "error"])

    return df.mapInPandas(run, out + ", status string, error string")


def write_report(df: DataFrame, path: str) -> None:
    """The rows as JSON lines and as CSV."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
