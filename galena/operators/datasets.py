"""Splits, limits and integrity of labelled datasets. Order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions.text import hash_fraction

from .evaluation import quantiles


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def label_conflicts(df: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    """n_keys, conflicts: rows whose label differs from their key's first."""
    first = F.first(label).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.select(key, (~F.col(label).eqNullSafe(first)).alias("x")).agg(F.countDistinct(key).alias("n_keys"), F.count_if(F.col("x")).alias("conflicts"))


def class_split(df: DataFrame, label: str, share: float = 0.1) -> DataFrame:
    """role: classes are dealt whole by their hash; those chosen are val, or distractors if they have one row only."""
    sizes = df.groupBy(label).agg(F.count("*").alias("__size"))
    role = F.when(hash_fraction(F.col(label).cast("string")) >= share, "train").when(F.col("__size") >= 2, "val").otherwise("val_distractors")
    return df.join(sizes, label).withColumn("role", role).drop("__size")


def trimmed(df: DataFrame, label: str, key: str, least: int, cap: int) -> DataFrame:
    """Classes of at least so many rows, and of each the first cap rows by hash. This operator is a sample by design."""
    per = Window.partitionBy(label)
    order = per.orderBy(F.sha2(F.col(key).cast("string"), 256))
    return df.select("*", F.count("*").over(per).alias("__n"), F.row_number().over(order).alias("__r")).filter((F.col("__n") >= least) & (F.col("__r") <= cap)).drop("__n", "__r")


def whole_classes(df: DataFrame, label: str, n: int) -> DataFrame:
    """Classes in order until they hold n rows, each whole. What is summed in order is a row for each class."""
    sizes = df.groupBy(label).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = sizes.withColumn("before", before).filter(F.col("before") < n).select(F.col(label).alias("__l"))
    return df.join(chosen, F.col(label) == F.col("__l"), "left_semi")


def evenly(df: DataFrame, pos: str, m: int) -> DataFrame:
    """m rows at even steps of a position that counts from 0: the first and the last are among them, halves go to the even position."""
    n = df.agg(F.max(pos) + 1).first()[0] or 0
    steps = df.sparkSession.range(m).select(F.bround(F.col("id") * F.lit((n - 1) / max(m - 1, 1)), 0).cast("long").alias("__at")).distinct()
    return df.join(F.broadcast(steps), F.col(pos) == F.col("__at"), "left_semi") if m <= 1_000_000 else df.join(steps, F.col(pos) == F.col("__at"), "left_semi")


def shard_of(pos: Column, n: Column, shards: int) -> Column:
    """Contiguous shards with edges floor(n k / shards): the shard that holds the position."""
    k = F.floor((pos * shards + shards - 1) / n)
    return F.when(F.floor(n * k / shards) > pos, k - 1).when(F.floor(n * (k + 1) / shards) <= pos, k + 1).otherwise(k).cast("long")


def one_shot(df: DataFrame, label: str, pos: str) -> DataFrame:
    """side: the first row of each class is gallery, the rest are queries."""
    first = F.row_number().over(Window.partitionBy(label).orderBy(pos)) == 1
    return df.withColumn("side", F.when(first, "gallery").otherwise("query"))


def halves(df: DataFrame, order: str) -> DataFrame:
    """half: the first floor(n / 2) rows are noise, the others queries. The cut is the value at that place of a unique order column."""
    cut = quantiles(df, order, {"cut": lambda n: F.floor(n / 2) - 1}).first()["cut"]  # one row
    return df.withColumn("half", F.when(F.lit(cut is not None) & (F.col(order) <= F.lit(cut)), "noise").otherwise("query"))


def differences(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """key, kind: keys that are missing, unknown or changed in b."""
    left, right = a.select(F.col(key).alias("ka"), F.col(value).alias("va")), b.select(F.col(key).alias("kb"), F.col(value).alias("vb"))
    kind = F.when(F.col("kb").isNull(), "missing").when(F.col("ka").isNull(), "unknown").when(~F.col("va").eqNullSafe(F.col("vb")), "changed")
    return left.join(right, F.col("ka") == F.col("kb"), "full").select(F.coalesce("ka", "kb").alias("key"), kind.alias("kind")).filter("kind is not null")


def set_equality(full: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """missing, unknown, equal of the set of rows of full against the union of the parts: how many rows only the one has, and only the other."""
    name = full.columns
    union = parts[0].toDF(*name)
    for p in parts[1:]:
        union = union.unionByName(p.toDF(*name))
    sides = full.select(*name, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(union.select(*name, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    rows = sides.groupBy(*name).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    out = rows.agg(F.count_if((F.col("__a") == 1) & (F.col("__b") == 0)).alias("missing"), F.count_if((F.col("__a") == 0) & (F.col("__b") == 1)).alias("unknown"))
    return out.withColumn("equal", (F.col("missing") == 0) & (F.col("unknown") == 0))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def fingerprint(config: Column) -> Column:
    """16 hexadecimal digits of the SHA-256 of a map's entries as JSON, sorted by key."""
    entries = F.transform(F.array_sort(F.map_entries(config)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), e["value"], F.lit('"')))
    return F.substring(F.sha2(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")), 256), 1, 16)


def content_hash(df: DataFrame) -> DataFrame:
    """n, digest of all rows in any order. Two numbers of 60 bits from each row's SHA-256 are added up, so that equal rows count as often as they occur."""
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return df.agg(F.count("*").alias("n"), F.concat_ws("-", part(1), part(16)).alias("digest"))
