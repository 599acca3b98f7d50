"""Catalog rows: constraints, cards, search, suggestions, knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions.text import all_words_in


def key_faults(df: DataFrame, key: str) -> DataFrame:
    """blank, repeated: how many rows break the rule that keys are given and unique."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    blank = F.trim(F.coalesce(F.col(key), F.lit(""))) == ""
    return counted.agg(F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("blank"), F.count_if(~blank & (F.col("n") > 1)).alias("repeated"))


def checked(df: DataFrame, key: str) -> DataFrame:
    """The rows, or an error if a key is blank or repeated."""
    f = key_faults(df, key).first()
    if f.blank or f.repeated:
        raise ValueError(f"{key}: {f.blank} blank, {f.repeated} repeated")
    return df


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that contain all words of the query in the columns together."""
    return df.filter(all_words_in(F.lit(query), F.concat_ws(" ", *columns)))


def same_group(df: DataFrame, key: str, group: str, order: str, n: int = 5) -> DataFrame:
    """key, other, rank: the first n other members of each row's group. The members that can be among them are cut before the join."""
    first = Window.partitionBy(group).orderBy(order)
    head = df.select(F.col(group).alias("og"), F.col(key).alias("other"), F.row_number().over(first).alias("nth")).filter(F.col("nth") <= n + 1)
    pairs = df.join(head, (F.col(group) == F.col("og")) & (F.col(key) != F.col("other")))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("nth")))
    return ranked.filter(F.col("rank") <= n).select(key, "other", "rank")


def suggestions(df: DataFrame, key: str, category: str, brand: str, image: str, of_category: str | None, of_brand: str | None, seed: int, n: int = 5) -> DataFrame:
    """key, rank: up to n items of the category, or of the brand if no item has the category; the own brand first, then
    items with an image, then by a hash of seed and key."""
    known = of_category is not None and not df.filter(F.col(category) == of_category).isEmpty()
    pool = df.filter(F.col(category) == of_category) if known else df.filter(F.col(brand) == of_brand)
    own = F.coalesce(F.col(brand) == F.lit(of_brand), F.lit(False))
    dice = F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")), 256)
    ranked = pool.select(key, own.alias("own"), F.col(image).isNotNull().alias("pictured"), dice.alias("dice")).orderBy(F.desc("own"), F.desc("pictured"), "dice").limit(n)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("own"), F.desc("pictured"), "dice"))).select(key, "rank")


def knowledge(selected: DataFrame, base: DataFrame) -> DataFrame:
    """key, axis, value, bullets: what is known of each selected (key, axis, value); the axis' entry for 'unknown' where the value has none; axes without bullets are left out."""
    exact = base.select("axis", "value", "bullets")
    unknown = base.filter(F.col("value") == "unknown").select("axis", F.col("bullets").alias("other"))
    out = selected.join(exact, ["axis", "value"], "left").join(unknown, "axis", "left")
    out = out.select("key", "axis", F.when(F.col("bullets").isNull(), "unknown").otherwise(F.col("value")).alias("value"), F.coalesce("bullets", "other").alias("bullets"))
    return out.filter(F.size("bullets") > 0)


def band(value: Column, limits: list[float], names: list[str]) -> Column:
    """The name of the first limit that the value is below; the last name beyond all; unknown if null."""
    out = F.when(value.isNull(), "unknown")
    for limit, name in zip(limits, names, strict=False):
        out = out.when(value < limit, name)
    return out.otherwise(names[-1])


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """The name of the first pattern that is found."""
    out = None
    for pattern, name in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)
