"""Features of candidates relative to their image, scores, and ordered quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import running_total


def relative_features(df: DataFrame, image: str, conf: str, area: str, tie: list[str], strong: float = 0.7) -> DataFrame:
    """conf_rel, area_rel, rank_rel (place by confidence from 0, over the number), n, n_strong."""
    per = Window.partitionBy(image)
    order = per.orderBy(F.desc(conf), *tie)
    n = F.count("*").over(per)
    return df.select(
        "*", (F.col(conf) / F.nullif(F.max(conf).over(per), F.lit(0.0))).alias("conf_rel"), (F.col(area) / F.max(area).over(per)).alias("area_rel"),
        ((F.row_number().over(order) - 1) / n).alias("rank_rel"), n.alias("n"), F.sum((F.col(conf) >= strong).cast("int")).over(per).alias("n_strong"),
    )


#: Candidates of an image that are compared where they are; images of more are counted in ranges of areas.
CROWD = 64


def crowd(df: DataFrame, image: str, key: list[str], conf: str, area: str, least: float = 0.5, low: float = 0.5, high: float = 2.0, repeated: bool = False) -> DataFrame:
    """key, crowd: how many other confident candidates of the image are of similar area; key tells the candidates of an image apart. Where rows may be
    repeated, one of each key counts. An image may have any number of candidates: those of few are compared in a row for each image, after one
    exchange; those of many are counted as differences of running counts over areas, not by pairs."""
    rows = df.select(F.col(image).alias("img"), *key, F.col(conf).alias("__conf"), F.col(area).alias("__area"))
    many = rows.groupBy("img").count().filter(F.col("count") > CROWD).select(F.col("img").alias("__many"))
    whole = lambda x: x.dropDuplicates(["img", *key]) if repeated else x
    same = F.col("img").eqNullSafe(F.col("__many"))
    if many.isEmpty():
        out = crowd_of_few(whole(rows.repartition("img")), key, least, low, high)
    else:
        few, rest = rows.join(many, same, "left_anti"), rows.join(many, same, "left_semi")
        out = crowd_of_few(whole(few.repartition("img")), key, least, low, high).unionByName(crowd_of_many(whole(rest), key, least, low, high))
    return out.withColumnRenamed("img", image)


def crowd_of_few(rows: DataFrame, key: list[str], least: float, low: float, high: float) -> DataFrame:
    sure = F.coalesce((F.col("__conf") >= least) & F.col("__area").isNotNull(), F.lit(False))
    one = F.struct(*key, sure.alias("__sure"), F.col("__area"))
    images = rows.groupBy("img").agg(F.collect_list(one).alias("all"), F.collect_list(F.when(sure, F.col("__area"))).alias("areas"))
    of = images.select("img", "areas", F.inline("all"))
    near = F.size(F.filter("areas", lambda x: (x >= F.col("__area") * low) & (x <= F.col("__area") * high)))
    own = (F.col("__sure") & (F.col("__area") >= F.col("__area") * low) & (F.col("__area") <= F.col("__area") * high)).cast("int")
    return of.select("img", *key, F.when(F.col("__area").isNull(), 0).otherwise(near - own).cast("long").alias("crowd"))


def crowd_of_many(df: DataFrame, key: list[str], least: float, low: float, high: float) -> DataFrame:
    sure = (F.col("__conf") >= least) & F.col("__area").isNotNull()
    own = df.select("img", F.struct(*key).alias("who"), F.coalesce(sure, F.lit(False)).cast("long").alias("sure"), F.col("__area").alias("area"))
    # the candidate itself, and the ends of its range: areas below the one and up to the other count
    marks = F.array(*(F.struct(v.alias("at"), F.lit(o).alias("kind")) for v, o in ((F.col("area"), 1), (F.col("area") * low, 0), (F.col("area") * high, 2))))
    events = own.filter("area is not null").select("img", "who", "sure", F.inline(marks))
    # ends of ranges weigh nothing, so it doesn't matter how those at one place are ordered
    placed = running_total(events.withColumn("n", F.when(F.col("kind") == 1, F.col("sure")).otherwise(0)), ["at", "kind"], "n", ("img",))
    ends = lambda k: F.max(F.when(F.col("kind") == k, F.col("before")))
    near = placed.filter("kind <> 1").groupBy("img", "who").agg((ends(2) - ends(0) - F.max("sure")).alias("crowd"))
    out = near.unionByName(own.filter("area is null").select("img", "who", F.lit(0).cast("long").alias("crowd")))
    return out.select("img", *(F.col("who")[c].alias(c) for c in key), "crowd")


def logistic(features: list[Column], mean: list[float], std: list[float], coef: list[float], intercept: float) -> Column:
    z = F.lit(float(intercept))
    for x, m, s, c in zip(features, mean, std, coef, strict=True):
        z = z + (x - m) / s * c
    return 1 / (1 + F.exp(-z))


def quota(df: DataFrame, image: str, score: str, tie: list[str], ok: Column, threshold: float, n: int) -> DataFrame:
    """verdict, place: candidates are walked by score; after n valid ones the rest is over the limit. n = 0: no limit."""
    order = Window.partitionBy(image).orderBy(F.desc(score), *tie)
    valid = (F.col(score) >= threshold) & ok
    before = F.coalesce(F.sum(valid.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    verdict = F.when(F.col(score) < threshold, "not_target").when(F.lit(n > 0) & (before >= n), "over_limit").when(~ok, "check_failed").otherwise("valid")
    return df.select("*", verdict.alias("verdict"), F.when(verdict == "valid", before + 1).alias("place"))
