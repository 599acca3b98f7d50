"""Quality of retrieval, of decisions and of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.session import prepared


def share(flag: Column, of: Column | None = None) -> Column:
    """Mean of a condition over the rows of a cohort; null where the cohort is empty."""
    value = flag.cast("int").cast("double")
    return F.avg(value if of is None else F.when(of, value))


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def running_total(df: DataFrame, by: str | list[str], value: str, groups: tuple[str, ...] = (), buckets: int = 64) -> DataFrame:
    """df with before, the sum of value over rows of the group with a smaller by, and total, the group's sum. by must be unique in a group, but for
    rows whose value is 0, and its first column a number. Ranges of it are summed apart and then put in order, so that no task needs all rows, nor all of a group."""
    prepared(df.sparkSession)
    by, groups = [by] if isinstance(by, str) else by, list(groups)
    cuts = df.agg(F.percentile_approx(by[0], [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.lit(0)  # how many cuts lie below
    for c in cuts:
        bucket = bucket + F.coalesce(F.col(by[0]) > F.lit(c), F.lit(False)).cast("int")
    out = df.withColumn("__b", bucket)
    sums = out.groupBy(*groups, "__b").agg(F.sum(value).alias("s"))  # a row for each range of a group
    per = Window.partitionBy(*groups)
    offset = sums.select(
        *(F.col(g).alias(f"__of_{g}") for g in groups), F.col("__b").alias("__o"),
        F.coalesce(F.sum("s").over(per.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.sum("s").over(per).alias("total"),
    )
    within = F.coalesce(F.sum(value).over(Window.partitionBy(*groups, "__b").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("__b") == F.col("__o")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    out = out.withColumn("__w", within).join(offset if groups else F.broadcast(offset), same)  # without groups at most ``buckets`` rows
    return out.withColumn("before", F.col("__base") + F.col("__w")).drop("__b", "__w", "__o", "__base", *(f"__of_{g}" for g in groups))


def quantiles(df: DataFrame, value: str, at: dict, groups: tuple[str, ...] = ()) -> DataFrame:
    """groups, n, lo, hi and a column for each name in at: the value at a place that is counted from 0 in ascending order, a function of the
    number of values; between two places the values are interpolated. Exact, and no task gets a whole group. Nulls don't count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("c"))
    placed = running_total(counts, value, "c", groups)
    n = F.col("total")

    def picked(place):
        """The value in the given whole place."""
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("c")), F.col(value)))

    def one(f):
        place = f(n)
        low = F.floor(place)
        return picked(low), picked(F.ceil(place)), F.max(place - low)

    parts = {name: one(f) for name, f in at.items()}
    out = placed.groupBy(*groups).agg(F.max("total").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), *(p.alias(f"__{name}_{i}") for name, ps in parts.items() for i, p in enumerate(ps)))
    between = lambda name: F.when(F.col(f"__{name}_2") == 0, F.col(f"__{name}_0")).otherwise(F.col(f"__{name}_0") + F.col(f"__{name}_2") * (F.col(f"__{name}_1") - F.col(f"__{name}_0")))
    return out.select(*groups, "n", "lo", "hi", *(between(name).alias(name) for name in at))


def quantile(p: float):
    """The place of a quantile, linearly interpolated."""
    return lambda n: (n - 1) * F.lit(p)


def nearest_rank(part: int, of: int):
    """The place n * part // of."""
    return lambda n: F.floor(n * part / of)


def auroc(signals: DataFrame) -> DataFrame:
    """auroc of signals (y 0 or 1, v): the chance that a positive is above a negative, ties counting half."""
    counts = signals.groupBy("v").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    placed = running_total(counts, "v", "n")
    wins = F.sum(F.col("p") * (F.col("before") + F.col("n") / 2))
    return placed.agg(ratio(wins, F.sum("p") * F.sum("n")).alias("auroc"))


def tpr_at_fpr(signals: DataFrame, fpr: float) -> DataFrame:
    """threshold, tpr: the share of positives strictly above the (1 - fpr) quantile of the negatives, linearly interpolated."""
    limit = quantiles(signals.filter("y = 0"), "v", {"threshold": quantile(1 - fpr)}).select("threshold")
    return signals.filter("y = 1").crossJoin(F.broadcast(limit)).groupBy("threshold").agg(share(F.col("v") > F.col("threshold")).alias("tpr"))  # limit: one row


def recall_at(hits: DataFrame, queries: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """recall_k columns over all queries (q); hits: q, rank, hit. A query without hits counts as missed."""
    per = hits.groupBy("q").agg(*(F.max((F.col("hit") & (F.col("rank") <= k)).cast("int")).alias(f"r{k}") for k in ks))
    joined = queries.select("q").join(per, "q", "left")
    return joined.agg(F.count("*").alias("n"), *(F.avg(F.coalesce(f"r{k}", F.lit(0)).cast("double")).alias(f"recall_{k}") for k in ks))


def end_to_end(rows: DataFrame) -> DataFrame:
    """Metrics of answers. rows: slug (null: there is none), indexed, answer (null: none given), correct."""
    has, none, unindexed = F.col("slug").isNotNull() & F.col("indexed"), F.col("slug").isNull(), F.col("slug").isNotNull() & ~F.col("indexed")
    given = F.col("answer").isNotNull()
    right = given & F.col("slug").eqNullSafe(F.col("answer"))
    p, r = ratio(F.count_if(right), F.count_if(given)), ratio(F.count_if(right & has), F.count_if(has))
    out = rows.agg(
        F.count("*").alias("n"), share(F.when(none, ~given).otherwise(right), has | none).alias("accuracy"), share(F.when(none | unindexed, ~given).otherwise(right)).alias("accuracy_all"),
        p.alias("precision"), r.alias("recall"), F.count_if(right & has).alias("hit"), F.count_if(given & ~right & has).alias("wrong"), F.count_if(~given & has).alias("missed"),
        F.count_if(given & none).alias("false_accept"), F.count_if(~given & none).alias("correct_reject"), F.count_if(given & unindexed).alias("unindexed_accepted"), F.count_if(~given & unindexed).alias("unindexed_rejected"),
    )
    return out.withColumn("f1", F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def detection(images: DataFrame, candidates: DataFrame, targets: DataFrame, threshold: float) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, exact (images without error), fp_on_empty. images: img; candidates: img, p, y; targets: img, n_targets."""
    chosen = candidates.filter(F.col("p") >= threshold).groupBy("img").agg(F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    per = images.select("img").join(chosen, "img", "left").join(targets, "img", "left").select("img", z("tp").alias("tp"), z("fp").alias("fp"), z("n_targets").alias("t"))
    per = per.withColumn("fn", F.greatest(F.col("t") - F.col("tp"), F.lit(0)))
    out = per.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), share((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"), share(F.col("fp") > 0, F.col("t") == 0).alias("fp_on_empty"))
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1.0))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    b = beta * beta
    return (1 + b) * p * r / (b * p + r + 1e-9)


def sweep(scored: DataFrame, missed: int, beta: float, steps: int = 91) -> DataFrame:
    """threshold, precision, recall, f for thresholds 0.05, 0.06, ... 0.95; scored: p, y. Scores are counted by the first
    threshold above them, so that each row is read once whatever the number of thresholds."""
    step = F.floor(F.round((F.col("p") - 0.05) * 100, 9)).cast("int")
    bins = scored.groupBy(F.least(F.greatest(step, F.lit(-1)), F.lit(steps - 1)).alias("b")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    spark = scored.sparkSession
    grid = spark.range(-1, steps).select(F.col("id").cast("int").alias("b")).join(bins, "b", "left").fillna(0, ["pos", "neg"])
    above = Window.orderBy(F.desc("b"))  # 92 rows
    all_ = F.sum("pos").over(Window.partitionBy())
    t = grid.select("b", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), all_.alias("total")).filter("b >= 0")
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    n = F.col("total") + missed
    r = F.when(n == 0, 1.0).otherwise(F.col("tp") / n)
    out = t.select(((F.col("b") + 5) / 100).alias("threshold"), p.alias("precision"), r.alias("recall"))
    return out.withColumn("f", f_beta(F.col("precision"), F.col("recall"), beta))


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """bin, n: equal bins on the range of the values widened to multiples of 0.05; the last bin holds its upper end."""
    ends = df.agg((F.floor(F.min(value) * 20) / 20).alias("lo"), (F.ceil(F.max(value) * 20) / 20).alias("hi"))  # one row
    at = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
