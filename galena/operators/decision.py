"""From candidates to one outcome for each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outcomes(crops: DataFrame, matches: DataFrame, rejections: DataFrame) -> DataFrame:
    """uuid, status, g, reason. crops: uuid; matches: uuid, g; rejections: uuid, reason. A crop with both a match and a rejection is an error."""
    out = crops.select("uuid").join(matches.select("uuid", "g"), "uuid", "left").join(rejections.select("uuid", "reason"), "uuid", "left")
    both = F.col("g").isNotNull() & F.col("reason").isNotNull()
    status = F.when(both, F.raise_error(F.lit("more than one outcome"))).when(F.col("g").isNotNull(), "matched").when(F.col("reason").isNotNull(), "rejected").otherwise("open")
    return out.withColumn("status", status)


def routed(candidates: DataFrame, picks: DataFrame) -> DataFrame:
    """q, n_groups, finalists, route, g: two rounds of choice.

    candidates: q, grp, g, place. picks: q, round (group or final), grp, g; g is null where nothing was chosen. A group of two or more needs a pick; a
    single candidate goes on by itself. Without finalists the query is rejected; one finalist out of a pick is the match;
    otherwise the final round decides.
    """
    return routed_groups(candidates.groupBy("q", "grp").agg(F.count("*").alias("n"), F.min_by("g", "place").alias("only"), F.min("place").alias("place")), picks)


def routed_groups(groups: DataFrame, picks: DataFrame) -> DataFrame:
    """As routed, from a row for each group: q, grp, n, only (its first candidate), place (of that one)."""
    picked = picks.filter(F.col("round") == "group").select("q", "grp", F.col("g").alias("pick"))
    final = picks.filter(F.col("round") == "final").select("q", F.col("g").alias("final_pick"))
    one = groups.join(picked, ["q", "grp"], "left").withColumn("finalist", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("pick")))
    made = F.transform(F.array_sort(F.filter(F.collect_list(F.struct("place", "finalist", "n")), lambda x: x["finalist"].isNotNull())), lambda x: F.struct(x["finalist"].alias("g"), x["n"].alias("n")))
    out = one.groupBy("q").agg(F.count("*").alias("n_groups"), made.alias("made")).join(final, "q", "left")
    size = F.size("made")
    route = F.when(size == 0, "rejected").when((size == 1) & (F.col("made")[0]["n"] > 1), "group").when(F.col("final_pick").isNull(), "final_rejected").otherwise("final")
    out = out.withColumn("finalists", size).withColumn("route", route)
    g = F.when(F.col("route") == "group", F.col("made")[0]["g"]).when(F.col("route") == "final", F.col("final_pick"))
    return out.select("q", "n_groups", "finalists", "route", g.alias("g"))


def with_fallback(answers: DataFrame, candidates: DataFrame, budget: float) -> DataFrame:
    """q, answer, source: the answer, or the best candidate where the second level failed or took longer than the budget; a given rejection stays."""
    top = candidates.groupBy("q").agg(F.max_by("g", F.struct("score", -F.col("g"))).alias("top"))
    late = (F.col("seconds") > budget) | F.col("failed")
    out = answers.join(top, "q", "left")
    return out.select("q", F.when(late, F.col("top")).otherwise(F.col("g")).alias("answer"), F.when(late, "fallback").when(F.col("g").isNull(), "rejected").otherwise("answer").alias("source"))


def first_detection(rows: DataFrame, image: str, score: str, tie: str) -> DataFrame:
    """The detection of the highest score of each image."""
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy(image).orderBy(F.desc(score), tie))).filter("rk = 1").drop("rk")


def similar_list(candidates: DataFrame, matched: DataFrame, n: int = 5) -> DataFrame:
    """q, g, rank: the first n candidates that aren't the match."""
    rest = candidates.join(matched.select("q", F.col("g").alias("own")), "q", "left").filter(~F.col("g").eqNullSafe(F.col("own")))
    return rest.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("place"))).filter(F.col("rank") <= n).select("q", "g", "rank")
