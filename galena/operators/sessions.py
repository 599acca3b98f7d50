"""Conversations and sessions as tables of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histories(turns: DataFrame, session: str = "conv_id") -> DataFrame:
    """session, messages (in order of turn), valid: a history must end with the user's message."""
    out = turns.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"), F.max_by("role", "turn").alias("last"))
    return out.select(session, "messages", (F.col("last") == "user").alias("valid"))


def retained(df: DataFrame, owner: str, at: str, tie: str, days: int, n: int) -> DataFrame:
    """The newest n rows of each owner that are at most so many days older than the newest row of all."""
    newest = df.agg(F.max(at).alias("__newest"))  # one row
    order = Window.partitionBy(owner).orderBy(F.desc(at), F.desc(tie))
    young = df.crossJoin(F.broadcast(newest)).filter(F.col(at) >= F.col("__newest") - F.expr(f"interval {days} days")).drop("__newest")
    return young.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")


def latest(df: DataFrame, key: str, operation: str, value: str) -> DataFrame:
    """key, value of the latest operation: what arrives late changes nothing."""
    return df.groupBy(key).agg(F.max(operation).alias(operation), F.max_by(value, operation).alias(value))


def serial_turns(operations: DataFrame, session: str, order: str, kind: str, failed: str) -> DataFrame:
    """status and turn of each operation ('open' or 'ask') of a session, taken one after the other: a second open is a conflict (409), an ask before the
    open finds no session (404), a failed ask (502) leaves the state as it is; turn is the number of answers so far."""
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.coalesce(F.max(F.col(kind) == "open").over(before), F.lit(False))
    status = F.when(F.col(kind) == "open", F.when(opened, 409).otherwise(200)).when(~opened, 404).when(F.col(failed), 502).otherwise(200)
    out = operations.withColumn("status", status)
    return out.withColumn("turn", F.sum(((F.col("status") == 200) & (F.col(kind) == "ask")).cast("long")).over(so_far))
