"""Centroids, whitening and margin logits. Sums over rows are distributed; what reaches the driver has the size of the dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.functions.vectors import dot, normalized


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """label, centroid: rows of unit length are summed by class and brought to unit length."""
    long = df.select(label, F.posexplode(normalized(F.col(vec))).alias("pos", "x"))
    sums = long.groupBy(label, "pos").agg(F.sum("x").alias("x"))
    whole = sums.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("e"))
    return whole.select(label, normalized(F.transform("e", lambda e: e["x"])).alias("centroid"))


def moments(df: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sum and Gram matrix: each task sends one d x d block, added up by position."""

    def run(batches):
        total, n = None, 0
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf.v.tolist(), np.float64)
                x = np.column_stack([np.ones(len(x)), x])
                total = x.T @ x if total is None else total + x.T @ x
                n += len(x)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    rows = df.select(F.col(vec).alias("v")).mapInPandas(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    d = int(rows.i.max()) + 1
    m = np.zeros((d, d))
    m[rows.i, rows.j] = rows.x
    return int(round(m[0, 0])), m[0, 1:], m[1:, 1:]


def covariance(df: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (n - 1)."""
    n, s, gram = moments(df, vec)
    mean = s / n
    return mean, (gram - n * np.outer(mean, mean)) / max(n - 1, 1)


def whitening(df: DataFrame, vec: str, k: int, eps: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, matrix of k rows that whitens, explained shares: the eigenvectors of the covariance, on the driver."""
    mean, cov = covariance(df, vec)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return mean, ((vectors * signs)[:, order] / np.sqrt(values[order] + eps)).T, values[order] / values.sum()


def residual_basis(df: DataFrame, vec: str, basis: np.ndarray, k: int) -> np.ndarray:
    """k principal directions of what a basis (rows) leaves of the vectors."""
    _, cov = covariance(df, vec)
    q, _ = np.linalg.qr(basis.T)
    rest = np.eye(len(cov)) - q @ q.T
    values, vectors = np.linalg.eigh(rest @ cov @ rest)
    return vectors[:, np.argsort(-values)[:k]].T


def project(df: DataFrame, vec: str, mean: np.ndarray, matrix: np.ndarray, out: str) -> DataFrame:
    """The vectors under a small matrix."""
    schema = df.drop(out).schema.simpleString().removeprefix("struct<").removesuffix(">")
    columns = df.drop(out).columns

    def run(batches):
        for pdf in batches:
            x = (np.array(pdf[vec].tolist(), np.float64).reshape(len(pdf), -1) - mean) @ matrix.T if len(pdf) else []
            yield pdf[columns].assign(**{out: list(x)})

    return df.drop(out).mapInPandas(run, schema + f",{out}:array<double>")


CENTRE_BYTES = 64 << 20


def class_scores(rows: DataFrame, centres: DataFrame, max_broadcast_bytes: int = CENTRE_BYTES) -> DataFrame:
    """q, label, cls, size, cos of each row (q, label, vec) with each class (cls, centre, size). Centres are sent to all tasks if their measured size allows; more of them
    are dealt to blocks, and rows go to each block."""
    facts = centres.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("centre")), F.lit(0)).alias("d")).first()
    n = max(1, -(-facts.n * (facts.d * 8 + 64) // max_broadcast_bytes))
    if n == 1:
        pairs = rows.crossJoin(F.broadcast(centres))
    else:
        dealt = centres.withColumn("__block", F.pmod(F.xxhash64("cls"), F.lit(n)).cast("int"))
        pairs = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(dealt.hint("shuffle_hash"), "__block")
    return pairs.select("q", "label", "cls", "size", dot(F.col("vec"), F.col("centre")).alias("cos"))


def arcface(scores: DataFrame, scale: float, margin_a: float, margin_b: float, decay: float) -> DataFrame:
    """q, loss. scores: q, label, cls, cos, size (rows of the class): the best of a class' sub-centres counts, the target's angle gets a margin that
    shrinks with the size of its class, and the loss is the cross entropy of the scaled cosines."""
    best = scores.groupBy("q", "label", "cls").agg(F.max("cos").alias("cos"), F.max("size").alias("size"))
    own = F.col("cls") == F.col("label")
    angle = F.acos(F.least(F.greatest(F.col("cos"), F.lit(-1 + 1e-7)), F.lit(1 - 1e-7)))
    margin = margin_a * F.pow(F.col("size"), F.lit(-decay)) + margin_b
    logits = best.select("q", own.alias("own"), (scale * F.when(own, F.cos(angle + margin)).otherwise(F.col("cos"))).alias("z"))
    top = logits.groupBy("q").agg(F.max("z").alias("top"))
    out = logits.join(top, "q").groupBy("q").agg((F.ln(F.sum(F.exp(F.col("z") - F.col("top")))) + F.max("top") - F.max(F.when(F.col("own"), F.col("z")))).alias("loss"))
    return out
