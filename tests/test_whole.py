"""Queries over whole texts, tables and vectors, where an older form of the query took a part."""

import hashlib

import numpy as np

from galena.plans import registry


def test_folded_whole_and_all_safe_names(spark, tmp_path):
    texts = ["  Ёлка " + "x" * 60 + " A", "  Ёлка " + "x" * 60 + " B", "а б/c.d-é", None]
    rows = [(i, text, lang) for i, (text, lang) in enumerate(zip(texts, ["de", None, "fr", "en"], strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    folded = {r.doc_id: r.folded for r in registry.QUERIES["P9_folded_whole"](spark, str(tmp_path)).collect()}
    assert folded == {i: x and hashlib.md5(x.strip(" ").lower().replace("ё", "е").encode()).hexdigest() for i, x, _ in rows}
    assert folded[0] != folded[1]
    names = {r.doc_id: r.name for r in registry.QUERIES["P10_safe_names_all"](spark, str(tmp_path)).collect()}
    assert names == {0: "_Ёлка_" + "x" * 60 + "_A", 1: "_Ёлка_" + "x" * 60 + "_B", 2: "а_б_c.d-é", 3: None}


def test_covariance_of_whole_vectors(spark, sf):
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], float)
    got = registry.QUERIES["G18_covariance_whole"](spark, sf).collect()
    cov = np.full((x.shape[1], x.shape[1]), np.nan)
    for r in got:
        cov[r.i, r.j] = r["cov"]
    assert len(got) == 64 * 64 and np.allclose(cov, np.cov(x.T), atol=1e-6)
