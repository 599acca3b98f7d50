"""The pipeline's stages against plain Python, stage by stage."""

import hashlib
import re

import corpus_pipeline
import numpy as np
import pytest
from galena.llm import bpe, pii
from test_native import leaks
from test_neardup import brute
from test_tokens import library

PLANTED = [re.compile(p) for p in (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d)", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(?<![\d.])\d{16}(?!\d)", r"[0-9a-f]{32,}")]


@pytest.fixture(autouse=True)
def one_key(spark):
    spark.conf.set(pii.KEY_SETTING, "a key for all runs")
    yield
    spark.conf.unset(pii.KEY_SETTING)


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    steps, df = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == docs.columns, name
        steps.append({r.doc_id: r.text for r in df.collect()})
        df = spark.createDataFrame(df.collect(), docs.schema)
    language, single, clean, private = steps
    assert language == {k: t for k, t in rows.items() if any(c.isalpha() for c in t or "")}
    kept = {k for k, _, _, own in brute(list(language.items()), 5, 80) if own}
    assert single == {k: language[k] for k in kept}
    assert clean == {k: t for k, t in single.items() if not leaks(t, items)[-1]}
    assert private.keys() == clean.keys()
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.text for r in got} == private and all(r.n_tokens > 0 for r in got)
    # entities go one for one, and all else stays
    for key, text in clean.items():
        found = [m for p in PLANTED for m in p.findall(text)]
        new = [m for p in PLANTED for m in p.findall(private[key])]
        assert len(found) == len(new) and not set(found) & set(new)
        if not pii_like(text):
            assert private[key] == text
    t = library(bpe.default_vocabulary())
    for r in got:
        ids = t.encode(r.text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def pii_like(text):
    return re.search(r"[0-9@]", text) or any(x in text for x in pii.TITLES)


def test_run_leaves_only_its_result(spark, sf):
    import os

    from galena.llm.common import shared_dir

    at = shared_dir(spark).removeprefix("file://")
    before = {p for p in os.listdir(at) if p.startswith("galena-")}
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert {p for p in os.listdir(at) if p.startswith("galena-")} == before


def test_edges(spark, edge_docs, no_docs, sf):
    edge = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for df in (edge, edge.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            df = spark.createDataFrame((out := stage(spark, df, sf)).collect(), out.schema)
        assert df.columns[:5] == edge.columns
