"""Repeated byte strings against a table of all strings, and the sort against sorted()."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from galena.llm import registry, suffixdedup


def brute(rows, length=400):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(d[i : i + length] for _, d in data for i in range(len(d) - length + 1))
    out = []
    for k, d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **options):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove(df, **options).collect()), key=str)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = registry.QUERIES["op3_suffix_dedup"](spark, sf).collect()
    assert sorted(map(tuple, rows), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def planted(seed):
    """Passages around the limit in changing surroundings, periodic texts, overlaps, borders at document ends."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [noise(n) for n in (398, 399, 400, 401, 450, 800, 1500)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            cut = rng.choice((0, 0, 0, 1, 30))
            parts += [noise(rng.choice((0, 1, 5, 40, 700))), p[cut:]]
        rows.append((i, "".join(parts)))
    rows += [(100, "ab" * 400), (101, "x" * 401), (102, "y" * 400), (103, noise(3000)), (104, "é" * 300 + noise(200)), (105, noise(10) + "é" * 300)]
    return rows


@pytest.mark.parametrize("group", [4096, 3])
def test_planted(spark, edge_docs, monkeypatch, group):
    monkeypatch.setattr(suffixdedup, "GROUP", group)
    monkeypatch.setattr(suffixdedup, "SORT_ROWS", 50)
    rows = planted(1) + [(r.doc_id + 200, r.text) for r in edge_docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lo", F.lit(1))
    assert got(df, keep_text=group == 3) == brute(rows)


def test_edges(spark, no_docs):
    assert suffixdedup.remove(no_docs).count() == 0
    same = "The same text. " * 40
    rows = [(1, same), (1, same), (None, same[:420]), (1, "short"), (2, None)]
    out = suffixdedup.remove(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.columns[:2] == ["doc_id", "text"]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_long_documents_are_cut_alike(monkeypatch):
    rng = random.Random(2)
    data = bytes(rng.choice(b"abc") for _ in range(5000))
    whole = {(lo, a) for _, _, lo0, hi, a in suffixdedup.segments(data) for lo in range(lo0, hi + 1)}
    monkeypatch.setattr(suffixdedup, "STARTS", 1000)
    parts = {(lo, a) for _, _, lo0, hi, a in suffixdedup.segments(data) for lo in range(lo0, hi + 1)}
    assert whole == parts and {lo for lo, _ in whole} == set(range(len(data) - 399))


def test_sorting():
    rng = random.Random(4)
    for alphabet, n in ((b"ab", 400), (bytes(range(256)), 300), (b"\0a", 300)):
        base = bytes(rng.choice(alphabet) for _ in range(200))
        strings = [base[: rng.randrange(200)] + bytes(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(n)]
        strings += [b"", b"\0", b"\0\0", base, base]
        order = suffixdedup.deep_shallow(strings)
        assert sorted(order.tolist()) == list(range(len(strings)))
        assert [strings[i] for i in order] == sorted(strings)
        common = suffixdedup.common_prefix
        for a, b in zip(strings, strings[1:], strict=False):
            assert common(a, b) == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
