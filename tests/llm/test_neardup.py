"""Near-duplicates against all pairs in plain Python."""

import random
import re

from pyspark.sql import functions as F

from galena.llm import neardup, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """rows: (doc_id, text). Per row (doc_id, n_shingles, component_id, kept)."""
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return sorted((key, len(sets[i]), least[find(i)], key == least[find(i)]) for i, (key, _) in enumerate(rows))


def same(df, rows, k, percent):
    assert sorted(map(tuple, neardup.near_duplicates(df, k, percent).collect())) == brute(rows, k, percent)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = registry.QUERIES["op5_near_duplicates"](spark, sf).collect()
    assert sorted(map(tuple, got)) == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)


def test_chains_and_limits(spark, edge_docs):
    """Chains whose ends aren't similar, pairs just above and below the limit, groups with no common first member."""
    rng = random.Random(11)
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((40, 120, 300)))]
        for _ in range(14):
            rows.append((1000 + len(rows) * 37 % 9973, " ".join(base)))
            for _ in range(max(1, len(base) // rng.choice((25, 50, 60, 100)))):
                base[rng.randrange(len(base))] = f"w{rng.randrange(4000)}"
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(0))
    same(df, rows, 3, 85)
    same(df, rows, 5, 80)


def test_edges(spark, edge_docs, no_docs):
    same(edge_docs, [(r.doc_id, r.text) for r in edge_docs.collect()], 3, 85)
    assert neardup.near_duplicates(no_docs).count() == 0
    kept = neardup.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    want = {k for k, _, _, own in brute([(r.doc_id, r.text) for r in edge_docs.collect()], 5, 80) if own}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    nulls = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, "x y z x y z")], "doc_id long, text string")
    got = neardup.near_duplicates(nulls).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(None, 5, False), (5, 5, True), (None, None, True)], key=str)


def test_small_blocks(spark, monkeypatch):
    """Buckets dealt out to many blocks, by members and by shingles."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.choice((1, 2, 3))):
            own[rng.randrange(len(own))] = f"v{rng.randrange(900)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __at", "2 as __NONE")
    for block, shingles in ((7, 1 << 21), (1024, 90)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
        same(df, rows, 3, 85)
    assert neardup.deduplicate(df, 3, 85).columns == df.columns
