"""Rows that share a doc_id, or have none, are told apart by their texts."""

import random

from galena.llm import decontam, neardup

SCHEMA = "doc_id long, text string, lang string"


def unrelated(n):
    rng = random.Random(3)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(n)]


def test_deduplicate_keeps_unrelated_texts(spark):
    a, b, c, d, e, f = unrelated(6)
    near = e.rsplit(" ", 1)[0] + " other"
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (8, e), (9, near), (9, f), (None, f), (None, None), (None, ""), (3, " "), (3, " ")]
    df = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)
    got = neardup.deduplicate(df)
    assert got.columns == df.columns
    want = [(None, a), (None, b), (7, c), (7, d), (8, e), (9, f), (None, None), (None, ""), (3, " "), (3, " ")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_near_copies_without_ids(spark):
    texts = unrelated(20)
    rows = [(None, t) for t in texts] + [(None, t + " tail") for t in texts]
    got = neardup.deduplicate(spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)).collect()
    assert sorted(r.text.removesuffix(" tail") for r in got) == sorted(texts)


def test_decontaminate_drops_only_the_row_that_holds_a_window(spark):
    a, b, item = unrelated(3)
    rows = [(None, a), (None, f"{b} {item}"), (None, None), (4, b), (4, item), (5, a)]
    df = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for options in ({}, {"max_broadcast_bytes": 0}):
        got = decontam.decontaminate(df, items, n=10, **options)
        assert got.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(None, a), (None, None), (4, b), (5, a)], key=repr)
