"""Language identification by held-out accuracy and plain bundling."""

import zlib

import numpy as np

from galena.llm import langid, registry


def test_held_out_accuracy(spark, sf):
    got = registry.QUERIES["op10_language"](spark, sf.replace("0.001", "0.01")).join(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    own = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(own) > 150 and sum(r.lang_pred == r.lang for r in own) >= 0.97 * len(own)
    assert all(0 <= r.score <= 1 for r in got)


def test_bundles_are_sums_of_bound_vectors():
    d = 64
    v = langid.letter_vectors(d).astype(int)
    c = langid.letter_classes()
    for text in ("Über das Tal", "a", "x1y  z", "日本 語"):
        letters = [0]
        for x in text.lower():
            k = int(c[ord(x)])
            if k or letters[-1]:
                letters.append(k)
        letters.append(0)
        want = sum((np.roll(v[letters[i - 1]], 2) * np.roll(v[letters[i]], 1) * v[letters[i + 1]] for i in range(1, len(letters) - 1) if letters[i]), np.zeros(d, int))
        assert (langid.bundle(["", text, "?!"], d) == [np.zeros(d), want, np.zeros(d)]).all()


def test_edges(spark, edge_docs, no_docs):
    prototypes = langid.train(edge_docs, dimensions=128)
    assert list(prototypes) == ["en", "fr"]
    got = langid.predict(edge_docs, prototypes, dimensions=128).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(x.isalpha() for x in r.text or "")), r
        assert r.lang_pred != "und" or r.score == 0
    assert langid.train(no_docs) == {}
    assert {r.lang_pred for r in langid.predict(edge_docs, {}).collect()} == {"und"}
    assert langid.predict(no_docs, prototypes, dimensions=128).count() == 0


def test_training_and_prediction_by_brute_force(spark, edge_docs):
    """Prototypes and cosines from plain sums over the texts."""
    d = 64
    rows = [r for r in edge_docs.collect()]
    total = {}
    for r in rows:
        if r.text is not None and r.lang is not None:
            total[r.lang] = total.get(r.lang, 0) + langid.bundle([r.text], d)[0].astype(float)
    unit = {k: v / np.linalg.norm(v) for k, v in sorted(total.items())}
    prototypes = langid.train(edge_docs, dimensions=d)
    assert prototypes.keys() == unit.keys() and all(np.allclose(prototypes[k], unit[k]) for k in unit)
    got = langid.predict(edge_docs, prototypes, dimensions=d).collect()
    for r in got:
        v = langid.bundle([r.text or ""], d)[0].astype(float)
        norm = np.linalg.norm(v)
        cosines = {k: v @ u / norm for k, u in unit.items()} if norm else {}
        assert abs(r.score - max([0, *cosines.values()])) < 1e-5
        assert not norm or cosines[r.lang_pred] > max(cosines.values()) - 1e-5


def test_a_null_id_is_not_held_out(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert [r.h for r in df.select(langid.held_out(df.doc_id).alias("h")).collect()] == [False, zlib.crc32(b"1") % 4 == 2]


def test_many_short_texts_of_a_large_alphabet_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, row)) for row in rng.integers(0x4E00, 0x9FFF, (2000, 100))]
    langid.bundle(texts[:10], langid.DIMENSIONS)
    tracemalloc.start()
    whole = langid.bundle(texts, langid.DIMENSIONS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak
    some = [0, 1, 255, 256, 1999]
    assert (whole[some] == np.concatenate([langid.bundle([texts[i]], langid.DIMENSIONS) for i in some])).all()
