"""Edge cases of the operators on small fixtures, and checks against plain numpy."""

import datetime
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.functions import geometry, text, vectors
from galena.operators import catalog, datasets, decision, evaluation, linalg, retrieval, scoring, sessions
from galena.sources import stores, tables
from galena.streaming import flows


def one(df, column="v"):
    return [r[column] for r in df.collect()]


def test_numbers(spark):
    df = spark.createDataFrame([("135",), ("12–14",), ("12,5%",), (" 7 ",), (None,), ("",), ("1.2.3",), ("100",)], "s string")
    assert one(df.select(text.strict_number(F.col("s"), 100).alias("v"))) == [None, None, 12.5, 7.0, None, None, None, 100.0]
    assert one(df.select(text.loose_number(F.col("s")).alias("v"))) == [135.0, 12.0, 12.5, 7.0, None, None, 1.2, 100.0]


def test_text(spark):
    df = spark.createDataFrame([(" NaN ",), ("не определено",), (" Ёлка x ",), ("",), (None,)], "s string")
    assert one(df.select(text.cleaned(F.col("s")).alias("v"))) == [None, None, "Ёлка x", None, None]
    assert one(df.select(text.folded(F.col("s")).alias("v")))[2] == "елка x"
    assert one(df.select(text.safe_name(F.lit("а б/c.d-é")).alias("v")))[0] == "а_б_c.d-é"
    assert one(df.select(text.uuid5(uuid.NAMESPACE_DNS.hex, F.lit("exämple")).alias("v")))[0] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "exämple"))
    assert one(df.select(text.all_words_in(F.lit(" ЁЛКА  X"), F.coalesce("s", F.lit(""))).alias("v"))) == [False, False, True, False, False]
    assert one(df.select(text.all_words_in(F.lit(" "), F.coalesce("s", F.lit(""))).alias("v"))) == [True] * 5


def test_topk_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 16))
    v[17] = v[5]  # a tie goes to the smaller id
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "g long, vec array<float>").repartition(7)
    v = np.float32(v).astype(float)
    score = v @ v.T
    np.fill_diagonal(score, -np.inf)
    want = [(q, int(g), r + 1) for q in range(300) for r, g in enumerate(np.lexsort((np.arange(300), -score[q]))[:5])]
    for limit in (1 << 26, 10_000, 700):
        got = retrieval.vector_topk(df.withColumnRenamed("g", "q"), df, 5, exclude_self=True, block_bytes=limit)
        assert sorted((r.q, r.g, r["rank"]) for r in got.collect()) == sorted(want)
    none = df.limit(0)
    assert retrieval.vector_topk(none.withColumnRenamed("g", "q"), df, 3).count() == 0
    assert retrieval.vector_topk(df.withColumnRenamed("g", "q"), none, 3).count() == 0


def test_groups(spark):
    hits = spark.createDataFrame([(1, 10, "a", 0.9), (1, 11, "a", 0.5), (1, 12, "b", 0.85), (1, 13, "c", 0.6), (2, 10, "a", 0.4)], "q long, g long, grp string, score double")
    members = spark.createDataFrame([(10, "a"), (11, "a"), (14, "a"), (12, "b"), (13, "c")], "g long, grp string")
    groups = retrieval.group_scores(hits)
    kept = retrieval.kept_groups(groups, 0.5, 0.07)
    assert sorted((r.q, r.grp) for r in kept.collect()) == [(1, "a"), (1, "b")]
    assert sorted((r.q, r.grp) for r in retrieval.kept_groups(groups, 0.5, None).collect()) == [(1, "a"), (1, "b"), (1, "c")]
    out = {r.place: (r.g, r.score, r.retrieved) for r in retrieval.expanded(kept, hits, members).collect()}
    assert out == {1: (10, 0.9, True), 2: (11, 0.5, True), 3: (14, 0.9, False), 4: (12, 0.85, True)}
    queries = spark.createDataFrame([(1,), (2,), (3,)], "q long")
    got = {r.q: (r.accepted, r.detail) for r in retrieval.accepted_or_rejected(queries, hits, 0.5).collect()}
    assert got == {1: (True, None), 2: (False, "best 0.400 is below 0.500"), 3: (False, "no result")}
    broken = spark.createDataFrame([(10, "a"), (10, "a"), (12, "b")], "g long, grp string")
    assert sorted(one(retrieval.incomplete_groups(broken, members), "grp")) == ["a"]


def test_routing(spark):
    cand = spark.createDataFrame([(1, "a", 1, 1), (2, "a", 1, 1), (2, "a", 2, 2), (3, "a", 1, 1), (3, "a", 2, 2), (4, "a", 1, 1), (4, "b", 2, 2), (4, "b", 3, 3), (5, "a", 1, 1)], "q long, grp string, g long, place int")
    picks = spark.createDataFrame([(2, "group", "a", 2), (3, "group", "a", None), (4, "group", "b", 3), (1, "final", None, 1), (4, "final", None, 3), (5, "final", None, None)], "q long, round string, grp string, g long")
    got = {r.q: (r.finalists, r.route, r.g) for r in decision.routed(cand, picks).collect()}
    assert got == {1: (1, "final", 1), 2: (1, "group", 2), 3: (0, "rejected", None), 4: (2, "final", 3), 5: (1, "final_rejected", None)}


def test_exactly_one_outcome(spark):
    crops = spark.createDataFrame([("x",), ("y",), ("z",)], "uuid string")
    m, r = spark.createDataFrame([("x", 5)], "uuid string, g long"), spark.createDataFrame([("y", "late")], "uuid string, reason string")
    assert {x.uuid: x.status for x in decision.outcomes(crops, m, r).collect()} == {"x": "matched", "y": "rejected", "z": "open"}
    with pytest.raises(Exception, match="more than one outcome"):
        decision.outcomes(crops, m, spark.createDataFrame([("x", "late")], "uuid string, reason string")).collect()


def test_auroc(spark):
    rng = np.random.default_rng(2)
    y, v = rng.integers(0, 2, 500), rng.integers(0, 40, 500) / 10
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, v, strict=True)], "y long, v double")
    p, n = v[y == 1], v[y == 0]
    want = ((p[:, None] > n[None, :]).mean() + (p[:, None] == n[None, :]).mean() / 2)
    got = evaluation.auroc(df).first().auroc
    assert abs(got - want) < 1e-9
    flipped = evaluation.auroc(df.withColumn("y", 1 - F.col("y"))).first().auroc
    assert abs(got + flipped - 1) < 1e-9
    assert evaluation.auroc(df.filter("y = 1")).first().auroc is None
    t = evaluation.tpr_at_fpr(df, 0.1).first()
    assert abs(t.threshold - np.quantile(n, 0.9)) < 1e-9 and abs(t.tpr - (p > t.threshold).mean()) < 1e-9


def test_sweep_against_loop(spark):
    rng = np.random.default_rng(8)
    p, y = rng.random(400), rng.integers(0, 2, 400)
    p[:5] = [0.05, 0.95, 0.5, 0.0, 1.0]
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y long")
    got = {round(r.threshold, 2): (r.precision, r.recall) for r in evaluation.sweep(df, 4, 1.5).collect()}
    assert len(got) == 91
    for t in (0.05, 0.3, 0.5, 0.95):
        chosen = p >= t - 1e-12
        tp = (chosen & (y == 1)).sum()
        assert got[t] == pytest.approx((tp / chosen.sum(), tp / (y.sum() + 4)))


def test_quota_against_loop(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i % 7), i, float(rng.integers(0, 10)) / 10, bool(rng.random() < 0.6)) for i in range(120)]
    df = spark.createDataFrame(rows, "img long, id long, s double, ok boolean")
    for n in (2, 0):
        got = {r.id: r.verdict for r in scoring.quota(df, "img", "s", ["id"], F.col("ok"), 0.3, n).collect()}
        for img in range(7):
            valid = 0
            for _, i, s, ok in sorted((r for r in rows if r[0] == img), key=lambda r: (-r[2], r[1])):
                want = "not_target" if s < 0.3 else "over_limit" if n and valid >= n else "check_failed" if not ok else "valid"
                valid += want == "valid"
                assert got[i] == want


def test_end_to_end_nulls(spark):
    df = spark.createDataFrame([(None, True, None), (1, True, None)], "slug long, indexed boolean, answer long")
    r = evaluation.end_to_end(df).first()
    assert r.precision is None and r.recall == 0 and r.f1 is None and r.correct_reject == 1 and r.missed == 1


def test_geometry(spark):
    square, hole = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [2.0, 1.0]]
    df = spark.createDataFrame([(square, [square, hole])], "p array<array<double>>, ps array<array<array<double>>>")
    c = F.col("p")
    r = df.select(geometry.area(c).alias("a"), geometry.contains(c, F.lit(2.0), F.lit(2.0)).alias("i"), geometry.contains(c, F.lit(5.0), F.lit(2.0)).alias("o"), geometry.bbox(F.col("ps")).alias("b"), F.size(geometry.proper(F.col("ps"))).alias("n")).first()
    assert (r.a, r.i, r.o, r.b, r.n) == (16.0, True, False, [0, 0, 4, 4], 1)
    u = df.select(geometry.to_unit(F.array(F.array(F.lit(20.0), F.lit(10.0))), F.lit(200.0), F.lit(100.0)).alias("u")).first().u
    assert u == [[0.1, 0.1]]


def test_splits(spark):
    df = spark.createDataFrame([(i, f"c{i % 40}") for i in range(200)] + [(200, "alone")], "id long, label string")
    roles = datasets.class_split(df, "label", 0.3).groupBy("label").agg(F.countDistinct("role").alias("n"))
    assert set(one(roles, "n")) == {1}
    whole = datasets.whole_classes(df, "label", 12)
    sizes = {r.label: r.n for r in whole.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"alone": 1, "c0": 5, "c1": 5, "c10": 5}
    ids = spark.range(10).toDF("g")
    for m in (1, 2, 4, 10):
        want = sorted({int(x) for x in np.round(np.linspace(0, 9, m))})
        assert sorted(one(datasets.evenly(ids, "g", m), "g")) == want
    for shards in (1, 3, 7, 10):
        edges = [10 * k // shards for k in range(shards + 1)]
        got = {r.g: r.s for r in ids.select("g", datasets.shard_of(F.col("g"), F.lit(10), shards).alias("s")).collect()}
        assert all(edges[s] <= g < edges[s + 1] for g, s in got.items())
    assert sorted(one(datasets.halves(ids, "g").filter("half = 'noise'"), "g")) == [0, 1, 2, 3, 4]


def test_suggestions(spark):
    rows = [(1, "red", "b1", "x"), (2, "red", "b1", None), (3, "red", "b1", "x"), (4, "red", "b2", "x"), (5, "red", "b2", None), (6, "red", "b3", "x"), (7, "white", "b1", "x")]
    df = spark.createDataFrame(rows, "k long, cat string, brand string, img string")
    ask = lambda c, b, s=1: [r.k for r in sorted(catalog.suggestions(df, "k", "cat", "brand", "img", c, b, s).collect(), key=lambda r: r["rank"])]
    got = ask("red", "b1")
    assert set(got[:2]) == {1, 3} and got[2] == 2 and set(got[3:]) == {4, 6}
    assert got == ask("red", "b1") and 5 not in got
    assert set(ask("no such", "b2")) == {4, 5} and ask("no such", "nor this") == []
    assert set(ask("white", None)) == {7}


def test_catalog_source(spark, tmp_path):
    (tmp_path / "ok.csv").write_bytes("﻿slug,name\n a ,\" x, y\"\nb,\n".encode())
    rows = tables.read_catalog(spark, f"file://{tmp_path}/ok.csv", "slug").collect()
    assert [tuple(r) for r in rows] == [("a", "x, y"), ("b", "")]
    (tmp_path / "bad.csv").write_text("slug,name\na,1\na ,2\n,3\n")
    with pytest.raises(ValueError, match="1 blank, 1 repeated"):
        tables.read_catalog(spark, f"file://{tmp_path}/bad.csv", "slug")
    with pytest.raises(ValueError, match="no column"):
        tables.read_catalog(spark, f"file://{tmp_path}/ok.csv", "key")


def test_json_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"b.jpg": "2",\n "a.jpg": "1"}')
    assert [tuple(r) for r in tables.read_label_map(spark, f"file://{tmp_path}/m.json").orderBy("pos").collect()] == [(0, "b.jpg", "2"), (1, "a.jpg", "1")]
    (tmp_path / "l.jsonl").write_text('{"file": "a", "n": 1}\n{"file": "b", "n": 2}\n{"file": "c", "n"')
    assert sorted(one(tables.read_lines(spark, f"file://{tmp_path}/l.jsonl", "file string, n long"), "file")) == ["a", "b"]


def test_snapshots_and_resume(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    tables.write_snapshot(df, f"file://{tmp_path}/s")
    assert tables.read_snapshot(spark, f"file://{tmp_path}/s").count() == 100
    df.limit(1).write.mode("append").parquet(f"file://{tmp_path}/s/data")
    with pytest.raises(ValueError, match="were written"):
        tables.read_snapshot(spark, f"file://{tmp_path}/s")
    done = f"file://{tmp_path}/done"
    run = lambda d, **meta: stores.append_results(done, d, "id", lambda x: x, meta)
    assert run(df.limit(40), size=1) == 40
    with open(f"{tmp_path}/done/rows/part-torn.json", "w") as f:
        f.write('{"id": 77, "x')
    with pytest.raises(ValueError, match="other settings"):
        run(df, size=2)
    assert run(df, size=1) == 60
    assert run(df, size=1) == 0
    assert sorted(one(tables.read_lines(spark, f"{done}/rows", "id long, x long"), "id")) == list(range(100))
    assert stores.append_results(f"file://{tmp_path}/none", df.limit(0), "id", lambda x: x, {}) == 0


def test_content_hash_sees_exchanged_pairs(spark):
    make = lambda *rows: datasets.content_hash(spark.createDataFrame(rows, "a string, b double")).first()
    x, y, z = ("x", 1.0), ("y", None), (None, 2.0)
    assert make(x, x, y) != make(z, z, y) and make(x, y, x) == make(x, x, y) != make(x, y, y) and make(x, y).n == 2
    assert make().digest == "0-0"


def test_snapshots_by_time(spark, tmp_path):
    s = stores.Snapshots(spark, f"file://{tmp_path}")
    with pytest.raises(KeyError):
        s.restore("t")
    s.dump(spark.range(5), "t", "2024-01-01")
    s.dump(spark.range(7), "t", "2024-03-01")
    assert s.restore("t").count() == s.restore("t", "2024-03-01").count() == 7
    with pytest.raises(ValueError, match="was built at 2024-03-01"):
        s.restore("t", "2024-01-01")


def test_sources_that_fail(spark, tmp_path):
    with pytest.raises(stores.SourceError, match="no such file"):
        stores.read_text(spark, f"file://{tmp_path}/none")
    with pytest.raises(stores.SourceError, match="no such file"):
        stores.read_labels(spark, f"file://{tmp_path}/none")
    with pytest.raises(RuntimeError, match="access is denied"):
        stores.reading("s3a://b/k", lambda: (_ for _ in ()).throw(OSError("AccessDenied (Service: S3, Status Code: 403)")))
    (tmp_path / "l.csv").write_text("\ufeffimage_filename, slug\na.jpg,  x \nb.jpg,\nc.jpg,\"\"\n", encoding="utf-8")
    assert sorted(map(tuple, stores.read_labels(spark, f"file://{tmp_path}/l.csv").collect())) == [("a.jpg", "x"), ("b.jpg", None), ("c.jpg", None)]
    (tmp_path / "m.csv").write_text("image_filename\na.jpg\n")
    with pytest.raises(stores.SourceError, match="no columns"):
        stores.read_labels(spark, f"file://{tmp_path}/m.csv")
    (tmp_path / "n.csv").write_text("image_filename,slug\n ,x\n")
    with pytest.raises(Exception, match="a row has no image_filename"):
        stores.read_labels(spark, f"file://{tmp_path}/n.csv").collect()


def test_listing_goes_on(spark, tmp_path):
    pages, asked = {1: "aab", 2: "bcd", 3: "def", 4: "g"}, []

    def fetch(page):
        asked.append(page)
        return spark.createDataFrame([(c, page) for c in pages.get(page, "")], "code string, page int")

    at = f"file://{tmp_path}/l"
    assert stores.listing(spark, fetch, at, "code", 3, pages=2) == 4
    assert stores.listing(spark, fetch, at, "code", 3) == 3 and asked == [1, 2, 2, 3, 4, 5]
    assert sorted(map(tuple, spark.read.parquet(at).collect())) == [("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3), ("f", 3), ("g", 4)]


def test_failing_rows(spark):
    def work(row):
        return {"id": row["id"], "y": 10 / (row["id"] - 3)}

    got = {r.status: r.n for r in tables.per_row(spark.range(8), work, "id long, y double").groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert got == {"ok": 7, "error": 1}


def test_linalg_against_numpy(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([(i, i % 4, r.tolist()) for i, r in enumerate(x)], "g long, label long, vec array<double>").repartition(5)
    mean, cov = linalg.covariance(df, "vec")
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T))
    mean, matrix, explained = linalg.whitening(df, "vec", 6, eps=0)
    white = np.array(one(linalg.project(df, "vec", mean, matrix, "w"), "w"))
    assert np.allclose(np.cov(white.T), np.eye(6), atol=1e-8) and abs(explained.sum() - 1) < 1e-9
    basis = rng.normal(size=(2, 6))
    rest = linalg.residual_basis(df, "vec", basis, 3)
    assert np.allclose(rest @ basis.T, 0, atol=1e-8)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for r in linalg.centroids(df, "label", "vec").collect():
        s = unit[np.arange(200) % 4 == r.label].sum(axis=0)
        assert np.allclose(r.centroid, s / np.linalg.norm(s))
    assert one(spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.normalized(F.col("v")).alias("v")))[0] == [0.0, 0.0]


def test_sessions(spark):
    df = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "system", "a"), (2, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: ([m.text for m in r.messages], r.valid) for r in sessions.histories(df).collect()}
    assert got == {1: (["a", "b"], True), 2: (["x"], False)}


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "open", 1), (1, "hi", 2), (1, "open", 3), (2, "early", 1), (2, "open", 2), (2, "yes", 3)], "s long, e string, n long").coalesce(1).write.parquet(src)
    run = lambda: flows.incremental(spark, src, "s long, e string, n long", f"{tmp_path}/out", f"{tmp_path}/cp", lambda d: d.filter("e <> 'open'")).awaitTermination()
    run()
    spark.createDataFrame([(3, "more", 1)], "s long, e string, n long").coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(one(spark.read.parquet(f"{tmp_path}/out"), "e")) == ["early", "hi", "more", "yes"]
    stream = spark.readStream.schema("s long, e string, n long").parquet(src)
    q = flows.sessions(stream, "s", "e", "n").writeStream.format("memory").queryName("turns").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.s: (r.turns, r.conflicts, r.unknown) for r in spark.table("turns").collect()}
    assert got == {1: (1, 1, 0), 2: (1, 0, 1), 3: (-1, 0, 1)}


def test_plugins(spark, tmp_path):
    from galena.plans import plugins

    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    gallery = spark.createDataFrame([(i, f"g{i % 9}", x.tolist()) for i, x in enumerate(v)], "g long, grp string, vec array<double>")
    queries = gallery.filter("g < 6").select(F.col("g").alias("q"), "vec")
    for mode in (plugins.TopN(3, 0.99), plugins.Groups(5, 2, 0.2, None)):
        s = plugins.GallerySearcher(gallery, mode)
        assert isinstance(s, plugins.Searcher) and s.slugs().count() == 40
        first = {r.q: r.g for r in s.search(queries).filter("place = 1").collect()}
        assert first == {i: i for i in range(6)}
    assert plugins.GallerySearcher(gallery, plugins.TopN(3, 1.5)).search(queries).count() == 0
    store = plugins.FolderStore(f"file://{tmp_path}")
    store.write(gallery, "gallery")
    assert isinstance(store, plugins.Store) and store.read(spark, "gallery").count() == 40
    out = plugins.encoded(spark.createDataFrame([("a",), ("bb",)], "s string"), "s", lambda: lambda xs: np.array([[len(x), 1] for x in xs]))
    assert sorted(one(out, "vec")) == [[1.0, 1.0], [2.0, 1.0]]
    with pytest.raises(ValueError, match="taken"):
        plugins.source("parquet")(lambda s, p: None)
    assert plugins.SOURCES["parquet"](spark, f"file://{tmp_path}/gallery").count() == 40
    turns = spark.createDataFrame([(1, 1, "user", "hi"), (2, 1, "assistant", "no")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in plugins.answered(sessions.histories(turns), lambda ms: f"{len(ms)} turns").collect()] == [(1, "1 turns")]


def test_session_table_and_reports(spark, tmp_path):
    store = stores.SessionTable(spark, f"file://{tmp_path}/s")
    make = lambda *rows: spark.createDataFrame([(i, datetime.datetime(2024, 1, day), [("user", x) for x in texts]) for i, day, texts in rows], "session_id string, at timestamp, messages array<struct<role: string, text: string>>")
    assert store.load("1") is None
    store.save(make(("1", 1, "a"), ("2", 2, "b")))
    store.save(make(("1", 3, "ac"), ("4", 20, "")))
    assert [m.text for m in store.load("1").messages] == ["a", "c"] and store.load("1").version == 2 and store.load("9") is None
    store.delete(spark.createDataFrame([("2",), ("8",)], "session_id string"))
    assert sorted(one(store.all(), "session_id")) == ["1", "4"]
    store.save(make(("2", 18, "x"), ("3", 19, "y")))
    assert store.load("2").version == 3
    store.expire(days=7, newest=2)
    assert sorted(one(store.all(), "session_id")) == ["3", "4"]
    with pytest.raises(Exception, match="not the id of a session"):
        store.save(make(("../x", 1, "a")))
    store.save(spark.createDataFrame([("5", datetime.datetime(2024, 1, 1), [(None, "x")])], store.all().drop("version").schema))
    with pytest.raises(ValueError, match="without role"):
        store.load("5")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    tables.write_report(rows, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r/json").count() == spark.read.option("header", True).csv(f"file://{tmp_path}/r/csv").count() == 2


def test_serial_turns(spark):
    rows = [(1, 1, "ask", False, 404, 0), (1, 2, "open", False, 200, 0), (1, 3, "ask", False, 200, 1), (1, 4, "ask", True, 502, 1), (1, 5, "open", False, 409, 1), (1, 6, "ask", False, 200, 2), (2, 1, "ask", True, 404, 0)]
    df = spark.createDataFrame(rows, "s long, n long, kind string, failed boolean, status_ int, turn_ int")
    assert all(r.status == r.status_ and r.turn == r.turn_ for r in sessions.serial_turns(df, "s", "n", "kind", "failed").collect())


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 2), ("c", 700), (None, 31)) for x in rng.integers(0, 60, n) / 4]
    df = spark.createDataFrame([*rows, ("c", None), ("z", None)], "g string, v double").repartition(5)
    at = {"p10": evaluation.nearest_rank(1, 10), "mid": evaluation.quantile(0.5), "q": evaluation.quantile(0.93)}
    got = {r.g: r for r in evaluation.quantiles(df, "v", at, ("g",)).collect()}
    assert got.keys() == {"a", "b", "c", None}
    for g, r in got.items():
        v = np.sort([x for h, x in rows if h == g])
        assert (r.n, r.lo, r.hi, r.p10) == (len(v), v[0], v[-1], v[len(v) // 10])
        assert np.isclose(r.mid, np.quantile(v, 0.5)) and np.isclose(r.q, np.quantile(v, 0.93))
    whole = evaluation.quantiles(df, "v", at).first()
    assert whole.n == len(rows) and np.isclose(whole.q, np.quantile([x for _, x in rows], 0.93))
    assert evaluation.quantiles(df.limit(0), "v", at).first().mid is None


def test_crowd_against_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 4)) if i % 50 else None, i, float(rng.integers(0, 10)) / 10, float(rng.integers(1, 30))) for i in range(300)]
    df = spark.createDataFrame([*rows, (1, 999, 0.9, None)], "img long, k long, conf double, area double")
    got = {r.k: r.crowd for r in scoring.crowd(df, "img", ["k"], "conf", "area").collect()}
    for img, k, _, area in rows:
        assert got[k] == sum(o[0] == img and o[1] != k and o[2] >= 0.5 and 0.5 * area <= o[3] <= 2 * area for o in rows), k


def test_class_scores_in_blocks(spark):
    rng = np.random.default_rng(10)
    rows = spark.createDataFrame([(i, i % 3, rng.normal(size=4).tolist()) for i in range(20)], "q long, label long, vec array<double>")
    centres = spark.createDataFrame([(c, rng.normal(size=4).tolist(), 5) for c in range(7)], "cls long, centre array<double>, size long")
    one_, many = ({(r.q, r.cls): round(r.cos, 9) for r in linalg.class_scores(rows, centres, n).collect()} for n in (1 << 20, 200))
    assert one_ == many and len(one_) == 140


def test_verdicts_are_checked(spark):
    from galena.plans import plugins

    candidates = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "q long, g long")

    class Says:
        def __init__(self, *rows):
            self.rows = rows

        def resolve(self, _):
            return spark.createDataFrame(self.rows, "q long, g long")

    assert sorted(map(tuple, plugins.resolved(Says((1, 11), (2, None)), candidates).collect())) == [(1, 11), (2, None)]
    for rows, fault in ((((1, 12), (2, 12)), "no candidate"), (((1, 10),), "one verdict"), (((1, 10), (1, 11), (2, 12)), "one verdict"), (((1, 10), (2, 12), (3, 10)), "without a query")):
        with pytest.raises(Exception, match=fault):
            plugins.resolved(Says(*rows), candidates).collect()


def test_normalized_binds_its_norm(spark):
    """The norm is worked out once a row, not once an element."""
    plan = spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(vectors.normalized(F.col("v")).alias("u"))
    assert plan.first().u == [0.6, 0.8]
    text_ = plan._jdf.queryExecution().analyzed().toString()
    assert text_.count("aggregate(") == 1


def test_retry_delay(spark):
    rows = [(1, 0.0, None), (2, 0.25, "0.5"), (3, 1.0, " 7 "), (9, 0.5, ""), (1, 0.0, "Wed, 21 Oct 2026 07:28:00 GMT"), (1, 0.0, "-3"), (1, 0.0, "5."), (1, 0.0, ".75")]
    df = spark.createDataFrame(rows, "attempt int, jitter double, hint string").select(text.retry_delay(F.col("attempt"), F.col("jitter"), F.col("hint")))
    assert [r[0] for r in df.collect()] == [0.5, 1.25, 7.0, 4.0, 0.5, 0.5, 5.0, 0.75]


def test_image_cache(spark, tmp_path):
    images = lambda *rows: spark.createDataFrame(rows, "name string, content binary")
    ask = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    got = lambda df: sorted((r.name, bytes(r.content)) for r in df.collect())
    cache = stores.ImageCache(spark, images(("a", b"1"), ("b", b"2")), f"file://{tmp_path}/cache")
    assert not cache.sync("one") and cache.sync("one") and cache.stamp() == "one"
    assert got(cache.images(ask("a", "a", "none", None))) == [("a", b"1")]
    cache.source = images(("a", b"3"), ("b", b"4"))
    assert got(cache.images(ask("a", "b"))) == [("a", b"1"), ("b", b"4")]
    assert not cache.sync("two") and got(cache.images(ask("b", "a"))) == [("a", b"3"), ("b", b"4")]
    assert got(cache.images(ask())) == []


def test_nearest_in_batches(spark):
    """Copies, huge and tiny numbers, null vectors and self-exclusion, with more rows than a batch of the gallery holds."""
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(900, 6)), rng.normal(size=(900, 3))
    a[100:200] = a[7]
    a[300], a[301], a[302] = a[300] * 1e200, a[301] * 1e-200, 0
    rows = [(i, None if i == 400 else x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame([*rows, (None, [0.0] * 6, [0.0] * 3)], "g long, a array<double>, b array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = retrieval.nearest(df.withColumnRenamed("g", "q"), df, ["a", "b"], 4, True, 9_000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    a[400] = np.nan
    score = {n: np.stack([retrieval.dots(np.repeat(x[i : i + 1], 900, 0), x) for i in range(900)]) for n, x in (("a", a), ("b", b))}
    want = set()
    for s in score.values():
        s = np.where(np.isnan(s), -np.inf, s)
        np.fill_diagonal(s, -np.inf)
        want |= {(q, int(g)) for q in range(900) for g in np.lexsort((np.arange(900), -s[q]))[:4] if s[q, g] > -np.inf}
    assert len(got) == len(want) and {(r.q, r.g) for r in got} == want
    for r in got:
        assert r.b == score["b"][r.q, r.g] and (r.a == score["a"][r.q, r.g] if 400 not in (r.q, r.g) else r.a is None)


def test_search_is_dealt_once(spark):
    """A search in two spaces deals vectors once and hands no scores from task to task but the best."""
    df = spark.range(50).selectExpr("id as g", "array(sin(id), cos(id)) as a", "array(cos(id), sin(id)) as b")
    plan = retrieval.merged_lists(df.withColumnRenamed("g", "q"), df, ["a", "b"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("MapInArrow") == 1


def by_window(kept, hits, members, exclude_self):
    """What expanded gives, by sorting all members of all groups."""
    from pyspark.sql import Window

    found = hits.select("q", "g", F.col("score").alias("hit"))
    out = kept.join(members.select("g", "grp"), "grp")
    out = (out.filter("q <> g") if exclude_self else out).join(found, ["q", "g"], "left")
    order = Window.partitionBy("q").orderBy("grank", F.desc(F.col("hit").isNotNull()), F.desc("hit"), "g")
    return sorted((r.q, r.grp, r.g, r.score, r.retrieved, r.place) for r in out.select("q", "grp", "g", F.coalesce("hit", "gscore").alias("score"), F.col("hit").isNotNull().alias("retrieved"), F.row_number().over(order).alias("place")).collect())


@pytest.mark.parametrize("itself", [False, True])
def test_expansion_against_window(spark, monkeypatch, itself):
    """Places of hits and other members, across lists of few members, with groups of one and queries within and without."""
    monkeypatch.setattr(retrieval, "MEMBERS", 3)
    rng = np.random.default_rng(12)
    groups = [int(x) for x in rng.integers(0, 6, 60)]
    members = spark.createDataFrame([(i, x) for i, x in enumerate(groups)] + [(60, 9), (61, 8), (62, 8)], "g long, grp long")
    hits = [(q, int(g), float(rng.integers(1, 9)) / 8) for q in [*range(0, 60, 3), 60, 61, 70] for g in rng.choice(60, 7, replace=False) if not itself or g != q]
    hits = spark.createDataFrame(hits, "q long, g long, score double").join(members, "g")
    kept = retrieval.kept_groups(retrieval.group_scores(hits), 0.4, 0.7)
    kept = kept.unionByName(spark.createDataFrame([(60, 9, 0.1, 8), (61, 8, 0.1, 8), (70, 8, 0.1, 8)], "q long, grp long, gscore double, grank int"))
    want = by_window(kept, hits, members, itself)
    whole = retrieval.expanded(kept, hits, members, itself)
    rows = lambda df: sorted((r.q, r.grp, r.g, r.score, r.retrieved, r.place) for r in df.collect())
    assert rows(whole) == want and len(want) > 300
    for n in (1, 6):
        assert rows(retrieval.expanded(kept, hits, members, itself, first=n)) == [r for r in want if r[5] <= n]
    one = {}
    for q, grp, g, _, _, place in sorted(want, key=lambda r: (r[0], r[5])):
        n, only, at = one.get((q, grp), (0, g, place))
        one[q, grp] = n + 1, only, at
    assert {(r.q, r.grp): (r.n, r.only, r.place) for r in retrieval.heads(kept, hits, members, itself).collect()} == one


def test_routing_joins_no_members(spark, sf, monkeypatch):
    """Routing and similar lists don't expand groups; expansion itself sorts and shuffles no expanded row."""
    from galena.plans import common, registry

    def refused(*a, first=None, **k):
        assert first is not None, "all members of a query's groups"
        return real(*a, first=first, **k)

    real = retrieval.expanded
    monkeypatch.setattr(retrieval, "expanded", refused)
    for name in ("A8_stage_decision", "A10_two_round_routing", "A14_similar_list"):
        assert registry.QUERIES[name](spark, sf).count() > 0
    monkeypatch.undo()
    plan = common.candidates(spark, sf)[1]._jdf.queryExecution().sparkPlan().toString().splitlines()
    made = next(i for i, x in enumerate(plan) if "posexplode(slice" in x)
    until = next(i for i, x in enumerate(plan) if i > made and "Join" in x)
    assert all("Generate" in x or "Project" in x or "Filter" in x for x in plan[made:until])


def test_modes_search_once(spark, sf, monkeypatch):
    """Both modes read one search, each its own n of it, and scores are rounded once a group, not once a member."""
    from galena.plans import common, plugins, registry

    real, asked = retrieval.vector_topk, []
    monkeypatch.setattr(retrieval, "vector_topk", lambda *a, **k: asked.append(a) or real(*a, **k))
    plan = registry.QUERIES["D7_modes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(i for i, x in enumerate(plan) if "posexplode(slice" in x)
    assert len(asked) == 1 and "Project" in plan[made - 1] and "round(" not in plan[made - 1]
    gallery = common.embeddings(spark, sf).filter("g < 90").withColumn("grp", F.col("g") % 7)
    queries = gallery.select(F.col("g").alias("q"), "vec")
    modes = {"top": plugins.TopN(2, 0.5), "few": plugins.Groups(3, 2, 0.2, None), "near": plugins.Groups(6, 3, 0.2, 0.8)}
    rows = lambda df: sorted((r.q, r.g, r.score, r.place) for r in df.collect())
    got = plugins.by_modes(gallery, modes, queries, lambda c: F.round(c, 3))
    assert len(asked) == 2
    for name, mode in modes.items():
        alone = plugins.GallerySearcher(gallery, mode).search(queries)
        assert rows(got.filter(F.col("mode") == name)) == rows(alone.withColumn("score", F.round("score", 3))) != []


def test_expansion_in_many_tasks(spark):
    """Members are made in many tasks, even if the rows that they are made of would fit into one; also where there is a single group."""
    members = spark.range(2000).select(F.col("id").alias("g"), F.lit(1).alias("grp"))
    hits = spark.range(400).select(F.col("id").alias("q"), F.col("id").alias("g"), F.lit(1.0).alias("score"), F.lit(1).alias("grp"))
    kept = retrieval.group_scores(hits)
    rest = retrieval.expanded(kept, hits, members).filter("not retrieved")
    sizes = sorted((r["count"] for r in rest.groupBy(F.spark_partition_id()).count().collect()), reverse=True)
    assert sum(sizes) == 400 * 1999 and len(sizes) >= 8 and sizes[0] <= sum(sizes) / 4


def test_crowd_of_few_and_many(spark, monkeypatch):
    """Images of few and of many candidates in one table, with repeated rows; where all have few, no range of areas is counted."""
    rng = np.random.default_rng(13)
    rows = [(i // 5 if i < 100 else 99, i, float(rng.integers(0, 10)) / 10, float(rng.integers(1, 30))) for i in range(300)]
    df = spark.createDataFrame([*rows, *rows[:7], *rows[-7:], (0, 999, 0.9, None)], "img long, k long, conf double, area double")
    want = {k: sum(o[0] == img and o[1] != k and o[2] >= 0.5 and 0.5 * area <= o[3] <= 2 * area for o in rows) for img, k, _, area in rows} | {999: 0}
    got = scoring.crowd(df, "img", ["k"], "conf", "area", repeated=True).collect()
    assert len(got) == len(want) and {r.k: r.crowd for r in got} == want
    monkeypatch.setattr(scoring, "running_total", None)
    got = scoring.crowd(df.filter("img < 20"), "img", ["k"], "conf", "area", repeated=True).collect()
    assert {r.k: r.crowd for r in got} == {k: n for k, n in want.items() if k < 100 or k == 999}
