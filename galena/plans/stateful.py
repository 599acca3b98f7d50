"""Queries of sources and stores that are written and read again, of sessions, and of the plug-in surfaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from galena.operators import sessions
from galena.session import scratch, settled
from galena.sources import stores, tables
from galena.streaming import flows

from . import plugins
from .common import LOO, as_queries, big, embeddings, r6, t
from .registry import query


@query("S2_text_source", "SELECT 'lines' AS what, CAST(count(*) + 1 AS VARCHAR) AS value FROM part UNION ALL SELECT 'header', 'slug,name' UNION ALL SELECT 'missing', 'there is no such file' UNION ALL SELECT 'kind', 'its kind of store isn''t known'")
def s2(spark, sf):
    """A catalog written as text, with a byte-order mark, and read again; what two paths that can't be read come to."""

    def reason(path):
        try:
            stores.read_text(spark, path).first()
        except stores.SourceError as e:
            return e.reason

    with scratch(spark) as at:
        p = t(spark, sf, "part").select(F.concat_ws(",", "p_partkey", "p_name").alias("value"))
        head = spark.createDataFrame([("\ufeffslug,name",)], "value string")
        head.unionByName(p).write.text(f"{at}/catalog")
        lines = stores.read_text(spark, f"{at}/catalog")
        facts = lines.agg(F.count("*").cast("string").alias("lines"), F.max(F.when(F.col("line").startswith("slug"), F.col("line"))).alias("header"))
        facts = facts.unpivot([], ["lines", "header"], "what", "value")
        errors = spark.createDataFrame([("missing", reason(f"{at}/none")), ("kind", reason("nosuchkind://bucket/key"))], "what string, value string")
        return settled(facts.unionByName(errors))


@query("S4_test_labels", "SELECT o_orderkey AS image, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS slug FROM orders")
def s4(spark, sf):
    with scratch(spark) as at:
        o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("image_filename"), F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("slug"))
        o.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{at}/labels")
        return settled(stores.read_labels(spark, f"{at}/labels").select(F.col("image_filename").cast("long").alias("image"), "slug"))


@query("S12_paged_listing", "SELECT DISTINCT p_name || '/' || p_brand AS code FROM part")
def s12(spark, sf):
    """A listing of ten pages, broken off after three and taken up again."""
    rows = t(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_name", "p_brand").alias("code"))
    low, high = rows.agg(F.min("p_partkey"), F.max("p_partkey")).first()
    size = max(1, -(-(high - low + 1) // 10))

    def fetch(page):
        return rows.filter(F.col("p_partkey").between(low + (page - 1) * size, low + page * size - 1))

    with scratch(spark) as at:
        stores.listing(spark, fetch, f"{at}/listing", "code", size, pages=3)
        stores.listing(spark, fetch, f"{at}/listing", "code", size)
        return settled(spark.read.parquet(f"{at}/listing").select("code"))


@query("S17_report", "SELECT f.format, l_returnflag AS flag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem, (VALUES ('csv'), ('json')) f(format) GROUP BY 1, 2")
def s17(spark, sf):
    with scratch(spark) as at:
        metrics = t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
        tables.write_report(metrics, at)
        schema = "flag string, n long, quantity double"
        back = {"json": spark.read.schema(schema).json(f"{at}/json"), "csv": spark.read.schema(schema).option("header", True).csv(f"{at}/csv")}
        # CSV columns go by place, JSON ones by name
        return settled(back["json"].withColumn("format", F.lit("json")).unionByName(back["csv"].withColumn("format", F.lit("csv"))))


@query("S18_resume", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 2 ELSE 1 END AS run, 'refused' AS other_settings FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def s18(spark, sf):
    """The labelled documents are done first; a torn line follows; a second run does the rest, and one with other settings is refused."""
    docs = t(spark, sf, "documents").select("doc_id").distinct()
    with scratch(spark) as at:
        stores.append_results(at, docs.join(t(spark, sf, "labels"), "doc_id", "left_semi"), "doc_id", lambda d: d.withColumn("run", F.lit(1)), {"size": 512})
        spark.createDataFrame([('{"doc_id": 1, "ru',)], "value string").coalesce(1).write.mode("append").text(f"{at}/rows")
        try:
            stores.append_results(at, docs, "doc_id", lambda d: d.withColumn("run", F.lit(3)), {"size": 256})
            other = "accepted"
        except ValueError:
            other = "refused"
        stores.append_results(at, docs, "doc_id", lambda d: d.withColumn("run", F.lit(2)), {"size": 512})
        return settled(tables.read_lines(spark, f"{at}/rows", "doc_id long, run int").withColumn("other_settings", F.lit(other)))


@query("S19_snapshot", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, 'refused' AS changed, 'refused' AS older FROM orders GROUP BY 1")
def s19(spark, sf):
    """Dumped and restored; a dump of which one row was exchanged for another, and one of an earlier time, are refused."""
    o = t(spark, sf, "orders")

    def verdict(f):
        try:
            f()
            return "accepted"
        except ValueError:
            return "refused"

    with scratch(spark) as at:
        snapshots = stores.Snapshots(spark, at)
        snapshots.dump(o, "orders", "2024-01-01T00:00:00")
        snapshots.dump(o, "orders", "2024-02-01T00:00:00")
        older = verdict(lambda: snapshots.restore("orders", "2024-01-01T00:00:00"))
        out = snapshots.restore("orders", "2024-02-01T00:00:00").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        out = settled(out)
        snapshots.dump(o, "changed", "2024-01-01T00:00:00")
        kept = snapshots.manifest("changed")
        low, high = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
        o.withColumn("o_orderkey", F.when(F.col("o_orderkey") == low, F.lit(high)).otherwise(F.col("o_orderkey"))).write.mode("overwrite").parquet(f"{kept.at}/data")
        changed = verdict(lambda: snapshots.restore("changed"))
    return out.withColumns({"changed": F.lit(changed), "older": F.lit(older)})


def saved_sessions(spark, sf, at):
    """A table of conversations: all are saved with their first message, and then whole."""
    store = stores.SessionTable(spark, at)
    turns = sessions.histories(t(spark, sf, "conversations"))
    messages = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    whole = turns.select(F.col("conv_id").cast("string").alias("session_id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(conv_id as int))").alias("at"), messages.alias("messages"))
    store.save(whole.withColumn("messages", F.slice("messages", 1, 1)))
    store.save(whole)
    return store


@query("S21_session_store", "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(2 AS BIGINT) AS version, count(*) AS turns, arg_max(role, turn) AS last FROM conversations GROUP BY conv_id")
def s21(spark, sf):
    with scratch(spark) as at:
        return settled(saved_sessions(spark, sf, at).all().select("session_id", "version", big(F.size("messages")).alias("turns"), F.element_at("messages", -1)["role"].alias("last")))


@query("S22_session_expiry", "WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT CAST(conv_id AS VARCHAR) AS session_id FROM c WHERE conv_id >= (SELECT max(conv_id) FROM c) - 7 QUALIFY row_number() OVER (ORDER BY conv_id DESC) <= 10")
def s22(spark, sf):
    """Sessions a day apart: the newest ten that are at most a week old stay. The limit is the feature."""
    with scratch(spark) as at:
        store = saved_sessions(spark, sf, at)
        store.expire(days=7, newest=10)
        return settled(store.all().select("session_id"))


@query("T1_serial_turns", """WITH o AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'open' ELSE 'ask' END kind, event_type = 'error' failed FROM events),
f AS (SELECT user_id, min(event_id) first FROM o WHERE kind = 'open' GROUP BY 1),
s AS (SELECT o.*, CASE WHEN kind = 'open' THEN CASE WHEN event_id > first THEN 409 ELSE 200 END WHEN first IS NULL OR event_id < first THEN 404 WHEN failed THEN 502 ELSE 200 END status FROM o LEFT JOIN f USING (user_id))
SELECT event_id, status, CAST(sum(CASE WHEN status = 200 AND kind = 'ask' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS turn FROM s""")
def t1(spark, sf):
    o = t(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", "open").otherwise("ask").alias("kind"), (F.col("event_type") == "error").alias("failed"))
    return sessions.serial_turns(o, "user_id", "event_id", "kind", "failed").select("event_id", "status", big(F.col("turn")).alias("turn"))


@query("T4_incremental", "SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 1 ELSE 2 END AS run FROM labels")
def t4(spark, sf):
    """Two batches of files; each run of the stream takes what is new."""
    lab = t(spark, sf, "labels").select("doc_id", "quality", "toxic")
    with scratch(spark) as at:
        for run, batch in ((1, lab.filter("toxic = 1")), (2, lab.filter("toxic <> 1"))):
            batch.write.mode("append").parquet(f"{at}/in")
            flows.incremental(spark, f"{at}/in", "doc_id long, quality int, toxic int", f"{at}/out", f"{at}/progress", lambda d, run=run: d.select("doc_id", "quality", F.lit(run).alias("run"))).awaitTermination()
        return settled(spark.read.schema("doc_id long, quality int, run int").parquet(f"{at}/out"))


# -- plug-in surfaces ---------------------------------------------------------------------------------------------

E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings)"
TOP3 = f"{E}, h AS (SELECT a.vec_id q, b.vec_id g, b.label, list_dot_product(a.v, b.v) s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) place FROM e a, e b QUALIFY place <= 3)"


def searcher(spark, sf, mode):
    e = embeddings(spark, sf).withColumn("grp", (F.col("g") % 37))
    return plugins.GallerySearcher(e, mode, {"size": 64, "unit": True}), as_queries(e).select("q", "vec")


@query("D1_searcher", f"WITH {TOP3} SELECT q, g, round(s, 6) AS score, place, 'refused' AS other_crops FROM h")
def d1(spark, sf):
    s, queries = searcher(spark, sf, plugins.TopN(3, 0.5))
    s.warmup()
    s.check_normalization({"size": 64, "unit": True})
    try:
        s.check_normalization({"size": 32, "unit": True})
        other = "accepted"
    except ValueError:
        other = "refused"
    return s.search(queries).select("q", "g", r6("score").alias("score"), big(F.col("place")).alias("place"), F.lit(other).alias("other_crops"))


@query("D2_resolver", f"WITH {TOP3}, c AS (SELECT q, max(CASE WHEN place = 2 AND s >= 0.3 THEN g END) g FROM h GROUP BY q) SELECT q, g FROM c")
def d2(spark, sf):
    """The second candidate, if it is near enough."""
    s, queries = searcher(spark, sf, plugins.TopN(3, 0.5))

    class Second:
        def resolve(self, candidates):
            return candidates.groupBy("q").agg(F.max(F.when((F.col("place") == 2) & (F.col("score") >= 0.3), F.col("g"))).alias("g"))

    return plugins.resolved(Second(), s.search(queries))


@query("D3_encoder", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS ends FROM documents WHERE text IS NOT NULL")
def d3(spark, sf):
    make = lambda: lambda xs: np.array([[len(x), x.count("\n")] for x in xs])
    out = plugins.encoded(t(spark, sf, "documents").filter("text is not null").select("doc_id", "text"), "text", make)
    return out.select("doc_id", F.col("vec")[0].cast("double").alias("chars"), F.col("vec")[1].cast("double").alias("ends"))


@query("S20_image_cache", "SELECT p_partkey, 'first ' || p_name AS cached, CASE WHEN p_partkey % 2 = 0 THEN 'first ' ELSE 'second ' END || p_name AS same_build, 'second ' || p_name AS next_build FROM part")
def s20(spark, sf):
    """All images of a build; then, after the store has changed, half of them cached and half not, of the same build; and those of the next build."""
    part = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"), "p_name")
    made = lambda what: part.select("name", F.concat(F.lit(f"{what} "), "p_name").cast("binary").alias("content"))
    even = part.filter(F.col("name").cast("long") % 2 == 0)

    def texts(cache, column):
        return cache.images(part).select("name", F.col("content").cast("string").alias(column))

    with scratch(spark) as at:
        whole, half = stores.ImageCache(spark, made("first"), f"{at}/whole"), stores.ImageCache(spark, made("first"), f"{at}/half")
        whole.sync("2024-01-01")
        half.sync("2024-01-01")
        half.images(even)
        out = settled(texts(whole, "cached"))
        for cache in (whole, half):
            cache.source = made("second")
        half.sync("2024-01-01")
        whole.sync("2024-02-01")
        out = out.join(texts(half, "same_build"), "name").join(texts(whole, "next_build"), "name")
        return settled(out.select(F.col("name").cast("long").alias("p_partkey"), "cached", "same_build", "next_build"))


@query("D4_stores", "SELECT n_nationkey, n_name, 'outdated' AS older FROM nation")
def d4(spark, sf):
    """A store whose tables are asked for by the time they were built."""
    with scratch(spark) as at:
        store = plugins.SnapshotStore(at)
        store.write(t(spark, sf, "nation").withColumn("n_name", F.lower("n_name")), "nation", "2024-01-01")
        store.write(t(spark, sf, "nation"), "nation", "2024-01-02")
        try:
            store.read(spark, "nation", "2024-01-01")
            older = "current"
        except ValueError:
            older = "outdated"
        return settled(store.read(spark, "nation", "2024-01-02").select("n_nationkey", "n_name", F.lit(older).alias("older")))


@query("D5_sources", "SELECT 'parquet' AS source, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 'lines', r_regionkey, r_name FROM region")
def d5(spark, sf):
    with scratch(spark) as at:
        t(spark, sf, "region").write.json(at)
        one = lambda name, path: plugins.SOURCES[name](spark, path).select(F.lit(name).alias("source"), F.col("r_regionkey").cast("int").alias("k"), F.col("r_name").alias("name"))
        return settled(one("parquet", f"{sf}/region.parquet").unionByName(one("lines", at)))


@query("D6_engine", "SELECT conv_id, count(*) || ' turns after ' || arg_max(role, turn) AS answer FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) = 'user'")
def d6(spark, sf):
    return plugins.answered(sessions.histories(t(spark, sf, "conversations")), lambda messages: f"{len(messages)} turns after {messages[-1]['role']}")


@query("D7_modes", f"""WITH {E}, h AS (SELECT a.vec_id q, b.vec_id g, b.vec_id % 37 grp, list_dot_product(a.v, b.v) s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) rk FROM e a, e b QUALIFY rk <= 5),
gr AS (SELECT q, grp, max(s) gs, row_number() OVER (PARTITION BY q ORDER BY max(s) DESC, grp) n FROM h GROUP BY q, grp QUALIFY n <= 2),
kp AS (SELECT * FROM gr WHERE gs >= 0.2)
SELECT 'top' AS mode, q, g, round(s, 6) AS score FROM h UNION ALL SELECT 'groups', kp.q, m.vec_id, round(coalesce(h.s, kp.gs), 6) FROM kp JOIN e m ON m.vec_id % 37 = kp.grp LEFT JOIN h ON h.q = kp.q AND h.g = m.vec_id""")
def d7(spark, sf):
    s, queries = searcher(spark, sf, None)
    modes = {"top": plugins.TopN(5, 0.5), "groups": plugins.Groups(5, 2, 0.2, None)}
    return plugins.by_modes(s.gallery, modes, queries, r6).select("mode", "q", "g", "score")


@query("D8_pool", "SELECT vec_id AS g, round(embedding[1] + embedding[2], 4) AS two FROM embeddings")
def d8(spark, sf):
    """An encoder on a pool of four workers."""
    make = lambda: lambda xs: np.array([[x[0] + x[1]] for x in xs])
    out = plugins.pooled(embeddings(spark, sf).select("g", F.col("vec").alias("pixels")), "pixels", make, workers=4)
    return out.select("g", F.round(F.col("vec")[0], 4).alias("two"))
