"""Queries of sources, projections, joins, aggregates, limits, set operations, functions, search and state."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galena.functions import geometry as geo
from galena.functions import text as tx
from galena.functions import vectors as vec
from galena.operators import catalog, datasets, evaluation, linalg, retrieval, scoring, sessions
from galena.sources import tables

from .common import HYBRID, big, embeddings, r6, spaces, t
from .registry import query

LINE = ["l_linenumber", "l_partkey", "l_suppkey"]


def lines(spark, sf):
    """Candidates of images, perhaps repeated: an order is an image, its lines are candidates."""
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("img"), *LINE, (F.col("l_discount") * 10).alias("conf"), F.col("l_extendedprice").alias("area"), "l_quantity", "l_tax", "l_returnflag")


def images(spark, sf):
    return lines(spark, sf).dropDuplicates(["img", *LINE])


IMAGES = "im AS (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey, l_suppkey) l_orderkey img, l_linenumber, l_partkey, l_suppkey, l_discount * 10 conf, l_extendedprice area, l_quantity, l_tax, l_returnflag FROM lineitem)"

# -- sources ------------------------------------------------------------------------------------------------------


@query("S1_catalog_constraints", "WITH c AS (SELECT trim(p_brand) k, count(*) n FROM part GROUP BY 1) SELECT CAST(coalesce(sum(CASE WHEN k = '' THEN n END), 0) AS BIGINT) AS blank, CAST(count_if(k <> '' AND n > 1) AS BIGINT) AS repeated FROM c")
def s1(spark, sf):
    return catalog.key_faults(t(spark, sf, "part").select(F.trim("p_brand").alias("k")), "k").select(big(F.col("blank")).alias("blank"), big(F.col("repeated")).alias("repeated"))


@query("S3_build_rows", "SELECT p_name || '/' || p_partkey AS slug, p_type AS photo, CASE WHEN p_size % 5 = 0 THEN p_name || '/' || p_partkey ELSE p_brand END AS grp, p_brand AS brand, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS size FROM part WHERE p_size % 7 <> 0")
def s3(spark, sf):
    p = t(spark, sf, "part").select(F.concat_ws("/", "p_name", "p_partkey").alias("slug"), F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_type")).alias("photo"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")).alias("g"), "p_brand", F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_size").cast("string")).alias("size"))
    return tables.build_rows(p, "slug", "photo", "g", {"brand": "p_brand", "size": "size"}).select("slug", "photo", "grp", F.col("fields")["brand"].alias("brand"), F.col("fields")["size"].alias("size"))


@query("S5_required_columns", "SELECT p_partkey AS slug, p_name AS name, p_brand AS brand FROM part")
def s5(spark, sf):
    p = t(spark, sf, "part")
    if missing := {"p_partkey", "p_name", "p_brand"} - set(p.columns):
        raise ValueError(f"no columns {sorted(missing)}")
    return p.select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))


@query("S6_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def s6(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_quantity").filter("l_quantity > 45")


@query("S7_row_count", "SELECT count(*) AS n FROM lineitem")
def s7(spark, sf):
    return t(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query("S8_unpack", "SELECT replace(CAST(o_orderkey AS VARCHAR) || '/' || o_orderpriority, '/', '_') AS file, CAST(o_custkey AS VARCHAR) AS label FROM orders WHERE o_orderstatus <> 'F'")
def s8(spark, sf):
    o = t(spark, sf, "orders").withColumn("image", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))).filter("image is not null")
    return o.select(F.replace(F.concat_ws("/", "o_orderkey", "o_orderpriority"), F.lit("/"), F.lit("_")).alias("file"), F.col("o_custkey").cast("string").alias("label"))


@query("S9_label_map", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS value, 'k' AS key FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def s9(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.explode(F.from_json("props", T.MapType(T.StringType(), T.StringType()))).alias("key", "value"))
    return e.select("event_id", big(F.col("value")).alias("value"), "key")


@query("S10_wanted_rows", "SELECT doc_id, quality IS NOT NULL AS found FROM documents LEFT JOIN labels USING (doc_id)")
def s10(spark, sf):
    got, missing = tables.wanted_lines(t(spark, sf, "labels"), t(spark, sf, "documents").select("doc_id"), "doc_id")
    return got.select("doc_id", F.lit(True).alias("found")).unionByName(missing.select("doc_id", F.lit(False).alias("found")))


@query("S11_first_candidate", "SELECT l_orderkey AS img, CAST(min(l_linenumber) AS BIGINT) AS first FROM lineitem GROUP BY 1")
def s11(spark, sf):
    lists = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("img")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("c"))
    return lists.select("img", big(F.element_at("c", 1)).alias("first"))


@query("S13_image_jobs", "SELECT p_partkey, kind, url FROM (SELECT p_partkey, 'front' AS kind, CASE WHEN p_size % 2 = 0 THEN p_name END AS url FROM part UNION ALL SELECT p_partkey, 'back', p_brand FROM part UNION ALL SELECT p_partkey, 'label', CASE WHEN p_size % 3 = 0 THEN p_type END FROM part) WHERE url IS NOT NULL")
def s13(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("front"), F.col("p_brand").alias("back"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("label"))
    return p.unpivot("p_partkey", ["front", "back", "label"], "kind", "url").filter("url is not null")


@query("S14_distinct_field", "SELECT DISTINCT p_brand AS slug FROM part")
def s14(spark, sf):
    return t(spark, sf, "part").select(F.col("p_brand").alias("slug")).distinct()


@query("S15_point_lookup", "SELECT vec_id AS g, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings WHERE vec_id IN (SELECT c_custkey FROM customer)")
def s15(spark, sf):
    wanted = t(spark, sf, "customer").select(F.col("c_custkey").alias("g"))
    return embeddings(spark, sf).join(wanted, "g", "left_semi").select("g", r6(vec.norm(vec.normalized(F.col("vec")))).alias("norm"))


@query("S16_upsert", "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer")
def s16(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = c.filter("k % 4 = 0")
    new = new.withColumn("n", F.lit(1)).unionByName(new.withColumn("v", F.col("v") + 1).withColumn("n", F.lit(2)))
    return tables.upserted(c, new, "k", "n")


@query("S23_failing_rows", "SELECT l_orderkey AS img, CASE WHEN l_orderkey % 50 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN l_orderkey % 50 <> 0 THEN l_orderkey * 2 END AS twice FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def s23(spark, sf):
    def work(row):
        if row["img"] % 50 == 0:
            raise ValueError("no image")
        return {"img": row["img"], "twice": row["img"] * 2}

    def keep(row):
        try:
            return work(row) | {"state": "ok"}
        except ValueError:
            return {"img": row["img"], "twice": None, "state": "error"}

    ids = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("img")).distinct()
    out = tables.per_row(ids, keep, "img long, twice double, state string")
    return out.select("img", F.col("state").alias("status"), big(F.col("twice")).alias("twice"))


@query("S24_sync_plan", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'fetch' WHEN quality = 0 THEN 'unpack' ELSE 'ready' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)")
def s24(spark, sf):
    d = t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.when(F.col("quality").isNull(), "fetch").when(F.col("quality") == 0, "unpack").otherwise("ready").alias("action"))


# -- projections and predicates -----------------------------------------------------------------------------------

MESSY = "CASE p_size % 6 WHEN 0 THEN '  ' WHEN 1 THEN ' NaN ' WHEN 2 THEN 'null' WHEN 3 THEN ' ' || p_name || ' ' WHEN 4 THEN CAST(p_size AS VARCHAR) || ',5%' ELSE CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 2 AS VARCHAR) END"


def messy(spark, sf):
    return t(spark, sf, "part").select("p_partkey", "p_size", "p_name", "p_brand", "p_type", "p_retailprice", F.expr(MESSY.replace("VARCHAR", "STRING")).alias("m"))


@query("P1_missing_text", f"WITH m AS (SELECT *, {MESSY} m FROM part) SELECT p_partkey, CASE WHEN lower(trim(m)) IN ('', 'nan', 'null', 'не определено') THEN NULL ELSE trim(m) END AS v FROM m")
def p1(spark, sf):
    return messy(spark, sf).select("p_partkey", tx.cleaned(F.col("m")).alias("v"))


@query("P2_strict_number", f"WITH m AS (SELECT *, {MESSY} m FROM part), n AS (SELECT p_partkey, CASE WHEN regexp_full_match(trim(m), '\\d+([.,]\\d+)?%?') THEN CAST(replace(replace(trim(m), '%', ''), ',', '.') AS DOUBLE) END v FROM m) SELECT p_partkey, CASE WHEN v BETWEEN 0 AND 40 THEN v END AS v FROM n")
def p2(spark, sf):
    return messy(spark, sf).select("p_partkey", tx.strict_number(F.col("m"), 40).alias("v"))


@query("P3_loose_number", f"WITH m AS (SELECT *, {MESSY} m FROM part) SELECT p_partkey, TRY_CAST(nullif(regexp_extract(replace(m, ',', '.'), '\\d+(\\.\\d+)?', 0), '') AS DOUBLE) AS v FROM m")
def p3(spark, sf):
    return messy(spark, sf).select("p_partkey", tx.loose_number(F.col("m")).alias("v"))


@query("P4_card_summary", "SELECT p_partkey, p_name AS title, array_to_string(list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> ''), '|') AS items, replace(p_name, ' ', '%20') AS link, CASE WHEN 1880 + p_size >= 1900 THEN CAST(1880 + p_size AS BIGINT) END AS year FROM part")
def p4(spark, sf):
    year = F.lit(1880) + F.col("p_size")
    return t(spark, sf, "part").select("p_partkey", F.coalesce(tx.cleaned(F.col("p_name")), F.lit("untitled")).alias("title"), F.array_join(tx.list_of(F.col("p_type"), " "), "|").alias("items"), tx.url_quoted(F.col("p_name")).alias("link"), F.when(year >= 1900, big(year)).alias("year"))


@query("P5_display_values", f"WITH m AS (SELECT *, {MESSY} m FROM part) SELECT p_partkey, coalesce(nullif(trim(m), ''), 'no data') AS shown FROM m")
def p5(spark, sf):
    return messy(spark, sf).select("p_partkey", F.coalesce(F.nullif(F.trim("m"), F.lit("")), F.lit("no data")).alias("shown"))


@query("P6_bands", "WITH b AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size * 1.0 ELSE (p_size + p_size + 4) / 2.0 END v FROM part) SELECT p_partkey, CASE WHEN v IS NULL THEN 'unknown' WHEN v < 10 THEN 'low' WHEN v < 25 THEN 'mid' WHEN v < 40 THEN 'high' ELSE 'top' END AS band FROM b")
def p6(spark, sf):
    exact, lo, hi = F.when(F.col("p_size") % 4 == 1, F.col("p_size").cast("double")), F.col("p_size"), F.col("p_size") + 4
    v = F.when(F.col("p_size") % 4 != 0, F.coalesce(exact, (lo + hi) / 2))
    return t(spark, sf, "part").select("p_partkey", catalog.band(v, [10, 25, 40], ["low", "mid", "high", "top"]).alias("band"))


@query("P7_first_rule", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name || ' ' || p_type), '\\bpolished\\b') THEN 'polished' WHEN regexp_matches(lower(p_name || ' ' || p_type), 'brass|copper') THEN 'metal' WHEN regexp_matches(lower(p_name || ' ' || p_type), '^[a-e]') THEN 'early' WHEN p_size > 25 THEN 'large' ELSE 'plain' END AS style FROM part")
def p7(spark, sf):
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return t(spark, sf, "part").select("p_partkey", catalog.first_rule(text, [(r"(?U)\bpolished\b", "polished"), ("brass|copper", "metal"), ("^[a-e]", "early")], F.when(F.col("p_size") > 25, "large").otherwise("plain")).alias("style"))


@query("P8_attribute_axes", "SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'red' WHEN 'Brand#12' THEN 'white' ELSE 'unknown' END AS colour, CASE WHEN p_size < 20 THEN 'small' ELSE 'unknown' END AS size FROM part")
def p8(spark, sf):
    known = F.create_map(F.lit("Brand#11"), F.lit("red"), F.lit("Brand#12"), F.lit("white"))
    return t(spark, sf, "part").select("p_partkey", F.coalesce(F.try_element_at(known, F.col("p_brand")), F.lit("unknown")).alias("colour"), F.when(F.col("p_size") < 20, "small").otherwise("unknown").alias("size"))


@query("P9_folded_whole", "SELECT doc_id, md5(replace(lower(trim(text)), 'ё', 'е')) AS folded FROM documents")
def p9_whole(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(tx.folded(F.col("text"))).alias("folded"))


@query("P10_safe_names_all", "SELECT doc_id, substr(regexp_replace(text, '[^\\p{L}\\p{N}_.-]+', '_', 'g'), 1, 80) AS name FROM documents")
def p10_all(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.safe_name(F.col("text")).alias("name"))


MODEL = {"mean": [25.0, 0.5], "std": [14.0, 0.3], "coef": [0.8, -1.1], "intercept": 0.2}
Z = "(0.2 + (l_quantity - 25.0) / 14.0 * 0.8 + (conf - 0.5) / 0.3 * -1.1)"


@query("P11_logistic_score", f"WITH {IMAGES} SELECT img, l_linenumber, l_partkey, l_suppkey, round(1 / (1 + exp(-{Z})), 6) AS p FROM im")
def p11(spark, sf):
    return images(spark, sf).select("img", *LINE, r6(scoring.logistic([F.col("l_quantity"), F.col("conf")], **MODEL)).alias("p"))


@query("P12_rejection_cascade", f"WITH {IMAGES} SELECT img, l_linenumber, l_partkey, l_suppkey, CASE WHEN conf < 0.2 THEN 'faint' WHEN l_quantity < 10 THEN 'small' WHEN l_tax > 0.06 THEN 'taxed' END AS reason FROM im")
def p12(spark, sf):
    return images(spark, sf).select("img", *LINE, F.when(F.col("conf") < 0.2, "faint").when(F.col("l_quantity") < 10, "small").when(F.col("l_tax") > 0.06, "taxed").alias("reason"))


@query("P13_resize_scale", "SELECT p_partkey, round(least(greatest(least(1.0, 1600 / (p_size * 100.0)), 512 / (p_size * 60.0)), 2048 / (p_size * 100.0)), 6) AS scale FROM part")
def p13(spark, sf):
    w, h = F.col("p_size") * 100.0, F.col("p_size") * 60.0
    return t(spark, sf, "part").select("p_partkey", r6(F.least(F.greatest(F.least(F.lit(1.0), 1600 / w), 512 / h), 2048 / w)).alias("scale"))


@query("P14_fit_size", "SELECT p_partkey, CAST(greatest(1, round_even(p_size * 7 * least(448.0 / (p_size * 7), 448.0 / (p_size * 3)), 0)) AS BIGINT) AS w, CAST(greatest(1, round_even(p_size * 3 * least(448.0 / (p_size * 7), 448.0 / (p_size * 3)), 0)) AS BIGINT) AS h FROM part")
def p14(spark, sf):
    w, h = F.col("p_size") * 7, F.col("p_size") * 3
    s = F.least(448.0 / w, 448.0 / h)
    return t(spark, sf, "part").select("p_partkey", *(big(F.greatest(F.lit(1.0), F.bround(x * s, 0))).alias(n) for x, n in ((w, "w"), (h, "h"))))


@query("P15_contract", "SELECT event_id, CASE WHEN json_keys(props) = ['k'] AND CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 50 THEN 'ok' ELSE 'invalid' END AS state FROM events")
def p15(spark, sf):
    m = F.from_json("props", T.MapType(T.StringType(), T.LongType()))
    ok = F.array_sort(F.map_keys(m)).eqNullSafe(F.array(F.lit("k"))) & m["k"].between(0, 50)
    return t(spark, sf, "events").select("event_id", F.when(ok, "ok").otherwise("invalid").alias("state"))


@query("P16_first_valid", "SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE length(text) BETWEEN 100 AND 400 GROUP BY conv_id")
def p16(spark, sf):
    lists = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("all"))
    first = F.get(F.filter("all", lambda x: F.length(x["text"]).between(100, 400)), 0)["text"]
    return lists.select("conv_id", first.alias("text")).filter("text is not null")


@query("P17_element_policy", "SELECT o_custkey, string_agg(CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey AS VARCHAR) || ':exact' ELSE CAST(o_orderkey AS VARCHAR) || ':any' END, ';' ORDER BY o_orderkey) AS policy FROM orders GROUP BY o_custkey")
def p17(spark, sf):
    lists = t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.when(F.col("o_orderstatus") == "O", "2020").otherwise(" ").alias("year")))).alias("e"))
    return lists.select("o_custkey", F.array_join(F.transform("e", lambda x: F.concat(x["o_orderkey"].cast("string"), F.when(F.trim(x["year"]) != "", ":exact").otherwise(":any"))), ";").alias("policy"))


@query("P18_facets", "SELECT DISTINCT p_type AS facet FROM part WHERE ('ALL' = 'ALL' OR p_brand = 'ALL') AND p_size > 10")
def p18(spark, sf):
    brand = F.lit("ALL")
    return t(spark, sf, "part").filter(((brand == "ALL") | (F.col("p_brand") == brand)) & (F.col("p_size") > 10)).select(F.col("p_type").alias("facet")).filter("facet is not null").distinct()


@query("P19_clamped_score", "SELECT s_suppkey, least(greatest(s_acctbal / 5000, 0), 1) AS score FROM supplier")
def p19(spark, sf):
    v = F.col("s_acctbal") / 5000
    return t(spark, sf, "supplier").select("s_suppkey", F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).alias("score"))


@query("P20_label_filter", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE NOT regexp_matches(lower(source), 'src1[0-9]') AND toxic = 0")
def p20(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source").join(t(spark, sf, "labels"), "doc_id")
    return d.filter(~F.col("source").rlike("(?i)SRC1[0-9]") & (F.col("toxic") == 0)).select("doc_id")


@query("P21_series_key", "SELECT doc_id, source AS series FROM documents")
def p21(spark, sf):
    named = F.concat_ws("_", "source", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 10))
    return t(spark, sf, "documents").select("doc_id", F.regexp_replace(named, "_[0-9a-f]{10}$", "").alias("series"))


@query("P22_media_type", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'image/gif' END AS kind FROM customer")
def p22(spark, sf):
    heads = F.element_at(F.array(*map(F.lit, ("FFD8FFE0", "89504E470D0A1A0A00", "524946460102030457454250", "474946383961", "00000000"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return t(spark, sf, "customer").select("c_custkey", tx.media_type(F.hex(F.unhex(heads))).alias("kind"))


@query("P23_config_projection", "SELECT p_partkey, 'brand=' || p_brand || ',type=' || p_type AS kept FROM part")
def p23(spark, sf):
    config = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("device"), F.lit("x"), F.lit("type"), F.col("p_type"))
    kept = F.map_filter(config, lambda k, v: ~k.isin("device", "batch"))
    return t(spark, sf, "part").select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("kept"))


# -- joins --------------------------------------------------------------------------------------------------------

BOX = ["l_quantity", "l_tax"]


def boxes(spark, sf):
    """Candidate boxes and target boxes of images (orders): targets are lines with flag R, candidates the others, side 10 and 12."""
    x, y = F.col("l_quantity") % 20, F.col("l_tax") * 100
    b = images(spark, sf).select("img", *LINE, "l_returnflag", "conf", x.alias("x"), y.alias("y"))
    box = lambda side: [F.col("x"), F.col("y"), F.col("x") + side, F.col("y") + side]
    cand = b.filter("l_returnflag <> 'R'").select("img", *LINE, "conf", *(v.alias(f"c{i}") for i, v in enumerate(box(10))))
    target = b.filter("l_returnflag = 'R'").select(F.col("img").alias("timg"), *(F.col(c).alias(f"t_{c}") for c in LINE), *(v.alias(f"t{i}") for i, v in enumerate(box(12))))
    overlap = geo.iou([F.col(f"c{i}") for i in range(4)], [F.col(f"t{i}") for i in range(4)])
    return cand, target, overlap


BOXES = f"""{IMAGES}, bx AS (SELECT *, l_quantity % 20 x, l_tax * 100 y FROM im),
cd AS (SELECT img, l_linenumber, l_partkey, l_suppkey, conf, x, y FROM bx WHERE l_returnflag <> 'R'), tg AS (SELECT img, l_linenumber tl, l_partkey tp, l_suppkey ts, x tx, y ty FROM bx WHERE l_returnflag = 'R'),
pr AS (SELECT c.*, t.tl, t.tp, t.ts, greatest(least(x + 10, tx + 12) - greatest(x, tx), 0) * greatest(least(y + 10, ty + 12) - greatest(y, ty), 0) inter FROM cd c JOIN tg t USING (img)),
io AS (SELECT *, inter / (100 + 144 - inter + 1e-9) iou FROM pr)"""


@query("J6_iou_join", f"WITH {BOXES}, mx AS (SELECT img, l_linenumber, l_partkey, l_suppkey, max(iou) m FROM io GROUP BY ALL) SELECT cd.img, cd.l_linenumber, cd.l_partkey, cd.l_suppkey, CAST(coalesce(m, 0) >= 0.4 AS INT) AS y FROM cd LEFT JOIN mx USING (img, l_linenumber, l_partkey, l_suppkey)")
def j6(spark, sf):
    cand, target, overlap = boxes(spark, sf)
    best = cand.join(target, F.col("img") == F.col("timg"), "left").groupBy("img", *LINE).agg(F.max(overlap).alias("m"))
    return best.select("img", *LINE, (F.coalesce("m", F.lit(0.0)) >= 0.4).cast("int").alias("y"))


@query("J6_missed_targets", f"WITH {BOXES}, mx AS (SELECT img, tl, tp, ts, max(iou) m FROM io GROUP BY ALL) SELECT count(*) AS missed FROM tg LEFT JOIN mx USING (img, tl, tp, ts) WHERE coalesce(m, 0) < 0.4")
def j6b(spark, sf):
    cand, target, overlap = boxes(spark, sf)
    best = target.join(cand, F.col("img") == F.col("timg"), "left").groupBy("timg", *(f"t_{c}" for c in LINE)).agg(F.max(overlap).alias("m"))
    return best.filter(F.coalesce("m", F.lit(0.0)) < 0.4).agg(F.count("*").alias("missed"))


@query("J7_best_match", f"WITH {BOXES} SELECT img, tl, tp, ts, arg_max(l_partkey, (round(iou, 9), conf, l_partkey)) AS best, round(max(iou), 6) AS iou FROM io GROUP BY img, tl, tp, ts")
def j7(spark, sf):
    cand, target, overlap = boxes(spark, sf)
    j = target.join(cand, F.col("img") == F.col("timg")).withColumn("iou", overlap)
    out = j.groupBy("img", *(f"t_{c}" for c in LINE)).agg(F.max_by("l_partkey", F.struct(F.round("iou", 9), "conf", "l_partkey")).alias("best"), r6(F.max("iou")).alias("iou"))
    return out.withColumnsRenamed({"t_l_linenumber": "tl", "t_l_partkey": "tp", "t_l_suppkey": "ts"})


@query("J3_outcome_join", "SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'matched' WHEN quality = 0 THEN 'rejected' END, 'open') AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def j3(spark, sf):
    d, lab = t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels")
    a, b = lab.filter("quality = 1").select("doc_id", F.lit("matched").alias("a")), lab.filter("quality = 0").select("doc_id", F.lit("rejected").alias("b"))
    return d.join(a, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", F.coalesce("a", "b", F.lit("open")).alias("status"))


@query("J4_membership_expansion", "SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s_nationkey = c_nationkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j4(spark, sf):
    s, c = t(spark, sf, "supplier"), t(spark, sf, "customer")
    hits = t(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return s.join(c, F.col("s_nationkey") == F.col("c_nationkey")).select("s_suppkey", "c_custkey").join(hits, "c_custkey", "left_anti").select("s_suppkey", "c_custkey")


@query("J5_referential_integrity", "SELECT count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def j5(spark, sf):
    return t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("orphans"))


@query("J8_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j8(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "source").join(t(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("J9_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j9(spark, sf):
    return t(spark, sf, "customer").select("c_custkey").join(t(spark, sf, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("J11_card_lookup", "SELECT o_orderkey, c_name, c_nationkey = n_nationkey AS agrees FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j11(spark, sf):
    o, c, n = t(spark, sf, "orders"), t(spark, sf, "customer"), t(spark, sf, "nation")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("o_orderkey", "c_name", (F.col("c_nationkey") == F.col("n_nationkey")).alias("agrees"))


@query("J12_knowledge_lookup", "WITH b(axis, value, bullets) AS (VALUES ('brand', 'Brand#11', 'a;b'), ('brand', 'unknown', 'c'), ('size', '10', 'd')), s AS (SELECT p_partkey key, 'brand' axis, p_brand value FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part) SELECT key, s.axis, CASE WHEN b.bullets IS NULL THEN 'unknown' ELSE s.value END AS value, coalesce(b.bullets, u.bullets) AS bullets FROM s LEFT JOIN b ON s.axis = b.axis AND s.value = b.value LEFT JOIN b u ON u.axis = s.axis AND u.value = 'unknown' WHERE coalesce(b.bullets, u.bullets) IS NOT NULL")
def j12(spark, sf):
    base = spark.createDataFrame([("brand", "Brand#11", ["a", "b"]), ("brand", "unknown", ["c"]), ("size", "10", ["d"])], "axis string, value string, bullets array<string>")
    p = t(spark, sf, "part")
    chosen = p.select(F.col("p_partkey").alias("key"), F.lit("brand").alias("axis"), F.col("p_brand").alias("value")).unionByName(p.select(F.col("p_partkey").alias("key"), F.lit("size").alias("axis"), F.col("p_size").cast("string").alias("value")))
    return catalog.knowledge(chosen, base).withColumn("bullets", F.array_join("bullets", ";"))


SAME = "SELECT a.p_partkey, b.p_partkey AS other, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS rank FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey QUALIFY rank <= 5"


@query("J13_same_group", SAME)
def j13(spark, sf):
    return catalog.same_group(t(spark, sf, "part"), "p_partkey", "p_brand", "p_partkey").withColumn("rank", big(F.col("rank")))


@query("J14_aligned_pairs", "WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings), b AS (SELECT vec_id + 7 vec_id, CAST(embedding AS DOUBLE[]) w FROM embeddings) SELECT vec_id AS g, round(list_dot_product(v, w), 6) AS cos FROM a JOIN b USING (vec_id)")
def j14(spark, sf):
    e = embeddings(spark, sf)
    a, b = e.select("g", F.col("vec").alias("v")), e.select((F.col("g") + 7).alias("g"), F.col("vec").alias("w"))
    return a.join(b, "g").select("g", r6(vec.dot(F.col("v"), F.col("w"))).alias("cos"))


@query("J15_transfer_with_default", "SELECT n_name, coalesce(max(c_acctbal), -1) AS v FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY n_name")
def j15(spark, sf):
    top = t(spark, sf, "customer").filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("v"))
    return t(spark, sf, "nation").join(top, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("v", F.lit(-1.0)).alias("v"))


# -- aggregates ---------------------------------------------------------------------------------------------------


@query("G3_quantile_summary", "SELECT event_type, count(*) AS n, min(value) AS lo, list_sort(list(value))[count(*) // 10 + 1] AS p10, median(value) AS mid, max(value) AS hi FROM events GROUP BY event_type")
def g3(spark, sf):
    return evaluation.quantiles(t(spark, sf, "events"), "value", {"p10": evaluation.nearest_rank(1, 10), "mid": evaluation.quantile(0.5)}, ("event_type",))


@query("G6_latency_percentiles", "SELECT o_orderstatus AS status, count(*) AS n, median(o_totalprice) AS p50, list_sort(list(o_totalprice))[CAST(floor(0.9 * (count(*) - 1)) AS INT) + 1] AS p90 FROM orders GROUP BY 1")
def g6(spark, sf):
    places = {"p50": evaluation.quantile(0.5), "p90": lambda n: F.floor((n - 1) * 0.9)}
    out = evaluation.quantiles(t(spark, sf, "orders"), "o_totalprice", places, ("o_orderstatus",))
    return out.select(F.col("o_orderstatus").alias("status"), "n", "p50", "p90")


def scored(spark, sf):
    """img (source), p and y of labelled documents."""
    d = t(spark, sf, "documents").select("doc_id", "source", "n_chars").join(t(spark, sf, "labels"), "doc_id")
    return d.select(F.col("source").alias("img"), "doc_id", F.round(scoring.logistic([F.ln(F.col("n_chars") + 1)], [7.0], [1.5], [1.2], 0.3), 9).alias("p"), F.col("quality").cast("long").alias("y"))


SCORED = "sc AS (SELECT source img, doc_id, round(1 / (1 + exp(-(0.3 + (ln(n_chars + 1) - 7.0) / 1.5 * 1.2))), 9) p, quality y FROM documents JOIN labels USING (doc_id))"


@query("G11_detection_metrics", f"""WITH {SCORED}, i AS (SELECT DISTINCT source img FROM documents), c AS (SELECT img, sum(y) tp, sum(1 - y) fp FROM sc WHERE p >= 0.5 GROUP BY img), g AS (SELECT img, count_if(y = 1) t FROM sc WHERE doc_id % 4 <> 0 GROUP BY img),
x AS (SELECT coalesce(tp, 0) tp, coalesce(fp, 0) fp, coalesce(t, 0) t, greatest(coalesce(t, 0) - coalesce(tp, 0), 0) fn FROM i LEFT JOIN c USING (img) LEFT JOIN g USING (img)),
m AS (SELECT sum(tp) tp, sum(fp) fp, sum(fn) fn, avg(CASE WHEN fp = 0 AND fn = 0 THEN 1.0 ELSE 0.0 END) exact, avg(CASE WHEN t = 0 THEN CASE WHEN fp > 0 THEN 1.0 ELSE 0.0 END END) fe FROM x), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END r FROM m)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(exact, 6) AS exact, round(fe, 6) AS fp_on_empty, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-9), 6) AS f1 FROM r""")
def g11(spark, sf):
    s = scored(spark, sf)
    targets = s.filter("doc_id % 4 <> 0").groupBy("img").agg(F.count_if(F.col("y") == 1).alias("n_targets"))
    out = evaluation.detection(t(spark, sf, "documents").select(F.col("source").alias("img")).distinct(), s, targets, 0.5)
    return out.select(*(big(F.col(c)).alias(c) for c in ("tp", "fp", "fn")), *(r6(c).alias(c) for c in ("exact", "fp_on_empty", "precision", "recall", "f1")))


SWEEP = SCORED + """, th AS (SELECT i / 100 threshold FROM range(5, 96) x(i)), z AS (SELECT threshold, count_if(p >= threshold - 1e-12 AND y = 1) tp, count_if(p >= threshold - 1e-12 AND y = 0) fp, count_if(y = 1) tot FROM th, sc GROUP BY threshold),
pr AS (SELECT threshold, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END p, CASE WHEN tot + 3 = 0 THEN 1.0 ELSE tp / (tot + 3) END r FROM z), fb AS (SELECT *, 3.25 * p * r / (2.25 * p + r + 1e-9) f FROM pr)"""


@query("G12_f_beta", f"WITH {SWEEP} SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f FROM fb")
def g12(spark, sf):
    out = evaluation.sweep(scored(spark, sf), 3, 1.5)
    return out.select("threshold", *(r6(c).alias(c) for c in ("precision", "recall", "f")))


@query("G13_best_threshold", f"WITH {SWEEP} SELECT threshold, round(f, 6) AS f FROM fb ORDER BY f DESC, threshold LIMIT 1")
def g13(spark, sf):
    return evaluation.sweep(scored(spark, sf), 3, 1.5).orderBy(F.desc("f"), "threshold").limit(1).select("threshold", r6("f").alias("f"))


@query("G14_holdout", f"WITH {SCORED}, h AS (SELECT img, arg_max(y, (p, doc_id)) best, bool_or(y = 1 AND p >= 0.5) any_ FROM sc GROUP BY img) SELECT round(avg(CAST(best AS DOUBLE)), 6) AS top1, round(avg(CASE WHEN any_ THEN 1.0 ELSE 0.0 END), 6) AS passes FROM h")
def g14(spark, sf):
    per = scored(spark, sf).groupBy("img").agg(F.max_by("y", F.struct("p", "doc_id")).alias("best"), F.bool_or((F.col("y") == 1) & (F.col("p") >= 0.5)).alias("any"))
    return per.agg(r6(F.avg(F.col("best").cast("double"))).alias("top1"), r6(evaluation.share(F.col("any"))).alias("passes"))


@query("G15_confusion", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def g15(spark, sf):
    return t(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("G16_class_sizes", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def g16(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"))


UNIT = "un AS (SELECT label, unnest(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))) x, generate_subscripts(embedding, 1) pos FROM embeddings), sm AS (SELECT label, pos, sum(x) x FROM un GROUP BY ALL), nm AS (SELECT label, sqrt(sum(x * x)) n FROM sm GROUP BY label)"


@query("G17_centroids", f"WITH {UNIT} SELECT CAST(label AS BIGINT) AS label, CAST(pos - 1 AS BIGINT) AS pos, round(x / n, 6) AS x FROM sm JOIN nm USING (label)")
def g17(spark, sf):
    return linalg.centroids(embeddings(spark, sf), "label", "vec").select("label", F.posexplode("centroid").alias("pos", "x")).select("label", big(F.col("pos")).alias("pos"), r6("x").alias("x"))


@query("G18_standardized", "WITH m AS (SELECT event_type, avg(value) mean, var_pop(value) var FROM events GROUP BY 1) SELECT event_id, round((value - mean) / sqrt(var + 1e-6), 6) AS z FROM events JOIN m USING (event_type)")
def g18(spark, sf):
    e = t(spark, sf, "events")
    m = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    return e.join(m, "event_type").select("event_id", r6((F.col("value") - F.col("mean")) / F.sqrt(F.col("var") + 1e-6)).alias("z"))


@query("G18_covariance_whole", "WITH l AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) x, generate_subscripts(embedding, 1) pos FROM embeddings) SELECT CAST(a.pos - 1 AS BIGINT) AS i, CAST(b.pos - 1 AS BIGINT) AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM l a JOIN l b USING (vec_id) GROUP BY a.pos, b.pos")
def g18b_whole(spark, sf):
    _, cov = linalg.covariance(embeddings(spark, sf), "vec")
    d, cov = range(len(cov)), cov.round(6)  # a small negative stays a negative zero
    return spark.createDataFrame([(i, j, float(cov[i, j])) for i in d for j in d], "i long, j long, cov double")


@query("G19_whitening")
def g19(spark, sf):
    e = embeddings(spark, sf)
    mean, matrix, explained = linalg.whitening(e, "vec", 8)
    return linalg.project(e.select("g", "vec"), "vec", mean, matrix, "white").select("g", "white")


@query("G21_speeds", "SELECT event_type, round(count(*) / sum(value), 6) AS per_second, round(sum(value) / count(*), 6) AS seconds FROM events GROUP BY 1")
def g21(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(r6(F.count("*") / F.sum("value")).alias("per_second"), r6(F.sum("value") / F.count("*")).alias("seconds"))


@query("G22_processing_time", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round((l_tax + l_discount) * 1000) AS BIGINT) AS ms FROM lineitem")
def g22(spark, sf):
    times = F.create_map(F.lit("normalize"), F.col("l_tax"), F.lit("search"), F.col("l_discount"))
    total = F.aggregate(F.map_values(times), F.lit(0.0), lambda s, x: s + x)
    return t(spark, sf, "lineitem").select("l_orderkey", *LINE, big(F.round(total * 1000)).alias("ms"))


@query("G23_dropped_per_role", "SELECT source AS role, count(*) AS raw, count(l.doc_id) AS kept, count(*) - count(l.doc_id) AS dropped FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def g23(spark, sf):
    d, lab = t(spark, sf, "documents").select("doc_id", F.col("source").alias("role")), t(spark, sf, "labels")
    raw, kept = d.groupBy("role").agg(F.count("*").alias("raw")), d.join(lab, "doc_id", "left_semi").groupBy("role").agg(F.count("*").alias("kept"))
    out = raw.join(kept, "role", "left").fillna(0, ["kept"])
    return out.select("role", "raw", "kept", (F.col("raw") - F.col("kept")).alias("dropped"))


@query("G26_first_match", "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) FILTER (l_quantity > 25) AS best FROM lineitem GROUP BY 1")
def g26(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.when(F.col("l_quantity") > 25, F.struct("l_linenumber", "l_partkey"))).alias("best"))


# -- windows and limits -------------------------------------------------------------------------------------------


@query("W1_relative_features", f"WITH {IMAGES} SELECT img, l_linenumber, l_partkey, l_suppkey, round(conf / nullif(max(conf) OVER p, 0), 6) AS conf_rel, round(area / max(area) OVER p, 6) AS area_rel, round((row_number() OVER (PARTITION BY img ORDER BY conf DESC, l_linenumber, l_partkey, l_suppkey) - 1) / count(*) OVER p, 6) AS rank_rel, count(*) OVER p AS n, CAST(sum(CASE WHEN conf >= 0.7 THEN 1 ELSE 0 END) OVER p AS BIGINT) AS n_strong FROM im WINDOW p AS (PARTITION BY img)")
def w1(spark, sf):
    out = scoring.relative_features(images(spark, sf), "img", "conf", "area", LINE)
    return out.select("img", *LINE, *(r6(c).alias(c) for c in ("conf_rel", "area_rel", "rank_rel")), "n", "n_strong")


@query("W2_crowd", f"WITH {IMAGES} SELECT a.img, a.l_linenumber, a.l_partkey, a.l_suppkey, count(b.img) AS crowd FROM im a LEFT JOIN im b ON a.img = b.img AND (a.l_linenumber, a.l_partkey, a.l_suppkey) <> (b.l_linenumber, b.l_partkey, b.l_suppkey) AND b.conf >= 0.5 AND b.area BETWEEN 0.5 * a.area AND 2 * a.area GROUP BY ALL")
def w2(spark, sf):
    return scoring.crowd(lines(spark, sf), "img", LINE, "conf", "area", repeated=True)


QUOTA = f"{IMAGES}, ok AS (SELECT *, conf >= 0.2 AND l_quantity >= 10 v, l_quantity >= 10 c FROM im), pv AS (SELECT *, coalesce(sum(CASE WHEN v THEN 1 ELSE 0 END) OVER (PARTITION BY img ORDER BY conf DESC, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM ok)"


@query("W3_ordered_quota", f"WITH {QUOTA} SELECT img, l_linenumber, l_partkey, l_suppkey, CASE WHEN conf < 0.2 THEN 'not_target' WHEN b >= 2 THEN 'over_limit' WHEN NOT c THEN 'check_failed' ELSE 'valid' END AS verdict, CASE WHEN conf >= 0.2 AND b < 2 AND c THEN CAST(b + 1 AS BIGINT) END AS place FROM pv")
def w3(spark, sf):
    out = scoring.quota(images(spark, sf), "img", "conf", LINE, F.col("l_quantity") >= 10, 0.2, 2)
    return out.select("img", *LINE, "verdict", big(F.col("place")).alias("place"))


@query("W6_trimmed_classes", "SELECT doc_id FROM documents QUALIFY count(*) OVER (PARTITION BY source) >= 10 AND row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) <= 7")
def w6(spark, sf):
    return datasets.trimmed(t(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 10, 7).select("doc_id")


@query("W7_whole_classes", "WITH z AS (SELECT source, count(*) n FROM documents GROUP BY 1), c AS (SELECT source, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM z) SELECT doc_id FROM documents JOIN c USING (source) WHERE b < 120")
def w7(spark, sf):
    return datasets.whole_classes(t(spark, sf, "documents").select("doc_id", "source"), "source", 120).select("doc_id")


@query("W8_even_subsample", "WITH n AS (SELECT max(vec_id) + 1 n FROM embeddings) SELECT vec_id AS g FROM embeddings WHERE vec_id IN (SELECT CAST(round_even(i * ((n - 1) / 32.0), 0) AS BIGINT) FROM n, range(33) r(i))")
def w8(spark, sf):
    return datasets.evenly(embeddings(spark, sf).select("g"), "g", 33)


@query("W9_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def w9(spark, sf):
    return sessions.retained(t(spark, sf, "events"), "user_id", "ts", "event_id", 7, 10).select("event_id")


@query("W10_shards", "WITH n AS (SELECT count(*) n FROM embeddings), e AS (SELECT k, n * k // 7 lo, n * (k + 1) // 7 hi FROM n, range(7) r(k)) SELECT vec_id AS g, k AS shard FROM embeddings JOIN e ON vec_id >= lo AND vec_id < hi")
def w10(spark, sf):
    e = embeddings(spark, sf).select("g")
    return e.select("g", datasets.shard_of(F.col("g"), F.lit(e.count()), 7).alias("shard"))


@query("W12_seeded_sample", "SELECT doc_id FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR) || '/7') LIMIT 25")
def w12(spark, sf):
    return t(spark, sf, "documents").select("doc_id").orderBy(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("/7")), 256)).limit(25)


@query("W13_sorted_index", f"WITH {IMAGES} SELECT img, l_partkey, l_suppkey, row_number() OVER (PARTITION BY img ORDER BY conf DESC, l_linenumber, l_partkey, l_suppkey) - 1 AS id FROM im")
def w13(spark, sf):
    order = Window.partitionBy("img").orderBy(F.desc("conf"), *LINE)
    return images(spark, sf).select("img", "l_partkey", "l_suppkey", big(F.row_number().over(order) - 1).alias("id"))


@query("W15_paging", "SELECT p_partkey FROM part ORDER BY p_name, p_partkey LIMIT 24 OFFSET 24")
def w15(spark, sf):
    return t(spark, sf, "part").select("p_name", "p_partkey").orderBy("p_name", "p_partkey").offset(24).limit(24).select("p_partkey")


@query("W16_history_validity", "SELECT conv_id, arg_max(role, turn) = 'user' AS valid FROM conversations GROUP BY conv_id")
def w16(spark, sf):
    return sessions.histories(t(spark, sf, "conversations")).select("conv_id", "valid")


# -- set operations -----------------------------------------------------------------------------------------------


@query("U1_first_wins", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first FROM orders GROUP BY 1")
def u1(spark, sf):
    return datasets.first_wins(t(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first"))


@query("U2_set_equality", """WITH d AS (SELECT doc_id, source FROM documents), l AS (SELECT doc_id, quality FROM labels), c(name, missing, unknown) AS (
SELECT 'labels', (SELECT count(*) FROM l WHERE quality NOT IN (0, 1)), 0 UNION ALL
SELECT 'documents', (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l)), (SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM d)) UNION ALL
SELECT 'customers', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)), (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)))
SELECT name, CAST(missing AS BIGINT) AS missing, CAST(unknown AS BIGINT) AS unknown, missing = 0 AND unknown = 0 AS equal FROM c""")
def u2(spark, sf):
    """Each table with what should make it up: labels of both kinds, documents with a label, customers that are suppliers."""
    d, lab = t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels")
    ids = lambda df: df.select("doc_id")
    cases = {
        "labels": (ids(lab), [ids(lab.filter("quality = 1")), ids(lab.filter("quality = 0"))]), "documents": (d, [ids(lab)]),
        "customers": (t(spark, sf, "customer").select("c_custkey"), [t(spark, sf, "supplier").select("s_suppkey")]),
    }
    out = None
    for name, (full, parts) in cases.items():
        one = datasets.set_equality(full, parts).select(F.lit(name).alias("name"), "missing", "unknown", "equal")
        out = one if out is None else out.unionByName(one)
    return out


@query("U3_movements", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'to_extra' ELSE 'to_train' END AS move FROM documents LEFT JOIN labels USING (doc_id) WHERE (doc_id % 2 = 0) = (quality IS NULL)")
def u3(spark, sf):
    d, lab = t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels").select("doc_id")
    train, extra = d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 <> 0")
    return train.join(lab, "doc_id", "left_anti").withColumn("move", F.lit("to_extra")).unionByName(extra.join(lab, "doc_id", "left_semi").withColumn("move", F.lit("to_train")))


@query("U7_config_diff", "WITH a AS (SELECT p_partkey k, p_size v FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey k, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END v FROM part WHERE p_partkey % 4 <> 0) SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unknown' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v")
def u7(spark, sf):
    p = t(spark, sf, "part")
    a = p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("value"))
    b = p.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("key"), (F.col("p_size") + (F.col("p_partkey") % 7 == 0).cast("int")).alias("value"))
    return datasets.differences(a, b)


@query("U8_label_conflicts", "WITH f AS (SELECT o_custkey, o_orderstatus <> first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) x FROM orders) SELECT count(DISTINCT o_custkey) AS n_keys, CAST(count_if(x) AS BIGINT) AS conflicts FROM f")
def u8(spark, sf):
    return datasets.label_conflicts(t(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["o_orderdate", "o_orderkey"])


FRACTION = "CAST('0x' || substr(sha256(CAST({0} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0"


@query("U9_class_split", f"WITH z AS (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) SELECT o_orderkey, CASE WHEN {FRACTION.format('o_custkey')} >= 0.1 THEN 'train' WHEN n >= 2 THEN 'val' ELSE 'val_distractors' END AS role FROM orders JOIN z USING (o_custkey)")
def u9(spark, sf):
    return datasets.class_split(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "role")


# -- scalar functions ---------------------------------------------------------------------------------------------


@query("F1_dot", "SELECT a.vec_id AS g, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f1(spark, sf):
    e = embeddings(spark, sf)
    b = e.select((F.col("g") - 1).alias("g"), F.col("vec").alias("w"))
    return e.join(b, "g").select("g", r6(vec.dot(F.col("vec"), F.col("w"))).alias("cos"))


@query("F2_normalized", "SELECT vec_id AS g, round(CAST(embedding[1] AS DOUBLE) * 3 / sqrt(list_dot_product(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3), list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3))), 6) AS x FROM embeddings")
def f2(spark, sf):
    return embeddings(spark, sf).select("g", r6(F.element_at(vec.normalized(F.transform(vec.doubles(F.col("vec")), lambda x: x * 3)), 1)).alias("x"))


@query("F3_iou", f"WITH {BOXES} SELECT img, l_linenumber, l_partkey, l_suppkey, tl, tp, ts, round(iou, 6) AS iou FROM io")
def f3(spark, sf):
    cand, target, overlap = boxes(spark, sf)
    return target.join(cand, F.col("img") == F.col("timg")).select("img", *LINE, F.col("t_l_linenumber").alias("tl"), F.col("t_l_partkey").alias("tp"), F.col("t_l_suppkey").alias("ts"), r6(overlap).alias("iou"))


def shapes(spark, sf):
    """A triangle and a rectangle of each part, by its size s: (0,0) (2s,0) (0,s) and (s,s) (s+4,s) (s+4,s+3) (s,s+3)."""
    s = F.col("p_size").cast("double")
    pt = lambda x, y: F.array(F.lit(x) if isinstance(x, float) else x, F.lit(y) if isinstance(y, float) else y)
    return t(spark, sf, "part").select("p_partkey", s.alias("s"), F.array(pt(0.0, 0.0), pt(2 * s, 0.0), pt(0.0, s)).alias("tri"), F.array(pt(s, s), pt(s + 4, s), pt(s + 4, s + 3), pt(s, s + 3)).alias("rect"))


@query("F4_area", "SELECT p_partkey, CAST(p_size * p_size AS DOUBLE) AS tri, CAST(12 AS DOUBLE) AS rect FROM part")
def f4(spark, sf):
    return shapes(spark, sf).select("p_partkey", geo.area(F.col("tri")).alias("tri"), r6(geo.area(F.col("rect"))).alias("rect"))


@query("F5_bbox", "SELECT p_partkey, CAST(0 AS INT) AS x0, CAST(0 AS INT) AS y0, CAST(greatest(2 * p_size, p_size + 4) AS INT) AS x1, CAST(p_size + 3 AS INT) AS y1 FROM part")
def f5(spark, sf):
    b = shapes(spark, sf).select("p_partkey", geo.bbox(F.array("tri", "rect")).alias("b"))
    return b.select("p_partkey", *(F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


@query("F6_point_in_polygon", "SELECT p_partkey, 5.0 / (2 * p_size) + 4.0 / p_size < 1 AS inside FROM part WHERE abs(5.0 / (2 * p_size) + 4.0 / p_size - 1) > 1e-9")
def f6(spark, sf):
    s = shapes(spark, sf).filter(F.abs(5 / (2 * F.col("s")) + 4 / F.col("s") - 1) > 1e-9)
    return s.select("p_partkey", geo.contains(F.col("tri"), F.lit(5.0), F.lit(4.0)).alias("inside"))


@query("F7_hit_test", "WITH k AS (SELECT p_partkey id, p_brand FROM part WHERE 5.0 / (2 * p_size) + 4.0 / p_size < 1 - 1e-9), a AS (SELECT id, k.p_brand, p_size * p_size area FROM k JOIN part ON id = p_partkey) SELECT p_brand, arg_min(id, (area, id)) AS hit FROM a GROUP BY 1")
def f7(spark, sf):
    s = shapes(spark, sf).join(t(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey").filter(F.abs(5 / (2 * F.col("s")) + 4 / F.col("s") - 1) > 1e-9)
    return s.filter(geo.contains(F.col("tri"), F.lit(5.0), F.lit(4.0))).groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(geo.area(F.col("tri")).alias("a"), "p_partkey")).alias("hit"))


@query("F8_contain_fit", "SELECT p_partkey, round(least(400.0 / (p_size * 10), 300.0 / (p_size * 4)), 6) AS scale, round((400 - p_size * 10 * least(400.0 / (p_size * 10), 300.0 / (p_size * 4))) / 2, 6) AS x, round((300 - p_size * 4 * least(400.0 / (p_size * 10), 300.0 / (p_size * 4))) / 2, 6) AS y FROM part")
def f8(spark, sf):
    scale, x, y = geo.contained(F.col("p_size") * 10.0, F.col("p_size") * 4.0, F.lit(400.0), F.lit(300.0))
    return t(spark, sf, "part").select("p_partkey", r6(scale).alias("scale"), F.abs(r6(x)).alias("x"), F.abs(r6(y)).alias("y"))


@query("F9_centre", "SELECT p_partkey, greatest(2 * p_size, p_size + 4) / 2 AS x, (p_size + 3) / 2 AS y FROM part")
def f9(spark, sf):
    c = shapes(spark, sf).select("p_partkey", geo.centre(F.array("tri", "rect")).alias("c"))
    return c.select("p_partkey", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"))


@query("F10_unit_polygons", "SELECT p_partkey, round(least(2 * p_size / 60, 1) * p_size / 90 / 2, 6) AS area FROM part")
def f10(spark, sf):
    p = shapes(spark, sf).select("p_partkey", geo.proper(F.array(geo.to_unit(F.col("tri"), F.lit(60.0), F.lit(90.0)), F.array(F.array(F.lit(0.0), F.lit(0.0))))).alias("p"))
    return p.select("p_partkey", r6(F.array_max(F.transform("p", geo.area))).alias("area"))


@query("F11_main_parts", "SELECT p_partkey, CASE WHEN 12 >= 0.1 * greatest(p_size * p_size, 12) AND p_size * p_size >= 0.1 * greatest(p_size * p_size, 12) THEN 2 ELSE 1 END AS n FROM part")
def f11(spark, sf):
    return shapes(spark, sf).select("p_partkey", F.size(geo.main_parts(F.array("tri", "rect"), 0.1)).alias("n"))


@query("F12_affine", "SELECT p_partkey, CAST(2 * 2 * p_size + 5 AS DOUBLE) AS x, CAST(-2 * p_size + 1 AS DOUBLE) AS y, round(p_size * cos(radians(30)) + 2 * p_size * sin(radians(30)), 6) AS w FROM part")
def f12(spark, sf):
    row = lambda *v: F.array(*map(F.lit, v))
    m = F.array(row(2.0, 0.0, 5.0), row(-1.0, 1.0, 1.0))
    s = shapes(spark, sf).select("p_partkey", "s", geo.affine(m, F.element_at("tri", 2)).alias("q"))
    return s.select("p_partkey", F.col("q")[0].alias("x"), F.col("q")[1].alias("y"), r6(geo.rotated_extent(F.col("s"), 2 * F.col("s"), F.lit(30.0))[0]).alias("w"))


@query("F13_principal_axis", "WITH m AS (SELECT l_returnflag k, var_pop(l_quantity) xx, var_pop(l_extendedprice / 1000) yy, covar_pop(l_quantity, l_extendedprice / 1000) xy FROM lineitem GROUP BY 1) SELECT k, round(degrees(atan2(2 * xy, xx - yy)) / 2, 6) AS angle, round((xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy), 6) AS major FROM m")
def f13(spark, sf):
    a = geo.principal_axis(F.col("l_quantity"), F.col("l_extendedprice") / 1000, "k")
    return t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(*(r6(v).alias(n) for n, v in a.items()))


@query("F14_label_geometry", "SELECT l_returnflag AS k, round(avg(0.6 * l_quantity + 0.8 * l_tax), 6) AS along, round(max(-0.8 * l_quantity + 0.6 * l_tax) - min(-0.8 * l_quantity + 0.6 * l_tax), 6) AS across FROM lineitem GROUP BY 1")
def f14(spark, sf):
    u, v = 0.6 * F.col("l_quantity") + 0.8 * F.col("l_tax"), -0.8 * F.col("l_quantity") + 0.6 * F.col("l_tax")
    return t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(r6(F.avg(u)).alias("along"), r6(F.max(v) - F.min(v)).alias("across"))


@query("F15_window_clamp", "SELECT p_partkey, CAST(greatest(0.0, least(p_size - 6.0, 50 - 12.0)) AS DOUBLE) AS x FROM part")
def f15(spark, sf):
    return t(spark, sf, "part").select("p_partkey", geo.window_in(F.col("p_size").cast("double"), F.lit(12.0), F.lit(50.0)).alias("x"))


@query("F16_band_fill", "WITH q AS (SELECT event_type, quantile_cont(value, 0.05) a, quantile_cont(value, 0.95) b FROM events GROUP BY 1) SELECT event_type, round(avg(CASE WHEN value BETWEEN a AND b THEN 1.0 ELSE 0.0 END), 6) AS fill FROM events JOIN q USING (event_type) GROUP BY 1")
def f16(spark, sf):
    e = t(spark, sf, "events")
    q = evaluation.quantiles(e, "value", {"a": evaluation.quantile(0.05), "b": evaluation.quantile(0.95)}, ("event_type",))
    return e.join(q, "event_type").groupBy("event_type").agg(r6(evaluation.share(F.col("value").between(F.col("a"), F.col("b")))).alias("fill"))


@query("F17_log_features", "SELECT p_partkey, round(ln(p_size), 6) AS a, round(ln(1 + p_retailprice), 6) AS b, round(sqrt(CAST(p_size AS DOUBLE) * p_size + 9), 6) AS c, round(1 / (1 + exp(-p_size / 10)), 6) AS d FROM part")
def f17(spark, sf):
    s = F.col("p_size")
    return t(spark, sf, "part").select("p_partkey", r6(F.ln(s)).alias("a"), r6(F.log1p("p_retailprice")).alias("b"), r6(F.hypot(s, F.lit(3.0))).alias("c"), r6(1 / (1 + F.exp(-s / 10))).alias("d"))


@query("F18_hash_fraction", f"SELECT c_custkey, round({FRACTION.format('c_custkey')}, 9) AS f FROM customer")
def f18(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", F.round(tx.hash_fraction(F.col("c_custkey").cast("string")), 9).alias("f"))


@query("F19_fingerprint", """SELECT p_partkey, substr(sha256('{"brand":"' || p_brand || '","type":"' || p_type || '"}'), 1, 16) AS print FROM part""")
def f19(spark, sf):
    return t(spark, sf, "part").select("p_partkey", datasets.fingerprint(F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))).alias("print"))


SPACE = uuid.NAMESPACE_URL.hex
V5 = f"sha1(unhex('{SPACE}') || encode(p_name))"


@query("F20_uuid5", f"WITH h AS (SELECT DISTINCT p_name, {V5} h FROM part) SELECT p_name, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h")
def f20(spark, sf):
    return t(spark, sf, "part").select("p_name").distinct().select("p_name", tx.uuid5(SPACE, F.col("p_name")).alias("id"))


@query("F21_sha256", "SELECT page_id, sha256(html) AS digest FROM pages")
def f21(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


@query("F23_json", """SELECT event_id, '{"type":"' || event_type || '","k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS j FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def f23(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return t(spark, sf, "events").filter(k.isNotNull()).select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("j"))


@query("F24_text_blocks", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1")
def f24(spark, sf):
    blocks = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("b"))
    mine = blocks.select("conv_id", F.filter("b", lambda x: x["role"] == "user").alias("b")).filter(F.size("b") > 0)
    return mine.select("conv_id", F.array_join(F.transform("b", lambda x: x["text"]), "").alias("text"))


@query("F25_date_stamp", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders")
def f25(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query("F26_url_encode", "SELECT page_id, url_encode(url) AS quoted FROM pages")
def f26(spark, sf):
    return t(spark, sf, "pages").select("page_id", tx.url_quoted(F.col("url")).alias("quoted"))


_HINT = "CASE o_orderpriority WHEN '1-URGENT' THEN '2.5' WHEN '2-HIGH' THEN ' 7 ' WHEN '3-MEDIUM' THEN 'Wed, 21 Oct 2026 07:28:00 GMT' WHEN '4-NOT SPECIFIED' THEN '' END"
_SECONDS = "CASE o_orderpriority WHEN '1-URGENT' THEN 2.5 WHEN '2-HIGH' THEN 7.0 ELSE 0.0 END"


@query("F27_retry_delay", f"SELECT o_orderkey, round(greatest(least(0.5 * pow(2, o_orderkey % 6) + (o_custkey % 100) / 100.0, 4.0), {_SECONDS}), 6) AS delay FROM orders")
def f27(spark, sf):
    attempt, jitter = F.col("o_orderkey") % 6 + 1, F.col("o_custkey") % 100 / 100.0
    return t(spark, sf, "orders").select("o_orderkey", r6(tx.retry_delay(attempt, jitter, F.expr(_HINT))).alias("delay"))


@query("F28_margin_logits", f"""WITH {UNIT}, ct AS (SELECT label cls, list(x / n ORDER BY pos) c FROM sm JOIN nm USING (label) GROUP BY label), sz AS (SELECT label cls, count(*) n FROM embeddings GROUP BY 1),
co AS (SELECT vec_id q, label, ct.cls, sz.n, list_dot_product(CAST(embedding AS DOUBLE[]), c) cs FROM embeddings, ct JOIN sz USING (cls)),
z AS (SELECT q, label = cls own, 16 * CASE WHEN label = cls THEN cos(acos(least(greatest(cs, -1 + 1e-7), 1 - 1e-7)) + 0.5 * n ** -0.25 + 0.1) ELSE cs END z FROM co)
SELECT q, round(ln(sum(exp(z))) - max(CASE WHEN own THEN z END), 6) AS loss FROM z GROUP BY q""")
def f28(spark, sf):
    e = embeddings(spark, sf)
    cls = linalg.centroids(e, "label", "vec").join(e.groupBy("label").agg(F.count("*").alias("size")), "label").select(F.col("label").alias("cls"), F.col("centroid").alias("centre"), "size")
    scores = linalg.class_scores(e.withColumnRenamed("g", "q"), cls)
    return linalg.arcface(scores, 16.0, 0.5, 0.1, 0.25).select("q", r6("loss").alias("loss"))


@query("F29_generalized_mean", "SELECT vec_id AS g, round((list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: greatest(x, 1e-6) ** 3)) / 64) ** (1 / 3.0), 6) AS m FROM embeddings")
def f29(spark, sf):
    return embeddings(spark, sf).select("g", r6(vec.generalized_mean(F.col("vec"), 3.0)).alias("m"))


@query("F30_slug_contract", "SELECT n_name, regexp_full_match(lower(n_name), '[a-z0-9]+(-[a-z0-9]+)*') AS ok FROM nation")
def f30(spark, sf):
    return t(spark, sf, "nation").select("n_name", F.lower("n_name").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$").alias("ok"))


# -- search and state ---------------------------------------------------------------------------------------------


@query("R1_keyword_search", "SELECT doc_id FROM documents WHERE contains(replace(lower(text), 'ё', 'е'), 'the') AND contains(replace(lower(text), 'ё', 'е'), 'tion')")
def r1(spark, sf):
    return catalog.search(t(spark, sf, "documents"), " The TION ", ["text"]).select("doc_id")


@query("F22_all_words", "SELECT p_partkey FROM part")
def f22(spark, sf):
    return catalog.search(t(spark, sf, "part"), "  ", ["p_name", "p_type"]).select("p_partkey")


@query("R2_suggestions", "WITH c AS (SELECT p_type FROM part WHERE p_partkey = 1), x AS (SELECT p_partkey, p_brand = 'Brand#12' own, p_size % 3 <> 0 pic, sha256('7/' || p_partkey) d FROM part WHERE p_type = (SELECT p_type FROM c)) SELECT p_partkey, row_number() OVER (ORDER BY own DESC, pic DESC, d) AS rank FROM x QUALIFY rank <= 5")
def r2(spark, sf):
    p = t(spark, sf, "part").withColumn("image", F.when(F.col("p_size") % 3 != 0, F.col("p_name")))
    kind = p.filter("p_partkey = 1").first()
    out = catalog.suggestions(p, "p_partkey", "p_type", "p_brand", "image", kind and kind.p_type, "Brand#12", 7)
    return out.withColumn("rank", big(F.col("rank")))


@query("R3_similar_in_group", SAME.replace("p_brand", "p_type"))
def r3(spark, sf):
    return catalog.same_group(t(spark, sf, "part"), "p_partkey", "p_type", "p_partkey").withColumn("rank", big(F.col("rank")))


@query("R4_substring_search", "SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), '01')")
def r4(spark, sf):
    return t(spark, sf, "supplier").filter(F.contains(F.lower("s_name"), F.lower(F.lit("01")))).select("s_suppkey")


@query("R5_allowed_values", "SELECT DISTINCT p_brand AS v FROM part UNION SELECT 'unknown'")
def r5(spark, sf):
    return t(spark, sf, "part").select(F.col("p_brand").alias("v")).unionByName(spark.createDataFrame([("unknown",)], "v string")).distinct()


@query("T2_history", "SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def t2(spark, sf):
    h = sessions.histories(t(spark, sf, "conversations"))
    return h.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["text"])), "|").alias("history"))


@query("T3_latest_operation", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def t3(spark, sf):
    return sessions.latest(t(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("T5_slow_state", "SELECT event_id, CASE WHEN value > 60 THEN 'slow' WHEN value > 8 THEN 'late' ELSE 'fine' END AS state FROM events")
def t5(spark, sf):
    return t(spark, sf, "events").select("event_id", F.when(F.col("value") > 60, "slow").when(F.col("value") > 8, "late").otherwise("fine").alias("state"))


# -- further forms of operators above -----------------------------------------------------------------------------


@query("A13_largest_target", f"WITH {IMAGES} SELECT img, arg_max(l_partkey, (area, l_partkey)) AS target FROM im GROUP BY img")
def a13(spark, sf):
    return images(spark, sf).groupBy("img").agg(F.max_by("l_partkey", F.struct("area", "l_partkey")).alias("target"))


@query("J1_similarity_join", "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings) SELECT a.vec_id AS q, b.vec_id AS g FROM e a JOIN e b ON a.label = 0 AND b.label > 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) <= 10")
def j1(spark, sf):
    e = embeddings(spark, sf)
    return retrieval.vector_topk(e.filter("label = 0").withColumnRenamed("g", "q"), e.filter("label > 0"), 10).select("q", "g")


@query("J2_merged_lists", f"WITH {HYBRID} SELECT q, g, round(sc, 6) AS crop, round(sd, 6) AS box, sc >= sd AS crop_first FROM sim JOIN pool USING (q, g)")
def j2(spark, sf):
    s = spaces(spark, sf)
    merged = retrieval.merged_lists(s.withColumnRenamed("g", "q"), s, ["crop", "box"], 10, exclude_self=True)
    return merged.select("q", "g", r6("crop").alias("crop"), r6("box").alias("box"), (F.col("crop") >= F.col("box")).alias("crop_first"))


@query("T6_session_retention", "WITH s AS (SELECT user_id, max(ts) last FROM events GROUP BY 1) SELECT user_id FROM s WHERE last >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def t6(spark, sf):
    last = t(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return sessions.retained(last.withColumn("all", F.lit(1)), "user_id", "last", "user_id", 7, 1).select("user_id")
