"""WARC, quality rules and decontamination against plain Python."""

import base64
import hashlib
import re

from pyspark.sql import functions as F

from galena.llm import decontam, quality, registry, warc

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def quality_of(text):
    t = text or ""
    w = BLANK.findall(t)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if BLANK.search(x)]
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed)


def same_quality(rows, docs):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=str)
    assert got == sorted(((d.doc_id, *quality_of(d.text)) for d in docs), key=str)
    assert not any(r.kept for r in rows if r.base_failed)


def test_quality_counts(spark, sf, edge_docs, no_docs):
    same_quality(registry.QUERIES["op6_quality_rules"](spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").collect())
    same_quality(quality.measure(edge_docs).collect(), edge_docs.collect())
    assert quality.measure(no_docs).count() == 0


def test_quality_verdict(spark, sf):
    got = registry.QUERIES["op6_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r.quality and not r.base_failed], [r for r in got if not r.quality]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)


def words7(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def leaks(text, items, n=10):
    w, hit, found = words7(text), set(), set()
    for item, t in items:
        b = words7(t)
        grams = [b] if 0 < len(b) < n else [b[i : i + n] for i in range(len(b) - n + 1)]
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if g and w[i : i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(str(item))
    return (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def report(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in df.collect()), key=str)


def test_decontamination(spark, sf, edge_docs, no_docs, texts, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = registry.QUERIES["op7_decontamination"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted((d.doc_id, *leaks(d.text, items)) for d in docs.collect())
    own = [(1, texts[9][40:600]), (2, "the river"), (3, None), (4, " .. "), (5, texts[9][40:600]), (10, texts[8]), (3, "x x x x x x x x x x x")]
    bench = spark.createDataFrame(own, "item_id long, text string").withColumn("gram", F.lit(1))
    want = sorted(((d.doc_id, *leaks(d.text, own)) for d in edge_docs.collect()), key=str)
    assert report(decontam.contamination(edge_docs, bench)) == want
    assert report(decontam.contamination(edge_docs, bench, max_broadcast_bytes=0)) == want
    with monkeypatch.context() as m:  # without the beginnings in the plan, and by those of one word
        for name, value in (("MAX_HEADS", 0), ("HEAD", 1)):
            m.setattr(decontam, name, value)
            assert report(decontam.contamination(edge_docs, bench)) == want
            m.undo()
    assert decontam.contamination(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(edge_docs, bench.limit(0)).collect())
    kept = decontam.decontaminate(edge_docs, bench)
    assert kept.columns == edge_docs.columns
    hit = {r[0] for r in want if r[-1]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d.doc_id for d in edge_docs.collect() if d.doc_id not in hit)


def test_warc(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    edge = spark.createDataFrame([(9, "http://a/\r\nb", None), (7, None, ""), (3, "u", "é\r\n\r\nx"), (1, "v", "é\r\n\r\nx"), (3, "u", "é\r\n\r\nx"), (12, "w", "long" * 50000), (11, "w", "long" * 50000)], "page_id long, url string, html string")
    for n, df in enumerate((pages, pages.union(edge).withColumn("digest", F.lit(1)), edge.limit(0))):
        warc.write_archive(df, at := f"file://{tmp_path}/{n}")
        back = warc.read_archive(spark, at)
        got = warc.parse(back).collect()
        rows = df.collect()
        first = {}
        for r in rows:
            first[r.html or ""] = min(r.page_id, first.get(r.html or "", 1 << 60))
        want = []
        for r in rows:
            h = (r.html or "").encode()
            own = first[r.html or ""]
            want.append((r.page_id, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), *(("response", None) if own == r.page_id else ("revisit", own))))
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
        assert all(r.length_agrees and r.digest_agrees for r in got)
        assert spark.read.parquet(f"{at}/payloads").count() == len(first)


def test_warc_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x\r\n\r\n"), (2, "u", "x\r\n\r\n"), (5, "z", "ü")], "page_id long, url string, html string")
    warc.write_archive(df, at := f"file://{tmp_path}/a")
    warc.export(warc.read_archive(spark, at).coalesce(1), f"file://{tmp_path}/w", compression="none")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part*")))
    records = []
    while data:  # as a WARC reader goes
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        records.append((re.search(rb"WARC-Type: (\w+)", head)[1], rest[:n]))
        assert rest[n : n + 4] == b"\r\n\r\n"
        data = rest[n + 4 :]
    assert sorted(records) == [(b"response", b"x\r\n\r\n"), (b"response", "ü".encode()), (b"revisit", b"")]


def test_lines_are_judged_by_their_end(spark):
    good = ["Title of four words", "One two three four five six.", 'He said: "one two three four five."', "One two three four. Five six seven. And it breaks off"]
    bad = ["1. Home about us products contact imprint", "Home about us products contact imprint", "v2.1 one two three four five six seven", "Home | Shop | Help | Contact"]
    df = spark.createDataFrame([(x, x in good) for x in good + bad], "line string, good boolean")
    assert all(r.bad != r.good for r in df.withColumn("bad", quality.bad_line(F.col("line"))).collect())


def test_chunks_of_a_long_text(spark, monkeypatch):
    """Windows that cross the chunks' borders are found once."""
    words = [f"w{i % 37}x{i % 11}" for i in range(400)]
    items = [(1, " ".join(words[3:20])), (2, " ".join(words[60:71])), (3, "w5x5 w6x6"), (4, " ".join(words[390:400])), (5, "absent " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:9])), (3, " ".join(words[:70])), (4, "")], "doc_id long, text string").selectExpr("*", "1 as base", "'p' as part", "2 as __hit")
    want = sorted(((r.doc_id, *leaks(r.text, items)) for r in docs.collect()), key=str)
    for size in (1, 2, 10, 64):
        monkeypatch.setattr(decontam, "CHUNK", size)
        assert report(decontam.contamination(docs, bench)) == want
    assert decontam.decontaminate(docs, bench).columns == docs.columns


def test_record_ids_are_unique(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (1, "v", "x"), (2, "u", "x"), (2, "u", "x"), (2, "u", "y"), (None, None, "y"), (None, None, "y")], "page_id long, url string, html string")
    warc.write_archive(df, at := f"file://{tmp_path}/a", date="2020-02-02T00:00:00Z")
    heads = [r.header for r in warc.read_archive(spark, at).collect()]
    ids = [re.search(r"WARC-Record-ID: (\S+)", h)[1] for h in heads]
    assert len(set(ids)) == len(heads) == 8
    responses = {re.search(r"WARC-Record-ID: (\S+)", h)[1] for h in heads if "Type: response" in h}
    assert all(re.search(r"WARC-Refers-To: (\S+)", h)[1] in responses for h in heads if "Type: revisit" in h)
    assert all("WARC-Date: 2020-02-02T00:00:00Z\r\n" in h for h in heads)
