"""Benchmark decontamination: a hash set of the normalised n-grams of the test items is broadcast, windows of the
training documents are scanned against it, and hits are verified word by word.

DataFrame functions only. Documents aren't shuffled: windows leave the scan only where they hit. What is broadcast is
bounded by ``max_broadcast_bytes`` against a measured size; a larger benchmark is joined by a shuffle instead. A text is cut
into chunks of CHUNK words, each with the beginning of the next, before windows are made, so that no row holds the windows of a whole text.
Where the benchmark's windows have at most MAX_HEADS different beginnings of HEAD words, the hashes of these are part of the plan, and only document
windows that begin like one are put together; without that the result is the same.

Defined cases: a null or empty text has no words and no hit; items without words give no window; an item of fewer words
than ``n`` is one window of all its words; repeated documents are reported once per row; a repeated item_id
counts once; of a window that several items have all items are counted, and its words once; texts of any length are scanned whole; ``decontaminate`` tells rows by doc_id and text, so a clean text stays whatever shares its doc_id; other columns of
the inputs are ignored by ``contamination`` and kept, whatever their names, by ``decontaminate``; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, let, lower_ascii, words_by

#: Everything in ASCII but digits and a-z, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20
CHUNK = 4096
HEAD, MAX_HEADS = 3, 1 << 15


def words(text: Column) -> Column:
    return words_by(lower_ascii(text), SEPARATORS)


def windows(found: Column, n: int) -> Column:
    """The array of all runs of n words, each joined by blanks; empty below n words."""
    return F.when(
        F.size(found) >= n,
        F.transform(F.sequence(F.lit(1), F.size(found) - (n - 1)), lambda i: F.array_join(F.slice(found, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, n: int, item: str, text: str) -> DataFrame:
    """gram, gram_hash, n_gram_words and the sorted item ids that have the window."""
    own = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    grams = own.select("item", F.least(F.size("w"), F.lit(n)).alias("len"), F.explode(F.when(F.size("w") < n, F.array(F.array_join("w", " "))).otherwise(windows(F.col("w"), n))).alias("gram"))
    return grams.groupBy("gram", "len").agg(F.collect_set("item").alias("items")).withColumn("gram_hash", F.xxhash64("gram"))


def beginnings(grams: DataFrame) -> dict[int, list[str]] | None:
    """For each length of the benchmark's windows, the hashes of their first HEAD words as literals; None if there are more than MAX_HEADS."""
    words_ = F.split("gram", " ")
    head = F.when(F.col("len") == 1, F.xxhash64(words_[0]))
    for n in range(2, HEAD):
        head = head.when(F.col("len") == n, F.xxhash64(*[words_[j] for j in range(n)]))
    found = grams.select("len", head.otherwise(F.xxhash64(*[F.get(words_, j) for j in range(HEAD)])).alias("h")).distinct().limit(MAX_HEADS + 1).collect()
    if len(found) > MAX_HEADS:
        return None
    out: dict[int, list[str]] = {}
    for k, h in found:
        out.setdefault(k, []).append(f"{h}L" if h > -(1 << 63) else f"({h + 1}L - 1L)")
    return out


def version_of(text: Column) -> Column:
    """With its key, the identity of a row."""
    return F.xxhash64(text)


def hit_rows(docs: DataFrame, benchmark: DataFrame, n: int, item: str, item_text: str, max_broadcast_bytes: int) -> DataFrame:
    """hit_key, hit_version, n_hit and items of the documents (key, text, version) that hold a window."""
    grams = benchmark_windows(benchmark, n, item, item_text)
    # one row of facts: which lengths below n occur, and how large the set is
    lengths, size = grams.agg(F.collect_set("len"), F.coalesce(F.sum(F.length("gram") + 16 * F.size("items") + 64), F.lit(0))).first()
    heads = beginnings(grams)

    def marked(k: int) -> Column:
        """The windows of k words that begin in a chunk's own words; the words after those belong to the next chunk."""
        last = F.least(F.size("part") - k, F.lit(CHUNK - 1))
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        if heads is not None:
            first = ", ".join(f"element_at(part, i + {j + 1})" for j in range(min(HEAD, k)))
            places = F.expr(f"filter(sequence(0, greatest(least(size(part) - {k}, {CHUNK - 1}), 0)), i -> size(part) >= {k} and xxhash64({first}) in ({', '.join(heads[k])}))")
        return F.transform(places, lambda i: F.struct((F.col("base") + i).alias("at"), F.lit(k).alias("len"), F.array_join(F.slice("part", i + 1, k), " ").alias("window")))

    empty = F.array().cast("array<struct<at:int,len:int,window:string>>")
    chunk = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(CHUNK)), lambda b: F.struct(b.alias("base"), F.slice(w, b + 1, CHUNK + n - 1).alias("part")))
    chunks = docs.select("key", "version", F.inline(let(words(F.col("text")), chunk)))
    scanned = chunks.select("key", "version", F.inline(F.concat(empty, *map(marked, sorted(lengths)))))
    known = grams.withColumnRenamed("len", "gram_len")
    known = F.broadcast(known) if size <= max_broadcast_bytes else known.hint("merge")
    scanned = scanned.withColumn("hash", F.xxhash64("window"))
    hits = scanned.join(known, (F.col("hash") == F.col("gram_hash")) & (F.col("window") == F.col("gram")) & (F.col("len") == F.col("gram_len"))).select("key", "version", "at", (F.col("at") + F.col("len")).alias("to"), "items")
    before = Window.partitionBy("key", "version").orderBy("at", "to").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("to") - F.greatest(F.col("at"), F.coalesce(F.max("to").over(before), F.lit(0)))
    found = hits.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("key", "version").agg(F.sum("fresh").alias("n_hit"), F.flatten(F.collect_set("items")).alias("items"))
    return found.select(F.col("key").alias("hit_key"), F.col("version").alias("hit_version"), "n_hit", F.array_sort(F.transform(F.array_distinct("items"), lambda i: i.cast("string"))).alias("items"))


def versioned(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("version", version_of(F.col("text")))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items (ids as strings, sorted) and contaminated."""
    docs = versioned(docs, key, text)
    found = hit_rows(docs, benchmark, n, item, item_text, max_broadcast_bytes)
    counted = docs.select("key", "version", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(found, F.col("key").eqNullSafe(F.col("hit_key")) & F.col("version").eqNullSafe(F.col("hit_version")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark."""
    hits = hit_rows(versioned(docs, key, text), benchmark, n, item, item_text, max_broadcast_bytes).filter("n_hit > 0")
    hit, version = free_names(docs, "__hit", "__hit_version")
    hits = hits.select(F.col("hit_key").alias(hit), F.col("hit_version").alias(version))
    return docs.join(hits, F.col(key).eqNullSafe(F.col(hit)) & (version_of(F.col(text)) == F.col(version)), "left_anti")
