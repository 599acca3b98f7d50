"""Near-duplicate detection: minima of many universal hash functions in bands, candidates checked by their signatures and
confirmed on their full shingle sets, and connected components by alternating large-star and small-star.

How hot groups are kept apart:

* Documents with equal shingle sets are one class from the start; all later steps see a class once, however many copies it has.
* A bucket (the classes that agree in a band) proposes its members paired with its first member, never all pairs.
* A link between two members that aren't linked with the first one can only be missed where a bucket's members end up in different
  components. Such buckets are taken up again: every member outside the largest component is compared with all members
  of the other components, block by block, and a block reports links that join components, at most one less than it has
  members. So no link that matters to the components is lost, and no pairs are sent around. Blocks that carry sets hold
  about 2 BLOCK_SHINGLES shingles, or one set that is larger.

A pair at the similarity limit s is in no common bucket with a probability of (1 - s^4)^bands, which ``bands_for`` keeps under
4e-6 (17 bands at 0.85, 24 at 0.8); above the limit it is less. Shingles are compared by 64-bit fingerprints.

Defined cases: null and empty texts and texts without words have an empty set and are linked with nothing, not even with
each other; with fewer words than a shingle needs, the whole sequence is the only shingle; repeated rows are copies of each
other; texts of any length count whole; of equal candidates the smallest is chosen; a row's component is that of its text, also when its doc_id occurs with other texts; a null doc_id stays null and is
no candidate for component_id unless its component has no other; ``deduplicate`` tells rows by doc_id and text, keeps one row of
each component, every row with an empty set, and other columns, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, checkpoint, free_names, slices

ROWS = 4
BLOCK, BLOCK_SHINGLES = 1024, 2 << 20
SLICE_CHARS = 2 << 20
CHUNK = 4 << 20
#: Standard errors of the signature's estimate that a candidate may fall short of the limit.
SLACK = 5.0
U = np.uint64
MULTIPLIER, MIX_1, MIX_2 = U(0x9E3779B97F4A7C15 | 1), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def bands_for(percent: int) -> int:
    """Bands, of ROWS rows, that miss a pair at the limit with a probability under 1e-5."""
    return int(np.ceil(np.log(1e-6 * 4) / np.log(1 - (percent / 100) ** ROWS)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX_1
    x = (x ^ (x >> U(27))) * MIX_2
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=1)
def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte after lower-casing A-Z, and which bytes are white space."""
    values = np.random.default_rng(77).integers(0, 1 << 64, 256, np.uint64)
    values[65:91] = values[97:123]
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    return values, blank


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(MULTIPLIER), -1, 1 << 64))
    out = []
    for base in (MULTIPLIER, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def word_prints(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and first byte of each word."""
    flat, (values, blank) = np.frombuffer(data, np.uint8), byte_tables()
    prints, places, at = [], [], 0
    while at < len(flat):
        end = min(at + CHUNK, len(flat))
        while end < len(flat) and not blank[flat[end]]:
            end += 1
        part = flat[at:end]
        gap = blank[part]
        edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = powers(max(CHUNK, 1 << int(len(part)).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[part] * up[: len(part)], dtype=np.uint64)])
        prints.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
        places.append(first + at)
        at = end
    return np.concatenate(prints or [np.empty(0, np.uint64)]), np.concatenate(places or [np.empty(0, np.int64)])


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The distinct shingles of k words of each text, as sorted fingerprints."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    prints, places = word_prints(b"\n".join(data))
    ends = np.cumsum([len(d) + 1 for d in data])
    cuts = np.concatenate([[0], np.searchsorted(places, ends)])
    out, rolled = [], prints
    if len(prints) >= k:
        rolled = prints[: len(prints) - k + 1]
        for j in range(1, k):
            rolled = mix(rolled * MULTIPLIER + prints[j : len(prints) - k + 1 + j])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = U(b - a)
            for x in prints[a:b]:
                whole = mix(np.array([whole], np.uint64) * MULTIPLIER + x)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


@functools.lru_cache(maxsize=2)
def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n functions of the multiply-shift family: (a x + b mod 2^64) >> 32, a odd."""
    rng = np.random.default_rng(4242)
    return rng.integers(0, 1 << 63, n, np.uint64) * U(2) + U(1), rng.integers(0, 1 << 64, n, np.uint64)


def signature(found: np.ndarray, n: int) -> np.ndarray:
    a, b = hash_functions(n)
    least = np.full(n, (1 << 64) - 1, np.uint64)
    for i in range(0, len(found), 2048):
        least = np.minimum(least, (found[i : i + 2048, None] * a + b).min(axis=0))
    return (least >> U(32)).astype(np.uint32)


def set_id(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |A and B| >= percent |A or B|, exactly."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


# -- steps --------------------------------------------------------------------------------------------------------


def features(docs: DataFrame, k: int, n_bands: int) -> DataFrame:
    """key, n_shingles, node (identity of the shingle set), bands (a key for each), sig (16 bits of each minimum) and
    digest; node, bands and sig are null where the set is empty."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        mark = mix(np.arange(1, n_bands + 1, dtype=np.uint64) * MULTIPLIER)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, SLICE_CHARS):
                sets = shingle_sets(texts[a:b], k)
                sigs = [signature(s, n_bands * ROWS) if len(s) else None for s in sets]
                bands = []
                for s in sigs:
                    h = None
                    if s is not None:
                        h = mark.copy()
                        for r in range(ROWS):
                            h = mix(h * MULTIPLIER + s.reshape(n_bands, ROWS)[:, r])
                        h = h.view(np.int64)
                    bands.append(h)
                yield pa.RecordBatch.from_pydict({
                    "key": keys.slice(a, b - a), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "node": pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())),
                    "sig": pa.array([None if s is None else (s & 0xFFFF).astype("<u2").tobytes() for s in sigs], pa.binary()),
                    "digest": batch.column(2).slice(a, b - a),
                })

    return docs.select("key", "text", "digest").mapInArrow(run, "key long, n_shingles long, node binary, bands array<long>, sig binary, digest binary")


def likely(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose signatures agree in so many places."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                of = lambda i: np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(n, -1)
                yield batch.select(["a", "b"]).filter(pa.array((of(2) == of(3)).sum(axis=1) >= least))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def confirmed(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b, text_a, text_b) that are similar by their full sets."""

    def run(batches):
        last, own = None, None
        for batch in batches:
            keep = []
            b, ta, tb = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for x, y, z in zip(b, ta, tb, strict=True):
                if x != last:
                    last, own = x, shingle_sets([z], k)[0]
                keep.append(similar(shingle_sets([y], k)[0], own, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links (a, b) reach, for all nodes that have a link but the roots. Large-star ties the larger neighbours of
    each node to its least one, small-star the smaller ones; joined by keys, so that no node's neighbours are gathered."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # written, so that both sides of the join are plain exchanges and Spark can split a hub's partition
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m")))
        tied = both.filter(F.col("v") > F.col("u")) if large else both
        out = tied.join(least, F.col("u") == F.col("of")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
        out = scratch.write(out.filter(F.col("a") != F.col("b")).distinct())
        scratch.remove(least)
        return out

    def state(edges: DataFrame):
        return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()

    edges = scratch.write(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    now = state(edges)
    while True:
        large = star(edges, True)
        small = star(large, False)
        scratch.remove(edges, large)
        before, now, edges = now, state(small), small
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def blocks(scratch: Scratch, members: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, i, j, node, root, outside: the work left in buckets (bucket, node, load) that hold more than one component. Each
    pair of a member outside the bucket's largest component and any other member meets in one block (i, j); a block holds rows of
    a load of about 2, so a large bucket is many tasks."""
    placed = members.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("bucket", "node", "load", F.coalesce("root", "node").alias("root"))
    placed = scratch.write(placed)
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("load").alias("load"))
    most = F.struct("n", "root")
    mixed = sizes.groupBy("bucket").agg(F.max_by("root", most).alias("main"), F.count("*").alias("parts"), F.sum("load").alias("load_all"), F.max_by("load", most).alias("load_main"))
    mixed = scratch.write(mixed.filter("parts > 1").withColumnRenamed("bucket", "in"))
    same = scratch.write(placed.join(mixed, F.col("bucket") == F.col("in")).drop("in"))
    # the same members often meet in many bands: of buckets with equal members one is taken
    marks = same.groupBy("bucket").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("root", "node").cast("decimal(38,0)")).alias("y"), F.count("*").alias("z"))
    chosen = scratch.write(marks.groupBy("x", "y", "z").agg(F.min("bucket").alias("in")).select("in"))
    same = same.join(chosen, F.col("bucket") == F.col("in")).drop("in")
    n_out, n_all = (F.greatest(F.ceil(F.round(x, 6)), F.lit(1)).cast("long") for x in (F.col("load_all") - F.col("load_main"), F.col("load_all")))
    spot = lambda n: F.pmod(F.xxhash64("node", "bucket"), n)
    zero = F.lit(0).cast("long")
    # a member goes with each block of outsiders; an outsider also goes, as such, with each block of members
    as_member = same.select("bucket", "node", "root", F.lit(False).alias("outside"), spot(n_all).alias("j"), F.explode(F.sequence(zero, n_out - 1)).alias("i"))
    outside = same.filter(F.col("root") != F.col("main"))
    as_outside = outside.select("bucket", "node", "root", F.lit(True).alias("outside"), F.explode(F.sequence(zero, n_all - 1)).alias("j"), spot(n_out).alias("i"))
    return as_member.unionByName(as_outside)


def sides(pdf, least: int):
    """The outsiders, the members, and for each outsider the members of other components whose signature is near, the nearest first."""
    own, others = (x.reset_index(drop=True) for x in (pdf[pdf.outside], pdf[~pdf.outside]))
    near = []
    if len(own) and len(others):
        table = np.frombuffer(b"".join(others.sig), "<u2").reshape(len(others), -1)
        roots = others.root.to_numpy()
        for root, sig in zip(own.root, own.sig, strict=True):
            agree = (table == np.frombuffer(sig, "<u2")).sum(axis=1)
            at = np.flatnonzero(agree >= least)
            at = at[[roots[i] != root for i in at]] if len(at) else at
            near.append(at[np.argsort(-agree[at], kind="stable")])
    return own, others, near


def hopeful(rows: DataFrame, least: int) -> DataFrame:
    """bucket, node: members of blocks (with sig) that have a near signature in another component."""

    def block(pdf):
        import pandas as pd

        own, others, near = sides(pdf, least)
        nodes = {own.node[i] for i, x in enumerate(near) if len(x)} | {others.node[j] for j in np.unique(np.concatenate(near or [np.empty(0, int)])).astype(int)}
        return pd.DataFrame({"bucket": pd.Series([pdf.bucket.iloc[0]] * len(nodes), dtype="int64"), "node": sorted(nodes)})

    return rows.groupBy("bucket", "i", "j").applyInPandas(block, "bucket long, node binary").distinct()


def rest_links(rows: DataFrame, percent: int, least: int) -> DataFrame:
    """Confirmed links (a, b) that join components, of blocks with sig and shingles: in a block, fewer than it has members."""

    def block(pdf):
        import pandas as pd

        group = {r: r for r in pdf.root.unique()}

        def find(x):
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        own, others, near = sides(pdf, least)
        full = lambda row: np.frombuffer(row.shingles, np.uint64)
        members, links = list(others.itertuples(index=False)), []
        for x, at in zip(own.itertuples(index=False), near, strict=False):
            for y in map(members.__getitem__, at):
                if find(x.root) != find(y.root) and similar(full(x), full(y), percent):
                    group[find(x.root)] = find(y.root)
                    links.append((x.node, y.node))
        return pd.DataFrame(links, columns=["a", "b"])

    return rows.groupBy("bucket", "i", "j").applyInPandas(block, "a binary, b binary")


def sets_of(own: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, shingles: the full sets of the wanted, as sorted fingerprints."""

    def run(batches):
        for batch in batches:
            nodes, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                yield pa.RecordBatch.from_arrays([nodes.slice(a, b - a), pa.array([x.tobytes() for x in shingle_sets(texts[a:b], k)], pa.binary())], names=["node", "shingles"])

    return texts_of(own, wanted, k).mapInArrow(run, "node binary, shingles binary")


def texts_of(own: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, text for the wanted (node, doc): the text of a document whose set is the node's. Documents are found by key and
    digest, as many unrelated ones may share a key or have none."""

    def run(batches):
        for batch in batches:
            nodes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                sets = shingle_sets([t or "" for t in texts[a:b]], k)
                yield batch.slice(a, b - a).filter(pa.array([set_id(s) == n for s, n in zip(sets, nodes[a:b], strict=True)], pa.bool_()))

    wanted = wanted.select("node", F.col("doc.key").alias("doc_key"), F.col("doc.digest").alias("doc_digest"))
    found = own.join(wanted, F.col("key").eqNullSafe(F.col("doc_key")) & (F.col("digest") == F.col("doc_digest"))).select("node", "text")
    return found.mapInArrow(run, "node binary, text string").groupBy("node").agg(F.first("text").alias("text"))


def of(df: DataFrame, end: str) -> DataFrame:
    """The columns of a node's table, named for an end of a pair."""
    return df.select(*(F.col(c).alias(f"{c}_{end}") for c in df.columns))


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text and digest; a row's identity is its key with its digest."""
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.unhex(F.md5(text)).alias("digest"))


def least_row() -> Column:
    """Aggregate: the identity with the smallest key, a null one only if there is no other."""
    return F.min(F.struct(F.col("key").isNull().alias("none"), "key", "digest"))


def located(scratch: Scratch, own: DataFrame, k: int, percent: int) -> DataFrame:
    """Per document: key, n_shingles, digest, root (null where the set is empty)."""
    n_bands = bands_for(percent)
    n, s = n_bands * ROWS, percent / 100
    least = int(np.floor(n * (s - SLACK * np.sqrt(s * (1 - s) / n))))
    on = lambda x, y: F.col(x) == F.col(y)
    found = scratch.write(features(own, k, n_bands))
    # a row for each class, put together within tasks first; classes in a band: buckets of one class are no candidates
    classes = scratch.write(found.filter("node is not null").groupBy("node").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"), least_row().alias("doc")))
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1").select(F.col("bucket").alias("in"), "lead")
    members = scratch.write(banded.join(scratch.write(buckets), on("bucket", "in")).select("bucket", "node", "lead"))
    met = members.select(F.col("node").alias("of")).distinct()
    sigs = scratch.write(classes.select("node", "sig", "doc").join(met, on("node", "of"), "left_semi"))
    scratch.remove(classes)
    # stars: each member with the first of its bucket
    pairs = members.filter(F.col("node") != F.col("lead")).select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    marked = sigs.select("node", "sig")
    pairs = scratch.write(likely(pairs.join(of(marked, "a"), on("a", "node_a")).join(of(marked, "b"), on("b", "node_b")), least))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct()
    texts = scratch.write(texts_of(own, sigs.join(asked, on("node", "of"), "left_semi"), k))
    links = scratch.write(confirmed(pairs.join(of(texts, "a"), on("a", "node_a")).join(of(texts, "b"), on("b", "node_b")), k, percent))
    roots = components(scratch, links)
    # what stars can't tell: pairs of different components within a bucket
    marked = sigs.select(F.col("node").alias("of"), "sig")
    rest = scratch.write(hopeful(blocks(scratch, members.withColumn("load", F.lit(1 / BLOCK)), roots).join(marked, on("node", "of")).drop("of"), least))
    if not rest.isEmpty():
        asked = rest.select(F.col("node").alias("of")).distinct()
        sets = scratch.write(sets_of(own, sigs.join(asked, on("node", "of"), "left_semi"), k).withColumnRenamed("node", "of"))
        load = sets.select("of", F.greatest(F.lit(1 / BLOCK), F.octet_length("shingles") / (8 * BLOCK_SHINGLES)).alias("load"))
        weighed = rest.join(load, on("node", "of")).drop("of")
        work = blocks(scratch, weighed, roots).join(marked, on("node", "of")).drop("of").join(sets, on("node", "of")).drop("of")
        roots = components(scratch, links.unionByName(rest_links(work, percent, least)))
    out = found.select("key", "n_shingles", "digest", "node").join(roots.withColumnRenamed("node", "of"), on("node", "of"), "left").select("key", "n_shingles", "digest", F.coalesce("root", "node").alias("root"))
    return scratch.write(out)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_shingles, component_id, kept."""
    with Scratch(docs.sparkSession) as scratch:
        found = located(scratch, identified(docs, key, text), k, percent)
        first = scratch.write(found.filter("root is not null").groupBy("root").agg(F.min("key").alias("first")).withColumnRenamed("root", "of"))
        out = found.join(first, F.col("root") == F.col("of"), "left").select("key", "n_shingles", F.coalesce("first", "key").alias("component_id"))
        return checkpoint(out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, of which each component keeps one row: that with the smallest key (null
    only if there is no other), and of those with that key the one with the first text digest. Rows without words are linked with nothing and stay."""
    with Scratch(docs.sparkSession) as scratch:
        found = located(scratch, identified(docs, key, text), k, percent).filter("root is not null")
        least = found.groupBy("root").agg(least_row().alias("at"))
        # the key alone may be null or shared by many rows: the join is by row identity
        names = free_names(docs, "__at", "__none", "__digest", "__kept", "__kept_none", "__kept_digest")
        own, other = names[:3], names[3:]
        kept = checkpoint(least.select(*(c.alias(n) for c, n in zip((F.coalesce("at.key", F.lit(0)), F.col("at.none"), F.col("at.digest")), other, strict=True))))
    number, worded = F.col(key).cast("long"), F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.filter(worded).withColumns(dict(zip(own, (F.coalesce(number, F.lit(0)), number.isNull(), F.unhex(F.md5(text))), strict=True)))
    single = marked.join(kept, [F.col(a) == F.col(b) for a, b in zip(own, other, strict=True)], "left_semi").dropDuplicates(own)
    return single.select(*docs.columns).unionByName(docs.filter(~worded))
