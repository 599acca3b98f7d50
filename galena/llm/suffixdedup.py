"""Removal of long repeated byte strings by sorting suffixes.

A string of LENGTH bytes contains at least one *anchor*: the start of the gram with the least hash among all its
grams, the leftmost of equals. Equal strings have their anchors in the same place, so only suffixes that begin at
anchors need to be compared, about one in 185. Starts of strings with a common anchor are a *segment*; the bytes that its strings
cover are the segment's content.

1. Each document is cut into segments. Segments with equal content are repeated from the first start to the last.
2. What is left are the borders of repetitions: different contents around equal grams. For these the bytes after the
   anchors and, reversed, those before them are sorted: multikey quicksort to a shallow depth, then blind tries that
   order the groups whose common prefix is longer. Neighbours' common prefixes tell which strings are equal.
3. A gram with many contents is never brought together: its strings are dealt out again by the bytes that ranges of 46, then
   6 strings, then one string have in common, and drop out as soon as these bytes are unique. At one string equality is a count.

Contents are compared by 128-bit digests and, at borders, byte by byte.

Defined cases: null and empty texts have no bytes and no spans; texts shorter than LENGTH have no spans; a string that overlaps
its own repetition counts; repeated rows are repetitions of each other; documents that share a doc_id but not the
text are kept apart; texts of any length are searched whole, in stretches that overlap by a string's length; of equal hashes in a string the leftmost
gram is its anchor; other columns are kept by ``remove``, whatever their names (its own columns replace those of the same name); empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded_batches, checkpoint, free_names

LENGTH, GRAM = 400, 32
STARTS = 1 << 20
#: Groups of more contents are dealt out again; ranges of strings for the next round.
GROUP, FINER = 512, (46, 6, 1)
SHALLOW = 64
SORT_ROWS = 8192
U = np.uint64


# -- anchors and segments -----------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.random.default_rng(99).integers(0, 1 << 64, 256, np.uint64)
    base = 0xD1342543DE82EF95
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(2 * STARTS, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return values, out[0], out[1]


def gram_hashes(flat: np.ndarray) -> np.ndarray:
    values, up, down = tables()
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(values[flat] * up[: len(flat)], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: len(flat) - GRAM + 1]
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: from minima that run to and from the ends of blocks."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(data: bytes, length: int = LENGTH):
    """(gram hash, content digest, first start, last start, anchor) of each segment."""
    n, width, low = len(data), length - GRAM + 1, U((1 << 24) - 1)
    for at in range(0, n - length + 1, STARTS):
        part = data[at : at + STARTS + length - 1]
        h = gram_hashes(np.frombuffer(part, np.uint8))
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        anchor = (sliding_least(key, width) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor)) - 1
        for lo, hi, a, g in zip(first.tolist(), last.tolist(), anchor[first].tolist(), h[anchor[first]].view(np.int64).tolist(), strict=True):
            yield g, hashlib.blake2b(part[lo : hi + length], digest_size=16).digest(), at + lo, at + hi, at + a


# -- deep-shallow sorting -----------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, skip: int = 0) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = skip, n
    while hi - lo > 1:  # a[:lo] == b[:lo], a[:hi] != b[:hi]
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_sort(strings: list[bytes], group: list[int], skip: int) -> list[int]:
    """Order strings with a common prefix of skip bytes by a blind trie: inner nodes know only the depth at which their
    branches part, so a descent looks at one byte a node, and one comparison with any leaf below tells the true depth."""
    if len(group) < 2:
        return group
    # node: [depth, {byte or -1 at the end of a string: child}]; a leaf is a list of equal strings' numbers
    root: list = [group[0]]
    for i in group[1:]:
        s, node = strings[i], root
        while isinstance(node[-1], dict):
            at = node[0]
            node = node[1].get(s[at] if at < len(s) else -1) or next(iter(node[1].values()))
        other = strings[node[0]]
        depth = common_prefix(s, other, skip)
        if depth == len(s) == len(other):
            node.append(i)
            continue
        up, branch, node = None, None, root
        while isinstance(node[-1], dict) and node[0] < depth:
            up, branch = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][branch]
        mine = s[depth] if depth < len(s) else -1
        if isinstance(node[-1], dict) and node[0] == depth:
            node[1][mine] = [i]
            continue
        fork = [depth, {mine: [i], other[depth] if depth < len(other) else -1: node}]
        if up is None:
            root = fork
        else:
            up[1][branch] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node[-1], dict):
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> np.ndarray:
    """The order of the strings. Multikey quicksort by words of eight bytes, big-endian with zeros after the end; groups that are equal
    at the shallow depth go to blind tries."""
    n = len(strings)
    heads = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8").reshape(n, shallow // 8).astype(np.uint64)
    out, stack = [], [(np.arange(n), 0)]
    while stack:
        group, word = stack.pop()
        if len(group) == 1 or word == heads.shape[1]:
            out += blind_sort(strings, group.tolist(), 0)
            continue
        x = heads[group, word]
        if len(group) < 24:  # an insertion sort's share
            order = np.argsort(x, kind="stable")
            group, x = group[order], x[order]
            cuts = np.flatnonzero(np.diff(x)) + 1
            stack += [(p, word + 1) for p in np.split(group, cuts)[::-1]]
            continue
        pivot = sorted(x[[0, len(x) // 2, -1]].tolist())[1]
        less, more = x < pivot, x > pivot
        parts = [(group[less], word), (group[~less & ~more], word + 1), (group[more], word)]
        stack += [p for p in parts[::-1] if len(p[0])]
    return np.array(out, np.int64)


def neighbours(strings: list[bytes], groups: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The common prefix of each string, in order, with the one before it; -1 where another group begins."""
    out = np.full(len(order), -1, np.int64)
    for i in range(1, len(order)):
        a, b = order[i - 1], order[i]
        if groups[a] == groups[b]:
            out[i] = common_prefix(strings[a], strings[b])
    return out


def repeated_starts(groups: np.ndarray, contents: list[bytes], before: np.ndarray, d0: np.ndarray, d1: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For rows of a group (equal grams), whether the string that begins d bytes before the anchor occurs in another row:
    a matrix of rows x d. before: bytes of the content that precede the anchor; d0 to d1: the starts that count."""
    n, width = len(contents), length - GRAM + 1
    tag = [int(g).to_bytes(8, "big") for g in groups]
    classes = []
    for strings in ([c[b:] for c, b in zip(contents, before, strict=True)], [c[:b][::-1] for c, b in zip(contents, before, strict=True)]):
        order = deep_shallow([t + s for t, s in zip(tag, strings, strict=True)])
        classes.append((order, neighbours(strings, groups, order)))
    after = np.array([len(c) for c in contents]) - before
    out = np.zeros((n, width), bool)
    for d in range(int(d0.min()), int(d1.max())):
        valid = (before >= d) & (after >= length - d) & (d0 <= d) & (d < d1)
        if valid.sum() < 2:
            continue
        key = np.zeros(n, np.int64)
        for (order, common), depth in zip(classes, (length - d, d), strict=True):
            number = np.empty(n, np.int64)
            number[order] = np.cumsum(common < depth)
            key = key * (n + 1) + number
        at = np.flatnonzero(valid)
        _, inverse, count = np.unique(key[at], return_inverse=True, return_counts=True)
        out[at, d] = count[inverse] > 1
    return out


# -- steps --------------------------------------------------------------------------------------------------------

SEGMENT = "doc long, version long, gram long, content binary, lo int, hi int, anchor int"
WORK = "part binary, d0 int, d1 int, doc long, version long, anchor int, before int, bytes binary, alone boolean"


def cut(docs: DataFrame, length: int) -> DataFrame:
    """docs: doc, version, text."""

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc, version, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for g, content, lo, hi, a in segments((text or "").encode("utf-8", "surrogatepass"), length):
                    for column, value in zip(rows, (doc, version, g, content, lo, hi, a), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["doc", "version", "gram", "content", "lo", "hi", "anchor"])

    return docs.mapInArrow(run, SEGMENT)


def with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted segments (doc, version, gram, lo, hi, anchor, alone) with their bytes, as work for the first round."""
    lists = wanted.groupBy("doc", "version").agg(F.collect_list(F.struct("gram", "lo", "hi", "anchor", "alone")).alias("list"))
    lists = lists.select(F.col("doc").alias("d"), F.col("version").alias("v"), "list")
    joined = docs.join(lists, F.col("doc").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))).select("doc", "version", "text", "list")

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc, version, text, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in found:
                    a = x["anchor"]
                    row = (x["gram"].to_bytes(8, "big", signed=True), a - x["hi"], a - x["lo"] + 1, doc, version, a, a - x["lo"], data[x["lo"] : x["hi"] + length], x["alone"])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield batch_of(out)

    return joined.mapInArrow(run, WORK)


def batch_of(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "d0", "d1", "doc", "version", "anchor", "before", "bytes", "alone"])


def dealt_out(work: DataFrame, size: int, length: int) -> DataFrame:
    """Each row's starts in ranges of the given size; the part is a digest of what the strings of a range have in common."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            columns = [batch.column(i).to_pylist() for i in range(9)]
            for _, d0, d1, doc, version, a, before, data, alone in zip(*columns, strict=True):
                for r in range(d0 // size, -(-d1 // size)):
                    x, y = max(d0, r * size), min(d1, (r + 1) * size)
                    # the strings of the whole range [r size, (r + 1) size) share these bytes; a row may end before
                    begin, end = before - r * size, before - (r + 1) * size + 1 + length
                    same = data[max(begin, 0) : max(end, 0)]
                    part = hashlib.blake2b(same + bytes([size]) + r.to_bytes(4, "big"), digest_size=16).digest()
                    for column, value in zip(out, (part, x, y, doc, version, a, before, data, alone), strict=True):
                        column.append(value)
            yield batch_of(out)

    return work.mapInArrow(run, WORK)


def sorted_groups(work: DataFrame, length: int) -> DataFrame:
    """doc, version, from, to: bytes of repeated strings among rows of a part. Rows come sorted by part; parts hold at most GROUP rows."""

    def spans(rows: list[tuple]):
        columns = list(zip(*rows, strict=True))
        numbers = {p: i for i, p in enumerate(dict.fromkeys(columns[0]))}
        groups = np.array([numbers[p] for p in columns[0]])
        before = np.array(columns[6], np.int64)
        found = repeated_starts(groups, list(columns[7]), before, np.array(columns[1], np.int64), np.array(columns[2], np.int64), length)
        out: list[list] = [[], [], [], []]
        for i in np.flatnonzero(found.any(axis=1)):
            if not columns[8][i]:
                continue
            d = np.flatnonzero(found[i])
            for run_ in np.split(d, np.flatnonzero(np.diff(d) > 1) + 1):
                for column, value in zip(out, (columns[3][i], columns[4][i], int(columns[5][i] - run_[-1]), int(columns[5][i] - run_[0]) + length), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc", "version", "from", "to"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if len(held) >= SORT_ROWS and row[0] != held[-1][0]:
                    yield spans(held)
                    held = []
                held.append(row)
        if held:
            yield spans(held)

    dealt = work.repartition(F.col("part")).sortWithinPartitions("part")
    return dealt.mapInArrow(run, "doc long, version long, from int, to int")


def counted(work: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of parts with two rows or more, one of which stands alone, and n, how many there are. The counts are written, so that both sides of the
    join are plain exchanges, of which Spark can split the partition of a part with many rows."""
    work = scratch.write(work)
    n = work.groupBy("part").agg(F.count("*").alias("n"), F.bool_or("alone").alias("some")).filter("n > 1 and some").select(F.col("part").alias("p"), "n")
    return work.join(scratch.write(n), F.col("part") == F.col("p")).drop("p")


def repeated(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """doc, version, from, to: byte ranges of docs (doc, version, text) that together cover every repeated string, and nothing else."""
    bounded_batches(docs.sparkSession)
    found = scratch.write(cut(docs, length))
    # most grams occur once; what goes on are the segments of the others
    print_ = F.xxhash64("content")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min(print_).alias("x"), F.max(print_).alias("y")).filter("n > 1")
    grams = scratch.write(grams.select(F.col("gram").alias("g"), (F.col("x") != F.col("y")).alias("border")))
    met = scratch.write(found.join(grams, F.col("gram") == F.col("g")).drop("g"))
    scratch.remove(found)
    # copies of a content are counted within tasks first; one of its segments stands for it
    classes = met.groupBy("content").agg(F.count("*").alias("n"), *(F.first(c).alias(f"of_{c}") for c in ("doc", "version", "lo"))).withColumnRenamed("content", "c")
    classes = scratch.write(classes)  # as in counted, for the join's sake
    before, met = met, scratch.write(met.join(classes, F.col("content") == F.col("c")).filter("border or n > 1").drop("c", "content"))
    scratch.remove(before)
    whole = met.filter("n > 1").select("doc", "version", F.col("lo").alias("from"), (F.col("hi") + length).alias("to"))
    # at borders: each content once, by the segment that stands for it
    stands = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version")) & (F.col("lo") == F.col("of_lo"))
    border = met.filter(F.col("border") & stands).select("doc", "version", "gram", "lo", "hi", "anchor", (F.col("n") == 1).alias("alone"))
    work = scratch.write(counted(with_bytes(docs, border, length), scratch))
    ranges = whole
    for size in FINER:
        ranges = ranges.unionByName(scratch.write(sorted_groups(work.filter(F.col("n") <= GROUP).drop("n"), length)))
        large = work.filter(F.col("n") > GROUP).drop("n")
        if large.isEmpty():
            return ranges
        work = scratch.write(counted(dealt_out(large, size, length), scratch))
    # strings of one start are equal if their digests are
    last = work.filter("alone").select("doc", "version", (F.col("anchor") - F.col("d0")).alias("from"), (F.col("anchor") - F.col("d0") + length).alias("to"))
    return ranges.unionByName(last)


def remove(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents with n_bytes, n_removed, n_spans, kept_sha256 and, unless told otherwise, the text that is left."""
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256")
    own = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    with Scratch(spark) as scratch:
        doc, version, spans = free_names(docs, "__doc", "__version", "__ranges")
        ranges = repeated(own, scratch, length).groupBy(F.col("doc").alias(doc), F.col("version").alias(version)).agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias(spans))
        ranges = checkpoint(ranges)
    joined = docs.join(ranges, F.col(key).cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(version)), "left").select(*docs.columns, spans)
    columns = docs.columns
    place, names, last = columns.index(text), [c for c in columns if keep_text or c != text], len(columns)

    def run(batches):
        for batch in batches:
            kept, facts = [], []
            for t, found in zip(batch.column(place).to_pylist(), batch.column(last).to_pylist(), strict=True):
                data, left, at, spans = (t or "").encode("utf-8", "surrogatepass"), [], 0, 0
                for r in found or ():
                    if r["from"] > at or not spans:
                        left.append(data[at : r["from"]])
                        spans += 1
                    at = max(at, r["to"])
                left.append(data[at:])
                rest = b"".join(left)
                kept.append(None if t is None else rest.decode("utf-8", "replace"))
                facts.append((len(data), len(data) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
            n = list(zip(*facts, strict=True)) or [[], [], [], []]
            own = [pa.array(kept, pa.string()) if c == text else batch.column(columns.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, pa.int64()) for v in n[:3]), pa.array(n[3], pa.string())], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(run, schema)
