"""Token ids in bit-packed files: each id takes the fewest bits that the vocabulary needs.

A file holds shards, one after the other, each with its own length, so that a reader can go from one to the next:

    magic "GTOK0002" | u64 bytes of the shard after this field | u32 bits per id | u32 ids per block | u64 documents | u64 ids
    | u64 partition | u64 number of the shard within it | i64 doc_id of each | u8 whether the doc_id is null | u64 first id of each document, and the end
    | u64 byte offset of each block in the payload, and the end | payload: blocks, each padded to whole bytes

and ends with a line feed, which readers skip. Documents stand in ascending order of doc_id within a shard and from one
shard to the next; the order of shards is that of partition and number, whatever the files' names. A block can be unpacked alone, and
so can any run of ids. A file holds at most FILE_SHARDS shards, however many there are, for the reader takes a file as one value.

Files are written by Spark's text writer, a shard being a value, so that a lost executor's work is committed once or not
at all, on any file system; they are read by the binaryFile source.

Defined cases: a null text counts as empty (only the end id); a null doc_id stands before all others; repeated rows are
encoded once each, next to each other; rows with the same doc_id stand in the order of a hash of their texts; a text of any length is
encoded whole, and a longer one than a shard's ids is a shard of its own; other columns are ignored; an empty table gives files without shards.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, slices

MAGIC = b"GTOK0002"
END = 1
BLOCK = 1 << 14
#: A shard ends with the document that brings it to so many ids.
SHARD_IDS = 4 << 20
FILE_SHARDS = 16
#: Text of a partition, on average.
PARTITION_BYTES = 256 << 20
PACKED = 8
SLICE_CHARS = 2 << 20
RECENT_WORDS = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bits_for(n_values: int) -> int:
    return max(1, (n_values - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of fixed width, the lowest bits first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(wide.reshape(-1), bitorder="little").tobytes()


def unpack(data: np.ndarray, bits: int, start: int, n: int) -> np.ndarray:
    """n ids from the start-th on, of bytes that begin with an id."""
    if bits in (8, 16, 32):
        return data[start * bits // 8 : (start + n) * bits // 8].copy().view(f"<u{bits // 8}").astype(np.uint32)
    first, last = start * bits // 8, -(-(start + n) * bits // 8)
    flat = np.unpackbits(data[first:last], bitorder="little")[start * bits - first * 8 :][: n * bits].reshape(n, bits)
    return np.packbits(np.pad(flat, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


def shard(doc_ids: list, ids: list[np.ndarray], bits: int, block: int = BLOCK, partition: int = 0, number: int = 0) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    ends = np.cumsum([0, *map(len, ids)]).astype("<u8")
    blocks = [pack(flat[i : i + block], bits) for i in range(0, len(flat), block)]
    body = b"".join([
        struct.pack("<IIQQQQ", bits, block, len(ids), len(flat), partition, number),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array([i is None for i in doc_ids], "u1").tobytes(),
        ends.tobytes(), np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes(), *blocks,
    ])
    return MAGIC + struct.pack("<Q", len(body)) + body


class Shard:
    """Random access to a shard in memory."""

    def __init__(self, body: memoryview):
        self.bits, self.block, self.n_docs, self.n_ids, self.partition, self.number = struct.unpack_from("<IIQQQQ", body)
        at = 40
        take = lambda kind, n: np.frombuffer(body, kind, n, at)
        self.doc_ids = take("<i8", self.n_docs)
        at += 8 * self.n_docs
        self.null = take("u1", self.n_docs)
        at += self.n_docs
        self.ends = take("<u8", self.n_docs + 1)
        at += 8 * (self.n_docs + 1)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = take("<u8", n_blocks + 1)
        at += 8 * (n_blocks + 1)
        self.payload = take("u1", len(body) - at)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Any run of ids: only the blocks that hold it are unpacked."""
        out = []
        for b in range(start // self.block, -(-stop // self.block)):
            base, data = b * self.block, self.payload[int(self.offsets[b]) : int(self.offsets[b + 1])]
            a, z = max(start - base, 0), min(stop - base, self.block)
            out.append(unpack(data, self.bits, a, z - a))
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i]), int(self.ends[i + 1]))


def shards(content: bytes):
    """The shards of a file."""
    view, at = memoryview(content), 0
    while at < len(view):
        if view[at : at + 1] == b"\n":
            at += 1
            continue
        if view[at : at + 8] != MAGIC:
            raise ValueError("not a shard")
        (n,) = struct.unpack_from("<Q", view, at + 8)
        yield Shard(view[at + 16 : at + 16 + n])
        at += 16 + n


class Encoder:
    """The tokenizers library, asked once for each word that is met. White space is a border that this vocabulary's
    normaliser and pre-tokenizer never cross, so the ids of a text are those of its words."""

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from .bpe import byte_characters

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.shown = dict(enumerate(byte_characters()))
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = self.library.get_vocab_size(with_added_tokens=True)

    def learn(self, words) -> None:
        """Put the ids of distinct words into recent. A word of plain letters is one pre-token, so the library's model can be asked directly, once for
        all cases and marks that the word has."""
        recent, older, plain, tokenize = self.recent, self.older.get, self.PLAIN.fullmatch, self.model.tokenize
        met = recent.get
        for w in words:
            if (found := older(w)) is None:
                if m := plain(w):
                    low, mark = m[1].lower(), m[2]
                    if (found := met(low) or older(low)) is None:
                        shown = low if low.isascii() else low.encode().decode("latin-1").translate(self.shown)
                        recent[low] = found = array("I", [t.id for t in tokenize(shown)]).tobytes()
                    if mark:
                        found += self.ids(mark)
                else:
                    found = self.ids(w)
            recent[w] = found

    @functools.lru_cache(maxsize=1024)  # noqa: B019
    def ids(self, word: str) -> bytes:
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def text(self, text: str) -> np.ndarray:
        words = text.replace("\n", " ").split(" ")
        if len(self.recent) > RECENT_WORDS:  # words met since are kept, the rest goes at the next turn
            self.recent, self.older = {}, self.recent
        recent = self.recent
        self.learn(set(words).difference(recent))
        return np.frombuffer(b"".join(map(recent.__getitem__, words)), "<u4")


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    return Encoder(path)


def partitions_for(n_bytes: int, least: int) -> int:
    return max(least, -(-n_bytes // PARTITION_BYTES))


def write(docs: DataFrame, out: str, path: str | None = None, key: str = "doc_id", text: str = "text", end: int = END, partitions: int | None = None) -> None:
    """Encode and write. Texts are shuffled once, into ranges of doc_id, whose number follows the measured length of all texts. They are measured where the
    files that are read, if they were PACKED times as long when unpacked, would fill more partitions than the session shuffles into."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or default_vocabulary()
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if PACKED * int(str(own._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > partitions * PARTITION_BYTES:
            partitions = partitions_for(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0, partitions)

    def run(batches):
        encoder, at, number = worker_encoder(path), TaskContext.get().partitionId(), 0
        bits, keys, found, total = bits_for(encoder.size), [], [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, t in zip(ids, texts, strict=True):
                keys.append(k)
                found.append(np.append(encoder.text(t or ""), np.uint32(end)).astype(np.uint16 if bits <= 16 else np.uint32))
                total += len(found[-1])
                if total >= SHARD_IDS:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([shard(keys, found, bits, partition=at, number=number)], pa.binary())})
                    keys, found, total, number = [], [], 0, number + 1
        if keys:
            yield pa.RecordBatch.from_pydict({"value": pa.array([shard(keys, found, bits, partition=at, number=number)], pa.binary())})

    ranged = own.repartitionByRange(partitions, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    ranged.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_SHARDS).text(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: partition and shard (whose order is that of the ids), key, first (id within the shard), n_tokens and ids_crc32."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for s in shards(content.as_buffer()):
                    ends = s.ends.astype(np.int64)
                    crc = []
                    for a, b in slices_of(ends):
                        run_ids = s.ids(int(ends[a]), int(ends[b])).astype("<u4")
                        cut = ends[a : b + 1] - ends[a]
                        crc += [zlib.crc32(run_ids[cut[j] : cut[j + 1]].tobytes()) for j in range(b - a)]
                    yield pa.RecordBatch.from_pydict({
                        "partition": pa.array([s.partition] * s.n_docs, pa.int64()), "shard": pa.array([s.number] * s.n_docs, pa.int64()),
                        "key": pa.array(s.doc_ids.astype(np.int64), pa.int64(), mask=s.null.astype(bool)), "first": pa.array(ends[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                    })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "partition long, shard long, key long, first long, n_tokens long, ids_crc32 long")


def slices_of(ends: np.ndarray, n_ids: int = 1 << 20):
    """Ranges of documents that hold about n_ids ids together, or one."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + n_ids, side="right")) - 1)
        yield a, min(b, n)
        a = b


def index(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document: key, start (ids of all documents before it), n_tokens, ids_crc32, read from the files. Where each
    shard starts comes from the shards' totals: a row for each shard, not for each document, is summed up in order."""
    rows = checkpoint(read(spark, path))
    return placed(rows).withColumnRenamed("key", key)


def placed(rows: DataFrame) -> DataFrame:
    """rows: partition, shard, key, first, n_tokens, ids_crc32."""
    totals = rows.groupBy("partition", "shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("partition", "shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("partition").alias("p"), F.col("shard").alias("s"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    joined = rows.join(base, (F.col("partition") == F.col("p")) & (F.col("shard") == F.col("s")))
    return joined.select("key", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
