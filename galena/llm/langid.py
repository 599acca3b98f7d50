"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of a trigram binds (multiplies) its letters' vectors, the first
rotated twice and the second once; a text's vector bundles (adds) those of its trigrams; a language's prototype bundles
those of all its training texts. A text gets the language whose prototype has the largest cosine with its vector.

Random vectors come from a fixed seed, and all sums are of whole numbers, so results don't depend on how rows are dealt.
Training sends one vector per language and task, never trigram tables; what the driver keeps is languages x dimensions. What a
task holds at once is bounded by BLOCK numbers, besides an Arrow batch and one vector a text of a slice.

Defined cases: a null text and a text without a letter are ``und`` with score 0; training ignores rows with null
text or lang; without any training row all texts are ``und``; ties go to the language that sorts first; repeated rows count
once each; texts of any length count whole; a document with a null key isn't held out; other columns are kept by ``predict`` (its own
columns replace those of the same name); empty tables give empty results and no prototypes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices

DIMENSIONS = 1024
#: Letters share so many classes; class 0 is all that is no letter.
CLASSES = 128
SEED = 20240229
UNKNOWN = "und"
SLICE_CHARS = 1 << 20
#: Numbers of a table of texts x trigrams, or of trigrams x dimensions.
BLOCK = 1 << 21


@functools.lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """The class of each code point of the basic plane: a-z have their own, other letters are spread over the rest."""
    out = np.zeros(1 << 16, np.int32)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (CLASSES - 27)
    return out


@functools.lru_cache(maxsize=2)
def letter_vectors(dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (CLASSES, dimensions), np.int8) * 2 - 1


@functools.lru_cache(maxsize=2)
def rotated(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = letter_vectors(dimensions)
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def trigram_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    two, one, none = rotated(dimensions)
    return two[codes // (CLASSES * CLASSES)] * one[codes // CLASSES % CLASSES] * none[codes % CLASSES]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all texts and the number of their text. Runs of other characters count as one border, and each
    text stands between borders; a trigram has a letter in the middle or two letters at least."""
    table = letter_classes()
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    flat = np.concatenate([np.concatenate([p, [0]]) for p in points] or [np.empty(0, np.uint32)])
    of = np.repeat(np.arange(len(texts)), [len(p) + 1 for p in points])
    c = table[np.minimum(flat, (1 << 16) - 1)].astype(np.int64)
    # beyond the basic plane a letter has the class of its own number
    if (far := flat >= 1 << 16).any():
        found, place = np.unique(flat[far], return_inverse=True)
        c[far] = np.where([chr(x).isalpha() for x in found.tolist()], 27 + found % (CLASSES - 27), 0)[place]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
    c, of = c[keep], of[keep]
    before, after = np.concatenate([[0], c[:-1]]), np.concatenate([c[1:], [0]])
    inner = c > 0
    return ((before * CLASSES + c) * CLASSES + after)[inner], of[inner]


def bundle(texts: list[str], dimensions: int) -> np.ndarray:
    """The vector of each text, of whole numbers: texts go in blocks of bounded tables."""
    codes, of = trigrams(texts)
    out = np.zeros((len(texts), dimensions), np.float32)
    bounds, step = np.searchsorted(of, np.arange(len(texts) + 1)), 256
    for a in range(0, len(texts), step):
        b = min(a + step, len(texts))
        known, place = np.unique(codes[bounds[a] : bounds[b]], return_inverse=True)
        out[a:b] = summed(known, place, of[bounds[a] : bounds[b]] - a, b - a, dimensions)
    return out


def summed(known: np.ndarray, place: np.ndarray, of: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """The sums of the vectors of known[place] by text, of which there are n."""
    out, wide = np.zeros((n, dimensions), np.float32), max(1, BLOCK // dimensions)
    pairs, counts = np.unique(of * max(len(known), 1) + place, return_counts=True)
    text, which = np.divmod(pairs, max(len(known), 1))
    if 16 * len(pairs) >= n * len(known):  # texts share their trigrams: a dense table of counts
        order = np.argsort(which, kind="stable")
        text, which, counts = text[order], which[order], counts[order]
        wide = min(wide, max(1, BLOCK // max(n, 1)))
        for i in range(0, len(known), wide):
            a, b = np.searchsorted(which, (i, i + wide))
            table = np.zeros((n, min(wide, len(known) - i)), np.float32)
            table[text[a:b], which[a:b] - i] = counts[a:b]
            out += table @ trigram_vectors(known[i : i + wide], dimensions).astype(np.float32)
        return out
    for i in range(0, len(pairs), wide):
        part = slice(i, i + wide)
        vectors = trigram_vectors(known[which[part]], dimensions) * counts[part, None].astype(np.float32)
        first = np.flatnonzero(np.concatenate([[True], np.diff(text[part]) > 0]))
        out[text[part][first]] += np.add.reduceat(vectors, first, axis=0)
    return out


def held_out(key: Column) -> Column:
    """The documents kept out of training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of unit length from all rows given."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == name]
                codes, n = zip(*(np.unique(trigrams(mine[a:b])[0], return_counts=True) for a, b in slices(mine, SLICE_CHARS)), strict=True)
                known, place = np.unique(np.concatenate(codes), return_inverse=True)
                total = totals.setdefault(name, np.zeros(dimensions, np.int64))
                counts, wide = np.bincount(place, np.concatenate(n), len(known)), max(1, BLOCK // dimensions)
                for i in range(0, len(known), wide):
                    total += (counts[i : i + wide] @ trigram_vectors(known[i : i + wide], dimensions).astype(np.float64)).astype(np.int64)
        for name, total in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * dimensions, pa.string()), "at": pa.array(np.arange(dimensions), pa.int32()), "value": pa.array(total, pa.int64())})

    sums = own.mapInArrow(count, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x dimensions numbers
        out.setdefault(r.lang, np.zeros(dimensions))[r["at"]] = r.value
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dimensions: int = DIMENSIONS, lettered_only: bool = False) -> DataFrame:
    """The documents with lang_pred and score, the cosine cut to 0..1; perhaps only those whose text has a letter."""
    bounded_batches(docs.sparkSession)
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), dimensions)
    docs = docs.drop("lang_pred", "score")
    columns, place = docs.columns, docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in slices(texts, SLICE_CHARS):
                v = bundle(texts[a:b], dimensions)
                norm = np.linalg.norm(v.astype(np.float64), axis=1)
                cosine = (v @ matrix.T).astype(np.float64) / np.maximum(norm, 1e-12)[:, None] if names else np.zeros((b - a, 1))
                best, some = cosine.argmax(axis=1), (norm > 0) & bool(names)
                langs = [names[i] if s else UNKNOWN for i, s in zip(best, some, strict=True)]
                score = np.where(some, np.clip(cosine.max(axis=1), 0, 1), 0.0)
                out = pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(columns))), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])
                yield out.filter(pa.array([any(map(str.isalpha, t)) for t in texts[a:b]], pa.bool_())) if lettered_only else out

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)
