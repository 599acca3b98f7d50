"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus are compiled, with their ids as outputs, into an automaton that shares prefixes and
suffixes; the path of a word adds up to its number, and the number finds its ids. The automaton is mapped into memory by each Python
worker. Words it doesn't hold are merged exactly, many at a time, by the ranks of the tokenizer's merges. A word is
what white space ends, with one blank before it, or a run of white space up to the blank of the next word: byte-level BPE never merges
across these borders. Every text takes this way, whatever its script. The tokenizers library names the added tokens, and
its pre-tokenizer (not its model) cuts words that hold a character that this Python's Unicode tables don't know.

The choice of lexicon never changes a result. It is built from counts over all texts: a task reports the words of at most 64 characters that
it saw at least twice (since it last held COUNTED different ones), and the most frequent of all, at most ``lexicon_words`` (a
documented bound), are compiled on the driver. All other words are merged.

Defined cases: a null text counts as empty and has no ids; repeated rows are encoded once each; texts of any length are encoded whole,
in slices of texts, never of a text, and words without a border in LONG bytes are merged by a heap instead of in rounds; words of equal
frequency at the lexicon's limit all stay out; other columns are kept by ``encode`` (its own columns replace those of the same
name); empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import os
import re
import sys
import tempfile
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded_batches, slices

LEXICON_WORDS = 1 << 17
#: Different words that a task counts at once.
COUNTED = 1 << 19
#: Bytes from which on a piece is merged alone.
LONG = 512
#: Fixed: the characters that are white space.
BLANKS = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where white space is blanks and line feeds that stand alone, words can be told by marking the borders with a character that the text doesn't hold.
MARK = "\x00"
RUNS, OTHERS = ("  ", "\n\n", " \n", "\n "), re.compile(f"[{BLANKS.replace(chr(92) + 'n', '').replace(' ', '')}{MARK}]")
WORDS = re.compile(f"[{BLANKS}]+(?![^{BLANKS}])| ?[^{BLANKS}]+|[{BLANKS}]+")
#: Fixed: the pattern by which the vocabulary's byte-level pre-tokenizer splits text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SLICE_CHARS = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words_of(text: str) -> list[str]:
    """The words of a text; put together they are the text."""
    if any(x in text for x in RUNS) or OTHERS.search(text):
        return WORDS.findall(text)
    return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split(MARK)


@functools.lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


def unsettled(text: str) -> bool:
    """Whether it has a character that is in no class yet by this Python's tables; the library's may be newer or older."""
    return not text.isascii() and bool(unassigned()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())


# -- the automaton ------------------------------------------------------------------------------------------------


class Automaton:
    """Minimal acyclic deterministic automaton over bytes, as sorted arrays.

    edge_key: state << 8 | byte, ascending; edge_to: the state it leads to; edge_skip: how many words stand before those
    of this edge, counted from its state. The skips on a word's path add up to the word's rank.
    """

    FIELDS = (("edge_key", np.int64), ("edge_to", np.int32), ("edge_skip", np.int32), ("final", np.uint8), ("id_from", np.int64), ("ids", np.uint32))

    def __init__(self, **arrays):
        for name, _ in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, words: list[bytes], ids: list[list[int]]) -> Automaton:
        """words: sorted and distinct. Incremental construction: once a branch can get no more words, its states are
        replaced by registered ones with the same finality and edges."""
        register: dict = {}
        states: list[tuple[bool, tuple]] = []
        path: list[list] = [[False, []]]  # open states: finality, closed edges
        labels: list[int] = []

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, edges = path.pop()
                key = (final, tuple(edges))
                if (at := register.get(key)) is None:
                    at = register[key] = len(states)
                    states.append(key)
                path[-1][1].append((labels.pop(), at))

        before = b""
        for w in words:
            same = len(os.path.commonprefix((before, w)))
            close(same)
            for b in w[same:]:
                path.append([False, []])
                labels.append(b)
            path[-1][0] = True
            before = w
        close(0)
        states.append((path[0][0], tuple(path[0][1])))
        # children precede parents, so counts are ready when a state is met; the root gets number 0
        number = {len(states) - 1: 0} | {i: i + 1 for i in range(len(states) - 1)}
        size, keys, tos, skips, finals = [0] * len(states), [], [], [], np.zeros(len(states), np.uint8)
        for i, (final, edges) in enumerate(states):
            n = int(final)
            for b, to in edges:
                keys.append(number[i] << 8 | b)
                tos.append(number[to])
                skips.append(n)
                n += size[to]
            size[i] = n
            finals[number[i]] = final
        order = np.argsort(np.array(keys, np.int64))
        take = lambda x, kind: np.array(x, kind)[order]
        lengths = np.array([len(x) for x in ids], np.int64)
        return cls(edge_key=take(keys, np.int64), edge_to=take(tos, np.int32), edge_skip=take(skips, np.int32), final=finals, id_from=np.concatenate([[0], np.cumsum(lengths)]), ids=np.array([i for x in ids for i in x], np.uint32))

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, n), k).tobytes() for n, k in self.FIELDS]
        head = json.dumps([len(p) for p in parts]).encode()
        return b"".join([len(head).to_bytes(8, "little"), head.ljust(-(-len(head) // 8) * 8), *(p.ljust(-(-len(p) // 8) * 8, b"\0") for p in parts)])

    @classmethod
    def mapped(cls, data: bytes) -> Automaton:
        """Mapped from a file that has no name any more: nothing stays behind when the worker goes."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(view[:8], "little")
        at, arrays = 8 + -(-n // 8) * 8, {}
        for (name, kind), size in zip(cls.FIELDS, json.loads(view[8 : 8 + n]), strict=True):
            arrays[name] = np.frombuffer(view, kind, size // np.dtype(kind).itemsize, at)
            at += -(-size // 8) * 8
        return cls(**arrays)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for those it doesn't hold. All words go one byte ahead at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        rank, state, last = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), len(self.edge_key) - 1
        if last < 0:
            return np.full(len(words), -1)
        going = np.flatnonzero(lengths > 0)
        step = 0
        while len(going):
            key = state[going] << 8 | flat[starts[going] + step]
            at = np.minimum(np.searchsorted(self.edge_key, key), last)
            found = self.edge_key[at] == key
            state[going] = np.where(found, self.edge_to[at], -1)
            rank[going] += self.edge_skip[at]
            step += 1
            going = going[found & (lengths[going] > step)]
        ended = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(ended, rank, -1)


# -- exact merging ------------------------------------------------------------------------------------------------


class Merger:
    """The tokenizer's merges, applied to many pieces at once."""

    NONE = np.int32(1 << 30)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocab = model["vocab"]
        self.added = added = {t["content"]: t["id"] for t in whole.get("added_tokens") or []}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        shown = byte_characters()
        self.first = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        back = {c: b for b, c in enumerate(shown)}
        self.token_bytes = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            self.token_bytes[i] = token.encode()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], self.NONE)

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.pair_key.tolist(), self.pair_rank.tolist(), strict=True))

    def one(self, piece: bytes) -> np.ndarray:
        """Ids of a long piece: the pair of lowest rank, the leftmost of equals, comes from a heap."""
        tokens, pairs, merged, n = self.first[np.frombuffer(piece, np.uint8)].tolist(), self.pairs, self.merged, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := pairs.get(tokens[i] << 20 | tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue  # one of both has been merged since
            tokens[i], tokens[j], k = int(merged[r]), -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := pairs.get(tokens[x] << 20 | tokens[y])) is not None:
                    heapq.heappush(heap, (r, x, tokens[x], tokens[y]))
        return np.array([t for t in tokens if t >= 0], np.int32)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        if not any(len(p) > LONG for p in pieces):
            return self.rounds(pieces)
        alone = {i: self.one(p) for i, p in enumerate(pieces) if len(p) > LONG}
        ids, n = self.rounds([b"" if i in alone else p for i, p in enumerate(pieces)])
        for i, x in alone.items():
            n[i] = len(x)
        out, at = np.empty(int(n.sum()), np.int32), np.cumsum(n) - n
        short = np.array([i for i in range(len(pieces)) if i not in alone], np.int64)
        out[spread(at[short], n[short])] = ids
        for i, x in alone.items():
            out[at[i] : at[i] + n[i]] = x
        return out, n

    def rounds(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """In each round every piece merges all places of its pair of lowest rank, from the left, which is what merging
        them one at a time comes to."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        who = np.flatnonzero(lengths)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        counts = lengths[who]
        rank = np.full(len(tokens), self.NONE, np.int32)
        if len(tokens):
            rank[:-1] = self.rank(tokens[:-1], tokens[1:])
            rank[np.cumsum(counts) - 1] = self.NONE
        while len(who):
            starts = np.cumsum(counts) - counts
            least = np.minimum.reduceat(rank, starts)
            live = least < self.NONE
            if not live.all():
                of = np.repeat(live, counts)
                done.append((who[~live], counts[~live], tokens[~of]))
                who, counts, tokens, rank, least = who[live], counts[live], tokens[of], rank[of], least[live]
                if not len(who):
                    break
                starts = np.cumsum(counts) - counts
            hit = rank == np.repeat(least, counts)
            if (hit[1:] & hit[:-1]).any():  # in aaa, the second place overlaps the first: take every other of a run
                at = np.flatnonzero(hit)
                new = np.concatenate([[True], (np.diff(at) > 1)])
                run = np.flatnonzero(new)
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                hit[at[place % 2 == 1]] = False
            at = np.flatnonzero(hit)
            tokens[at] = self.merged[rank[at]]
            counts = counts - np.add.reduceat(hit.astype(np.int64), starts)
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            now = np.cumsum(keep) - 1
            at, tokens, rank = now[at], tokens[keep], rank[keep]
            ends = np.zeros(len(tokens), bool)
            ends[np.cumsum(counts) - 1] = True
            stale = np.zeros(len(tokens), bool)
            stale[at] = stale[at[at > 0] - 1] = True
            rank[stale & ends] = self.NONE
            inner = np.flatnonzero(stale & ~ends)
            rank[inner] = self.rank(tokens[inner], tokens[inner + 1])
        total = np.zeros(len(pieces), np.int64)
        for w, c, _ in done:
            total[w] = c
        out, begin = np.empty(int(total.sum()), np.int32), np.cumsum(total) - total
        for w, c, t in done:
            out[spread(begin[w], c)] = t
        return out, total


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable in
    Latin-1, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [chr(b) for b in range(256)], 256
    for b in range(256):
        if b not in plain:
            out[b], free = chr(free), free + 1
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


# -- a worker's encoder -------------------------------------------------------------------------------------------


class Encoder:
    def __init__(self, path: str, lexicon: bytes):
        from tokenizers import Tokenizer

        self.merger, self.lexicon = Merger(path), Automaton.mapped(lexicon)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if odd := [t.content for t in self.library.get_added_tokens_decoder().values() if t.single_word or t.lstrip or t.rstrip]:
            raise ValueError(f"added tokens that take in their surroundings: {odd}")
        self.added = self.merger.added
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")

    def pieces(self, word: str) -> list[str]:
        if unsettled(word):
            return [word[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(word)]
        return PIECES.findall(word)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, and how many each has."""
        rank = self.lexicon.ranks([w.encode() for w in words])
        held = rank >= 0
        other = np.flatnonzero(~held)
        merged, n = self.merge([words[i] for i in other])
        counts, (begin, end) = np.empty(len(words), np.int64), (self.lexicon.id_from[rank[held] + k] for k in (0, 1))
        counts[held], counts[other] = end - begin, n
        out, at = np.empty(int(counts.sum()), np.uint32), np.cumsum(counts) - counts
        out[spread(at[held], counts[held])] = self.lexicon.ids[spread(begin, end - begin)]
        out[spread(at[other], n)] = merged
        return out, counts

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As words, without the lexicon. Words are cut into pieces together, but for those that can't stand in a row."""
        odd = np.array([not w or w.isspace() or w in self.added for w in words], bool)
        if unsettled("".join(words)):
            odd |= np.array([unsettled(w) for w in words], bool)
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        tokens = PIECES.findall("\n".join(words[i] for i in plain))  # the line end is a piece of its own, for words hold none
        known = dict.fromkeys(tokens)
        cut = {int(i): [] if words[i] in self.added else self.pieces(words[i]) for i in rest}
        known.update(dict.fromkeys(chain.from_iterable(cut.values())))
        number = dict(zip(known, range(len(known)), strict=True))
        end = number.setdefault("\n", len(number))
        ids, n = self.merger.encode([p.encode() for p in number])
        begin = np.cumsum(n) - n
        flat = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        stop = flat == end
        of, flat = plain[np.cumsum(stop)[~stop]] if len(plain) else plain, flat[~stop]
        if len(rest):  # behind the others, then put in order
            more = [(i, number[p]) for i, x in cut.items() for p in x]
            of, flat = np.concatenate([of, [i for i, _ in more]]).astype(np.int64), np.concatenate([flat, [p for _, p in more]]).astype(np.int64)
            order = np.argsort(of, kind="stable")
            of, flat = of[order], flat[order]
        counts = np.bincount(of, n[flat], len(words)).astype(np.int64)
        out = ids[spread(begin[flat], n[flat])].astype(np.uint32)
        if single := [(i, self.added[words[i]]) for i in rest.tolist() if words[i] in self.added]:
            at = [i for i, _ in single]
            out = np.insert(out, (np.cumsum(counts) - counts)[at], np.array([x for _, x in single], np.uint32))
            counts[at] = 1
        return out, counts

    def parts(self, text: str) -> list[str]:
        """The words of a text and, as they are, its added tokens."""
        if not any(x in text for x in self.added):
            return words_of(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*words_of(text[at : m.start()]), m[0]]
            at = m.end()
        return out + words_of(text[at:])

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = list(map(self.parts, texts))
        number = dict.fromkeys(chain.from_iterable(split))
        number = dict(zip(number, range(len(number)), strict=True))
        ids, counts = self.words(list(number))
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64)
        begin = np.cumsum(counts) - counts
        taken = ids[spread(begin[flat], counts[flat])] if len(flat) else ids[:0]
        ends = np.concatenate([[0], np.cumsum(counts[flat])])[np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)]
        return [taken[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.merger.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str, key: str, lexicon) -> Encoder:
    return Encoder(path, lexicon.value)


# -- operators ----------------------------------------------------------------------------------------------------


def frequent_words(docs: DataFrame, n: int, text: str = "text") -> list[str]:
    """The most frequent words, at most n and as many as have the same count or none, from counts over all texts."""

    def reported(found) -> pa.RecordBatch:
        words = [(w, c) for w, c in found.items() if c > 1 and len(w) <= 64]
        return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in words], pa.string()), "n": pa.array([c for _, c in words], pa.int64())})

    def count(batches):
        from collections import Counter

        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    found.update(words_of(t))
                    if len(found) > COUNTED:
                        yield reported(found)
                        found.clear()
        yield reported(found)

    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.write(counts)
        # how many words occur how often: a row for each power of two, then one for each count in the power that is cut
        power = F.length(F.bin("n")) - 1
        taken, least = 0, 1
        for p, words in sorted(map(tuple, counts.groupBy(power.alias("p")).agg(F.count("*")).collect()), reverse=True):
            if taken + words > n:
                least = 2 << p
                if p < 24:  # counts from 2^p to 2^(p + 1), of which the largest fit
                    for c, w in sorted(map(tuple, counts.filter(power == p).groupBy("n").agg(F.count("*")).collect()), reverse=True):
                        if taken + w > n:
                            break
                        taken, least = taken + w, c
                break
            taken += words
        return [r.word for r in counts.filter(F.col("n") >= least).select("word").collect()]


def build_lexicon(words: list[str], path: str) -> bytes:
    """The automaton of these words and their ids."""
    merger = Merger(path)
    data = sorted({w.encode(): w for w in words if w and w not in merger.added and not unsettled(w)}.items())
    pieces = [[p.encode() for p in PIECES.findall(w)] for _, w in data]
    ids, n = merger.encode([p for x in pieces for p in x])
    ends, out, at = np.cumsum(n), [], 0
    for x in pieces:
        begin = ends[at - 1] if at else 0
        at += len(x)
        out.append(ids[begin : ends[at - 1] if at else 0].tolist())
    return Automaton.build([b for b, _ in data], out).to_bytes()


def encode(docs: DataFrame, path: str | None = None, text: str = "text", lexicon_words: int = LEXICON_WORDS, keep_ids: bool = False) -> DataFrame:
    """The documents with n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256
    (of the text decoded from the ids) and, if asked for, ids and decoded."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    path = path or default_vocabulary()
    data = build_lexicon(frequent_words(docs, lexicon_words, text), path)  # some MB: lexicon_words bounds it
    lexicon, key = spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()
    added = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    if keep_ids:
        added += [("ids", T.ArrayType(T.LongType()), pa.list_(pa.int64())), ("decoded", T.StringType(), pa.string())]
    docs = docs.drop(*(n for n, _, _ in added))
    names, place = docs.columns, docs.columns.index(text)

    def run(batches):
        encoder = worker_encoder(path, key, lexicon)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in slices(texts, SLICE_CHARS):
                found = encoder.texts(texts[a:b])
                decoded = [encoder.decode(x) for x in found]
                columns = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                values = [[len(x) for x in found], [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], [hashlib.sha256(t.encode()).hexdigest() for t in decoded], found, decoded]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, kind) for v, (_, _, kind) in zip(values, added, strict=False))], names=[*names, *(n for n, _, _ in added)])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k, _ in added)])
    return docs.mapInArrow(run, schema)
