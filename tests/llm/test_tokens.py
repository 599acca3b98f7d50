"""Token files and BPE against the tokenizers library itself."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from galena.llm import bpe, registry, tokenpack


def library(path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def stream(rows, path):
    """The contract's rows by plain Python; rows: (doc_id, text) in order."""
    t, start, out = library(path), 0, []
    for key, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, sf, edge_docs, no_docs, tmp_path):
    path = tokenpack.default_vocabulary()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = registry.QUERIES["op2_token_files"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(stream(sorted(docs), path))
    tokenpack.write(edge_docs, at := f"file://{tmp_path}/e", partitions=3)
    got = sorted(map(tuple, tokenpack.index(spark, at).collect()))
    rows = sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=lambda r: r[0])
    assert got == sorted(stream(rows, path))
    tokenpack.write(no_docs, at := f"file://{tmp_path}/n")
    assert tokenpack.index(spark, at).count() == 0


def test_null_id_comes_first(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (None, "a b"), (-2, "z")], "doc_id long, text string")
    tokenpack.write(df, at := f"file://{tmp_path}/x", partitions=2)
    assert [(r.doc_id, r.n_tokens) for r in sorted(tokenpack.index(spark, at).collect(), key=lambda r: r.start)] == [(None, 3), (-2, 2), (3, 2)]


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5, 300, 1000)]
    data = tokenpack.shard([4, None, 6, 7, 8], docs, bits, block=64)
    (s,) = tokenpack.shards(data + b"\n")
    assert s.bits == bits and [bool(x) for x in s.null] == [False, True, False, False, False]
    assert all((s.document(i) == d).all() and len(s.document(i)) == len(d) for i, d in enumerate(docs))
    flat = np.concatenate(docs)
    for a, b in ((0, 0), (1, 2), (63, 65), (100, 900), (0, len(flat))):
        assert (s.ids(a, b) == flat[a:b]).all()
    assert len(s.payload) <= len(flat) * bits / 8 + len(s.offsets)


def test_width():
    assert [tokenpack.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65537)] == [1, 1, 2, 8, 9, 16, 17]


def digests(text, t):
    ids = t.encode(text or "", add_special_tokens=False).ids
    decoded = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe(spark, sf, edge_docs, no_docs):
    t = library(bpe.default_vocabulary())
    want = sorted((r.doc_id, *digests(r.text, t)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, registry.QUERIES["op4_bpe"](spark, sf).collect())) == want
    want = sorted((r.doc_id, *digests(r.text, t)) for r in edge_docs.collect())
    for words in (0, 20):
        got = bpe.encode(edge_docs, lexicon_words=words, keep_ids=True).collect()
        assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
        assert all(r.decoded == (r.text or "") for r in got)
    assert bpe.encode(no_docs).count() == 0


def test_automaton():
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(500)})
    a = bpe.Automaton.mapped(bpe.Automaton.build(words, [[i, i + 1] for i in range(len(words))]).to_bytes())
    assert a.ranks(words).tolist() == list(range(len(words)))
    assert a.ranks([b"", b"d", b"abcabcabcabc", b"ab" * 20]).tolist() == [-1] * 4
    # minimal: states with the same finality and edges are one
    edges = {}
    for k, to in zip(a.edge_key.tolist(), a.edge_to.tolist(), strict=True):
        edges.setdefault(k >> 8, []).append((k & 255, to))
    shapes = [(int(a.final[s]), tuple(edges.get(s, []))) for s in range(len(a.final))]
    assert len(set(shapes)) == len(shapes)
    assert bpe.Automaton.build([], []).ranks([b"x"]).tolist() == [-1]


def test_merging_overlaps():
    m, t = bpe.Merger(bpe.default_vocabulary()), library(bpe.default_vocabulary())
    rng = random.Random(5)
    words = ["a" * n for n in range(1, 40)] + ["".join(rng.choice("aabhelo ") for _ in range(30)).replace(" ", "") for _ in range(200)]
    ids, n = m.encode([w.encode() for w in words])
    cuts = np.cumsum(n)[:-1]
    assert [x.tolist() for x in np.split(ids, cuts)] == [t.encode(w).ids for w in words]


def test_frequent_words(spark):
    """The most frequent words up to the bound; of words with one count all or none."""
    texts = [" ".join(f"w{i}" for i in range(40) for _ in range(i + 2))] + ["same same other other"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    counts = {}
    for t in texts:
        for w in bpe.words_of(t):
            counts[w] = counts.get(w, 0) + 1
    for n in (0, 1, 5, 30, 1000):
        got = bpe.frequent_words(df, n)
        assert len(got) <= n
        low = min((counts[w] for w in got), default=10**9)
        assert set(got) == {w for w, c in counts.items() if c >= low and c > 1}
        above = [c for w, c in counts.items() if w not in got and c > 1]
        assert not above or len(got) + sum(c == max(above) for c in above) > n


SCRIPTS = ["“quotes” – dashes… it’s", "Привет, мир! Ёлка", "你好，世界。" * 40, "e\u0301 👍🏽 \U0001f9d1\u200d🚀", "tabs\tand  runs \n\n of\u00a0blanks\u3000 ", "\x1c\x00\x85'll 's", "a\U0001e6c0b ՘", "x" * 1500 + " " + "né" * 900]


@pytest.mark.parametrize("lexicon", [[], [" the", "Привет", " runs", "\n", "<|endoftext|>", "，"]])
def test_every_script_takes_the_automaton_and_the_merger(lexicon):
    path = bpe.default_vocabulary()
    encoder, t = bpe.Encoder(path, bpe.build_lexicon(lexicon, path)), library(path)

    class OnlyCuts:  # the library's model may not be asked
        pre_tokenizer = t.pre_tokenizer

    encoder.library = OnlyCuts()
    rng = random.Random(11)
    pieces = [*SCRIPTS, " ", "\n", "<|endoftext|>", "<|end", "it's", "12½", "٣", "ß"]
    texts = [*pieces, *("".join(rng.choice(pieces) for _ in range(6)) for _ in range(60))]
    for text, ids in zip(texts, encoder.texts(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and encoder.decode(ids) == t.decode(want, skip_special_tokens=False)


def test_long_pieces_merge_as_short_ones_do(monkeypatch):
    merger, rng = bpe.Merger(bpe.default_vocabulary()), random.Random(2)
    pieces = ["".join(rng.choice("abcdeést") for _ in range(n)).encode() for n in (1, 0, 7, 300, 40, 900)]
    monkeypatch.setattr(bpe, "LONG", 1 << 30)
    ids, n = merger.encode(pieces)
    for limit in (0, 8, 400):
        monkeypatch.setattr(bpe, "LONG", limit)
        got = merger.encode(pieces)
        assert got[0].tolist() == ids.tolist() and got[1].tolist() == n.tolist()


def test_start_follows_partitions_not_file_names(spark):
    """More files than five digits can number."""
    n = 100_001
    rows = spark.range(n).selectExpr("id as partition", "0L as shard", "id as key", "0L as first", "id % 3 as n_tokens", "0L as ids_crc32")
    more = rows.filter("partition % 10 = 0").selectExpr("partition", "1L as shard", "key", "0L as first", "1L as n_tokens", "ids_crc32")
    got = {(r.key, r.n_tokens, r.start) for r in tokenpack.placed(rows.union(more)).filter("key >= 99990").collect()}
    start = sum(i % 3 + (i % 10 == 0) for i in range(99990))
    want = set()
    for i in range(99990, n):
        want.add((i, i % 3, start))
        start += i % 3
        if i % 10 == 0:
            want.add((i, 1, start))
            start += 1
    assert got == want


def test_shards_order_files(spark, tmp_path, monkeypatch):
    """Many small shards and files, renamed so that their names sort the other way round."""
    monkeypatch.setattr(tokenpack, "SHARD_IDS", 40)
    monkeypatch.setattr(tokenpack, "FILE_SHARDS", 2)
    docs = [(i * 3 % 200 - 50, " ".join(["word", "Straße", "x9"] * (i % 7))) for i in range(200)]
    tokenpack.write(spark.createDataFrame(docs, "doc_id long, text string"), f"file://{tmp_path}/w", partitions=3)
    files = sorted(p for p in os.listdir(tmp_path / "w") if p.startswith("part-"))
    assert len(files) > 6
    os.mkdir(tmp_path / "r")
    for i, p in enumerate(files):
        os.rename(tmp_path / "w" / p, tmp_path / "r" / f"part-{99999 - i}")
    got = sorted(map(tuple, tokenpack.index(spark, f"file://{tmp_path}/r").collect()))
    assert got == sorted(stream(sorted(docs), tokenpack.default_vocabulary()))


def test_partitions_follow_the_texts():
    assert [tokenpack.partitions_for(n, 8) for n in (0, 1 << 30, 100 << 40)] == [8, 8, 409600]
