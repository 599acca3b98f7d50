"""Surrogates: nothing of what was found is left, types and formats stay, one entity has one surrogate."""

import re

from galena.llm import pii, registry

EMAIL, IPV4 = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d)")
OTHERS = [re.compile(p) for p in (r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(?<![\d.])\d{16}(?!\d)", r"[0-9a-f]{32,}")]


def luhn(n):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(n))) % 10 == 0


def test_planted_entities_go(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()}
    out = {r.doc_id: r for r in registry.QUERIES["op9_surrogates"](spark, sf.replace("0.001", "0.01")).collect()}
    assert out.keys() == docs.keys()
    mapping = {}
    for key, text in docs.items():
        found = [m for p in (EMAIL, IPV4, *OTHERS) for m in p.findall(text)]
        assert (out[key].n_entities == 0) == (text == out[key].text)
        if not found:
            assert out[key].text == text
        for p in (EMAIL, IPV4, *OTHERS):
            a, b = p.findall(text), p.findall(out[key].text)
            assert len(a) == len(b)
            for x, y in zip(a, b, strict=True):
                assert x != y and [len(w) for w in x.split(".")] == [len(w) for w in y.split(".")]
                assert mapping.setdefault(x.lower(), y.lower()) == y.lower()
    assert len(mapping) > 50 and len(set(mapping.values())) == len(mapping) and not set(mapping.values()) & set(mapping)


def test_formats(spark):
    rows = [
        (1, "X.y9@Mail2.example.com and x.y9@mail2.example.com, +1 (293) 555-9179 or 293-555-9179. Dr. Anna Smith met Mrs. Smith."),
        (2, 'card 4111 1111 1111 1111 and 4111111111111111; 123-45-6789 "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" DE89 3704 0044 0532 0130 00'),
        (3, "Господин Иван Петров 10.0.0.1, fe80:0:0:0:0:0:0:1"),
        (3, "Frau Petra Lang"), (4, "Herr Petra Lang"), (5, None), (6, ""), (7, "a" * 20000 + " 12 plain. The end of 3.14 and 1999-2004"), (2, "x.y9@mail2.example.com"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' as kind", "1 as core")
    out = pii.pseudonymise(df, "a key")
    assert out.columns == ["doc_id", "text", "kind", "core", "n_entities"]
    got = out.collect()
    text = {(r.doc_id, (r.text or "")[:4]): r.text for r in got}
    one, two = (next(r.text for r in got if r.doc_id == k and r.n_entities > 4) for k in (1, 2))
    a, b = EMAIL.findall(one)
    assert a.lower() == b.lower() and a.endswith(".example.com") and EMAIL.findall(next(r.text for r in got if r.doc_id == 2 and r.n_entities == 1)) == [b]
    assert "".join(re.findall(r"\d", re.search(r"\+1 (\(\d{3}\) \d{3}-\d{4})", one)[1])) == re.search(r"or (\d{3}-\d{3}-\d{4})", one)[1].replace("-", "")
    assert re.search(r"Dr\. \w+ (\w+) met Mrs\. \1\.", one) and "Smith" not in one
    c, d = re.search(r"card ([\d ]{19}) and (\d{16});", two).groups()
    assert c.replace(" ", "") == d and luhn(d) and d[0] == "4" and d != "4" + "1" * 15
    assert re.search(r"; 9\d\d-\d\d-\d{4} \"[0-9a-f]{40}\" DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d$", two)
    assert re.match(r"Господин [А-Яа-я]+н [А-Яа-я]+ \d\d\.\d\.\d\.\d, ", next(t for t in text.values() if t and t.startswith("Госп")))
    f, m = next(r.text for r in got if r.text and r.text.startswith("Frau")), next(r.text for r in got if r.text and r.text.startswith("Herr"))
    assert f.split()[1].endswith("na") and m.split()[1].endswith("n") and f.split()[2] == m.split()[2]
    same = {r.doc_id: r for r in got if r.doc_id in (5, 6, 7)}
    assert same[5].text is None and same[6].text == "" and same[7].text == rows[7][1] and same[7].n_entities == 0
    assert pii.pseudonymise(df.limit(0), "a key").count() == 0


def test_collisions_are_derived_again(spark):
    """More names than one attempt can keep apart."""
    from galena.llm.common import Scratch

    names = spark.range(3000).selectExpr("'family' as kind", "concat('n', id) as canon")
    with Scratch(spark) as scratch:
        got = pii.assign(names.union(names), scratch, "a key").collect()
    assert len(got) == 3000 and len({r.core for r in got}) == 3000


def test_a_full_shape_is_widened(spark):
    """Every address of single digits, and every email of two letters: no surrogate of the same length is free."""
    import string

    addresses = [f"{a}.{b}.{c}.{d}" for a in range(1, 10) for b in range(1, 10) for c in range(1, 10) for d in range(1, 10)]
    emails = [f"{a}@{b}.io" for a in string.ascii_lowercase for b in string.ascii_lowercase]
    phones = [f"+1 {a:02d} {b:02d} 5" + "0" for a in range(100) for b in range(0, 100, 10)]
    rows = [(i, " and ".join(x[i::40])) for i in range(40) for x in (addresses, emails, phones)]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "a key").collect()
    inputs, mapping = sorted(rows), {}
    by_first = {}
    for r in got:
        by_first.setdefault(r.doc_id, []).append(r.text)
    for key, text in inputs:
        before = text.split(" and ")
        kind = EMAIL if "@" in text else IPV4 if "." in text else None
        after = next(t for t in by_first[key] if ("@" in t) == ("@" in text) and ("+" in t) == ("+" in text)).split(" and ")
        assert len(before) == len(after)
        for a, b in zip(before, after, strict=True):
            assert kind is None or kind.fullmatch(b), b
            assert kind is not IPV4 or all(int(x) < 256 for x in b.split("."))
            mapping[a] = b
    assert len(mapping) == len(addresses) + len(emails) + len(phones)
    assert len(set(mapping.values())) == len(mapping) and not set(mapping.values()) & set(mapping)


def test_what_has_no_room_is_an_error(spark, monkeypatch):
    import pytest

    from galena.llm.common import Scratch

    monkeypatch.setattr(pii, "surrogate", lambda kind, canon, *_: canon)
    monkeypatch.setattr(pii, "ATTEMPTS", 3)
    with Scratch(spark) as scratch, pytest.raises(RuntimeError, match="family.*5"):
        pii.assign(spark.range(5).selectExpr("'family' as kind", "concat('n', id) as canon"), scratch, "a key")


def test_clashing_names_and_keys(spark):
    df = spark.createDataFrame([(1, "Ask a.b@example.com or 10.20.30.40", "x", 2, 3)], "doc_id long, text string, __row string, __Of int, __new int")
    one, same, other = (pii.pseudonymise(df, k).first() for k in ("k1", "k1", "k2"))
    assert (one["__row"], one["__Of"], one["__new"]) == ("x", 2, 3) and one.n_entities == 2
    assert one.text == same.text != other.text
    assert len(pii.session_key(spark)) == 64 and pii.session_key(spark) != pii.session_key(spark)


def test_replacement_by_brute_force(spark):
    """Each mention of an entity, found with plain patterns, is replaced, always by the same and by nothing another entity has; all else stays."""
    import random

    rng = random.Random(4)
    entities = [f"{rng.choice('abcdef')}{i}@mail{i % 7}.example.org" for i in range(40)] + [f"{rng.randrange(1, 250)}.{i}.{rng.randrange(9)}.7" for i in range(40)]
    texts = [" ".join(rng.choice([*entities, "plain", "words", "3.14", "x@", "12:30"]) for _ in range(30)) for _ in range(80)]
    out = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "a key").collect()}
    mapping = {}
    for i, text in enumerate(texts):
        before, after = text.split(" "), out[i].split(" ")
        assert len(before) == len(after)
        for a, b in zip(before, after, strict=True):
            assert (a == b) == (a not in entities) and mapping.setdefault(a, b) == b
    own = [b for a, b in mapping.items() if a in entities]
    assert len(set(own)) == len(own) and not set(own) & set(entities)
