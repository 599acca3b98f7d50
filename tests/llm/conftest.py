import random

import pytest

WORDS = "the and river stone Garden light ocean Über été señor market table window cloud seven paper".split()


def prose(rng, n):
    """n words with full stops and line ends."""
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.5) + ("." if i % 9 == 8 else ""))
    return "".join(w + ("\n" if i % 31 == 30 else " ") for i, w in enumerate(out)).strip()


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, short, long, repeated and near-equal texts."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (1, 2, 3, 9, 10, 30, 80, 200, 700)]
    near = base[7].split(" ")
    near[100] = "changed"
    rest = ["A1 b2\x1fc3\x85d4 e5 'tis it's WE'LL <|endoftext|>  two\t\ttabs\n\n\nlines ", "ΟΔΥΣΣΕΥΣ ПРИВЕТ мир 你好 👍🏽 é İstanbul", "x " * 400, "a" * 3000, "!!! ... ###", "one | two | three | four | five", "﻿mark"]
    return [None, "", " \n\t ", *base, base[6], base[6], " ".join(near), base[7] + " tail words here.", base[8] * 3, *rest]


@pytest.fixture(scope="session")
def edge_docs(spark, texts):
    """Documents with a repeated row and columns whose names clash with the operators' own."""
    rows = [(i * 7 % 101, t, ["en", "fr", None][i % 3], f"src{i % 2}", len(t or ""), "mine", -1, "w") for i, t in enumerate(texts)]
    rows.append(rows[8])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, version int, items string")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
