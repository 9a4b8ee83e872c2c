import random

import pytest

#: Columns whose names operators use inside.
CLASHING = ["id", "batch", "part", "fp", "fp0", "node", "size", "bucket", "start", "body", "w", "p", "h", "kept", "more", "role", "label", "row", "m", "target", "sid", "digest"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def corpus(seed: int = 1, n: int = 60):
    """(doc_id, text) with copies, shared passages, mixed white space, other alphabets, nulls, empties, repeated rows and one long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["Été", "ÜBER", "naïve", "日本語", "😀", "X9", "a.b", "--"]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))
        if k % 5 == 0:
            text += "\n" + passage
        if k % 7 == 0:
            text = text.replace(" ", rng.choice(["  ", "\t", "\n", " \r\n", "\x0b"]), 5).upper()
        rows.append((k * 3 + 1, text))
    rows += [(1000 + k, rows[k][1]) for k in range(8)]  # exact copies
    rows += [(1100 + k, rows[k + 10][1] + " end") for k in range(8)]  # near copies
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "\u00a0\u2003"), (None, rows[3][1]), (None, None), rows[5], rows[5]]
    rows.append((3000, " ".join(rng.choice(words) for _ in range(20_000))))  # a long text
    rows.append((3001, "x" * 5000))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


def frame(spark, rows):
    sources = ["s1", "s2", None, "", "é"]
    full = [(i, t, "en", sources[k % 5] if k % 3 else "s1", len(t) if t else None, *["clash"] * len(CLASHING)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def framed(spark):
    """Makes a table of documents of (doc_id, text) rows."""
    return lambda rows: frame(spark, rows)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
