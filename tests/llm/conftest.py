import random

import pytest

WORDS = "the of and erth onle tion reas winda kolo merat suvi lapen dorit fenna gulo haris".split()
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list:
    """Texts with copies, near copies, shared passages and lines, nulls, empty, short and long ones."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(40)]
    out: list = [None, "", " \n\t ", "one", "One two\nTHREE", "a b c d", "a b c d", "é ñ ü 日本語 🎉", prose(rng, 6000)]
    passage = prose(rng, 90)
    line = "This line is on Many pages"
    for i, t in enumerate(base):
        w = t.split()
        out.append(t)
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        if i % 4 == 0:
            out.append(t)
        if i % 5 == 0:
            out.append(prose(rng, 20) + " " + passage + " " + prose(rng, 20))
        if i % 2 == 0:
            out.append(f"{prose(rng, 9)}\n  {line.upper() if i % 4 else line}\t\n\n{prose(rng, 5)}")
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents; two rows share an id, one has none; a column's name clashes with an operator's."""
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, texts[20], "en", "a", 1), (None, texts[21], "de", None, 1)]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOC_SCHEMA).withColumn("n", F.lit(1)).withColumn("size", F.lit("x"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
