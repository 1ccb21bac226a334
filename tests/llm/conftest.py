import random

import pytest

#: Columns that clash with names the operators use inside.
EXTRA = "id string, key string, rep int, n int, h string, name string, pos string, doc string, learn string, spans string, marks string, a int, b int, html string, v string, q int, score string, _key string, _id string, _text string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edit(rng, text, share):
    w = text.split(" ")
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = words(rng, 1)
    return " ".join(w)


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, and odd ones."""
    rng = random.Random(11)
    base = [words(rng, rng.randint(1, 250)) for _ in range(60)]
    out = list(base)
    for t in base[:12]:
        out += [t, edit(rng, t, 0.02), edit(rng, t, 0.08)]
    passage = words(rng, 60)
    out += [f"{words(rng, 20)}\n{passage}\n{words(rng, 20)}" for _ in range(6)]
    lines = [words(rng, 8) for _ in range(6)]
    out += ["\n".join(lines), "\n".join(lines[:3] + [words(rng, 5)] + lines[3:]), "\n".join(lines + lines), "\n".join(lines[:1])]
    out += [None, "", " ", "\n", "\n\n", "a", "A b", "a b c", "a  b\tc", "é ü ß", "x" * 700, "x" * 450, "ab" * 400, "¿qué? 中文 text", " ", words(rng, 3000), "<|endoftext|> x", "1 2 3 4"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents with clashing extra columns, a repeated row, and one without an id."""
    from pyspark.sql import functions as F

    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for c in EXTRA.split(", "):
        name, kind = c.split(" ")
        df = df.withColumn(name, F.lit("7").cast(kind))
    return df.cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
