import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, _h int, keep_id string, words string"


def table(spark, texts, sources=None, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    rows = []
    for k, t in enumerate(texts):
        doc = k if ids is None else ids[k]
        rows.append((doc, t, None, sources[k] if sources else None, None if t is None else len(t), 1, "x", 2, "y", "z"))
    return spark.createDataFrame(rows, KINDS)


@pytest.fixture(scope="session")
def make(spark):
    return lambda *a, **k: table(spark, *a, **k)


@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, empty and blank ones, exact and near copies, shared passages and one very long text."""
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    base = [text(rnd.randint(1, 120)) for _ in range(40)]
    passage = text(60)
    near = base[5].split()
    out = [*base, None, "", " \t\n", "A", "a", base[3].upper(), base[3], base[3]]
    out += [f"{text(20)} {passage} {text(15)}" for _ in range(6)]
    out += [" ".join(near[:k] + ["zz"] + near[k + 1 :]) for k in range(0, min(len(near), 30), 3)]
    out += [text(20_000), "é ü ñ " * 30, "same " * 200, passage]
    return out
