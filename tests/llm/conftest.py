import random

import pytest

KEY = "a key for tests"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int, n: int) -> list[str]:
    """Texts with copies, near copies, shared passages and repeated lines."""
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "and", "tion", "éa", "ing"]) if r.random() < 0.5 else "".join(r.choices("abcdefgh", k=5))
    words = lambda k: " ".join(word() for _ in range(k))
    shared = [words(r.randint(20, 60)) for _ in range(5)]
    out: list[str] = []
    for _ in range(n):
        k = r.random()
        if k < 0.2 and out:
            t = r.choice(out)
        elif k < 0.4 and out:
            t = r.choice(out)
            at = r.randint(0, len(t))
            t = t[:at] + "#" + t[at + 2 :]
        else:
            t = words(r.randint(0, 80)) + "\n" + r.choice(shared) + "\n" + words(r.randint(0, 60))
        out.append(t)
    return out


ODD = ["", None, " \n\t ", "a", "a" * 900, "ab" * 400, "line of text that repeats here and there\n" * 20, "é" * 300, "<|endoftext|> x", "Á ΣΑΣ 字"]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i * 3, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts(1, 120) + ODD)]
    rows += [rows[5], (None, "no id at all", None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def clashing(df):
    """The same rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    out = df
    for c in ("fp", "key", "pos", "runs", "_runs", "ids", "kept", "component", "covered", "block", "digest", "vec", "part", "_doc", "tie", "n_pii", "_finds", "_new"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit("x"))
    return out
