import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(60)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Small documents with copies, near copies, shared passages and odd cases: (doc_id, text)."""
    import random

    rng = random.Random(3)
    shared, base = prose(rng, 60), prose(rng, 200)
    rows = [(i, prose(rng, rng.randrange(5, 120))) for i in range(40)]
    rows += [(100 + i, f"{prose(rng, 20)} {shared} {prose(rng, 20)}") for i in range(6)]
    for i in range(8):
        words = base.split()
        for _ in range(i):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, base) for i in range(3)]
    rows += [(400, None), (401, ""), (402, "  \n\t "), (403, "one"), (404, "ONE"), (405, "one two three"), (406, "é ü  ñ x ☃ \U0001f600 <|endoftext|> y"), (407, prose(rng, 6000)), (-5, base.upper()), (408, "z" * 3000)]
    rows += [(None, "no id at all"), (405, "one two three")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names operators may use themselves."""
    rows = [(i, t, "en", None if k % 7 == 0 else f"s{min(k % 9, 3)}", k) for k, (i, t) in enumerate(corpus)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({"_id": F.lit(1), "chunk": F.lit("c"), "_size": F.lit(None).cast("double"), "score": F.lit(0.5), "a b": F.lit("odd")}).repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
