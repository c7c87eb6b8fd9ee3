"""Quality scores: statistics against plain Python, held-out labels, odd inputs."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strata.llm import quality


def plain(text):
    """The statistics by their definitions."""
    if not text:
        return [0.0] * len(quality.NAMES)
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", text.encode()) if w]
    lines = text.encode().split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    n, m, k = len(text), max(len(words), 1), max(len(lines), 1)
    share = lambda chars: sum(text.count(c) for c in chars) / n
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / m, np.log1p(max(map(len, words), default=0)), *[share(c) for c in quality.CLASSES[1:]], sum(ord(c) > 127 for c in text) / n,
        len(set(words)) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, sum(len(w) <= 3 for w in words) / m,
        sum(w[:1].isupper() for w in words) / m, sum(w[-1:] in b"!#$%&*|" for w in words) / m, np.log1p(len(lines)), len(set(lines)) / k, n / k, sum(line[-1:] in (b".", b"!", b"?") for line in lines) / k,
    ]


def test_statistics_equal_their_definitions():
    rng = random.Random(2)
    signs = list("abcAB É世 12.,!?#$|\n\n \t'\"()<")
    texts = ["", None, "one", "\n", "\n\n", "a\n", "\na", "é", "A b\nA b\n", "x" * 5000] + ["".join(rng.choice(signs) for _ in range(rng.randrange(200))) for _ in range(300)]
    np.testing.assert_allclose(quality.statistics(pa.array(texts)), [plain(t) for t in texts])
    np.testing.assert_allclose(quality.statistics(pa.array(texts).slice(7, 40)), [plain(t) for t in texts[7:47]])
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(quality.NAMES))


def corpus(rng, n):
    words = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        kind = rng.randrange(6)
        if kind == 0:
            text = [w + rng.choice(["###", "$$$", "%%%"]) for w in text]
        elif kind == 1:
            text = [text[0]] * len(text)
        rows.append((i, " ".join(text), int(kind > 1)))
    return rows


def test_quality_of_held_out_labels(spark):
    rows = corpus(random.Random(4), 900)
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("label", F.lit("clash"))
    odd = spark.createDataFrame([(5000, None), (5001, ""), (5002, "z" * 3_000_000), (None, "no id."), (1, rows[1][1])], "doc_id long, text string")
    model = quality.fit(df, df.where("doc_id < 600").select("doc_id", "quality"))
    got = {r["doc_id"]: r["score"] for r in model.score(df).collect()}
    assert all((got[i] >= 0.5) == bool(q) for i, _, q in rows if i >= 600) and all(0 <= s <= 1 for s in got.values())
    again = model.score(odd).collect()
    assert len(again) == 5 and all(0 <= r["score"] <= 1 for r in again)
    assert [r["score"] for r in again if r["doc_id"] == 1] == [got[1]]


def test_descent_equals_a_walk_through_each_tree():
    rng = np.random.default_rng(1)
    nodes = (1 << quality.DEPTH) - 1
    trees = quality.Trees(rng.integers(0, 5, (3, nodes)), rng.normal(size=(3, nodes)), rng.normal(size=(3, nodes + 1)), 0.25)
    x = rng.normal(size=(50, 5))
    want = []
    for row in x:
        total = trees.bias
        for t in range(3):
            node = 0
            while node < nodes:
                node = 2 * node + (2 if row[trees.feature[t, node]] > trees.cut[t, node] else 1)
            total += trees.leaf[t, node - nodes]
        want.append(total)
    np.testing.assert_allclose(trees.margins(x), want)


def test_quality_without_labels_or_rows(docs, none):
    labels = docs.select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert {r["score"] for r in quality.fit(docs, labels).score(docs).collect()} == {0.5}
    one = quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert {r["score"] for r in one.score(docs).collect()} == {1.0}
    assert one.score(none).count() == 0
