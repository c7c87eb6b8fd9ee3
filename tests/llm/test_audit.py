"""The filter audit against a count over all orders in Python, whatever the order in which files arrive."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from strata.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, labels):
    least, marks, out = {}, {}, {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, good, toxic in labels:
        if i is not None:
            old = marks.get(i, (False, False))
            marks[i] = (old[0] or good == 1, old[1] or toxic == 1)
    facts = []
    for i, text, part in rows:
        t = text or ""
        ws = WORD.findall(t)
        fails = {f for f, test in zip("ABCD", (len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t))), strict=True) if test}
        if i is not None and i > least[t]:
            fails.add("E")
        facts.append((part or "", fails, *marks.get(i, (False, False))))
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                out[part, "".join(order), step + 1] = [len(left) - len(gone), len(gone), sum(f in x[1] and bool(x[1] & set(order[:step])) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                left = [x for x in left if f not in x[1]]
        for f in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == f)
            for key, v in out.items():
                if key[0] == part and key[1][key[2] - 1] == f:
                    v.append(total)
    return {k: tuple(v) for k, v in out.items()}


def cases():
    rng = random.Random(8)
    words = [f"word{k}" for k in range(90)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 49, 50, 70, 200, 400)]
    texts += [t.upper() for t in texts[:3]] + [texts[3] + " #1", "", None, "a\x0bb c", "É" * 80, "x " * 60, "A" + "b" * 19]
    rows = [(i, rng.choice(texts) if rng.random() < 0.7 else " ".join(rng.choice(words) for _ in range(rng.randrange(30, 90))), rng.choice(["s0", "s0", "s0", "s1", None])) for i in range(300)]
    rows += [(1000 + i, texts[4], "hot") for i in range(200)] + [(5, texts[4], "s0")] * 3 + [(None, texts[4], "s1"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1), (99_999, 1, 1)]
    rng.shuffle(rows)
    return rows, labels


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_counts_every_order(spark):
    rows, labels = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"mask": F.lit("x"), "n": F.lit(7), "good": F.lit(1)}).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = expected(rows, labels)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in audit.audit_filters(docs, marks).collect()}
    assert got == want
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in audit.audit_filters(docs, marks, batches=1).collect()}
    assert got == want


def test_audit_of_nothing(spark, docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert audit.audit_filters(docs.where("false"), labels).count() == 0
    alone = audit.audit_filters(docs, labels.where("false"))
    assert alone.where("good_lost + toxic_lost > 0").count() == 0 and alone.where("filter_order = 'ABCDE' and step = 1").agg(F.sum(F.col("kept") + F.col("removed"))).first()[0] == docs.count()


class Held:
    """A group's state, as the stream keeps it."""

    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_a_smaller_id_retracts_what_was_counted():
    import pandas as pd

    state, columns = Held(), ["key", "part", "mask", "good", "toxic", "known", "low", "at_low", "n"]
    take = lambda *rows: {tuple(r[:4]): r[4] for f in audit.update((0,), [pd.DataFrame(list(rows), columns=columns)], state) for r in f.itertuples(index=False, name=None)}
    assert take((b"t", "p", 2, 1, 0, True, 50, 1, 3)) == {("p", 2, 1, 0): 1, ("p", 18, 1, 0): 2}
    assert take((b"t", "q", 2, 0, 0, True, 60, 1, 1)) == {("q", 18, 0, 0): 1}
    assert take((b"t", "q", 2, 0, 0, True, 7, 2, 2)) == {("q", 2, 0, 0): 2, ("p", 2, 1, 0): -1, ("p", 18, 1, 0): 1}
    assert take((b"t", "q", 2, 0, 0, False, 0, 1, 1)) == {("q", 2, 0, 0): 1}  # without an id
