"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Features are densities of lexicon words (a short fixed list and one learned from
labels: whole words and word beginnings), their proximity to second-person words,
capitals, punctuation and obfuscation rates. The labelled sample is bounded
(``MAX_LABELLED`` rows, chosen by a hash of the id) and split in three: the first
part teaches the lexicon, the second the trees, the third the calibration, so no
stage grades its own work. Scoring is one pass over all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .shared import give_back, materialize, small_batches

#: Labelled rows that may teach the model, and the most learned words and word beginnings kept.
MAX_LABELLED, MAX_WORDS, MAX_BEGINNINGS = 20_000, 3_000, 500
#: A learned term appears in so many different toxic texts, and its odds there are this much higher.
MIN_TEXTS, MIN_LOG_ODDS = 4, 3.0
THRESHOLD = 0.7

INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers trash garbage scum pathetic worthless clown disgusting filthy vermin imbecile fool hate kill ugly".split())
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"\w+")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
HIDDEN = re.compile(r"[^\W_]+(?:[*@$!|._\-#]+[^\W_]+)+|[^\W\d_]+[0134578]+[^\W\d_]+")
#: Never part of an obfuscated word's first or last character.
EDGE = ".,;:?!\"'()[]{}-*"
NAMES = ["insults", "learned", "begun", "log_learned", "log_begun", "distinct", "near_you", "you", "capitals", "shouted", "punctuation", "exclamations", "obfuscated", "hidden_hits", "log_words"]
#: How far, in words, a second-person word counts as near.
NEAR = 6


def beginnings(word: str) -> tuple[str, ...]:
    return (word[:4], word[:5], word[:6]) if len(word) > 6 else (word[:4], word[:5]) if len(word) > 5 else (word[:4],) if len(word) > 4 else ()


def obfuscated(pieces: list[str]) -> list[str]:
    """What HIDDEN finds in a text, given its pieces between spaces: its matches hold no space and begin and end with a
    letter or digit, so the edges of a piece do not matter, and pieces of letters alone hold none."""
    found = []
    for piece in pieces:
        if not piece.isalpha():
            core = piece.strip(EDGE)
            if not core.isalpha():
                found += HIDDEN.findall(core)
    return found


def features(text: str, words: frozenset[str], begun: frozenset[str]) -> list[float]:
    """The dense features of one whole text; an empty text gives zeros."""
    tokens = WORD.findall(text.lower())
    n = len(tokens)
    if not n:
        return [0.0] * len(NAMES)
    fixed = sum(t in INSULTS for t in tokens)
    at = [k for k, t in enumerate(tokens) if t in words]
    starts = [t for t in tokens if t[:5] in begun or t[:4] in begun or t[:6] in begun]
    near = sum(1 for k in at if not YOU.isdisjoint(tokens[max(0, k - NEAR) : k + NEAR + 1]))
    pieces = text.split()
    hidden = obfuscated(pieces)
    opened = [re.sub(r"[\W_]+", "", h.lower().translate(LEET)) for h in hidden]
    letters = max(1, len(text))
    return [
        fixed / n, len(at) / n, len(starts) / n, math.log1p(len(at)), math.log1p(len(starts)), float(len({tokens[k] for k in at})), near / n,
        sum(t in YOU for t in tokens) / n, len(CAPITAL.findall(text)) / letters,
        sum(len(w) > 2 and w.isupper() for w in pieces) / n, sum(text.count(c) for c in ".,;:?\"'") / letters, text.count("!") / letters,
        len(hidden) / n, sum(o in words or o in INSULTS or o[:5] in begun for o in opened) / n, math.log1p(n),
    ]


def _sketch(tokens: list[str]) -> int:
    """Near copies mostly share it: two smallest word hashes."""
    return hash(tuple(sorted({xxhash.xxh3_64_intdigest(t) for t in tokens})[:2])) & (2**63 - 1)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            tokens = set(WORD.findall((text.as_py() or "").lower()))
            sketch = _sketch(list(tokens))
            rows += [(t, False, toxic, sketch) for t in tokens]
            rows += [(b, True, toxic, sketch) for b in {b for t in tokens for b in beginnings(t)}]
        kinds = [pa.string(), pa.bool_(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["term", "begun", "toxic", "sketch"])
    give_back()


def learned_lexicon(labelled: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Words and word beginnings far likelier in toxic texts; copies of one text count once."""
    totals = labelled.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_terms, "term string, begun boolean, toxic int, sketch long")
    once = rows.distinct().groupBy("term", "begun").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    odds = F.log((F.col("p") + 0.5) / ((totals["p"] or 0) + 1.0)) - F.log((F.col("n") + 0.5) / ((totals["n"] or 0) + 1.0))
    strong = once.where(f"p >= {MIN_TEXTS}").withColumn("odds", odds).where(f"odds >= {MIN_LOG_ODDS}")
    order = [F.desc(F.col("odds") * F.log1p("p")), "term"]
    words = strong.where("not begun").orderBy(*order).limit(MAX_WORDS).select("term").collect()
    begun = strong.where("begun").orderBy(*order).limit(MAX_BEGINNINGS).select("term").collect()
    return frozenset(r["term"] for r in words), frozenset(r["term"] for r in begun)


def with_features(docs: DataFrame, words: frozenset[str], begun: frozenset[str], id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, feature columns); null ids stay null, null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py() or "", words, begun) for t in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(NAMES))]
            rest = [batch.column(i) for i in range(batch.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*rest, *columns], ["doc_id", *keep, *NAMES])
        give_back()

    chosen = docs.select(F.col(id_col).cast("long"), F.col(text_col), *keep)
    schema = StructType([StructField("doc_id", LongType()), *[StructField(c, chosen.schema[c].dataType) for c in keep], *[StructField(n, DoubleType()) for n in NAMES]])
    return small_batches(chosen).mapInArrow(run, schema)


@dataclass
class ToxicityModel:
    words: frozenset[str]
    begun: frozenset[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score) of every row in one pass; texts are read whole, null as empty."""
        found = with_features(docs, self.words, self.begun, id_col, text_col)
        if self.trees is None:
            return found.select("doc_id", F.lit(self.prior).alias("score"))
        raw = _raw(self.trees, found, "doc_id")
        if self.calibration is None:
            return raw.select("doc_id", F.col("raw").alias("score"))
        return self.calibration.transform(raw).select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))

    def judge(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with ``_score``, in one pass and whatever their other columns are called."""
        names = docs.drop("_score").columns
        plain = docs.select(F.col(f"`{text_col}`").alias("_judged"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.lit(0).cast("long").alias("_none"))
        found = with_features(plain, self.words, self.begun, "_none", "_judged", ("_row",))
        if self.trees is None:
            scored = found.select("_row", F.lit(self.prior).alias("score"))
        else:
            scored = _raw(self.trees, found, "_row")
            scored = scored.withColumnRenamed("raw", "score") if self.calibration is None else self.calibration.transform(scored)
        return scored.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], F.col("score").alias("_score"))


def _raw(trees: GBTClassificationModel, found: DataFrame, *keep: str) -> DataFrame:
    vectors = VectorAssembler(inputCols=NAMES, outputCol="vector").transform(found)
    return trees.transform(vectors).select(*keep, vector_to_array("probability")[1].alias("raw"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic), of which at most ``max_labelled`` rows are used.

    Labels without an id or class are ignored; of several for one id the highest
    counts. Without both classes the score is their rate (0 without any).
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.withColumn("deal", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("deal", "doc_id").limit(max_labelled)
    chosen = chosen.select("doc_id", "toxic", F.pmod("deal", F.lit(10)).alias("deal"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = materialize(texts.join(F.broadcast(chosen), "doc_id").repartition(12, "doc_id"), "labelled")  # bounded: max_labelled rows
    counts = {(r["part"], r["toxic"]): r["count"] for r in sample.withColumn("part", F.when(F.col("deal") < 5, 0).when(F.col("deal") < 8, 1).otherwise(2)).groupBy("part", "toxic").count().collect()}
    known = sum(counts.values())
    prior = sum(v for (_, toxic), v in counts.items() if toxic) / known if known else 0.0
    if not 0 < prior < 1:
        return ToxicityModel(frozenset(), frozenset(), None, None, prior)
    words, begun = learned_lexicon(sample.where("deal < 5"))
    found = materialize(with_features(sample, words, begun, "doc_id", "text", ("toxic", "deal")), "labelled-features")
    both = lambda part: counts.get((part, 0)) and counts.get((part, 1))
    taught = found.where("deal between 5 and 7") if both(1) else found
    vectors = VectorAssembler(inputCols=NAMES, outputCol="vector").transform(taught.coalesce(4)).select("vector", F.col("toxic").cast("double").alias("label"))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.2, seed=7, subsamplingRate=1.0, maxBins=64).fit(vectors)
    if not both(2):
        return ToxicityModel(words, begun, trees, None, prior)
    held = _raw(trees, found.where("deal >= 8").coalesce(4), "toxic").select("raw", F.col("toxic").cast("double").alias("label"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(held)
    return ToxicityModel(words, begun, trees, calibration, prior)


def training_rows(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32 of the id's text modulo 3 is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
