"""Operators against brute force on a small corpus with nulls, empty and long texts, ties, repeated rows, odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strata.llm import ann, components, fingerprint, jaccard, lines, lm, mixing, packing, settree, substring, toxicity, warc
from strata.llm.textkit import Words, string_buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


def known(corpus):
    return [(i, t or "") for i, t in corpus if i is not None]


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_words_are_runs_of_other_bytes():
    import pyarrow as pa

    texts = ["a b c\x0bd", None, "", " x ", "no", "é\x1cé z"]
    words = Words(*string_buffers(pa.array(texts)))
    got = [[words[k].decode() for k in range(words.first[i], words.first[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    assert len({int(h) for h in words.hash}) == len({words[k] for k in range(len(words.hash))})


def test_window_hashes_agree_across_places():
    import pyarrow as pa

    w = Words(*string_buffers(pa.array(["a b c d e f", "x y c d e", "c d"])))
    hashed, inside = w.windows(3)
    assert hashed[2] == hashed[8] and inside[2] and inside[8]
    assert not inside[5] and not inside[11]


# --- 1 ------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_generalises(spark):
    import random

    rng = random.Random(1)
    mean, fine = ["gorfen", "blikzom", "gorfet"], [f"word{k}" for k in range(400)]
    rows = []
    for i in range(900):
        text = [rng.choice(fine) for _ in range(rng.randrange(15, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(mean))
        rows.append((i, " ".join(text), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("_row", F.lit(1))
    model = toxicity.fit(df, df.where("doc_id < 700").select("doc_id", "toxic"))
    got = {r["doc_id"]: r["score"] for r in model.score(df).collect()}
    held = [(got[i], t) for i, _, t in rows if i >= 700]
    assert all((s >= 0.7) == bool(t) for s, t in held) and all(0 <= s <= 1 for s in got.values())
    judged = model.judge(df)
    assert judged.columns == ["doc_id", "text", "toxic", "_row", "_score"] and judged.count() == 900


def test_toxicity_without_labels_or_rows(docs, none):
    labels = docs.select("doc_id", F.lit(None).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    assert {r["score"] for r in model.score(docs).collect()} == {0.0}
    assert model.score(none).count() == 0
    assert toxicity.features("", frozenset(), frozenset()) == [0.0] * len(toxicity.NAMES)


def test_obfuscated_words_are_those_of_the_pattern():
    rng = np.random.default_rng(3)
    signs = list("aZé世01357_*@$!|.-#,;:?'\"()[]\n \t\u00a0\x1c\u0660²")
    for k in range(3000):
        text = "".join(rng.choice(signs, rng.integers(0, 60)))
        assert toxicity.obfuscated(text.split()) == toxicity.HIDDEN.findall(text)


# --- 2 ------------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_gapless(docs, corpus, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack_documents(docs, TOKENIZER).collect()
    got = Counter()
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 1024 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        got[(r["doc_id"], r["piece"], r["start"], tuple(ids.tolist()))] += 1
    expected = Counter()
    for i, t in corpus:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at, piece = 0, 0
        while at < len(ids):
            n = (len(ids) - at - 1) % 1024 + 1
            expected[(i, piece, at, tuple(ids[at : at + n]))] += 1
            at, piece = at + n, piece + 1
    assert got == expected
    placed = {}
    for r in rows:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in placed.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r["length"] for r in rows)
    assert len(placed) <= 1.05 * math.ceil(total / 1024) + 1
    assert packing.pack_documents(none, TOKENIZER).count() == 0


def by_hand(counts, length=1024):
    """Sequences that best fit needs, one piece after another."""
    import bisect

    gaps, used = [], 0
    for size in sorted(Counter(counts).elements(), reverse=True):
        at = bisect.bisect_left(gaps, size)
        used += at == len(gaps)
        gap = length if at == len(gaps) else gaps.pop(at)
        bisect.insort(gaps, gap - size)
    return used


@pytest.mark.parametrize("counts", [{1024: 3, 700: 5, 400: 4, 300: 9, 24: 40, 1: 100}, {1: 5000}, {513: 40}, {k: 2 for k in range(1, 1025)}, {340: 31, 341: 31, 343: 31}])
def test_rounds_place_all_ranks_about_as_well_as_best_fit(spark, counts):
    plan = packing.best_fit(spark.createDataFrame(list(counts.items()), "length long, count long")).collect()
    for size, n in counts.items():
        ranks = sorted(r for p in plan if p["length"] == size for r in range(p["low"], p["high"]))
        assert ranks == list(range(n))
    spans = {}
    for p in plan:
        for k in range(p["high"] - p["low"]):
            spans.setdefault(p["first"] + k // p["per"], []).append((p["offset"] + k % p["per"] * p["length"], p["length"]))
    for held in spans.values():
        end = 0
        for offset, size in sorted(held):
            assert offset == end
            end += size
        assert end <= 1024
    assert len(spans) <= by_hand(counts) * 1.01 + 1


def test_sweeps_of_ranges_agree_with_one(spark):
    """Runs that several ranges share meet in the second sweep: the placements are those of a single sweep."""
    import random

    rng = random.Random(5)
    rows, first = [], 0
    for size in rng.sample(range(1, 1025), 300):
        if rng.random() < 0.5:
            rows.append({"kind": packing.PIECES, "size": size, "low": 0, "high": rng.randrange(1, 60)})
        else:
            rows.append({"kind": packing.GAPS, "size": size, "first": first, "number": rng.randrange(1, 60)})
            first += rows[-1]["number"]
    names = [x.split()[0] for x in packing._RUNS.split(", ")]
    got = packing.one_round(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], packing._RUNS), 1024).collect()
    expected = packing.sweep(sorted(rows, key=lambda r: (r["size"], r["kind"])), 1024)

    def placed(found):
        return sorted((r["size"], r["low"] + k, r["first"] + k // r["per"]) for r in found if r["kind"] == packing.PLACED for k in range(r["high"] - r["low"]))

    assert placed([r.asDict() for r in got]) == placed(expected)


# --- 3 ------------------------------------------------------------------------------------------------------------


def removed(corpus, window):
    low = {}
    for i, t in known(corpus):
        w = WORD.findall(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            low[key] = min(low.get(key, i), i)
    out = Counter()
    for i, t in known(corpus):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if low[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    return out


@pytest.mark.parametrize("window", [13, 5, 50])
def test_substring_removal(docs, corpus, none, window):
    got = Counter(tuple(r) for r in substring.remove_repeats(docs, window).collect())
    assert got == removed(corpus, window)
    assert substring.remove_repeats(none, window).count() == 0


def test_levels():
    assert substring.lengths(13) == [7, 13] and substring.lengths(50) == [7, 13, 25, 50] and substring.lengths(4) == [4]


# --- 4 ------------------------------------------------------------------------------------------------------------


def test_lm_counts_and_gain(docs, corpus, none):
    got = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    tokens = [(i, [*WORD.findall(t.translate(LOW)), None]) for i, t in known(corpus)]
    count = Counter()
    for i, w in tokens:
        if zlib.crc32(str(i).encode()) % 10:
            count.update(w)
    n, v = sum(count.values()), len(count)
    for i, w in tokens:
        r = got[i]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] <= 0
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert lm.score_documents(none).count() == 0
    alone = lm.score_documents(docs, lambda i: True).collect()
    assert {r["base_score"] for r in alone} == {0.0}


def test_bloom_filter_reads_counts_back():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**64, 20000, dtype=np.uint64))
    counts = rng.integers(1, 500, len(keys))
    assert lm.segment(keys, counts, 1 << 26)[1] == 2
    filt = lm.Filter(8, {b: lm.segment(keys[(keys >> np.uint64(61)) == b], counts[(keys >> np.uint64(61)) == b], 1 << 23)[0].tobytes() for b in range(8)})
    got = filt.counts(keys)
    expected = lm.count_of(lm.level(counts))
    assert (got >= expected).all() and (got == expected).mean() > 0.9
    assert (expected[counts >= 2] <= counts[counts >= 2]).all()
    small, raised = lm.segment(keys, counts, 1 << 16)
    assert len(small) * 8 <= (1 << 16) + 64 and raised > 2


def test_what_the_driver_gets_of_the_language_model_does_not_follow_the_buckets(spark, monkeypatch):
    """4,096 buckets: sums reach the driver as one row a place, segments within the bound, and sparse filters answer alike."""
    from strata.llm.chunks import pack

    collected = []
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "collect", lambda self, f=kind.collect: collected.append(f(self)) or collected[-1])
    bits = {b: lm.segment_bits(b, 4096, 1 << 16) for b in range(4096)}
    assert sum(v > 0 for v in bits.values()) == 64 and sum(bits.values()) <= 1 << 16 and min(v for v in bits.values() if v) == 1024
    assert lm.segment_bits(3, 8, 1 << 20) == 1 << 17
    rows = [(b, pack(np.full(2 if bits[b] else 0, b % 7 + 1, np.uint8), np.array([1.0, b]))) for b in range(4096)]
    df = spark.createDataFrame(rows, "bucket int, body binary").repartition(7)
    assert lm.summed(df, 1, 2).tolist() == [4096.0, sum(range(4096))] and lm.summed(df.where("false"), 1, 2).tolist() == [0.0, 0.0]
    held = lm.segments_of(df)
    assert {b: len(x) for b, x in held.items()} == {b: 2 for b, v in bits.items() if v}
    assert sum(len(c) for c in collected) <= 2 + 64
    rng = np.random.default_rng(2)
    keys, counts = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2)), 5
    some = {b: lm.segment(keys[(keys >> np.uint64(60)) == b], np.full(((keys >> np.uint64(60)) == b).sum(), counts), 1 << 16)[0].tobytes() for b in (2, 9)}
    got = lm.Filter(16, some).counts(keys)
    inside = np.isin((keys >> np.uint64(60)).astype(int), (2, 9))
    assert (got[~inside] == 0).all() and (got[inside] >= 5).all()


def test_lm_scores_do_not_depend_on_the_filters_bound(docs):
    whole, least = ({(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score_documents(docs, **more).collect()} for more in ({}, {"max_bits": 1 << 9}))
    assert whole == pytest.approx(least, rel=1e-12)


def test_lm_scores_against_brute_force(docs, corpus):
    """Every training gram counts, those seen once too."""
    texts = [(i, [*WORD.findall(t.translate(LOW)), None]) for i, t in known(corpus)]
    one, two, three = Counter(), Counter(), Counter()
    for i, w in texts:
        if not lm.tenth(i):
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))

    steps = [1, 2, 3, *((4 + k) << j for j in range(30) for k in range(4)), math.inf]

    def held(n):
        return max((x for x in steps if x <= n), default=0)

    def most(n):
        return min(x for x in steps if x > n) - 1

    def kind(word):
        return min(31, int(2 * math.log2(max(1, one[word]))) + 1)

    def off(counts):
        n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2)

    def weights(counts):
        kept, number = Counter(), Counter()
        for gram, c in counts.items():
            kept[kind(gram[-2])] += held(c)
            number[kind(gram[-2])] += 1
        return {k: min(1 - off(counts) * number[k] / kept[k], 0.999) for k in kept}

    seen2, seen3 = weights(two), weights(three)
    total, distinct, expected, once = sum(one.values()), len(one), Counter(), 0
    for i, w in texts:
        score = 0.0
        for k, x in enumerate(w):
            p = (one[x] + 0.1) / (total + 0.1 * (distinct + 1))
            if k and one[w[k - 1]]:
                s = seen2.get(kind(w[k - 1]), 0)
                p = s * held(two[w[k - 1], x]) / one[w[k - 1]] + (1 - s) * p
            if k > 1 and two[w[k - 2], w[k - 1]]:
                s = seen3.get(kind(w[k - 1]), 0)
                p = s * held(three[w[k - 2], w[k - 1], x]) / most(held(two[w[k - 2], w[k - 1]])) + (1 - s) * p
            once += lm.tenth(i) and k > 0 and two[w[k - 1], x] == 1
            score += math.log10(p)
        expected[(i, len(w), round(score, 6))] += 1
    got = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in lm.score_documents(docs).collect())
    assert once > 0 and [r[:2] for r in sorted(got.elements())] == [r[:2] for r in sorted(expected.elements())]
    assert [r[2] for r in sorted(got.elements())] == pytest.approx([r[2] for r in sorted(expected.elements())], abs=2e-6)


def test_lm_probabilities_sum_to_one_at_most(spark):
    """All texts of up to three words are given, so the sums over what follows each word, or pair, are known."""
    import itertools

    words = ["a", "b", "c", "d", "new"]
    train = ["a b", "a b", "a b c", "a c", "b c d", "b a", "a b c", "d d d", "c a b"] + ["a d"] * 9 + [f"b u{k}" for k in range(16)] + ["c x1 y", "c x2 y"] * 8
    texts = [" ".join(w) for n in range(4) for w in itertools.product(words, repeat=n)]
    rows = [*enumerate(train), *((1000 + k, t) for k, t in enumerate(texts))]
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), lambda i: i >= 1000).collect()}
    p = {t: 10 ** got[1000 + k] for k, t in enumerate(texts)}
    assert sum(p.values()) < 1
    count = Counter(w for t in train for w in [*t.split(), None])
    total, distinct = sum(count.values()), len(count)
    for first in words:
        start = (count[first] + 0.1) / (total + 0.1 * (distinct + 1))
        assert sum(v for t, v in p.items() if t.split()[:1] == [first]) <= start * (1 + 1e-9)
    assert lm.count_of(lm.level(np.array([1, 2, 3, 4, 7, 9, 11, 1000]))).tolist() == [0, 2, 3, 4, 7, 8, 10, 896]
    assert lm.ceiling(np.array([1.0, 2, 7, 8, 896])).tolist() == [1, 2, 7, 9, 1023]


# --- 5 ------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>é</p>" * 40, "y" * 100
    rows = [(3, "http://a/\r\nx", big), (1, None, big), (2, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", other), (9, "u", big), (8, "u\r\n\r\n", "a\r\n\r\nb" * 50), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = {r["page_id"]: r for r in warc.read_records(index).collect()}
    for i, url, html in rows:
        data = (html or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["url"]) == (len(data), hashlib.sha256(data).hexdigest(), url)
        lead = 1 if html == big and i != 1 else None
        assert (r["record_type"], r["refers_to"]) == (("revisit", lead) if lead else ("response", None))
        assert r["payload"] == (None if lead else data)
    some = warc.read_records(index.where("page_id in (2, 8)")).collect()
    assert sorted(r["page_id"] for r in some) == [2, 8]
    assert warc.read_records(warc.write_archives(pages.where("false"))).count() == 0
    import gzip

    whole = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").iterdir() if f.suffix == ".gz")
    assert whole.count(b"WARC/1.1\r\n") >= len(rows)


def test_warc_of_repeated_rows_hot_payloads_and_a_folder_without_scheme(spark, tmp_path):
    """Every record has an id of its own, one payload may be a third of all rows, and a plain folder is Spark's own."""
    hot = "<p>hot</p>" * 30
    rows = [(i, f"http://h/{i}", hot if i % 3 == 0 else f"{i % 40}" * 100) for i in range(300)] + [(7, "http://h/7", "7" * 100)] * 3 + [(None, "n", hot), (None, "n", "short"), (None, "n", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    assert warc.qualified(spark, str(tmp_path)).startswith("file:/")
    index = warc.write_archives(pages, f"{tmp_path}/w")
    assert index.where("archive not like 'file:/%'").isEmpty() and index.count() == len(rows)
    least = {}
    for i, _, html in rows:
        if i is not None:
            least[html] = min(i, least.get(html, i))
    want = Counter((i, None if len(h) < 100 or least[h] == i else least[h], hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows)
    assert Counter((r["page_id"], r["refers_to"], r["payload_digest"]) for r in warc.read_records(index).collect()) == want
    import gzip

    whole = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").iterdir() if f.suffix == ".gz")
    ids = re.findall(rb"WARC-Record-ID: (<urn:uuid:[-0-9a-f]{36}>)\r\n", whole)
    assert len(ids) == len(set(ids)) == whole.count(b"WARC/1.1\r\n") and b"WARC-Refers-To-Target-URI: http://h/0\r\n" in whole


# --- 6 ------------------------------------------------------------------------------------------------------------


def test_mixing_reaches_weights_and_is_reproducible(spark, docs, none):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("source"))
    got = mixing.mix_sources(df, {"big": 0.2, "s1": 0.7, "s2": 0.1}).groupBy("source").count().collect()
    share = {r["source"]: r["count"] / 6000 for r in got}
    assert share == pytest.approx({"big": 0.2, "s1": 0.7, "s2": 0.1}, abs=0.04)
    once = mixing.mix_sources(docs)
    assert once.columns == [*docs.columns, "_copy", "_rate", "_place"]
    assert once.exceptAll(mixing.mix_sources(docs.repartition(7))).isEmpty()
    assert mixing.mix_sources(none).count() == 0
    places = [r["_place"] for r in once.collect()]
    assert places == sorted(places)


def test_poisson_tables_and_large_means(spark):
    row = spark.range(1).select(mixing.poisson_table(F.lit(3.0)).alias("c")).first()["c"]
    assert row[2] == pytest.approx(sum(math.exp(-3) * 3**k / math.factorial(k) for k in range(3)))
    df = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("s").alias("source"))
    n = mixing.mix_sources(df, total=30 * 3 * 1000.0).count()
    assert n == pytest.approx(30_000, rel=0.02)


# --- 7 ------------------------------------------------------------------------------------------------------------


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 24))
    for k in range(120):
        x[200 + k] = x[k] + rng.standard_normal(24) * rng.choice([0.02, 0.3, 0.45])
    x[350:] = x[0]
    rows = [(i, [float(v) for v in x[i].astype(np.float32)]) for i in range(400)]
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [1.0] * 23 + [float("nan")]), (504, [1.0] * 23 + [float("inf")]), (505, [1.0] * 12), (506, [None] + [1.0] * 23)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit("x"))
    got = {r["vec_id"]: r for r in ann.near_duplicates(df).collect()}
    y = x.astype(np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    links = y @ y.T >= 0.9
    true = {i: int(links[i].sum()) - 1 for i in range(400)}
    assert all(got[i]["n_links"] <= true[i] for i in true)
    assert sum(got[i]["n_links"] for i in true) >= 0.95 * sum(true.values())
    for i in range(500, 507):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[399]["component_id"] == 0 and ann.near_duplicates(df.where("false")).count() == 0


def test_vectors_recall_by_bands_of_cosine(spark):
    rng = np.random.default_rng(9)
    x = ann.unit(rng.standard_normal((10_000, 48)))
    low = np.repeat([0.901, 0.92, 0.95], 1000)
    cosine = low + rng.random(3000) * 0.018
    away = rng.standard_normal((3000, 48))
    away = ann.unit(away - (away * x[:3000]).sum(1, keepdims=True) * x[:3000])
    x[5000:8000] = cosine[:, None] * x[:3000] + np.sqrt(1 - cosine**2)[:, None] * away
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(10_000), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in ann.near_duplicates(df).collect()}
    for band in (0.901, 0.92, 0.95):
        pairs = np.flatnonzero(low == band)
        assert np.mean([got[5000 + k]["component_id"] == k and got[k]["n_links"] == 1 for k in pairs]) >= 0.95
    assert sum(r["n_links"] for r in got.values()) <= 6000


def test_vectors_dense_groups_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 16))
    x[:500] = x[0] + 0.05 * rng.standard_normal((500, 16))  # one group, all linked, over many blocks
    x[500:520] = x[499]
    ids = np.arange(700)
    ids[690:] = 600  # an id of several vectors
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    rows = ann.near_duplicates(df).collect()
    assert sorted(r["vec_id"] for r in rows) == sorted(ids.tolist())
    assert {(r["n_links"], r["component_id"]) for r in rows if r["vec_id"] < 520} == {(519, 0)}
    assert [tuple(r) for r in rows if r["vec_id"] == 600] == [(600, 0, 600, True)] * 11
    codes = ann.coded(df.where("vec_id < 500").select(F.col("vec_id").alias("rep"), F.lit(16).alias("dim"), F.lit(1).cast("long").alias("members"), F.lit(x[0].tobytes()).alias("vector")), 6, 4)
    found = ann.linked(codes, 6, 4, 500, 0.9)
    assert found.agg(F.sum("others")).first()[0] == 500 * 499 and found.count() <= 500 * 16


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    dim = 64
    o, q = ann.unit(rng.standard_normal((2, dim)))
    found = []
    for k in range(300):
        r = ann.rotations(dim, 1, seed=1000 + k)[0]
        a, b = o @ r, q @ r
        found.append((np.sign(a) @ b) / math.sqrt(dim) / (np.abs(a).sum() / math.sqrt(dim)))
    assert np.mean(found) == pytest.approx(o @ q, abs=0.02)


# --- 8 ------------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = WORD.findall(text.translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            common = len(s & t)
            if s and t and 100 * common >= 75 * (len(s) + len(t) - common):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(parent, i)) for i, s in sets)


def test_jaccard_components(docs, corpus, none):
    got = Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect())
    assert got == expected_components(known(corpus))
    assert jaccard.jaccard_components(none).count() == 0


def test_large_clusters_are_dealt_over_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(settree, "BLOCK", 10)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(80)] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    got = Counter(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == expected_components(rows)


def test_components_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "SMALL", 0)
    edges = [(k, k + 1) for k in range(20)] + [(30, 31), (31, 31), (40, 40), (50, 45), (45, 52)]
    got = {tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(21)} | {(30, 30), (31, 30), (40, 40), (45, 45), (50, 45), (52, 45)}


# --- 9 ------------------------------------------------------------------------------------------------------------


def half_edited_by_hand(rows):
    """(id, characters, sha256 of the edited text, equal to edited, equal to next) of rows in their order."""
    out = Counter()
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        same, following = (float(fingerprint.canonical(text) == fingerprint.canonical(t)) for t in (edited, after))
        out[(i, len(text), hashlib.sha256(edited.encode()).hexdigest(), same, following)] += 1
    return out


def test_half_edited(spark, docs, corpus, none):
    got = fingerprint.half_edited(docs).collect()
    # rows that share an id follow each other by the hash Spark gives their texts
    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    rows = sorted(corpus, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == half_edited_by_hand([(i, t or "") for i, t in rows])
    assert all((r["fingerprint"] == r["edited_fingerprint"]) == (r["near_edited"] == 1) for r in got)
    one = {r["doc_id"]: r["fingerprint"] for r in got}
    assert one[300] == one[301] == one[-5] != one[201]
    assert fingerprint.half_edited(none).count() == 0
    assert fingerprint.half_edited(docs.where("doc_id = 100")).first()["near_next"] == 1


def test_edited_texts_are_compared_by_bytes(spark, monkeypatch):
    """With a digest that makes all texts of one length collide, only equal bytes share a fingerprint, edited or not."""
    from pyspark import cloudpickle

    class Weak:
        @staticmethod
        def xxh3_128_hexdigest(data):
            return f"{len(data):032x}"

    monkeypatch.setattr(fingerprint, "xxhash", Weak)
    cloudpickle.register_pickle_by_value(fingerprint)
    try:
        rows = [(9, "aaaa"), (8, "bbbb"), (7, "aabb"), (6, "cccc"), (5, "x"), (4, "ccc"), (3, "cccccc"), (2, "dd")]
        got = fingerprint.half_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(fingerprint)
    texts = dict(rows)
    order = [i for i, _ in rows]
    printed = {}
    for r in got:
        text = texts[r["doc_id"]]
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[order[(order.index(r["doc_id"]) + 1) % len(order)]][:half]
        for t, f in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert printed.setdefault(t, f) == f
    assert len(set(printed.values())) == len(printed)


def test_groups_and_collisions(spark, docs, corpus, monkeypatch):
    got = {r["doc_id"]: r["group_id"] for r in fingerprint.fingerprint_groups(docs).collect() if r["doc_id"] is not None}
    first = {}
    for i, t in known(corpus):
        key = fingerprint.canonical(t)
        first[key] = min(first.get(key, i), i)
    assert got == {i: first[fingerprint.canonical(t)] for i, t in known(corpus)}
    # widening splits a bucket whose members differ
    found = spark.createDataFrame([("same", "x"), ("same", "y"), ("else", "z")], "fingerprint string, second string")
    clash = spark.createDataFrame([("same",)], "fingerprint string")
    assert fingerprint.settled(found, clash, [("fingerprint", "second")]).select("fingerprint").distinct().count() == 3


# --- 10 -----------------------------------------------------------------------------------------------------------


def test_lines(spark):
    long = "this is a rather long line that many documents repeat word for word"
    near = "this is a rather long line that many documents repeat word for werd"
    rows = [(1, f"{long}\nown line number one of the first document\nshort"), (2, f"short\n{near}\nanother quite different line stands here"), (3, f"{long}\n{long}"), (4, None), (5, ""), (6, f"\n\n{long.upper()}\n"), (7, "x" * 5000), (8, "ü" * 30), (None, long), (9, f"tail\r\n{long}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"c0": F.lit("mine"), "source": F.lit(None).cast("string"), "chunk": F.lit(1)})
    out = lines.dedup_lines(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_removed"]
    got = {r["doc_id"]: (r["text"], r["_n_lines"], r["_n_removed"], r["c0"]) for r in out.collect()}
    assert got == {
        1: (rows[0][1], 3, 0, "mine"), 2: ("short\nanother quite different line stands here", 3, 1, "mine"), 3: ("", 2, 2, "mine"), 4: ("", 1, 0, "mine"), 5: ("", 1, 0, "mine"),
        6: ("\n\n", 4, 1, "mine"), 7: ("x" * 5000, 1, 0, "mine"), 8: ("ü" * 30, 1, 0, "mine"), None: (long, 1, 0, "mine"), 9: ("tail\r", 2, 1, "mine"),
    }
    assert lines.dedup_lines(df.where("false")).count() == 0


def test_short_lines_and_single_characters(spark):
    near = "single inner letters differ in this short line"
    rows = [(1, f"menu\n \n\nok\n{near}"), (2, f"MENU\n \n\nno\n{near.replace('differ', 'diffor')}"), (3, "x\nx\nmenus")]
    got = {r["doc_id"]: (r["text"], r["_n_removed"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=1).collect()}
    assert got == {1: (rows[0][1], 0), 2: (" \n\nno", 2), 3: ("x\nmenus", 1)}


def test_line_recall_against_brute_force(spark):
    """Pairs of lines by their similarity, in the operator's own shingles: most at the threshold and all well above it."""
    import random

    rng = random.Random(6)
    rows, like = [], {}
    for k in range(400):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(40)]
        other = list(base)
        for at in rng.sample(range(40), rng.randrange(1, 6)):
            other[at] = f"{rng.choice('ijkl')}{rng.randrange(5000)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        a, b = ({t[j : j + lines.SHINGLE] for j in range(len(t) - lines.SHINGLE + 1)} for _, t in rows[-2:])
        like[2 * k + 1] = len(a & b) / len(a | b)
    got = {r["doc_id"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["_n_removed"]}
    assert got <= {i for i, x in like.items() if x >= 0.75}
    near, above = ({i for i, x in like.items() if low <= x < high} for low, high in ((0.75, 0.8), (0.8, 1.01)))
    assert len(near) > 20 and len(above) > 50
    assert len(got & near) >= 0.93 * len(near) and len(got & above) >= 0.985 * len(above)


def test_repeated_rows_keep_one_copy_of_a_line_and_blank_lines_stay(spark):
    rows = [(1, "a line that is held by rows of the same id")] * 3 + [(2, " " * 30 + "\n   \n\nthe only other words of this document"), (3, " " * 30 + "\n\t\t\t\n" + "\u00e9" * 40)]
    for min_chars in (1, 24):
        for width in (1, 5):
            out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(width), min_chars=min_chars).collect()
            assert sorted((r["doc_id"], r["text"], r["_n_removed"]) for r in out) == sorted([(1, "", 1), (1, "", 1), (1, rows[0][1], 0), (2, rows[3][1], 0), (3, rows[4][1], 0)])
