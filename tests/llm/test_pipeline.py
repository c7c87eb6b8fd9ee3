import math
import os
import zlib
from collections import Counter
from hashlib import md5

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").persist()
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = stage["toxicity"](spark, docs, SF)
    assert clean.columns == names
    gone = {r["doc_id"] for r in docs.select("doc_id").subtract(clean.select("doc_id")).collect()}
    labelled = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert not gone & labelled and gone <= toxic | {r["doc_id"] for r in docs.select("doc_id").collect()} - labelled
    lined = stage["line_dedup"](spark, docs, SF)
    assert lined.columns == names and lined.count() == docs.count()
    once = stage["ngram_jaccard"](spark, docs, SF)
    assert once.columns == names and once.exceptAll(docs).isEmpty() and once.count() < docs.count()
    mixed = stage["mix_sources"](spark, docs, SF)
    assert mixed.columns == names and mixed.distinct().exceptAll(docs).isEmpty()
    packed = stage["best_fit_packing"](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    for name, f in corpus_pipeline.STAGES:
        if name != "best_fit_packing":
            assert f(spark, docs.where("false"), SF).columns == names


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def roots(items, linked):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(items)):
        for y in range(x):
            if linked(items[x], items[y]):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(len(items))]


def lines_by_hand(rows):
    """Each id and text, in order of the ids, without the lines that are near an earlier one."""
    held = [(i, n, line) for i, text, *_ in rows for n, line in enumerate((text or "").split("\n"))]
    grams = [{x[k : k + 5] for k in range(len(x) - 4)} for x in (line.lower() for _, _, line in held)]
    part = [line.strip() != "" for _, _, line in held]
    links = roots(range(len(held)), lambda x, y: part[x] and part[y] and (held[x][2].lower() == held[y][2].lower() or similar(grams[x], grams[y])))
    out = {}
    for k, (i, _, line) in enumerate(held):
        out.setdefault(i, [])
        if links[k] == k:
            out[i].append(line)
    return {i: "\n".join(x) for i, x in out.items()}


def test_stages_against_brute_force(spark, tmp_path):
    """A run over a small corpus with nulls, empty texts, copies, near lines and odd columns, each stage held on its own input."""
    words = [f"w{k}" for k in range(60)]
    near = [" ".join(words), " ".join([*words[:59], "other"]), " ".join(words[20:])]
    rows = [(1, near[0], "a"), (2, near[1], "a"), (3, near[2], "b"), (4, None, "b"), (5, "", None), (6, "menu\nan inner letter of this longer line differs\nlast words of six", "a"), (7, "MENU\nan inner letter of this longar line differs\nseven has its own end", "a"), (8, "one two three four", "c"), (9, "One two three four", "c"), (10, near[0], "c"), (11, "z" * 9000, "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage, path = dict(corpus_pipeline.STAGES), f"file://{tmp_path}"
    assert stage["toxicity"](spark, docs, path).exceptAll(docs).isEmpty() and stage["toxicity"](spark, docs, path).count() == len(rows)
    # lines: bands find nearly all near lines; these are equal or far above the threshold
    lined = stage["line_dedup"](spark, docs, path)
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == lines_by_hand(rows)
    assert {r["n_chars"] == len(r["text"]) for r in lined.collect()} == {True}
    # one of each group, and rows that repeat an id
    doubled = docs.union(docs.where("doc_id in (3, 8)")).union(docs.where("doc_id = 8").withColumn("text", F.lit("a wholly different text of one id")))
    kept = Counter((r["doc_id"], r["text"]) for r in stage["ngram_jaccard"](spark, doubled, path).collect())
    links = roots(rows, lambda x, y: similar(shingles(x[1]), shingles(y[1])))
    assert kept == Counter([(i, t) for k, (i, t, _) in enumerate(rows) if links[k] == k] + [(8, "a wholly different text of one id")])
    # as many copies as the hash of the id draws
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t or "")
    root = sum(math.sqrt(x) for x in size.values())
    expected = Counter()
    for i, _, s in rows:
        rate = math.sqrt(size[s]) / root * sum(size.values()) / size[s] if size[s] else 0
        u, p, k = int(md5(f"17|{i}|1".encode()).hexdigest()[:13], 16) / 16**13, math.exp(-rate), 0
        total = p
        while rate and u >= total:
            k += 1
            p *= rate / k
            total += p
        expected[i] = k
    assert Counter(r["doc_id"] for r in stage["mix_sources"](spark, docs, path).collect()) == +expected
    # token ids, whole and once
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces = Counter()
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        while at < len(ids):
            n = (len(ids) - at - 1) % 1024 + 1
            pieces[(i, at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + n])))] += 1
            at += n
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in stage["best_fit_packing"](spark, docs, path).collect()) == pieces
    # and all of them after one another
    done = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in done} <= {i for i, *_ in rows} and done
