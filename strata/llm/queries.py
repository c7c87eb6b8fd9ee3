"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, conversations, fingerprint, jaccard, lines, lm, mixing, packing, quality, substring, toxicity, warc
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` mixed so that sources hold the square root of their size; the texts travel along."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("_copy").cast("long").alias("copy"), F.round("_rate", 6).alias("rate"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.col("_place").alias("place"))


OP6_SQL = """
WITH sizes AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (SELECT source, pow(size, 0.5) / (SELECT sum(pow(size, 0.5)) FROM sizes) * (SELECT sum(size) FROM sizes) / nullif(size, 0) AS rate FROM sizes),
drawn AS (
  SELECT d.doc_id, d.source, d.text, r.rate,
         CAST(CAST('0x' || substr(md5('17|' || d.doc_id || '|1'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
ks AS (SELECT unnest(range(0, 200)) AS k),
terms AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, ks),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
copies AS (SELECT d.doc_id, d.source, d.text, d.rate, c.k AS copy FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u)
SELECT doc_id, source, CAST(copy AS BIGINT) AS copy, round(rate, 6) AS rate, sha256(coalesce(text, '')) AS text_sha256, md5('place17|' || doc_id || '|' || copy) AS place
FROM copies
"""


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS k FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM comp LEFT JOIN n USING (doc_id)
"""


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical fingerprints of all ``documents`` and of their half-edited texts."""
    return fingerprint.half_edited(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file, never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``; a third of the labels stays unseen."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    return model.score(docs).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 1024 tokens."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` covered by 13-word windows that start in an earlier document."""
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 12) AS k FROM w, unnest(range(1, len(ws) - 11)) t(i) WHERE len(ws) >= 13),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) t(p)),
kept AS (SELECT doc_id, count(*) AS n_words, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY w2.p) FILTER (g.p IS NULL) AS text
         FROM words w2 LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored by a model of those whose crc32 modulo 10 is not 0."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC records, indexed, and read back from the archives."""
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS lead FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN lead IS NOT NULL AND lead <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN lead <> page_id THEN lead END AS refers_to
FROM f
"""


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings`` at a cosine of 0.9 or more."""
    return ann.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` under 5-word shingle Jaccard of 0.75 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without their near-repeated lines."""
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"), min_chars=1)
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all ``documents`` in each of their 120 orders, by source."""
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 5 * length(x) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END) AS mask
  FROM words LEFT JOIN marks USING (doc_id)),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(c, bit)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a JOIN l b ON b.c <> a.c JOIN l c ON c.c NOT IN (a.c, b.c) JOIN l d ON d.c NOT IN (a.c, b.c, c.c) JOIN l e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
steps AS (SELECT filter_order, step, any_value(l.bit) AS f, coalesce(sum(p.bit), 0) AS b
          FROM o, range(1, 6) r(step) JOIN l ON l.c = filter_order[step] LEFT JOIN l p ON strpos(filter_order, p.c) < step GROUP BY filter_order, step),
n AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, mask)
SELECT part, filter_order, CAST(step AS INT) AS step,
       CAST(sum(CASE WHEN mask & CAST(f + b AS INT) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN mask & f <> 0 AND mask & CAST(b AS INT) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN mask & f <> 0 AND mask & CAST(b AS INT) <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN mask = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN mask & f <> 0 AND mask & CAST(b AS INT) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN mask & f <> 0 AND mask & CAST(b AS INT) = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN mask & f <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM n, steps GROUP BY part, filter_order, step
"""


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``; a third of the labels stays unseen."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.training_rows(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All damaged ``conversations``: their faults, and the cheapest repair of each."""
    return conversations.repair(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {"op1_toxicity": op1_toxicity, "op4_lm_scoring": op4_lm_scoring, "op2_best_fit_packing": op2_best_fit_packing, "op3_substring_dedup": op3_substring_dedup, "op5_warc": op5_warc, "op7_embedding_near_dedup": op7_embedding_near_dedup, "op8_ngram_jaccard": op8_ngram_jaccard, "op6_mix_sources": op6_mix_sources, "op9_fingerprint": op9_fingerprint, "op10_line_dedup": op10_line_dedup, "op11_filter_audit": op11_filter_audit, "op12_quality": op12_quality, "op13_conversation_repair": op13_conversation_repair, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op5_warc": OP5_SQL, "op7_embedding_near_dedup": OP7_SQL, "op8_ngram_jaccard": OP8_SQL, "op6_mix_sources": OP6_SQL, "op11_filter_audit": OP11_SQL}
