"""Corpus-wide lookups: two hops give what one gives, and rows grow more slowly than chunks times buckets."""

import numpy as np
import pytest

from strata.llm import chunks, jaccard, lines, lm, substring


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("bucket_keys", [1_500_000, 700])
@pytest.mark.parametrize("operator", [substring.remove_repeats, jaccard.jaccard_components, lm.score_documents, lambda docs: lines.dedup_lines(docs.select("doc_id", "text"), min_chars=1)])
def test_two_hops_answer_like_one(docs, monkeypatch, operator, bucket_keys):
    monkeypatch.setattr(chunks, "BUCKET_KEYS", bucket_keys)
    one = rows_of(operator(docs))
    monkeypatch.setattr(chunks, "DIRECT", 4)
    assert chunks.way_count(8) == 4
    assert rows_of(operator(docs)) == one


def test_two_hops_on_an_empty_table(none, monkeypatch):
    monkeypatch.setattr(chunks, "DIRECT", 4)
    assert jaccard.jaccard_components(none).isEmpty()


def test_slices_of_buckets():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    for buckets in (1, 2, 8, 1 << 14):
        found = list(chunks.by_bucket(keys, buckets))
        assert [b for b, _ in found] == sorted({int(k) * buckets >> 64 for k in keys})
        assert all(int(k) * buckets >> 64 == b for b, s in found for k in keys[s])
        assert found[0][1].start == 0 and all(x[1].stop == y[1].start for x, y in zip(found, found[1:], strict=False)) and found[-1][1].stop == len(keys)
    assert list(chunks.by_bucket(keys[:0], 8)) == []


def test_rows_a_chunk_grow_with_the_root_of_the_corpus():
    """Rows that a chunk causes in both hops, over corpora of 10 GB to 100 TB."""
    for size in (10**k for k in range(10, 15)):
        buckets = chunks.bucket_count(size / 5)
        ways, parts = chunks.way_count(buckets), size / chunks.CHUNK_BYTES
        if buckets <= chunks.DIRECT:
            assert ways == buckets
            continue
        bundles = -(-parts // ways)
        rows = parts * ways + bundles * buckets
        assert ways * ways in (buckets, 2 * buckets) and rows / parts <= 3 * np.sqrt(buckets) + buckets / parts
        assert chunks.CHUNK_BYTES / 6 / ways > 100  # keys of a row, at six bytes a word
