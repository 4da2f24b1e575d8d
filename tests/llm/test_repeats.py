"""Repeated strings within one short text, and anchors that two gatherings hold."""

import hashlib

import pyarrow as pa

from airsense.llm import suffix_dedup
from test_operators import expected_removal


def letters(seed: int, n: int) -> str:
    return "".join(hashlib.sha256(f"{seed} {k}".encode()).hexdigest() for k in range(n // 64 + 1))[:n]


def with_sentence_twice(seed: int) -> str:
    """210 bytes with an 80-byte sentence at two places: no 200-byte string is repeated."""
    sentence = letters(seed, 80)
    return letters(seed + 1000, 15) + sentence + letters(seed + 2000, 20) + sentence + letters(seed + 3000, 15)


def removed(spark, folder, texts):
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    rows = suffix_dedup.op5_suffix_dedup(spark, str(folder)).collect()
    return {r.doc_id: (r.n_removed, r.kept_sha256) for r in rows}


def brute(texts):
    return {k: (v[1], v[3]) for k, v in expected_removal(texts).items()}


def test_a_sentence_twice_in_a_short_text_stays(spark, tmp_path):
    texts = {k: with_sentence_twice(k) for k in range(40)}
    assert {n for n, _ in removed(spark, tmp_path, texts).values()} == {0}


def test_copies_of_such_texts_and_their_parts_go(spark, tmp_path):
    texts = {}
    for k in range(40):
        text = with_sentence_twice(k)
        texts |= {3 * k: text, 3 * k + 1: text, 3 * k + 2: letters(k + 4000, 50) + text[k % 11 :][:200] + letters(k + 5000, 50)}
    assert removed(spark, tmp_path, texts) == brute(texts)


def test_an_anchor_in_two_gatherings_is_one(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FLUSH", 1)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([letters(1, (5 << 19) + 999)])], names=["doc_id", "text"])
    rows = suffix_dedup.sort_anchors(suffix_dedup.emit_anchors(iter([batch])))
    assert sum(b.num_rows for b in rows) == 0
