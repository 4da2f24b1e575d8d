"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words of a document, across line ends, as long as the template with
a tenth of other words between. It holds a template if the template's distinct words are in it to at
least ``CONTAINMENT``. Template words are ordered by their frequency in all documents, rare first.
With m words and o = ceil(CONTAINMENT m) needed, one of the first m - o + 1 must be in the block
(prefix filter); the document must have o words (length filter); and so many places of template
words must lie within a block's length of that one (positional filter). What passes is counted
exactly, for all blocks.

Besides, base labels come from places where a license's name stands as consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsense.llm.tables import read
from airsense.llm.text import ALNUM, LOWER, column_bytes, pieces, row_words, small_batches, span_hashes, word_spans

CONTAINMENT = 0.9
# Base phrases, and the wording of license notices.
PHRASES = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "licensed under the bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
)


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def vocabulary() -> list[str]:
    return sorted({w for _, text in TEMPLATES for w in text.split()} | {w for _, phrase in PHRASES for w in phrase})


class Words:
    """The words of a piece of a batch; ``known`` has their number in the vocabulary, or -1."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        self.hashes, self.numbers = hashes, numbers

    def read(self, column: pa.Array) -> Iterator[tuple]:
        data, offsets = column_bytes(column)
        for i, j in pieces(offsets):
            part = LOWER[data[offsets[i] : offsets[j]]]
            local = offsets[i : j + 1] - offsets[i]
            starts, ends = word_spans(part, local, ALNUM)
            own = span_hashes(part, starts, ends)
            place = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            known = np.where(self.hashes[place] == own, self.numbers[place], -1)
            yield i, j, part, starts, known, row_words(local, starts)


def reader() -> tuple[Words, list[str]]:
    words = vocabulary()
    hashes = np.array([word_hash(w) for w in words], np.uint64)
    order = np.argsort(hashes)
    return Words(hashes[order], order.astype(np.int64)), words


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each vocabulary word occurs in a task's texts."""
    words, names = reader()
    total = np.zeros(len(names) + 1, np.int64)
    for batch in batches:
        for *_, known, _ in words.read(batch.column("text")):
            total += np.bincount(known + 1, minlength=len(names) + 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array(total[1:])], names=["word", "times"])


def phrase_places(known: np.ndarray, bounds: np.ndarray, numbers: dict[str, int]) -> dict[str, np.ndarray]:
    """Where, in the list of words, each base phrase starts; never across rows."""
    out = {}
    for label, phrase in PHRASES:
        n = len(known) - len(phrase) + 1
        if n <= 0:
            out[label] = np.zeros(0, np.int64)
            continue
        hit = np.ones(n, bool)
        for k, word in enumerate(phrase):
            hit &= known[k : k + n] == numbers[word]
        at = np.flatnonzero(hit)
        row_end = bounds[np.searchsorted(bounds, at, "right")]
        out[label] = at[at + len(phrase) <= row_end]
    return out


def best_shares(known: np.ndarray, bounds: np.ndarray, number: np.ndarray, need: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, most distinct template words in a block of it) of rows where a block has ``need``.

    ``number`` gives each vocabulary word its place in the template, rare first, or -1."""
    own = number[known]
    m = int(number.max()) + 1
    at = np.flatnonzero(own >= 0)
    row = np.searchsorted(bounds, at, "right") - 1
    start, end = bounds[row], bounds[row + 1]
    hit = (own[at] <= m - need) & (end - start >= need)
    low = np.searchsorted(at, np.maximum(at[hit] - width + 1, start[hit]))
    high = np.searchsorted(at, np.minimum(at[hit] + width, end[hit]))
    enough = high - low >= need
    cover = np.zeros(len(at) + 1, np.int64)
    np.add.at(cover, low[enough], 1)
    np.add.at(cover, high[enough], -1)
    near = np.cumsum(cover[:-1]) > 0
    at, row, start = at[near], row[near], start[near]
    if not len(at):
        return row, row
    # the best block ends at a template word; it has each word whose last place lies in it
    first = np.maximum(at - width + 1, start)
    shared = np.zeros(len(at), np.int64)
    for k in range(m):
        shared += np.maximum.accumulate(np.where(own[at] == k, at, -1)) >= first
    held = shared >= need
    rows, place = np.unique(row[held], return_inverse=True)
    best = np.zeros(len(rows), np.int64)
    np.maximum.at(best, place, shared[held])
    return rows, best


def scan(rank: list[int]):
    """``rank`` gives each vocabulary word its place by frequency, rare first."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = reader()
        numbers = {w: k for k, w in enumerate(names)}
        templates = []
        for label, text in TEMPLATES:
            own = sorted({numbers[w] for w in text.split()}, key=lambda w: rank[w])
            number = np.full(len(names) + 1, -1)  # the last is for unknown words, number -1
            number[own] = np.arange(len(own))
            width = ceil(len(text.split()) / CONTAINMENT - 1e-9)
            templates.append((label, number, len(own), ceil(CONTAINMENT * len(own) - 1e-9), width))
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = []
            for i, j, _, _, known, bounds in words.read(batch.column("text")):
                found: dict[int, dict[str, float]] = {}
                for label, number, size, need, width in templates:
                    for row, shared in zip(*best_shares(known, bounds, number, need, width), strict=True):
                        best = found.setdefault(int(row), {})
                        best[label] = max(best.get(label, 0.0), float(shared) / size)
                base = phrase_places(known, bounds, numbers)
                every = np.sort(np.concatenate(list(base.values())))
                cuts = np.searchsorted(every, bounds)
                labelled: dict[int, set[str]] = {}
                for label, at in base.items():
                    for row in np.unique(np.searchsorted(bounds, at, "right") - 1):
                        labelled.setdefault(int(row), set()).add(label)
                for k in range(j - i):
                    a, b = int(bounds[k]), int(bounds[k + 1])
                    mine = every[cuts[k] : cuts[k + 1]]
                    names_ = labelled.get(k, set())
                    more = found.get(k, {})
                    score = 1.0 if names_ else max(more.values(), default=0.0)
                    out.append((ids[i + k], b - a, len(mine), int(mine[0]) - a if len(mine) else None, int(mine[-1]) - a if len(mine) else None, ",".join(sorted(names_)), ",".join(sorted(names_ | set(more))), score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every
    document. Null and empty texts have no words and no labels, and score 0; so has a document
    without a license. Without labels, both label columns are empty strings."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    counts = {r.word: r.times for r in docs.mapInArrow(count_words, "word long, times long").groupBy("word").agg(F.sum("times").alias("times")).collect()}
    size = len(vocabulary())
    order = sorted(range(size), key=lambda w: (counts.get(w, 0), w))
    rank = [0] * size
    for k, w in enumerate(order):
        rank[w] = k
    return docs.mapInArrow(scan(rank), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read(spark, sf_dir, "documents"))
