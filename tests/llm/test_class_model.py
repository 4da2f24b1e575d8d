"""The class-based model against a plain one, on small tables in several gatherings and buckets."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from made_texts import prose

from airsense.llm import brown_lm
from airsense.llm.text import span_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def number(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def tail(word):
    return word.encode()[-1] % brown_lm.TAILS


def expected_scores(rows, n_seeds):
    """Scores of (id, text) rows by the docstring's steps, word by word."""
    lines = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for _, t in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    count = Counter(w for line, use in zip(lines, train) if use for w in line)
    signed = {w: number(w) - (1 << 64 if number(w) >> 63 else 0) for w in count}
    seeds = sorted(sorted(count, key=lambda w: (-count[w], signed[w]))[:n_seeds], key=number)
    size = len(seeds) + brown_lm.TAILS + 1
    symbol = lambda w: size - 1 if w is None else seeds.index(w) if w in seeds else len(seeds) + tail(w)
    steps = [(a, b) for line, use in zip(lines, train) if use for a, b in zip([None, *line], [*line, None])]
    bigrams = np.zeros((size, size), np.int64)
    for a, b in steps:
        bigrams[symbol(a), symbol(b)] += 1
    label = brown_lm.exchange_clusters(bigrams, max(brown_lm.CLASSES, round(len(count) ** (1 / 3))))
    k = int(label.max())
    first = lambda w: int(label[symbol(w)])
    table = np.zeros((k + 1, k + 1))
    for a, b in steps:
        table[first(a), first(b)] += 1
    behind = np.log((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * (k + 1)))
    own = {w: first(w) for w in seeds}
    fits = {w: np.zeros(k) for w in count if w not in own}
    for a, b in steps:
        if a in fits:
            fits[a] += behind[:k, first(b)]
        if b in fits:
            fits[b] += behind[first(a), :k] - np.log(table.sum(0)[:k] + 0.5)
    own |= {w: int(np.argmax(f)) for w, f in fits.items()} | {None: k}
    per_tail = np.zeros((brown_lm.TAILS, k + 1))
    for w in count:
        per_tail[tail(w), own[w]] += 1
    final = np.zeros((k + 1, k + 1))
    for a, b in steps:
        final[own[a], own[b]] += 1
    out = []
    for line in lines:
        c = [own[w] if w in own else int(per_tail[tail(w)].argmax()) for w in line]
        total = sum(math.log10((final[a, b] + 0.5) / (final[a].sum() + 0.5 * (k + 1))) for a, b in zip([k, *c], [*c, k]))
        out.append(total + sum(math.log10((count[w] + 0.1) / (final[:, x].sum() + 0.1 * (per_tail[:, x].sum() + 1))) for w, x in zip(line, c)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_score_is_that_of_the_plain_model(spark, docs, texts, monkeypatch, small):
    if small:  # several gatherings and buckets, most words exchanged on their own
        for name, value in (("FLUSH", 300), ("BUCKET", 100), ("SEEDS", 12), ("CLASSES", 5)):
            monkeypatch.setattr(brown_lm, name, value)
    out = {r.doc_id: r.score for r in brown_lm.score_documents(docs).collect()}
    expected = dict(zip(texts, expected_scores(list(texts.items()), brown_lm.SEEDS)))
    assert out == pytest.approx(expected, rel=1e-9)


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, prose(1, 50)), (1, prose(1, 50)), (1, "other text"), (None, prose(2, 30)), (None, None), (10, prose(1, 20) + " never seen")]
    out = brown_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.score for r in out) == pytest.approx(sorted(expected_scores(rows, brown_lm.SEEDS)), rel=1e-9)
    assert sorted(r.n_tokens for r in out) == [1, 3, 23, 31, 51, 51] and all(r.n_known < r.n_tokens and r.base_score < 0 for r in out)


def test_arrow_setting_is_left_alone(spark, docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    brown_lm.score_documents(docs)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def likelihood(bigrams, label):
    k = int(label.max()) + 1
    onehot = np.eye(k)[label]
    table = onehot.T @ bigrams @ onehot
    return sum(brown_lm.plogp(x).sum() * sign for x, sign in ((table, 1), (table.sum(0), -1), (table.sum(1), -1)))


def test_exchange_takes_the_likeliest_class():
    rng = np.random.default_rng(3)
    bigrams = rng.poisson(rng.gamma(0.3, 6, (15, 15)))
    label = brown_lm.exchange_clusters(bigrams, 4, rounds=50)
    best = likelihood(bigrams, label)
    for w in range(14):  # once no symbol moves, no single move is better
        for c in range(4):
            other = label.copy()
            other[w] = c
            if len(set(other)) == len(set(label)):
                assert likelihood(bigrams, other) <= best + 1e-6
    dealt = np.empty(15, np.int64)
    dealt[np.argsort(-bigrams[:-1].sum(1), kind="stable")] = np.arange(14) % 4
    dealt[14] = 4
    assert best > likelihood(bigrams, dealt)
