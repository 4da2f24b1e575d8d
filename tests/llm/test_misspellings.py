"""The lexicon scanner against edit distances to every term."""

import random

import numpy as np
import pyarrow as pa
import pytest

from airsense.llm import toxicity

TERMS = [
    ("idiot", False, 5.0), ("scum", False, 4.0), ("worthless", False, 6.0), ("disgusting", False, 3.1), ("dégoûtant", False, 5.5), ("größe", False, 4.4),
    ("идиот", False, 4.2), ("stupi", True, 4.6), ("low", True, 2.5), ("abcdefgh", True, 3.7), ("moron", False, 1.2), ("worth", True, 2.2), ("x" * 70, False, 5.0),
]


def distance(a, b):
    """Edits, swaps of neighbours included, from ``a`` to every start of ``b``."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1]


def expected(word, terms):
    best = None
    for k, (text, is_stem, weight) in enumerate(terms):
        row = distance(text, word)
        d = min(row) if is_stem else row[-1]
        if d <= (0 if len(text) < 5 else 1 if len(text) < 9 else 2) and (best is None or (weight - 1.5 * d, k) > best[:2]):
            best = (weight - 1.5 * d, k, d)
    return best[1:] if best and best[0] > 0 else None


def variants(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        word = list(rng.choice(TERMS)[0] + rng.choice(["", "", "s", "ness", "ы"]))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(word)) if word else 0
            kind = rng.randrange(4)
            if kind == 0:
                word.insert(i, rng.choice("aeioußйx"))
            elif kind == 1 and len(word) > 1:
                del word[i]
            elif kind == 2:
                word[i] = rng.choice("abcdetuüи")
            elif i + 1 < len(word):
                word[i], word[i + 1] = word[i + 1], word[i]
        yield "".join(word)


@pytest.mark.parametrize("seed", [1, 2])
def test_hits_are_those_of_edit_distance(seed):
    words = [*variants(seed, 1500), "idoit", "idi0t", "scam", "scum", "wortlhess", "tcusum", "x" * 69, "x" * 73, "q" * 5000, "1"]
    scanner = toxicity.Scanner(TERMS)
    for part in (words[::2], words[1::2], words):  # words seen before and new ones
        found = {}
        for i, j, data, offsets in toxicity.lower_pieces(pa.array([" ".join(part[:400]), None, "", " ".join(part[400:])])):
            for start, end, term, d in scanner.hits(data, offsets)[1]:
                found[data[start:end].tobytes().decode()] = (term, d)
        assert found == {w: e for w in part if (e := expected(w, TERMS)) is not None}


def test_no_terms_and_no_words():
    assert toxicity.Scanner([]).hits(np.frombuffer(b"some words", np.uint8), np.array([0, 10]))[1] == []
    assert toxicity.Scanner(TERMS).hits(np.zeros(0, np.uint8), np.array([0, 0]))[1] == []


def test_every_term_with_evidence_is_kept(spark):
    """More toxic words than any cap would keep, each in texts of its own."""
    words = [f"{a}{b}{c}foul" for a in "bcdfghjk" for b in "aeiou" for c in "lmnprstvz"]
    ids = (i for i in range(10**6) if not toxicity.held_out(i))
    rows = [(next(ids), f"plain talk of {word} number {k}{w}", 1) for w, word in enumerate(words) for k in "abcdefghijkl"]
    rows += [(next(ids), f"plain talk of number {k}", 0) for k in range(9000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    terms, _ = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    covered = {w for w in words if any(w == t or (stem and w.startswith(t)) for t, stem, _ in terms)}
    assert len(covered) == len(words) == 360
