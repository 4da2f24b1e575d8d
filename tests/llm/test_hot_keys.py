"""Keys that many different sets hold, and the sketches that tell their sets apart."""

import numpy as np
import pytest
from made_texts import prose
from test_operators import expected_components

from airsense.llm import ngram_jaccard


@pytest.mark.parametrize("hot_known", [True, False])
def test_a_passage_in_most_documents(spark, monkeypatch, hot_known):
    """Documents around one passage: unlike ones, a chain of near copies, strays that link in pairs."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    monkeypatch.setattr(ngram_jaccard, "RUN_MOST", 40)
    if not hot_known:  # then the passage makes the keys
        monkeypatch.setattr(ngram_jaccard, "HOT_TOTAL", 1 << 40)
    passage = prose(1, 90)
    texts = {k: f"{prose(k + 500, 18)} {passage}" if k % 3 else f"{passage} {prose(k + 900, 40)}" for k in range(150)}
    chain = prose(7, 100).split()
    for k in range(60):
        chain[(k * 13) % 100] = f"turn{k}"
        texts[200 + k] = " ".join(chain)
    for k in range(8):
        texts[300 + k] = f"{passage} {prose(2000 + k // 2, 60)} {'odd' * (k % 2)}"
    texts |= {400 + k: passage for k in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    found = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_classes(docs).collect()}
    want = expected_components(texts)
    assert found == {k: (v[1] if isinstance(v, tuple) else v) for k, v in want.items()}


@pytest.mark.parametrize("sizes", [(40, 60), (900, 1300), (5000, 4000), (30_000, 20_000)])
def test_sketch_distance_bounds_the_difference(sizes):
    rng = np.random.default_rng(sizes[0])
    pool = rng.integers(0, 1 << 63, sum(sizes)).astype(np.uint64)
    for shared in (0, min(sizes) // 2, min(sizes) - 3):
        a, b = pool[: sizes[0]], pool[sizes[0] - shared : sizes[0] - shared + sizes[1]]
        different = sizes[0] + sizes[1] - 2 * shared
        sketches = [ngram_jaccard.filter_sketch(x).tobytes() for x in (a, b)]
        (far,) = ngram_jaccard.distances(sketches, np.array([0]), np.array([1]))
        assert far <= different
        n = np.array(sizes)
        if min(sizes) / max(sizes) >= 0.75:
            linked = ngram_jaccard.linked(shared, *sizes)
            close = bool(ngram_jaccard.close(np.array([far]), n[:1], n[1:])[0])
            assert close or not linked
            assert not close or shared  # sets without a common shingle are told apart at every size
