"""What the class model's tasks and stored tables hold in memory."""

from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from airsense.llm import brown_lm
from airsense.llm.text import BATCH_BYTES, BATCH_ROWS, PARQUET_ROWS


def test_large_rows_are_written_without_buffers_as_large_as_a_page(spark, docs, monkeypatch):
    stored, inside = {}, {}

    def watched(df, name, **options):
        stored[name] = plain(df, name, **options)
        inside[name] = [spark.conf.get(x) for x in (BATCH_BYTES, PARQUET_ROWS)]
        return stored[name]

    plain = brown_lm.store
    monkeypatch.setattr(brown_lm, "store", watched)
    monkeypatch.setattr(brown_lm, "FLUSH", 300)
    before = [spark.conf.get(x) for x in (BATCH_ROWS, BATCH_BYTES, PARQUET_ROWS)]
    brown_lm.score_documents(docs)
    assert [spark.conf.get(x) for x in (BATCH_ROWS, BATCH_BYTES, PARQUET_ROWS)] == before
    assert inside["lm-classed"] == [str(brown_lm.BATCH_BYTES), str(brown_lm.PARQUET_ROWS)]
    for name in ("lm-gathered", "lm-classed", "lm-sequences"):
        files = [pq.ParquetFile(f.removeprefix("file://")) for f in stored[name].inputFiles()]
        codecs = {f.metadata.row_group(g).column(c).compression for f in files for g in range(f.metadata.num_row_groups) for c in range(f.metadata.num_columns)}
        assert codecs == {"ZSTD"}, name


@pytest.mark.parametrize("kind", [np.uint32, np.int64])
def test_entries_are_the_classes_beside_each_word(monkeypatch, kind):
    monkeypatch.setattr(brown_lm, "small_enough", lambda values: kind)
    rng = np.random.default_rng(1)
    lengths, own, k = np.array([0, 5, 0, 40, 1, 0]), rng.integers(0, 4, 9), 4
    tokens = rng.integers(0, 9, lengths.sum())
    use = np.repeat([True, True, True, True, False, True], lengths)
    bounds, near, times = brown_lm.neighbours({"tokens": tokens.astype(np.uint32).tobytes(), "lengths": lengths.astype(np.int64).tobytes()}, own, k, use)
    expected, start = Counter(), 0
    for n, trained in zip(lengths, [True, True, True, True, False, True]):
        words = tokens[start : start + n].tolist()
        start += n
        classes = [k, *own[words].tolist(), k] if n else [k, k]
        for i, w in enumerate(words):
            if trained:
                expected[w, classes[i + 2]] += 1
                expected[w, k + 1 + classes[i]] += 1
    found = {(w, int(near[i])): int(times[i]) for w in range(9) for i in range(bounds[w], bounds[w + 1])}
    assert found == expected
    pairs = sorted(expected)
    fit = rng.random((2 * k + 2, k))
    twice = [np.array([p[x] for p in pairs * 2]) for x in (0, 1)]
    classes = brown_lm.classes_of(10, *twice, np.array([expected[p] for p in pairs * 2]), fit)
    for w in range(9):
        weighed = sum((fit[c] * n for (x, c), n in expected.items() if x == w), np.zeros(k))
        assert classes[w] == (np.argmax(weighed) if any(x == w for x, _ in pairs) else brown_lm.UNSEEN)
    assert classes[9] == brown_lm.UNSEEN
