"""Language identification, ranked search and centroid clustering against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from airsense.llm import centroids, language_id, lexical_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


# ---- ranked search ----


def ranked(docs, items, top=10):
    """{item row: [(score, doc_id)]} by scoring every document for every item."""
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in counted:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def test_search_equals_scoring_everything(spark, texts, docs):
    items = [(1, texts[5]), (2, texts[30]), (3, None), (4, ""), (5, "na X"), (6, "Ünï cödé"), (7, "nowhere"), (8, "alpha1 ALPHA1 beta2"), (2, texts[40]), (None, "na")]
    more = docs.union(docs.where("doc_id in (5, 41)"))  # repeated rows
    more = more.unionByName(spark.createDataFrame([(None, "na alpha1", "en", "s", 1, "h", 0)], docs.schema)).withColumn("rank", more.doc_id).withColumn("score", more.text)
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1L AS doc_id", "'x' AS query")
    found = lexical_search.search(more, table).collect()
    rows = [(r.doc_id, r.text) for r in more.collect()]
    assert sorted([tuple(r) for r in found], key=str) == ranked(rows, items)
    assert {f.name: f.dataType.simpleString() for f in lexical_search.search(more, table).schema} == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_search_of_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "alpha1")], "item_id long, text string")
    assert lexical_search.search(no_docs, items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs.where("text is null"), items).count() == 0


def test_queries_in_blocks_and_small_shards_give_the_same(spark, texts, docs, monkeypatch):
    items = spark.createDataFrame([(k, t) for k, t in texts.items()], "item_id long, text string")
    once = sorted(map(tuple, lexical_search.search(docs, items).collect()))
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 20_000)
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 2)
    assert sorted(map(tuple, lexical_search.search(docs, items).collect())) == once


@pytest.mark.parametrize("seed", range(6))
def test_best_first_intervals_equal_full_scores(seed):
    """Random postings with many equal impacts: same documents, ties by the smaller one."""
    rng = np.random.default_rng(seed)
    n_docs, n_terms = 3000, 40
    per_term = [np.sort(rng.choice(n_docs, rng.integers(1, n_docs), replace=False)) for _ in range(n_terms)]
    lengths = np.array([len(p) for p in per_term])
    impacts = rng.integers(0, 4 if seed % 2 else 10**9, int(lengths.sum()))
    shard = lexical_search.Shard(n_docs, np.arange(n_terms), lengths, np.concatenate(per_term).astype(np.int32), impacts)
    starts = np.cumsum(lengths) - lengths
    least = n_docs
    for size in (1, 2, 7, 40):
        query = rng.choice(n_terms + 2, size, replace=False).tolist()  # some terms that the shard lacks
        scores = np.zeros(n_docs, np.int64)
        for t in query:
            if t < n_terms:
                scores[per_term[t]] += impacts[starts[t] : starts[t] + lengths[t]]
        want = sorted([(-int(s), d) for d, s in enumerate(scores) if s > 0])[:10]
        got, scored = shard.best(query, 10)
        assert [(-s, d) for s, d in got] == want
        least = min(least, scored)
    assert least < n_docs / 4 or seed % 2  # bounds leave most documents unscored where impacts differ


def test_long_text_in_parts_counts_like_one():
    text = ("alpha Beta, gamma7 " * 160_000) + "x" * 1_500_000 + " alpha"
    short = pa.array([None, "", "alpha", text, "Beta"], pa.string())
    queries = lexical_search.parse([0], ["alpha beta " + "X" * 1_500_000])
    n, row, term, tf = lexical_search.term_counts(short, queries.vocabulary)
    assert n.tolist() == [0, 0, 1, 3 * 160_000 + 2, 1]
    assert sorted(zip(row.tolist(), tf.tolist(), strict=True)) == [(2, 1), (3, 1), (3, 160_000), (3, 160_001), (4, 1)]


# ---- centroid clustering ----


def lloyd(rows, k, rounds, width):
    """Cluster, distance per row and centroids, in Python integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centers = [v for _, v in sorted(kept, key=key)[:k]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centers)):
                own = [v for (_, v), n in zip(kept, near, strict=True) if n[1] == j]
                if own:
                    centers[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted([(i, j, d) for (i, _), (d, j) in zip(kept, near, strict=True)], key=str), centers


def vectors(seed, groups=8, each=60, width=8, spread=0.3):
    rng = np.random.default_rng(seed)
    return [(g * each + k, [float(x) for x in rng.normal(g * 3 % 7, spread, width)]) for g in range(groups) for k in range(each)]


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_plain_rounds(spark, seed):
    rows = vectors(seed)
    rows += rows[:200] + [(None, rows[0][1]), (901, None), (902, [1.0]), (903, [None] + [1.0] * 7), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (906, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, x string, cluster int").repartition(5)
    found = centroids.cluster_vectors(df, k=8, components=8)
    want, centers = lloyd(rows, 8, 5, 8)
    assert sorted(map(tuple, found.rows.collect()), key=str) == want
    assert found.centroids.tolist() == centers
    assert sum(found.inertia) == sum(r[2] for r in want)
    # the bounds spare most of the vectors
    assert found.scanned[0] == len(want) and sum(found.scanned[1:]) < 0.6 * 5 * len(want)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.25, 0.0]), (2, [0.25, 0.0])], "vec_id long, embedding array<float>")
    found = centroids.cluster_vectors(df, components=2)
    assert len(found.centroids) == 3 and found.rows.agg({"distance": "max"}).first()[0] == 0
    none = centroids.cluster_vectors(df.limit(0), components=2)
    assert none.rows.count() == 0 and none.rows.columns == ["vec_id", "cluster", "distance"]


def test_components_beyond_the_range_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit 64 bits"):
        centroids.cluster_vectors(df, components=2)


@pytest.mark.parametrize("width", [2, 3, 16])
def test_loosening_covers_every_member_and_is_at_most_the_drift(width):
    rng = np.random.default_rng(width)
    tighter = 0
    for _ in range(60):
        old = rng.integers(-300, 300, (5, width))
        new = old + rng.integers(-60, 60, (5, width))
        new[rng.integers(5)] = old[rng.integers(5)]
        radius = rng.uniform(0, 250, 5)
        loosen = centroids.loosening(old, new, radius)
        for i in range(5):
            direction = rng.normal(size=(400, width))
            members = old[i] + direction / np.linalg.norm(direction, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (400, 1)) ** 0.2
            others = [j for j in range(5) if j != i]
            nearer = max((np.linalg.norm(members - old[j], axis=1) - np.linalg.norm(members - new[j], axis=1)).max() for j in others)
            drift = max(np.linalg.norm(new[j] - old[j]) for j in others)
            assert nearer <= loosen[i] + 1e-9 and loosen[i] <= drift * (1 + 1e-9)
            tighter += loosen[i] < 0.9 * drift
    assert tighter > 30


def test_distances_are_exact_beyond_doubles():
    rng = np.random.default_rng(0)
    for most in (100, centroids.MOST - 1):
        x, c = rng.integers(-most, most, (7, 64)), rng.integers(-most, most, (3, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
        assert centroids.squared_distances(x, c).tolist() == want


# ---- language identification ----


def test_gradients_equal_differences():
    """Backpropagation through time against the loss at shifted weights, padded windows included."""
    net = language_id.Network.start(3, hidden=3, kind=np.float64)
    rng = np.random.default_rng(1)
    net.offset += rng.normal(0, 0.3, net.offset.shape)
    x = rng.integers(0x61, 0x66, (6, 4))
    x[4:, 0] = x[2:, 1] = language_id.PAD
    language = np.array([0, 1, 2, 1])
    _, gradients = net.gradients(x, language)
    for w, g in zip(net.weights(), gradients, strict=True):
        places = [tuple(p) for p in np.argwhere(np.abs(g) > 0)]
        for place in [places[k] for k in rng.choice(len(places), min(12, len(places)), replace=False)]:
            kept, step = w[place], 1e-6
            w[place] = kept + step
            high = net.gradients(x, language)[0]
            w[place] = kept - step
            low = net.gradients(x, language)[0]
            w[place] = kept
            assert (high - low) / (2 * step) == pytest.approx(g[place], rel=1e-4, abs=1e-8)


@pytest.fixture(scope="module")
def predicted(spark, sf_dir):
    return language_id.op11_language_id(spark, sf_dir).collect()


def test_held_out_languages_are_found(spark, sf_dir, predicted):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(docs) == sorted(r.doc_id for r in predicted)
    for r in predicted:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or ""))
    judged = [r.lang_pred == docs[r.doc_id].lang for r in predicted if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert len(judged) > 40 and sum(judged) / len(judged) >= 0.95


@pytest.fixture(scope="module")
def model():
    return language_id.fit([("xx", b"abc abd " * 16), ("yy", b"qrs qrt " * 16), ("yy", b"qrs")], batches=25)


def test_awkward_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "abc abd " * 40_000), (5, "qrs"), (5, "qrs"), (None, "qrs qrt qrs"), (7, "日本"), (8, "qrs " * 33)]
    df = spark.createDataFrame([(*r, "zz", 0.5) for r in rows], "doc_id long, text string, lang_pred string, score double").repartition(3)
    found = language_id.identify(df, model).collect()
    got = {r.doc_id: (r.lang_pred, round(r.score, 2)) for r in found}
    assert len(found) == len(rows) and got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "xx" and got[5][0] == got[None][0] == got[8][0] == "yy" and got[7][0] in ("xx", "yy")
    assert language_id.identify(df.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark, docs):
    none = language_id.learn(docs.where("lang = 'nowhere'"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs, none).collect()} == {("und", 0.0)}
    assert language_id.language_spans(docs, none).count() == 0


def test_windows_stand_alone(model):
    """A text's probabilities do not depend on the texts beside it; every position is in a window."""
    texts = ["abc " * 100, "qrs", "", "abc qrs " * 50, "12"]
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    offsets = np.cumsum([0, *[len(d) for d in data]])
    together = language_id.pooled(model.network, np.concatenate(data), offsets)
    for k, d in enumerate(data):
        assert language_id.pooled(model.network, d, np.array([0, len(d)]))[0] == pytest.approx(together[k], abs=1e-5)


def test_spans_cover_every_byte(spark, model):
    texts = {1: "abc abd " * 30 + "qrs qrt " * 30, 2: "abc", 3: "", 4: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = sorted(tuple(r) for r in language_id.language_spans(df, model).collect())
    for i, t in texts.items():
        mine = [s for s in spans if s[0] == i]
        assert [s[1] for s in mine[1:]] == [s[2] for s in mine[:-1]]
        assert not t and not mine or (mine[0][1], mine[-1][2]) == (0, len(t))
        assert all(a[3] != b[3] for a, b in zip(mine, mine[1:], strict=False))
