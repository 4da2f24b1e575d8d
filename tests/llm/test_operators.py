"""The operators against brute force, on small tables with the awkward cases in them."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from compare import differences, duck

from airsense.llm import brown_lm, chat, decontamination, fingerprints, licenses, mixing, ngram_jaccard, suffix_dedup, toxicity, warc
from airsense.llm.queries import LLM_ORACLES, LLM_QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text, pattern=SPACED):
    return re.findall(pattern, (text or "").translate(LOWER))


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(spark, duck(sf_dir), LLM_QUERIES[name], LLM_ORACLES[name], sf_dir) == []


def expected_components(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in texts}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in texts}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_components(docs, texts, monkeypatch, small):
    if small:  # runs as one entry, hot shingles, several blocks
        monkeypatch.setattr(ngram_jaccard, "RUN_MOST", 2)
        monkeypatch.setattr(ngram_jaccard, "HOT_LOCAL", 2)
        monkeypatch.setattr(ngram_jaccard, "HOT_TOTAL", 2)
        monkeypatch.setattr(ngram_jaccard, "BLOCK", 2)
    rows = ngram_jaccard.jaccard_classes(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected_components(texts)


def expected_removal(texts):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    out = {}
    for i, b in raw.items():
        keep = bytearray(b"\1" * len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                keep[k : k + 200] = bytes(200)
        kept = bytes(x for x, y in zip(b, keep) if y)
        out[i] = (len(b), keep.count(0), len([x for x in bytes(keep).split(b"\1") if x]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_bytes(spark, docs, texts, monkeypatch, tmp_path, hot):
    if hot:
        for name, value in (("HOT_LOCAL", 2), ("HOT_GROUP", 3), ("FLUSH", 500)):
            monkeypatch.setattr(suffix_dedup, name, value)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = suffix_dedup.op5_suffix_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == expected_removal(texts)


def test_cut_texts_keep_rows_and_columns(docs, texts):
    cut = suffix_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns
    got = {r.doc_id: r.text for r in cut.collect()}
    assert set(got) == set(texts) and got[0] is None and got[2] == "one two" and got[5] == ""


def test_language_model(docs, texts):
    out = {r.doc_id: r for r in brown_lm.score_documents(docs).collect()}
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    train = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(train.values()), len(train)
    for i, t in tokens.items():
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        got = out[i]
        assert (got.n_tokens, got.n_known, got.train_tokens) == (len(t), sum(train[w] > 0 for w in t), n)
        assert abs(got.base_score - base) < 1e-6 * max(1, abs(base)) and got.score < 0


def test_license_scan(docs, spark):
    extra = [(100, "x\nReleased under the MIT License.\ny"), (101, "mit\nlicense general public license"), (102, "Licensed under CC BY-NC 4.0.")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    out = {r.doc_id: r for r in licenses.scan_documents(rows).collect()}
    assert (out[100].n_base, out[100].first_word, out[100].base_labels, out[100].score) == (1, 4, "mit", 1.0)
    assert (out[101].n_base, out[101].first_word, out[101].last_word, out[101].base_labels) == (2, 0, 2, "gpl,mit")
    assert "cc-by-nc" in out[102].labels and out[102].base_labels == ""
    assert out[0].n_words == 0 and out[0].score == 0.0 and out[0].first_word is None
    for r in rows.collect():
        assert out[r.doc_id].n_words == len(words(r.text, ALNUM))


def test_fingerprints(docs, texts):
    out = {r.doc_id: r for r in fingerprints.compare_edited(docs).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(t) // 3
        assert out[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()
    assert out[5].fingerprint == out[6].fingerprint and out[2].fingerprint == out[3].fingerprint
    assert out[3].near_next == 1.0 and 0 <= out[40].near_edited <= 1 and out[11].near_next > 0.7


def test_toxic_words_and_misspellings(spark):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, f"plain words number {i} here" + (" you nastyword fool" if toxic else " go on") + f" end{i}"))
        labels.append((i, 0, int(toxic)))
    docs = spark.createDataFrame([*rows, (400, None), (401, "")], "doc_id long, text string")
    terms, weights = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "nastyword" in {t[0] for t in terms}
    out = {r.doc_id: r for r in toxicity.score(docs, terms, weights).collect()}
    assert all(out[i].predicted == int(i % 4 == 0) for i in range(400)) and out[400].score == out[401].score < 0.3
    trie = toxicity.Trie([("idiot", False, 5.0), ("scum", False, 5.0)])
    assert trie.find("idoit") == (0, 1) and trie.find("diiots") is None and trie.find("idi0t") == (0, 1) and trie.find("idiots") == (0, 1) and trie.find("scam") is None


def test_decontamination_finds_other_values(spark, docs):
    bench = spark.createDataFrame([(1, "a train leaves the town at 40 km and comes back at 40 km after the third long bridge of the valley"), (2, None), (3, "short one")], "item_id long, text string")
    leaks = [(200, "so a train leaves the town at 77 km and comes back at 77 km after the third long bridge of the valley ok"), (201, "a train leaves the town at 77 km and comes back at 99 km after the third long bridge of the valley")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(leaks, "doc_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in decontamination.matches(rows, bench).collect()] == [(200, 1)]


def test_salvage_goes_on_after_damage(spark, tmp_path):
    members = [warc.record(i, f"http://x/{i}", f"page {i}".encode(), warc.digest(f"page {i}".encode()), 6, "response", None) for i in range(5)]
    members[2] = members[2][:20] + b"\0\0\0\0" + members[2][24:]
    data = b"junk" + b"".join(members) + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n" + b"tail"
    parts = list(warc.salvage(data))
    assert [p[3]["page_id"] for p in parts if p[0] == "record"] == [0, 1, 3, 4, None]
    assert parts[0][:3] == ("gap", 0, 4) and parts[-1][0] == "gap"
    assert all(a[2] == b[1] for a, b in zip(parts, parts[1:])) and parts[-1][2] == len(data)


def test_warc_nulls_and_copies(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "é"), (4, "u", "é")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    out = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.op2_warc(spark, str(tmp_path)).collect()}
    assert out == {1: (0, "revisit", 2), 2: (0, "response", None), 3: (2, "revisit", 4), 4: (2, "response", None)}


def test_chat_segments_join_to_the_dialogue(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (2, 0, None, "x"), (3, 0, "system", "only")]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("perspective", "position").collect()
    ann = [r for r in out if r.conv_id == 1 and r.perspective == "ann"]
    whole = "".join(r.segment for r in ann)
    assert [r.role for r in ann] == ["system", "assistant", "user", "assistant", "assistant"]
    assert all(whole[r.start : r.end] == r.segment for r in ann)
    assert [whole[r.train_start : r.train_end] for r in ann if r.train_start is not None] == ["hi<|end|>", "bye<|end|>", "bye<|end|>"]
    assert {r.conv_id for r in out} == {1, 2}


def test_mixing_on_awkward_rows(docs, texts):
    rows = mixing.rated(docs).collect()
    assert {r.doc_id for r in rows} == set(texts) and all(0 <= r.probability <= 1 for r in rows)
    assert all(r.probability == 0 and not r.drawn for r in rows if not r.n_tokens)


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert toxicity.score(no_docs, *toxicity.learn(no_docs, labels)).isEmpty()
    assert ngram_jaccard.jaccard_classes(no_docs).isEmpty() and suffix_dedup.remove_repeats(no_docs).isEmpty()
    assert decontamination.matches(no_docs, bench).isEmpty() and mixing.rated(no_docs).isEmpty()
    assert fingerprints.compare_edited(no_docs).isEmpty() and licenses.scan_documents(no_docs).isEmpty()
    assert brown_lm.score_documents(no_docs).isEmpty()
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()


def test_pipeline_on_awkward_rows(spark, docs, texts, tmp_path):
    import corpus_pipeline

    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[30][:300])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs.select(*corpus_pipeline.COLUMNS)
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.store(stage(spark, out, str(tmp_path)), "test")
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
    components = expected_components(texts)
    assert kept[0] == set(texts) and kept[1] == {i for i, (_, c) in components.items() if c == i} == kept[2]
    assert kept[3] == kept[2] - {30} and kept[4] <= kept[3]
