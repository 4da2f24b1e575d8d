"""Toxicity scores from a learned lexicon, misspellings included.

* Lexicon: words and stems (starts of words) that occur in toxic training texts far more often than
  in clean ones. It is learned from at most ``SAMPLE`` labelled texts, chosen by a hash of their id.
  Every term of two letters and more that passes the test of evidence is kept.
* Matching: a Levenshtein automaton runs along the lexicon's trie; a trie node that no spelling
  within the distance can reach ends its branch. An edit adds, takes away or replaces a letter (code
  point), or swaps two neighbours. Terms of five letters and more match within one edit, of nine and
  more within two, shorter ones as they are; a stem matches the start of a word.
* Context: each hit looks at the bytes around it. Hits between quotation marks or after a verb of
  speech count as quoted; a word of address nearby makes a hit more likely abuse.
* Score: logistic regression over the hits of the whole text, fitted on the same sample.

Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsense.llm.tables import read
from airsense.llm.text import ALNUM, LOWER, column_bytes, pieces, row_words, small_batches, span_hashes, word_spans
from airsense.sources.stored import store

#: Labelled texts from which lexicon and weights are learned, at most.
SAMPLE = 20_000
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
LEAST_TEXTS, LEAST_ODDS = 3, 2.0
THRESHOLD = 0.3
WINDOW = 60
# Verbs of speech and words of address in the languages of the texts.
SPEECH = (b"said", b"says", b"wrote", b"quote", b"called", b"sagte", b"schrieb", b"dijo", b"dit")
ADDRESS = (b"you", b"your", b"du", b"dein", b"ihr", b"tu", b"vous", b"usted")
FEATURES = 7


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def edits_of(term: str) -> int:
    """Edits that a term of so many letters may differ by."""
    return (len(term) >= 5) + (len(term) >= 9)


class Trie:
    """Words and stems of a lexicon; ``find`` gives the best (term, distance) for a word."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        #: Terms that end at a node, and the most edits of the terms at and below it.
        self.ends: list[list[int]] = [[]]
        self.reach: list[int] = [0]
        self.longest = max((len(t[0]) for t in terms), default=0)
        for k, (text, _, _) in enumerate(terms):
            node, edits = 0, edits_of(text)
            self.reach[0] = max(self.reach[0], edits)
            for letter in text:
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.next[node][letter]
                self.reach[node] = max(self.reach[node], edits)
            if node:
                self.ends[node].append(k)

    def find(self, word: str) -> tuple[int, int] | None:
        """Walks trie and automaton together. A state of the automaton is the row of edit distances
        between the node's path and every start of ``word``, with the row and letter before it, since
        two neighbouring letters in wrong order are one edit. A stem's distance is that of the nearest
        start. Of several terms the one with the highest weight less 1.5 an edit is taken."""
        # a longer word is beyond the distance of every whole word, and a stem sees no more of it
        word = word[: self.longest + self.reach[0] + 1]
        n = len(word)
        best: tuple[float, int, int] | None = None
        todo = [(0, 0, tuple(range(n + 1)), None, "")]
        while todo:
            node, depth, row, before, last = todo.pop()
            for k in self.ends[node]:
                text, is_stem, weight = self.terms[k]
                distance = min(row) if is_stem else row[n]
                if distance <= edits_of(text):
                    found = (weight - 1.5 * distance, k, distance)
                    best = found if best is None else max(best, found)
            for letter, child in self.next[node].items():
                # distances outside the band around the diagonal are beyond ``most``
                most = self.reach[child]
                new = [most + 1] * (n + 1)
                new[0] = row[0] + 1
                for i in range(max(1, depth + 1 - most), min(n, depth + 1 + most) + 1):
                    new[i] = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (word[i - 1] != letter))
                    if before and i > 1 and letter == word[i - 2] and last == word[i - 1]:
                        new[i] = min(new[i], before[i - 2] + 1)
                if min(new) <= most:
                    todo.append((child, depth + 1, tuple(new), row, letter))
        return (best[1], best[2]) if best and best[0] > 0 else None


def letter_bits(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the code points of UTF-8 bytes start, and one of 64 bits for each."""
    places = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(places):
        return places, np.zeros(0, np.uint64)
    return places, np.uint64(1) << (np.add.reduceat(data.astype(np.uint64), places) & np.uint64(63))


class Scanner:
    """Hits of a lexicon in batches of texts. Each different word is looked at once. The automaton
    sees those whose number of letters and whose letters can be those of a term: an edit changes the
    number by one at most and adds and takes away one letter at most."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.trie = Trie(terms)
        self.weight = np.array([t[2] for t in terms])
        self.words: list[tuple[int, int, bool, np.uint64]] = []
        for text, is_stem, _ in terms:
            _, bits = letter_bits(np.frombuffer(text.encode(), np.uint8))
            if len(bits):
                self.words.append((len(bits), edits_of(text), is_stem, np.bitwise_or.reduce(bits)))
        #: Hashes of words already looked at, sorted, and the term and distance of each, or -1.
        self.seen = np.zeros(0, np.uint64)
        self.found = np.zeros((0, 2), np.int64)

    def near_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of some words, those that may be within the distance of a term."""
        out = np.zeros(len(starts), bool)
        if not len(starts):
            return out
        size = ends - starts
        word_at = np.cumsum(size) - size
        at = np.repeat(starts - word_at, size) + np.arange(int(size.sum()))
        places, bits = letter_bits(data[at])
        first = np.searchsorted(places, word_at)
        letters = np.diff(np.append(first, len(places)))
        # each word starts with a code point, so that no group of reduceat is empty
        mask = np.bitwise_or.reduceat(bits, first)
        place = np.arange(len(places)) - np.repeat(first, letters)
        starts_of: dict[int, np.ndarray] = {}
        for n, edits, is_stem, own in self.words:
            if is_stem:
                if n + edits not in starts_of:
                    starts_of[n + edits] = np.bitwise_or.reduceat(np.where(place < n + edits, bits, np.uint64(0)), first)
                out |= (letters >= n - edits) & (np.bitwise_count(own & ~starts_of[n + edits]) <= edits)
            else:
                out |= (np.abs(letters - n) <= edits) & (np.bitwise_count(mask ^ own) <= 2 * edits)
        return out

    def look_at(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Adds different new words to those seen."""
        found = np.full((len(hashes), 2), -1, np.int64)
        for i in np.flatnonzero(self.near_words(data, starts, ends)).tolist():
            hit = self.trie.find(data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"))
            if hit is not None:
                found[i] = hit
        if len(self.seen) > 1_000_000:
            self.seen, self.found = self.seen[:0], self.found[:0]
        every = np.concatenate((self.seen, hashes))
        order = np.argsort(every, kind="stable")
        self.seen, self.found = every[order], np.concatenate((self.found, found))[order]

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]], np.ndarray]:
        """(words per row, [(start, end, term, distance)], bounds of rows in that list)."""
        starts, ends = word_spans(data, offsets, ALNUM)
        bounds = row_words(offsets, starts)
        words, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.seen):
            new = self.seen[np.minimum(np.searchsorted(self.seen, words), len(self.seen) - 1)] != words
        else:
            new = np.ones(len(words), bool)
        if len(self.seen) > 1_000_000:
            new[:] = True
        some = first[new]
        self.look_at(data, starts[some], ends[some], words[new])
        found = self.found[np.searchsorted(self.seen, words)][back] if len(words) else np.zeros((0, 2), np.int64)
        at = np.flatnonzero(found[:, 0] >= 0)
        out = list(zip(starts[at].tolist(), ends[at].tolist(), found[at, 0].tolist(), found[at, 1].tolist(), strict=True))
        return np.diff(bounds), out, np.searchsorted(starts[at], offsets)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words, found, rows = self.hits(data, offsets)
        out = np.zeros((len(offsets) - 1, FEATURES))
        for k in range(len(out)):
            mine = found[rows[k] : rows[k + 1]]
            if not mine:
                continue
            low, high = int(offsets[k]), int(offsets[k + 1])
            best: dict[int, float] = {}
            quoted = address = 0
            fuzzy = 0.0
            for start, end, term, distance in mine:
                before = data[max(low, start - WINDOW) : start].tobytes()
                behind = data[end : min(high, end + WINDOW)].tobytes()
                in_quotes = (before.count(b'"') % 2 == 1 and b'"' in behind) or (before.rfind(b"\xe2\x80\x9c") > before.rfind(b"\xe2\x80\x9d") and b"\xe2\x80\x9d" in behind)
                spoken = any(v in before[-24:].split() for v in SPEECH)
                near = set((before[-24:] + b" " + behind[:24]).split())
                share = 0.3 if in_quotes or spoken else 1.0
                quoted += share < 1
                address += any(a in near for a in ADDRESS)
                weight = self.weight[term] - 1.5 * distance
                if distance:
                    fuzzy = max(fuzzy, weight * share)
                best[term] = max(best.get(term, 0.0), weight * share)
            total = sum(best.values())
            out[k] = max(best.values()), np.log1p(total), np.log1p(len(mine)), fuzzy, quoted / len(mine), np.log1p(100 * len(mine) / max(1, int(words[k]))), address > 0
        return out


def lower_pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = column_bytes(column)
    for i, j in pieces(offsets):
        yield i, j, LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]


def terms_of(data: np.ndarray, offsets: np.ndarray, row: int) -> set[str]:
    """Words of a text as "word " and their starts as stems."""
    text = data[offsets[row] : offsets[row + 1]]
    starts, ends = word_spans(text, np.array([0, len(text)]), ALNUM)
    out = set()
    for word in {text[a:b].tobytes() for a, b in zip(starts, ends, strict=True)}:
        word = word.decode("utf-8", "replace")
        if len(word) >= 2:
            out.add(word + " ")
            out.update(word[:n] for n in STEM_LENGTHS if n <= len(word))
    return out


def count_terms(wanted: set[str] | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for i, j, data, offsets in lower_pieces(batch.column("text")):
                for k in range(i, j):
                    found = terms_of(data, offsets, k - i)
                    seen[toxic[k]].update(found if wanted is None else found & wanted)
        for label, counts in seen.items():
            items = list(counts.items())
            for i in range(0, len(items), 20_000):
                part = items[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(part), pa.int32()), pa.array([x[0] for x in part]), pa.array([x[1] for x in part], pa.int64())], names=["toxic", "term", "n"])

    return count


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """(text, is a stem, log odds) of the kept terms; ``sample`` is a stored, bounded table."""
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic:
        return []
    schema = "toxic int, term string, n long"
    often = (
        sample.where("toxic = 1").mapInArrow(count_terms(None), schema).groupBy("term").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= LEAST_TEXTS)
    )
    toxic = {r.term: r.n for r in often.collect()}
    clean = {
        r.term: r.n for r in sample.where("toxic = 0").mapInArrow(count_terms(set(toxic)), schema)
        .groupBy("term").agg(F.sum("n").alias("n")).collect()
    }
    odds = {t: float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean.get(t, 0) + 0.5) / (n_clean + 1))) for t, n in toxic.items()}
    # as many terms are tried, chance alone must not explain a kept one
    share = n_toxic / (n_toxic + n_clean)
    by_chance = np.log(max(1, len(odds))) + 2.5

    def evidence(t: str) -> float:
        n, m = toxic[t], clean.get(t, 0)
        return n * np.log(n / ((n + m) * share)) + (m * np.log(m / ((n + m) * (1 - share))) if m else 0.0)

    odds = {t: w for t, w in odds.items() if w >= LEAST_ODDS and evidence(t) >= by_chance}
    kept: dict[str, float] = {}
    for t in sorted(odds, key=lambda t: (len(t), t)):
        bare = t.rstrip(" ")
        # a term that a shorter stem covers as well is left out
        if any(bare[:n] in kept and (bare[:n] != t) and kept[bare[:n]] >= odds[t] - 0.7 for n in STEM_LENGTHS if n <= len(bare)):
            continue
        kept[t] = odds[t]
    # a stem that one word makes is that word
    by_stem: dict[str, tuple[str, int]] = {}
    for t, n in toxic.items():
        if t.endswith(" ") and t in odds:
            for k in STEM_LENGTHS:
                if t[:k] in kept and n > by_stem.get(t[:k], ("", 0))[1]:
                    by_stem[t[:k]] = (t, n)
    terms: dict[tuple[str, bool], float] = {}
    for t, w in kept.items():
        word, n = by_stem.get(t, ("", 0))
        if t.endswith(" "):
            terms[(t[:-1], False)] = w
        elif n >= 0.9 * toxic[t]:
            terms[(word[:-1], False)] = odds[word]
        else:
            terms[(t, True)] = w
    ranked = [(text, stem, weight) for (text, stem), weight in sorted(terms.items(), key=lambda x: (-x[1], x[0]))]
    held = [set(r.terms) for r in sample.where("toxic = 1").mapInArrow(terms_found(ranked), "terms array<int>").collect()]
    return [ranked[k] for k in needed(held)]


def terms_found(terms: list[tuple[str, bool, float]]):
    """For each text the terms that its words are, spelt right; of several the one of highest weight."""
    place = {text if is_stem else text + " ": k for k, (text, is_stem, _) in enumerate(terms)}

    def best(word: str) -> int:
        known = (place.get(t, -1) for t in (word + " ", *(word[:n] for n in STEM_LENGTHS if n <= len(word))))
        return max(known, key=lambda k: (terms[k][2], k) if k >= 0 else (0.0, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, data, offsets in lower_pieces(batch.column("text")):
                out += [sorted({best(t[:-1]) for t in terms_of(data, offsets, k) if t.endswith(" ")} - {-1}) for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], names=["terms"])

    return run


def needed(held: list[set[int]]) -> list[int]:
    """Terms without those that copies of one text brought in: rare terms, none of whose texts
    depends on them, are taken out, the rarest first."""
    often = Counter(t for terms in held for t in terms)
    most = max(often.values(), default=0)
    by_term: dict[int, list[set[int]]] = {}
    for terms in held:
        for t in terms:
            by_term.setdefault(t, []).append(terms)
    for t in sorted(often, key=lambda t: (often[t], t)):
        if 8 * often[t] < most and all(len(terms) > 1 for terms in by_term[t]):
            for terms in by_term[t]:
                terms.discard(t)
            del by_term[t]
    return sorted(by_term)


def feature_rows(terms: list[tuple[str, bool, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms)
        for batch in batches:
            parts = [scanner.features(data, offsets) for _, _, data, offsets in lower_pieces(batch.column("text"))]
            x = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), *(pa.array(x[:, k]) for k in range(FEATURES))], names=["toxic", *(f"x{k}" for k in range(FEATURES))])

    return run


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge; the last weight is the constant."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, bool, float]], np.ndarray]:
    """Lexicon and weights from the labelled rows that are not held out, at most ``SAMPLE`` of them.
    Rows without a label or text are not used, equal texts of one label count once; without toxic
    rows every score is low."""
    spark = docs.sparkSession
    small_batches(spark)
    use = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    chosen = store(
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(use & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE),
        "toxicity-labels",
    )
    sample = store(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("toxic", "text").distinct(), "toxicity-sample")
    terms = learn_lexicon(sample)
    schema = "toxic int, " + ", ".join(f"x{k} double" for k in range(FEATURES))
    rows = np.array([tuple(r) for r in sample.mapInArrow(feature_rows(terms), schema).collect()], np.float64).reshape(-1, FEATURES + 1)
    weights = fit(rows[:, 1:], rows[:, 0]) if len(rows) else np.append(np.zeros(FEATURES), -3.0)
    return terms, weights


def score(docs: DataFrame, terms: list[tuple[str, bool, float]], weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits of every document. Null texts count as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_hits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_pylist()
            x = np.concatenate([scanner.features(data, offsets) for _, _, data, offsets in lower_pieces(batch.column("text"))])
            p = 1 / (1 + np.exp(-np.clip(np.column_stack((x, np.ones(len(x)))) @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(np.rint(np.expm1(x[:, 2])).astype(np.int64))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_hits long")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, *learn(docs, read(spark, sf_dir, "labels")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the score rejects."""
    scored = score(docs, *learn(docs, labels)).where("predicted = 1").select("doc_id")
    return docs.join(scored, "doc_id", "left_anti")
