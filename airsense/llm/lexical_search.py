"""Ranked lexical search by best-first document intervals over range-maximum tables.

* Index: one pass over the documents cuts whole texts into terms and keeps, per shard of documents,
  a posting list (documents, occurrences) of every term that some query has, with the shares of the
  corpus figures N, L and df. The shards are a stored table.
* Impacts: what a term gives a document's score depends on the document alone, so each posting list
  becomes a list of integers, and a sparse table over it answers the largest one between any two
  places at once.
* Search, per shard and query: intervals of documents wait in order of their bound, the sum over the
  terms of the largest impact within. The best ones are cut at the document of the largest impact:
  that document is scored, what lies left and right of it becomes two intervals with lower bounds.
  Intervals of few postings are scored whole. An interval whose bound cannot enter the best ``top``
  any more is dropped, so the answer is exact; equal scores prefer the smaller document.
* The shards' best are ranked once more per query: ``top`` rows per shard and query are shuffled.

Queries travel to the tasks in blocks of about ``QUERY_BYTES`` of text, each with its own passes, so
that what is broadcast is bounded whatever the number of queries. A shard holds ``SHARD_POSTINGS``
postings at most beyond one Arrow batch. A long text is read in parts; no text is cut.

Null and empty texts have no terms: such documents do not count in N and are never found, such
queries give no rows. Every row is a document and every query row a query, repeated ids included;
with equal scores and ids the order of repeated rows has no meaning. A null ``doc_id`` comes last
among equal scores. Empty tables give no rows. Other columns are ignored, whatever their names.
Terms are compared by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsense.llm.tables import read
from airsense.llm.text import ALNUM, LOWER, column_bytes, row_words, segments, span_hashes, word_spans
from airsense.sources.stored import store

TOP = 10
#: Bytes of query texts that one pair of passes serves.
QUERY_BYTES = 4 << 20
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 3_000_000
#: Intervals taken at a time, and postings up to which an interval is scored whole.
TAKEN, LEAF = 64, 256
DOCS, TERMS_IN_ALL = -1, -2

SHARDS = T.StructType([
    T.StructField("ids", T.BinaryType()), T.StructField("unknown", T.BinaryType()), T.StructField("n", T.BinaryType()), T.StructField("terms", T.BinaryType()),
    T.StructField("lengths", T.BinaryType()), T.StructField("docs", T.BinaryType()), T.StructField("tf", T.BinaryType()),
    T.StructField("term", T.IntegerType()), T.StructField("df", T.LongType()),
])
ARROW_SHARDS = pa.schema([*[(c, pa.binary()) for c in ("ids", "unknown", "n", "terms", "lengths", "docs", "tf")], ("term", pa.int32()), ("df", pa.int64())])
HITS = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
ARROW_HITS = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def term_counts(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each row, then row, term, occurrences of what is in ``vocabulary``, by row)."""
    data, offsets = column_bytes(column)
    size = max(1, len(vocabulary))
    n = np.zeros(len(offsets) - 1, np.int64)
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, part, local in segments(data, offsets, ALNUM):
        part = LOWER[part]
        starts, ends = word_spans(part, local, ALNUM)
        bounds = row_words(local, starts)
        n[first : first + len(local) - 1] += np.diff(bounds)
        if not len(vocabulary):
            continue
        hashes = span_hashes(part, starts, ends)
        place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = np.flatnonzero(vocabulary[place] == hashes)
        row = np.searchsorted(bounds, known, "right") - 1
        key, count = np.unique((first + row) * size + place[known], return_counts=True)
        keys.append(key)
        times.append(count)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, back, np.concatenate(times))  # a long row may come in parts
    return n, key // size, key % size, count


def indexer(vocabulary: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        seen = length = 0
        held: list[tuple[np.ndarray, ...]] = []
        docs = postings = 0

        def shard() -> pa.RecordBatch:
            ids, unknown, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            base = np.cumsum([0, *[len(h[0]) for h in held]])
            row = np.concatenate([h[3] + b for h, b in zip(held, base, strict=False)])
            term, tf = (np.concatenate([h[k] for h in held]) for k in (4, 5))
            order = np.lexsort((ids, unknown))
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            by_term = np.lexsort((rank[row], term))
            terms, lengths = np.unique(term, return_counts=True)
            cells = [ids[order], unknown[order], n[order], terms.astype(np.int32), lengths.astype(np.int32), rank[row][by_term].astype(np.int32), tf[by_term].astype(np.int64)]
            return pa.RecordBatch.from_arrays([*[pa.array([c.tobytes()], pa.binary()) for c in cells], pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())], schema=ARROW_SHARDS)

        for batch in batches:
            n, row, term, tf = term_counts(batch.column("text"), vocabulary)
            seen += int((n > 0).sum())
            length += int(n.sum())
            df += np.bincount(term, minlength=len(vocabulary))
            # only documents that hold a term of a query can be found
            some, row = np.unique(row, return_inverse=True)
            unknown = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
            held.append((ids[some], unknown[some], n[some], row, term, tf))
            docs += len(some)
            postings += len(term)
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield shard()
                held, docs, postings = [], 0, 0
        if postings:
            yield shard()
        known = np.flatnonzero(df)
        term = np.concatenate((known, [DOCS, TERMS_IN_ALL])).astype(np.int32)
        none = pa.nulls(len(term), pa.binary())
        yield pa.RecordBatch.from_arrays([none] * 7 + [pa.array(term), pa.array(np.concatenate((df[known], [seen, length])))], schema=ARROW_SHARDS)

    return index


class Shard:
    """Posting lists of impacts with their range-maximum tables, longest list first: the table of
    level j, whose entries cover 2**j places, needs the lists of that length and more only."""

    def __init__(self, n_docs: int, terms: np.ndarray, lengths: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        old = np.cumsum(lengths) - lengths
        self.lengths = lengths[order].astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        at = np.repeat(old[order] - self.starts, self.lengths) + np.arange(len(docs))
        self.docs, self.impacts = docs[at], impacts[at]
        self.place = {int(t): k for k, t in enumerate(terms[order])}
        self.n_docs = n_docs
        #: sorted: (list, document) of every posting
        self.keys = np.repeat(np.arange(len(order)) * n_docs, self.lengths) + self.docs
        levels = [np.arange(len(docs), dtype=np.int32)]
        most = int(self.lengths[0]) if len(self.lengths) else 0
        while 2 << (len(levels) - 1) <= most:
            width = 1 << len(levels)
            inside = int(self.lengths[self.lengths >= width].sum())
            left, right = levels[-1][: inside - width + 1], levels[-1][width // 2 : inside - width // 2 + 1]
            # the left one on equal impacts
            levels.append(np.where(self.impacts[left] >= self.impacts[right], left, right))
        self.offsets = np.cumsum([0, *[len(x) for x in levels]])[:-1]
        self.table = np.concatenate(levels)
        self.log = np.zeros(most + 1, np.int64)
        for j in range(1, len(levels)):
            self.log[1 << j :] = j

    def largest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest impact between places of a list, and its place; impact 0 where there are none."""
        some = high > low
        low, high = np.where(some, low, 0), np.where(some, high, 1)
        level = self.log[high - low]
        one = self.table[self.offsets[level] + low]
        two = self.table[self.offsets[level] + high - (1 << level)]
        place = np.where(self.impacts[one] >= self.impacts[two], one, two)
        return np.where(some, self.impacts[place], 0), place

    def best(self, terms: list[int], top: int) -> tuple[list[tuple[int, int]], int]:
        """The ``top`` (score, document) of a query, best first, and the number of documents scored."""
        lists = np.array([self.place[t] for t in terms if t in self.place], np.int64)
        found_docs, found_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(lists):
            return [], 0
        scored = 0

        def offer(docs: np.ndarray, scores: np.ndarray) -> None:
            nonlocal found_docs, found_scores, scored
            scored += len(docs)
            docs, scores = np.concatenate((found_docs, docs)), np.concatenate((found_scores, scores))
            keep = np.lexsort((docs, -scores))[:top]
            found_docs, found_scores = docs[keep], scores[keep]

        def bounded(first: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
            values, places = self.largest(low, high)
            cut = self.docs[places[np.arange(len(values)), values.argmax(1)]]
            return values.sum(1), first, cut, low, high

        waiting = bounded(np.zeros(1, np.int64), self.starts[lists][None], (self.starts + self.lengths)[lists][None])
        while True:
            bound, first = waiting[:2]
            alive = bound > 0
            if len(found_docs) == top:
                # equal scores: only a smaller document is better
                alive &= (bound > found_scores[-1]) | ((bound == found_scores[-1]) & (first < found_docs[-1]))
            waiting = tuple(w[alive] for w in waiting)
            bound, first, cut, low, high = waiting
            if not len(bound):
                return list(zip(found_scores.tolist(), found_docs.tolist(), strict=True)), scored
            take = np.argpartition(-bound, TAKEN)[:TAKEN] if len(bound) > TAKEN else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[take] = False
            size = (high[take] - low[take]).sum(1)
            leaf, split = take[size <= LEAF], take[size > LEAF]
            if len(leaf):
                begin, count = low[leaf].ravel(), (high[leaf] - low[leaf]).ravel()
                at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                by_doc = at[np.argsort(self.docs[at], kind="stable")]
                docs, heads = np.unique(self.docs[by_doc], return_index=True)
                offer(docs.astype(np.int64), np.add.reduceat(self.impacts[by_doc], heads))
            parts = [tuple(w[rest] for w in waiting)]
            if len(split):
                want = lists * self.n_docs + cut[split][:, None]
                at = np.searchsorted(self.keys, want)
                hit = self.keys[np.minimum(at, len(self.keys) - 1)] == want
                offer(cut[split].astype(np.int64), np.where(hit, self.impacts[np.minimum(at, len(self.keys) - 1)], 0).sum(1))
                parts.append(bounded(first[split], low[split], at))
                parts.append(bounded(cut[split] + 1, at + hit, high[split]))
            waiting = tuple(np.concatenate(w) for w in zip(*parts, strict=True))


def impacts_of(tf: np.ndarray, length: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 90 + (90 * length * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def weight_of(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def searcher(queries: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = {c: batch.column(c)[k].as_py() for c in ("ids", "unknown", "n", "terms", "lengths", "docs", "tf")}
                ids, unknown, n = np.frombuffer(cell["ids"], np.int64), np.frombuffer(cell["unknown"], bool), np.frombuffer(cell["n"], np.int64)
                terms, lengths = np.frombuffer(cell["terms"], np.int32), np.frombuffer(cell["lengths"], np.int32).astype(np.int64)
                docs, tf = np.frombuffer(cell["docs"], np.int32), np.frombuffer(cell["tf"], np.int64)
                shard = Shard(len(ids), terms, lengths, docs, impacts_of(tf, n[docs], np.repeat(weights[terms], lengths), n_docs, n_terms))
                hits = [(q, None if unknown[d] else int(ids[d]), s) for q, query in enumerate(queries) for s, d in shard.best(query, top)[0]]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*hits, strict=True), ARROW_HITS, strict=True)], schema=ARROW_HITS)

    return search


@dataclass(frozen=True)
class Queries:
    ids: list
    #: of every query, its terms as places in the vocabulary
    terms: list[list[int]]
    vocabulary: np.ndarray


def parse(ids: list, texts: list) -> Queries:
    data, offsets = column_bytes(pa.array(texts, pa.large_string()))
    data = LOWER[data] if len(data) else data
    starts, ends = word_spans(data, offsets, ALNUM)
    bounds = row_words(offsets, starts)
    vocabulary, place = np.unique(span_hashes(data, starts, ends), return_inverse=True)
    return Queries(ids, [np.unique(place[a:b]).tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], vocabulary)


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """Queries in blocks of about ``QUERY_BYTES``."""
    items = items.where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // QUERY_BYTES)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if rows:
            yield parse([r.item_id for r in rows], [r.text for r in rows])


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents (doc_id, text) of every item (item_id, text)."""
    spark: SparkSession = docs.sparkSession
    docs, items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items.select("item_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()
    found = []
    for block in query_blocks(items):
        index = store(docs.mapInArrow(indexer(block.vocabulary), SHARDS), "search-index")
        figures = {r.term: r.df for r in index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        n_docs, n_terms = figures.pop(DOCS, 0), figures.pop(TERMS_IN_ALL, 0)
        if not figures:
            continue
        weights = np.zeros(len(block.vocabulary), np.int64)
        for term, df in figures.items():
            weights[term] = weight_of(df, n_docs)
        hits = index.where("term is null").drop("term", "df").mapInArrow(searcher(block.terms, weights, n_docs, n_terms, top), HITS)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        # a row per query of the block
        names = F.broadcast(spark.createDataFrame(list(enumerate(block.ids)), f"query int, item_id {kind}"))
        found.append(ranked.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = r"list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"

ORACLE = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
counted AS (SELECT r, doc_id, len(terms) AS n FROM doc WHERE len(terms) > 0),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM counted),
item AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark),
wanted AS (SELECT DISTINCT i, item_id, unnest(terms) AS term FROM item),
posting AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM doc) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), corpus),
scored AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM wanted JOIN posting USING (term) JOIN weight USING (term) JOIN counted USING (r), corpus GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}
"""
