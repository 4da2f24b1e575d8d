"""LM scoring with Brown classes: a class-based bigram model whose classes come from exchange
clustering of the whole training vocabulary.

1. Documents are gathered: a gathering holds the distinct words of some documents and the documents
   as sequences of them. Gatherings are stored, one row each.
2. A gathering sends its distinct words to the words' buckets, which count them. There are as many
   buckets as the words call for, so that a bucket stays of bounded size.
3. The ``SEEDS`` most frequent words shape the classes: exchange clustering moves one of them at a
   time to the class that raises the likelihood of the class bigrams most, until a round moves none.
   Less frequent words take part as ``TAILS`` symbols by their last byte.
4. Every other training word is then exchanged on its own. Its bucket adds up which classes stand
   before and behind it, in all training documents, and gives it the class that makes these, and
   the word itself, likeliest. Only the class table, of fixed size, is sent to the tasks.
5. Buckets send the words' classes and counts back to the gatherings, whose documents become
   sequences of classes. Class bigrams are counted over all training documents; a text's
   probability is the product, over its tokens and the end, of

    p(class | class before) = (n(before, class) + 0.5) / (n(before) + 0.5 K)
    p(word | class)         = (c(word) + 0.1) / (c(class) + 0.1 (V(class) + 1))

A word that no training document holds has the class most words with its last byte have. The
number of classes grows with the cube root of the vocabulary, from ``CLASSES`` to ``MOST_CLASSES``.
To the driver go the seeds, squared tables of symbols and of classes, and (last byte, class) counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsense.llm.tables import partitions, read
from airsense.llm.text import LOWER, NOT_SPACE, batches_of, column_bytes, pieces, row_words, span_hashes, word_spans
from airsense.sources.stored import store

SEEDS, TAILS = 400, 32
#: Classes at least, and at most (they are kept as bytes).
CLASSES, MOST_CLASSES = 32, 128
ADD = 0.1
#: Tokens that a task gathers, and distinct words of gatherings that a bucket receives, about.
FLUSH, BUCKET = 1_500_000, 4_000_000
#: The class of words without a class yet.
UNSEEN = 255
#: Bytes of an Arrow batch, about, and rows of a Parquet batch, where a row may be a whole gathering.
BATCH_BYTES, PARQUET_ROWS = 4 << 20, 4
#: How tables of such rows are written: zstd works through streams, snappy takes two buffers outside the
#: heap as large as a page, which is a whole row here; pages end with each large row.
LARGE_ROWS = {"compression": "zstd", "parquet.page.size.row.check.min": "1"}
#: Entries (word, class near it) that a bucket weighs at once.
WEIGHED = 8_000

GATHERED = "gathering long, n_words long, ids array<bigint>, lengths binary, tokens binary, hashes binary, tails binary"
GATHERED_ARROW = pa.schema([("gathering", pa.int64()), ("n_words", pa.int64()), ("ids", pa.list_(pa.int64())), *[(x, pa.binary()) for x in ("lengths", "tokens", "hashes", "tails")]])
SENT = "bucket int, gathering long, hashes binary, tails binary, counts binary, n_near binary, near binary, times binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("gathering", pa.int64()), *[(x, pa.binary()) for x in ("hashes", "tails", "counts", "n_near", "near", "times")]])
COUNTED = "hash long, tail int, count long, distinct long"
#: ``kind`` 0: counts and classes of a gathering's words of a bucket; 2: (last byte, class) counts.
CLASSED = "kind int, gathering long, bucket int, counts binary, classes binary"
CLASSED_ARROW = pa.schema([("kind", pa.int32()), ("gathering", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("classes", pa.binary())])
SEQUENCES = "ids array<bigint>, lengths binary, classes binary, known binary, totals binary"
SEQUENCES_ARROW = pa.schema([("ids", pa.list_(pa.int64())), *[(x, pa.binary()) for x in ("lengths", "classes", "known", "totals")]])


def held_out(doc_id: int | None, folds: int = 10) -> bool:
    """Whether a document is kept out of training; one without an id is not."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def documents_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
    """(doc_id, word hashes, last bytes of the words) of each row, A-Z lower-cased."""
    data, offsets = column_bytes(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    for i, j in pieces(offsets):
        part = LOWER[data[offsets[i] : offsets[j]]]
        local = offsets[i : j + 1] - offsets[i]
        starts, ends = word_spans(part, local, NOT_SPACE)
        hashes = span_hashes(part, starts, ends)
        tails = (part[ends - 1] % TAILS).astype(np.uint8)
        bounds = row_words(local, starts)
        for k in range(i, j):
            a, b = bounds[k - i], bounds[k - i + 1]
            yield ids[k], hashes[a:b], tails[a:b]


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a partition sorted by ``key``, those of one value together."""
    for value, rows in groupby((r for b in batches for r in b.to_pylist()), lambda r: r[key]):
        yield value, list(rows)


def numbers(row: dict, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gatherings of a partition's documents, numbered within the partition."""
    task, made = TaskContext.get().partitionId(), 0

    def row(held: list[tuple]) -> pa.RecordBatch:
        hashes, first, tokens = np.unique(np.concatenate([h for _, h, _ in held]), return_index=True, return_inverse=True)
        tails = np.concatenate([t for _, _, t in held])[first]
        lengths = np.array([len(h) for _, h, _ in held], np.int64)
        return rows_of([((task << 32) + made, len(hashes), [x[0] for x in held], lengths.tobytes(), tokens.astype(np.uint32).tobytes(), hashes.tobytes(), tails.tobytes())], GATHERED_ARROW)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for x in documents_of(batch):
            held.append(x)
            size += len(x[1]) + 1
            if size >= FLUSH:
                yield row(held)
                held, size, made = [], 0, made + 1
    if held:
        yield row(held)


def trained(row: dict) -> np.ndarray:
    return np.array([not held_out(i) for i in row["ids"]], bool)


def with_ends(values: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' values in order with ``end`` before, between and after them, and for each step
    from one to the next the document it belongs to."""
    inside = inside_of(lengths)
    out = np.full(len(inside), end, np.int64)
    out[inside] = values
    return out, np.repeat(np.arange(len(lengths)), lengths + 1)


def inside_of(lengths: np.ndarray) -> np.ndarray:
    """Whether a place holds a word, in documents with an end before, between and after them."""
    inside = np.ones(int(lengths.sum()) + len(lengths) + 1, bool)
    inside[0] = inside[np.cumsum(lengths + 1)] = False
    return inside


def small_enough(values: int) -> type:
    """The type of whole numbers up to ``values``; half the memory for nearly all gatherings and buckets."""
    return np.uint32 if values < 1 << 32 else np.int64


def neighbours(row: dict, own: np.ndarray, k: int, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the words' entries, the class behind a word or ``k`` + 1 more than that before it, and
    how often, over the tokens in ``use``; ``own`` is the class of each word, ``k`` that of an end."""
    tokens, inside = numbers(row, "tokens", np.uint32), inside_of(numbers(row, "lengths", np.int64))
    line = np.full(len(inside), k, np.uint8)
    line[inside] = own.astype(np.uint8)[tokens]
    middle, width = inside[1:-1], 2 * k + 2
    kind, n = small_enough(len(own) * width), int(use.sum())
    pair = np.empty(2 * n, kind)
    pair[:n] = tokens[use]
    pair[:n] *= kind(width)
    pair[n:] = pair[:n]
    pair[:n] += line[2:][middle][use]
    pair[n:] += line[:-2][middle][use]
    pair[n:] += kind(k + 1)
    pair.sort()
    first = firsts(pair)
    times = np.diff(np.append(first, len(pair))).astype(np.uint32)
    pair = pair[first]
    return np.searchsorted(pair, (np.arange(len(own) + 1) * width).astype(kind)), (pair % kind(width)).astype(np.uint16), times


def firsts(values: np.ndarray) -> np.ndarray:
    """Where a value of a sorted list comes first."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of words by bucket, the buckets in it and the bounds of their words."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    return order, used, np.append(first, len(order))


def sender(buckets: int, seeds: np.ndarray | None = None, label: np.ndarray | None = None):
    """Distinct words of gatherings, with counts in training documents, to their buckets; with
    ``label`` (classes of symbols) also the classes before and behind them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, tails, tokens, lengths = numbers(row, "hashes", np.uint64), numbers(row, "tails", np.uint8), numbers(row, "tokens", np.uint32), numbers(row, "lengths", np.int64)
                use = np.repeat(trained(row), lengths)
                counts = np.bincount(tokens[use], minlength=len(hashes)).astype(np.uint32)
                near = None
                if label is not None:
                    k = int(label.max())  # the end's class is the last
                    bounds, near, times = neighbours(row, label[symbols(hashes, tails, seeds)], k, use)
                    n_near = np.diff(bounds)
                order, used, cuts = by_bucket(hashes, buckets)
                for b, low, high in zip(used, cuts[:-1], cuts[1:], strict=True):
                    mine, entries = order[low:high], (b"", b"", b"")
                    if near is not None:
                        n = n_near[mine]
                        some = np.repeat(bounds[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                        entries = n.astype(np.uint16).tobytes(), near[some].tobytes(), times[some].tobytes()
                    yield rows_of([(int(b), row["gathering"], hashes[mine].tobytes(), tails[mine].tobytes(), counts[mine].tobytes(), *entries)], SENT_ARROW)

    return send


def add_up(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, their last bytes, their counts, place of each row's words in them) of a bucket."""
    words, first, back = np.unique(np.concatenate([numbers(r, "hashes", np.uint64) for r in rows]), return_index=True, return_inverse=True)
    counts = np.zeros(len(words), np.int64)
    np.add.at(counts, back, np.concatenate([numbers(r, "counts", np.uint32) for r in rows]))
    return words, np.concatenate([numbers(r, "tails", np.uint8) for r in rows])[first], counts, back


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent words of each bucket, and a row without a word: all tokens and words."""
    names = ["hash", "tail", "count", "distinct"]
    for _, rows in runs(batches, "bucket"):
        words, tails, counts, _ = add_up(rows)
        best = np.lexsort((words.view(np.int64), -counts))[:SEEDS]
        best = best[counts[best] > 0]
        yield pa.RecordBatch.from_arrays([
            pa.array([*words[best].view(np.int64).tolist(), None], pa.int64()), pa.array([*tails[best].tolist(), None], pa.int32()),
            pa.array([*counts[best].tolist(), int(counts.sum())], pa.int64()), pa.array([*[1] * len(best), int((counts > 0).sum())], pa.int64()),
        ], names=names)


def symbols(hashes: np.ndarray, tails: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Symbols of words: a seed's place among the ``seeds`` (sorted), else one by its last byte."""
    out = len(seeds) + tails.astype(np.int64)
    if len(seeds):
        place = np.minimum(np.searchsorted(seeds, hashes), len(seeds) - 1)
        out = np.where(seeds[place] == hashes, place, out)
    return out


def bigram_counter(size: int, line_of):
    """Bigrams of the training documents; ``line_of`` gives a row's values, the end is the last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                line, doc = with_ends(line_of(row), numbers(row, "lengths", np.int64), size - 1)
                total += np.bincount((line[:-1] * size + line[1:])[trained(row)[doc]], minlength=size * size)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(total[at[i : i + 50_000]])], names=["bigram", "times"])

    return count


def bigrams_of(rows: DataFrame, size: int, line_of) -> np.ndarray:
    out = np.zeros(size * size, np.int64)
    for r in rows.mapInArrow(bigram_counter(size, line_of), "bigram long, times long").groupBy("bigram").agg(F.sum("times").alias("times")).collect():
        out[r.bigram] = r.times
    return out.reshape(size, size)


def plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_clusters(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """A class for each symbol: the last symbol (the end) has the last class to itself.

    Starts with symbols dealt by frequency; a round takes each symbol out of its class and puts it
    where the likelihood, sum n log n over class bigrams less both margins, grows most.
    """
    n = len(bigrams) - 1
    classes = max(1, min(classes, n))
    order = np.argsort(-bigrams[:-1].sum(1), kind="stable")
    label = np.empty(n + 1, np.int64)
    label[order] = np.arange(n) % classes
    label[n] = classes
    onehot = np.zeros((n + 1, classes + 1))
    onehot[np.arange(n + 1), label] = 1
    big = bigrams.astype(np.float64)
    table = onehot.T @ big @ onehot
    for _ in range(rounds):
        moved = 0
        for w in order:
            old = label[w]
            onehot[w, old] = 0
            out, back, own = big[w] @ onehot, big[:, w] @ onehot, big[w, w]
            table[old, :] -= out
            table[:, old] -= back
            table[old, old] -= own
            # both sides of every class; where they meet the word is added at once
            gain = (plogp(table + out) - plogp(table)).sum(1) + (plogp(table + back[:, None]) - plogp(table)).sum(0)
            meet = table.diagonal()
            gain += plogp(meet + out + back + own) - plogp(meet + out) - plogp(meet + back) + plogp(meet)
            before, behind = table.sum(1) + back, table.sum(0) + out
            gain -= plogp(before + out.sum() + own) - plogp(before) + plogp(behind + back.sum() + own) - plogp(behind)
            best = int(np.argmax(gain[:classes]))
            at = best if gain[best] > gain[old] + 1e-9 else old
            table[at, :] += out
            table[:, at] += back
            table[at, at] += own
            onehot[w, at] = 1
            label[w] = at
            moved += at != old
        if not moved:
            break
    return label


def fit_of_classes(between: np.ndarray) -> np.ndarray:
    """Log probability, by class of a word (columns), of a class behind it and of one before it (rows);
    the latter with the word's share of its class."""
    k = len(between) - 1
    step = np.log((between + 0.5) / (between.sum(1, keepdims=True) + 0.5 * (k + 1)))
    return np.concatenate((step[:k].T, step[:, :k] - np.log(between.sum(0)[:k] + 0.5)))


def classes_of(words: int, at: np.ndarray, near: np.ndarray, times: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """The likeliest class of each word from (word, class near it, times); ties: the smaller class."""
    out = np.full(words, UNSEEN, np.uint8)
    kind = small_enough(words * len(fit))
    pair = at.astype(kind)
    pair *= kind(len(fit))
    pair += near.astype(kind)
    order = np.argsort(pair, kind="stable")
    pair, times = pair[order], times[order]
    first = firsts(pair)
    times = np.add.reduceat(times, first, dtype=np.float64) if len(first) else np.zeros(0)
    pair = pair[first]
    word, near = pair // kind(len(fit)), pair % kind(len(fit))
    first = firsts(word)
    i = 0
    while i < len(first):
        # words with about ``WEIGHED`` entries together
        j = max(i + 1, int(np.searchsorted(first, first[i] + WEIGHED)))
        low, high = int(first[i]), int(first[j]) if j < len(first) else len(word)
        value = np.add.reduceat(fit[near[low:high]] * times[low:high, None], first[i:j] - low)
        out[word[first[i:j]]] = np.argmax(value, 1)
        i = j
    return out


def class_giver(seeds: np.ndarray, label: np.ndarray, fit: np.ndarray):
    """Classes of a bucket's words, sent to the gatherings that hold them."""
    k = int(label.max())

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((TAILS, k + 1), np.int64)
        for bucket, rows in runs(batches, "bucket"):
            words, tails, counts, back = add_up(rows)
            at = np.repeat(back.astype(small_enough(len(words))), np.concatenate([numbers(r, "n_near", np.uint16) for r in rows]))
            near, times = (np.concatenate([numbers(r, x, t) for r in rows]) for x, t in (("near", np.uint16), ("times", np.uint32)))
            own = classes_of(len(words), at, near, times, fit)
            place = symbols(words, np.zeros(len(words), np.uint8), seeds)
            own = np.where((place < len(seeds)) & (counts > 0), label[np.minimum(place, len(label) - 1)], own).astype(np.uint8)
            np.add.at(table, (tails[counts > 0], own[counts > 0]), 1)
            low = 0
            for r in rows:
                mine = back[low : low + len(r["tails"])]
                low += len(mine)
                yield rows_of([(0, r["gathering"], bucket, counts[mine].tobytes(), own[mine].tobytes())], CLASSED_ARROW)
        yield rows_of([(2, None, None, table.tobytes(), None)], CLASSED_ARROW)

    return give


def attacher(buckets: int, of_tail: np.ndarray):
    """Documents of gatherings as classes, with how many tokens are known and the sum of
    log10(count + 0.1); the words' classes come before the gathering itself."""

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "gathering"):
            row = rows.pop()
            hashes, lengths, tokens = numbers(row, "hashes", np.uint64), numbers(row, "lengths", np.int64), numbers(row, "tokens", np.uint32)
            counts, own = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.uint8)
            order, used, cuts = by_bucket(hashes, buckets)
            sent = {r["bucket"]: r for r in rows}
            for b, low, high in zip(used.tolist(), cuts[:-1], cuts[1:], strict=True):
                counts[order[low:high]], own[order[low:high]] = numbers(sent[b], "counts", np.int64), numbers(sent[b], "classes", np.uint8)
            own = np.where(own == UNSEEN, of_tail[numbers(row, "tails", np.uint8)], own).astype(np.uint8)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            known = np.bincount(doc, counts[tokens] > 0, len(lengths)).astype(np.int64)
            totals = np.bincount(doc, np.log10(counts + ADD)[tokens], len(lengths)).astype(np.float64)
            yield rows_of([(row["ids"], row["lengths"], own[tokens].tobytes(), known.tobytes(), totals.tobytes())], SEQUENCES_ARROW)

    return attach


def scorer(step: np.ndarray, emit: np.ndarray, ends: int, below: float, n_all: int):
    """Scores of documents given as classes; ``emit`` is log10 of a class's size, ``below`` that of all
    tokens; ``ends`` of the ``n_all`` training tokens are ends."""
    end = float(np.log10(ends + ADD))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, known, totals = numbers(row, "lengths", np.int64), numbers(row, "known", np.int64), numbers(row, "totals", np.float64)
                line, doc = with_ends(numbers(row, "classes", np.uint8), lengths, len(step) - 1)
                local = np.bincount(doc, step[line[:-1], line[1:]] - emit[line[1:]], len(lengths))
                n = lengths + 1
                all_scores = local + totals
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(~trained(row)), pa.array(n), pa.array(known + (ends > 0)), pa.array(np.full(len(n), n_all, np.int64)),
                    pa.array(totals + end - n * below), pa.array(all_scores), pa.array(10.0 ** (-all_scores / n)),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity per token
    of every row, repeated rows and rows without an id too; the latter are trained on. Null texts are
    empty: one token, the end. Without training documents every count is 0."""
    spark: SparkSession = docs.sparkSession
    with batches_of(spark, 1000):
        gathered = store(docs.select("doc_id", "text").mapInArrow(gather, GATHERED), "lm-gathered", **LARGE_ROWS)
    # a row is a whole gathering from here on, or a message, of which many fit a batch
    with batches_of(spark, 1000, BATCH_BYTES, PARQUET_ROWS):
        entries = gathered.agg(F.sum("n_words")).first()[0] or 0
        buckets = max(partitions(spark), -(-entries // BUCKET))
        counted = store(gathered.mapInArrow(sender(buckets), SENT).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count_buckets, COUNTED), "lm-counted")
        best = counted.where("hash is not null").orderBy(F.desc("count"), "hash").limit(SEEDS).collect()
        seeds = np.sort(np.array([r.hash & 0xFFFFFFFFFFFFFFFF for r in best], np.uint64))
        tokens, distinct = counted.where("hash is null").agg(F.sum("count"), F.sum("distinct")).first()
        size = len(seeds) + TAILS + 1

        def seed_line(row: dict) -> np.ndarray:
            return symbols(numbers(row, "hashes", np.uint64), numbers(row, "tails", np.uint8), seeds)[numbers(row, "tokens", np.uint32)]

        bigrams = bigrams_of(gathered, size, seed_line)
        label = exchange_clusters(bigrams, int(np.clip(round((distinct or 0) ** (1 / 3)), CLASSES, MOST_CLASSES)))
        k = int(label.max())
        onehot = np.eye(k + 1)[label]
        fit = fit_of_classes(onehot.T @ bigrams @ onehot)
        classed = store(
            gathered.mapInArrow(sender(buckets, seeds, label), SENT).repartition(buckets, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(class_giver(seeds, label, fit), CLASSED), "lm-classed", **LARGE_ROWS,
        )
        by_tail = np.zeros((TAILS, k + 1), np.int64)
        for r in classed.where("kind = 2").select("counts").toLocalIterator():
            by_tail += np.frombuffer(r.counts, np.int64).reshape(by_tail.shape)
        words = classed.where("kind = 0").withColumns({x: F.lit(None).cast(t) for x, t in (("ids", "array<bigint>"), *((y, "binary") for y in ("lengths", "tokens", "hashes", "tails")))})
        whole = gathered.withColumns({"kind": F.lit(1), "bucket": F.lit(None).cast("int"), "counts": F.lit(None).cast("binary"), "classes": F.lit(None).cast("binary")}).drop("n_words")
        both = words.unionByName(whole).repartition(partitions(spark), "gathering").sortWithinPartitions("gathering", "kind")
        lines = store(both.mapInArrow(attacher(buckets, by_tail.argmax(1)), SEQUENCES), "lm-sequences", **LARGE_ROWS)
        between = bigrams_of(lines, k + 1, lambda row: numbers(row, "classes", np.uint8)).astype(np.float64)
        step = np.log10((between + 0.5) / (between.sum(1, keepdims=True) + 0.5 * (k + 1)))
        emit = np.log10(between.sum(0) + ADD * (by_tail.sum(0) + 1))
        emit[k] = 0.0  # the end is the only word of its class
        ends = int(between[:, k].sum())
        n_all, v_all = (tokens or 0) + ends, (distinct or 0) + (ends > 0)
        below = float(np.log10(n_all + ADD * (v_all + 1)))
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
        return store(lines.mapInArrow(scorer(step, emit, ends, below, n_all), schema), "lm-scores")


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
