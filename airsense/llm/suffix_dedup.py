"""Suffix-array dedup: every byte within a 200-byte string that also starts elsewhere.

A full suffix array of the corpus does not fit a task, so repeated strings are first brought
together. Of every run of 137 successive 64-byte strings the one with the smallest hash is an
*anchor*; a 200-byte string holds 137 of them, so equal 200-byte strings hold equal anchors at equal
places. The span of an anchor is the 336 bytes that all 200-byte strings around it cover.

* Anchors that occur once are dropped, by one shuffle on their hash. Equal anchors at equal places of
  equal spans collapse before that shuffle: all their strings are repeated. Two equal anchors in one
  short text may both have the whole text as their span; their places in it keep them apart.
* What is left per anchor is a small collection of distinct spans. Its occurrences, sorted by what
  follows (a suffix array), form the first interval. Backward extension by one byte at a time, all
  intervals breadth first, splits intervals by the byte before (their Burrows-Wheeler column), so
  common prefixes come up by increasing length: an interval with j bytes to the left and a common
  prefix of 136 - j bytes beyond the anchor to the right is a repeated string of exactly 200 bytes.
  Intervals of one occurrence are dropped; extension ends at the minimum length.
* An anchor with very many distinct spans (a passage that a large part of all documents holds) is
  not gathered in one task: its spans are cut into their 200-byte strings, which are counted with
  partial sums before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsense.llm.tables import partitions, read
from airsense.llm.text import _powers, column_bytes, mix, pieces, small_batches
from airsense.sources.stored import store

LENGTH, ANCHOR = 200, 64
REACH = LENGTH - ANCHOR
#: Anchors that a task gathers before it emits them.
FLUSH = 1_000_000
#: Distinct spans of one anchor in a gathering, and in all, from which it counts as hot.
HOT_LOCAL, HOT_GROUP = 256, 4096
ASK, SPAN, HOT_MARK, EDGE, HOT = 0, 1, 2, 3, 4
_ODD = np.uint64(0xD6E8FEB86659FD93)

ROWS = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("c", T.LongType()),
    T.StructField("n", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("pos", T.LongType()),
    T.StructField("before", T.IntegerType()), T.StructField("after", T.LongType()),
])
ROWS_ARROW = pa.schema([
    ("kind", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("doc_id", pa.int64()), ("pos", pa.int64()),
    ("before", pa.int32()), ("after", pa.int64()),
])
SPANS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
CONTEXTS = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("pos", T.LongType()), T.StructField("before", T.IntegerType()), T.StructField("after", T.LongType()),
    T.StructField("bytes", T.BinaryType()),
])


def _sliding(x: np.ndarray, op: np.ufunc, width: int) -> np.ndarray:
    """op over all runs of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: -(width - done)], x[width - done :]) if width > done else x


def find_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, hash) of the anchors of rows that lie one after another."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, np.zeros(0, np.uint64)
    powers, inverses = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
    hashes = mix((total[ANCHOR:] - total[:-ANCHOR]) * inverses[: len(data) - ANCHOR + 1]) | np.uint64(1)
    least = _sliding(hashes, np.minimum, REACH + 1)
    # strings that would cross the end of a row have no anchor
    for end in offsets[1:-1]:
        least[max(0, end - LENGTH + 1) : end] = 0
    most = _sliding(np.concatenate((np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64))), np.maximum, REACH + 1)
    at = np.flatnonzero(most == hashes)
    row = np.searchsorted(offsets, at, "right") - 1
    return row, at - offsets[row], hashes[at]


def span_ids(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, from running sums."""
    powers, inverses = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((mix(data.astype(np.uint64) + np.uint64(7))) * powers[: len(data)], out=total[1:])
    return mix((total[hi] - total[lo]) * inverses[lo] + (hi - lo).astype(np.uint64) * _ODD)


def place_ids(data: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A hash of the span around each anchor and of the anchor's place in it: anchors with equal ids
    have their equal spans at different places of the corpus."""
    return mix(span_ids(data, at - before, at + ANCHOR + after) + before.astype(np.uint64) * _ODD)


def anchors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place, hash, hash of span and place in it, bytes before, bytes after) in pieces of bounded size. A row
    longer than a piece is cut into parts that overlap by a string less one byte."""
    data, offsets = column_bytes(column)
    part = 1 << 20
    for i, j in pieces(offsets, part):
        if j == i + 1 and offsets[j] - offsets[i] > 2 * part:
            n = int(offsets[j] - offsets[i])
            text = data[offsets[i] : offsets[j]]
            for a in range(0, n - LENGTH + 1, part):
                b = min(n, a + part + LENGTH - 1)
                _, at, h = find_anchors(text[a:b], np.array([0, b - a]))
                at = at + a
                lo, hi = max(0, a - REACH), min(n, b + REACH)
                before, after = np.minimum(at, REACH), np.minimum(n - ANCHOR - at, REACH)
                c = place_ids(text[lo:hi], at - lo, before, after)
                yield np.full(len(at), i), at, h, c, before, after
            continue
        text = data[offsets[i] : offsets[j]]
        local = offsets[i : j + 1] - offsets[i]
        row, at, h = find_anchors(text, local)
        if len(at):
            size = (local[1:] - local[:-1])[row]
            before, after = np.minimum(at, REACH), np.minimum(size - ANCHOR - at, REACH)
            start = local[row] + at
            yield row + i, at, h, place_ids(text, start, before, after), before, after


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document united where they overlap or touch."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    heads = np.concatenate(([True], doc[1:] != doc[:-1]))
    # running ends within documents: lift each document above the one before
    lift = np.cumsum(heads) * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + lift) - lift
    new = heads.copy()
    new[1:] |= lo[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], lo[first], reach[np.append(first[1:], len(doc)) - 1]


def _batch(kind: int, h, c, n, doc, pos, before, after) -> pa.RecordBatch:
    size = len(doc)
    full = lambda x, t: np.broadcast_to(np.asarray(x, t), size)
    return pa.RecordBatch.from_arrays(
        [pa.array(full(kind, np.int32)), pa.array(full(h, np.int64)), pa.array(full(c, np.int64)), pa.array(full(n, np.int32)), pa.array(full(doc, np.int64)), pa.array(full(pos, np.int64)), pa.array(full(before, np.int32)), pa.array(full(after, np.int64))],
        schema=ROWS_ARROW,
    )


def _cut(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _heads(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors by gathering: one row for equal spans (n: 1 or 2 for more), the spans themselves
    where they occurred twice here already, marks of anchors that are hot here."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        doc, at, h, c, before, after = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, doc, c, h))
        doc, at, h, c, before, after = (x[order] for x in (doc, at, h.view(np.int64), c.view(np.int64), before, after))
        # an anchor found in two parts of a long text is one anchor
        once = _heads(h, c, doc, at)
        doc, at, h, c, before, after = (x[once] for x in (doc, at, h, c, before, after))
        head = _heads(h, c)
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(h)))
        many = np.repeat(count > 1, count)
        d, lo, hi = merged(doc[many], (at - before)[many], (at + ANCHOR + after)[many])
        yield from _cut(_batch(SPAN, d, 0, 0, d, lo, 0, hi))
        doc, at, h, c, before, after = (x[first] for x in (doc, at, h, c, before, after))
        yield from _cut(_batch(ASK, h, c, np.minimum(count, 2), doc, at, before, after))
        starts = np.flatnonzero(_heads(h))
        spans = np.diff(np.append(starts, len(h)))
        hot = h[starts[spans > HOT_LOCAL]]
        yield from _cut(_batch(HOT_MARK, hot, 0, 0, np.zeros(len(hot)), 0, 0, 0))

    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for row, at, h, c, before, after in anchors_of(batch.column("text")):
            held.append((ids[row], at, h, c, before, after))
            size += len(at)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def sort_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the anchors of a partition (all of an anchor's rows are here): repeated spans, EDGE rows
    of anchors with two or more distinct spans (one row a span), HOT rows of hot ones."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    kind, h, c, n, doc, pos, before, after = (table.column(x.name).to_numpy() for x in ROWS_ARROW)
    spans = kind == SPAN
    yield from _cut(_batch(SPAN, 0, 0, 0, doc[spans], pos[spans], 0, after[spans]))
    marked = np.unique(h[kind == HOT_MARK])
    ask = np.flatnonzero(kind == ASK)
    order = ask[np.lexsort((pos[ask], doc[ask], c[ask], h[ask]))]
    h, c, n, doc, pos, before, after = (x[order] for x in (h, c, n, doc, pos, before, after))
    if not len(h):
        return
    # parts of a long text may fall into two gatherings, which then both have the anchor
    head = np.flatnonzero(_heads(h, c, doc, pos))
    n = np.maximum.reduceat(n, head)
    h, c, doc, pos, before, after = (x[head] for x in (h, c, doc, pos, before, after))
    first = np.flatnonzero(_heads(h, c))
    length = np.diff(np.append(first, len(h)))
    times = np.add.reduceat(n, first)
    repeated = np.repeat(times > 1, length)
    d, lo, hi = merged(doc[repeated], (pos - before)[repeated], (pos + ANCHOR + after)[repeated])
    yield from _cut(_batch(SPAN, 0, 0, 0, d, lo, 0, hi))
    h, doc, pos, before, after = (x[first] for x in (h, doc, pos, before, after))
    start = np.flatnonzero(_heads(h))
    many = np.diff(np.append(start, len(h)))
    hot = np.repeat((many > HOT_GROUP) | np.isin(h[start], marked), many)
    edge = np.repeat(many > 1, many) & ~hot
    multi = np.minimum(times, 2)
    for k, which in ((EDGE, edge), (HOT, hot)):
        yield from _cut(_batch(k, h[which], 0, multi[which], doc[which], pos[which], before[which], after[which]))


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each asked anchor of a document: REACH before, the anchor, REACH after,
    filled up with zeros. A zero byte of the text is written 255, which UTF-8 never holds."""
    schema = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("before", pa.int32()), ("after", pa.int64()), ("bytes", pa.binary())])
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        ids, asked = batch.column("doc_id").to_pylist(), batch.column("asked").to_pylist()
        rows = []
        for k, doc in enumerate(ids):
            text = data[offsets[k] : offsets[k + 1]]
            text = np.where(text == 0, 255, text).astype(np.uint8).tobytes()
            for a in asked[k]:
                p, before, after = a["pos"], a["before"], a["after"]
                rows.append((a["kind"], a["h"], doc, p, before, after, bytes(REACH - before) + text[p - before : p + ANCHOR + after] + bytes(REACH - after)))
        for i in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + 5000], strict=True), schema, strict=True)], schema=schema)


def common(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows, at most ``limit``."""
    different = a != b
    first = np.where(different.any(1), different.argmax(1), a.shape[1])
    return np.minimum(first, limit)


def extend_intervals(h: np.ndarray, context: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each row and each j of 0..REACH: does the string that starts j bytes before the anchor
    occur in another row of the same anchor?"""
    n = len(h)
    found = np.zeros((n, REACH + 1), bool)
    tail = np.ascontiguousarray(context[:, REACH:])
    order = np.lexsort((tail.view(f"S{LENGTH}").ravel(), h))
    right = tail[:, ANCHOR:]
    interval = np.cumsum(_heads(h[order]) | np.concatenate(([True], (tail[order[1:], :ANCHOR] != tail[order[:-1], :ANCHOR]).any(1))))

    def prefixes(order: np.ndarray, interval: np.ndarray) -> np.ndarray:
        out = np.full(len(order), -1)
        same = np.flatnonzero(interval[1:] == interval[:-1]) + 1
        one, two = order[same - 1], order[same]
        for i in range(0, len(same), 100_000):
            x, y = one[i : i + 100_000], two[i : i + 100_000]
            out[same[i : i + 100_000]] = common(right[x], right[y], np.minimum(after[x], after[y]))
        return out

    prefix = prefixes(order, interval)
    for j in range(REACH + 1):
        hit = np.flatnonzero(prefix >= REACH - j)
        found[order[hit], j] = found[order[hit - 1], j] = True
        if j == REACH:
            break
        # extend to the left by one byte; rows that have none there leave
        kept = before[order] > j
        order, interval = order[kept], interval[kept]
        byte = context[order, REACH - 1 - j].astype(np.int64)
        key = interval * 256 + byte
        moved = not kept.all()
        if (np.diff(key) < 0).any():
            sort = np.argsort(key, kind="stable")
            order, key = order[sort], key[sort]
        head = _heads(key)
        moved |= int(head.sum()) != len(np.unique(interval))
        size = np.diff(np.append(np.flatnonzero(head), len(key)))
        alone = np.repeat(size == 1, size)
        interval = np.cumsum(head)
        if alone.any() or moved:
            order, interval = order[~alone], interval[~alone]
            prefix = prefixes(order, interval) if len(order) else np.zeros(0, np.int64)
        if not len(order):
            break
    return found


def repeated_spans(found: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """The bytes of the strings marked in ``found``, united by document."""
    row, j = np.nonzero(found)
    d, lo, hi = merged(doc[row], pos[row] - j, pos[row] - j + LENGTH)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, lo, hi)], schema=SPANS_ARROW)


def extend_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole anchors are worked on, some thousand rows at a time."""

    def work(table: pa.Table) -> pa.RecordBatch:
        h, doc, pos, before, after = (table.column(c).to_numpy() for c in ("h", "doc_id", "pos", "before", "after"))
        context = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(-1, LENGTH + REACH)
        return repeated_spans(extend_intervals(h, context, before, after), doc, pos)

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 8192:
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            last = int(np.argmax(h == h[-1]))
            if last:
                yield work(table.slice(0, last))
            held = table.slice(last).to_batches()
            rows = table.num_rows - last
    if rows:
        yield work(pa.Table.from_batches(held))


def single_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 200-byte strings around hot anchors, by two hashes."""
    schema = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64())])
    for batch in batches:
        for part in _cut(batch, 1000):
            doc, pos, before, after = (part.column(c).to_numpy() for c in ("doc_id", "pos", "before", "after"))
            context = np.frombuffer(b"".join(part.column("bytes").to_pylist()), np.uint8).reshape(-1, LENGTH + REACH)
            flat = np.ascontiguousarray(context).ravel()
            j = np.arange(REACH + 1)
            row, j = np.nonzero((j <= before[:, None]) & (REACH - j <= after[:, None]))
            start = row * (LENGTH + REACH) + REACH - j
            one = span_ids(flat, start, start + LENGTH)
            two = span_ids(flat ^ np.uint8(0x5A), start, start + LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(doc[row]), pa.array(pos[row] - j)], schema=schema)


SINGLE = T.StructType([T.StructField(x, T.LongType()) for x in ("one", "two", "doc_id", "pos")])


def repeated(docs: DataFrame) -> DataFrame:
    """Spans (doc_id, lo, hi) of bytes within 200-byte strings that start more than once. Spans of
    a document may overlap."""
    spark: SparkSession = docs.sparkSession
    n = partitions(spark)
    docs = docs.select("doc_id", "text")
    rows = store(docs.mapInArrow(emit_anchors, ROWS).repartition(n, "h").mapInArrow(sort_anchors, ROWS), "repeats-anchors")
    asked = rows.where(F.col("kind").isin(EDGE, HOT)).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "h", "pos", "before", "after")).alias("asked"))
    contexts = store(docs.join(asked, "doc_id").mapInArrow(cut_contexts, CONTEXTS), "repeats-contexts")
    edges = contexts.where(F.col("kind") == EDGE).repartition(n, "h").sortWithinPartitions("h").mapInArrow(extend_groups, SPANS)
    out = rows.where(F.col("kind") == SPAN).select("doc_id", F.col("pos").alias("lo"), F.col("after").alias("hi")).union(edges)
    hot = contexts.where(F.col("kind") == HOT)
    if not hot.isEmpty():
        strings = hot.mapInArrow(single_strings, SINGLE).distinct()
        twice = strings.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1")
        out = out.union(strings.join(twice, ["one", "two"], "left_semi").select("doc_id", F.col("pos").alias("lo"), (F.col("pos") + LENGTH).alias("hi")))
    return store(out, "repeats-spans")


def with_kept(finish: Callable, fields: list[tuple[str, pa.DataType]]):
    """Runs ``finish(bytes removed, spans, kept bytes)`` for each document with its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *fields])
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            spans, ids = batch.column("spans"), batch.column("doc_id").to_pylist()
            rows = []
            for k, doc in enumerate(ids):
                text = data[offsets[k] : offsets[k + 1]]
                if spans[k].is_valid and len(spans[k]):
                    flat = spans[k].values
                    lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
                    _, lo, hi = merged(np.zeros(len(lo), np.int64), lo, hi)
                    keep = np.ones(len(text), bool)
                    for a, b in zip(lo, hi, strict=True):
                        keep[a:b] = False
                    rows.append((doc, *finish(int((hi - lo).sum()), len(lo), len(text), text[keep].tobytes())))
                else:
                    rows.append((doc, *finish(0, 0, len(text), text.tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def apply_spans(docs: DataFrame, spans: DataFrame, finish: Callable, schema: str, fields: list) -> DataFrame:
    lists = spans.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return docs.select("doc_id", "text").join(lists, "doc_id", "left").mapInArrow(with_kept(finish, fields), schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document. Null and empty texts
    have no bytes; a text of less than 200 bytes keeps all."""
    small_batches(spark, 500)
    docs = read(spark, sf_dir, "documents")
    finish = lambda removed, spans, size, kept: (size, removed, spans, hashlib.sha256(kept).hexdigest())
    return apply_spans(
        docs, repeated(docs), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())],
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``. Where a cut leaves part of a character,
    that part goes too. Rows without cuts stay as they are, nulls included."""
    small_batches(docs.sparkSession, 500)
    spans = repeated(docs)
    touched = docs.join(spans.select("doc_id").distinct(), "doc_id", "left_semi")
    finish = lambda removed, spans, size, kept: (kept.decode("utf-8", "ignore"),)
    cut = apply_spans(touched, spans, finish, "doc_id long, kept string", [("kept", pa.string())])
    return docs.join(cut, "doc_id", "left").withColumn("text", F.coalesce("kept", "text")).select(docs.columns)
