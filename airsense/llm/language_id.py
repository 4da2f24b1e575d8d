"""Language identification by a bidirectional gated recurrent network over bytes.

* Network: per direction, a gated recurrent unit whose input is a table row per byte; both hidden
  states of a position give the probabilities of its language. A document's probabilities are the
  mean over its positions that hold letters (ASCII letters and all bytes beyond ASCII).
* Windows: a text is read in windows of ``WINDOW`` bytes, so that long texts run side by side
  instead of one step after another. Every byte of a text is in one window; state starts anew there.
* Training: plain numpy, backpropagation through all steps of a window, Adam, every language with
  the same share of a batch. It learns from a bounded sample: about ``PER_LANGUAGE`` documents of
  each of the ``LANGUAGES`` most frequent languages, chosen by a hash of their id, and up to
  ``PER_DOCUMENT`` windows of each, spread over its whole text. Only those windows reach the driver
  (``LANGUAGES * PER_LANGUAGE * PER_DOCUMENT * WINDOW`` bytes at most, 32 MB). The same rows give the
  same weights.
* Prediction: one pass over the documents without a shuffle; each text stays in its row.

A text that is null or has no letter is ``und`` with score 0, and so is every text where there is no
labelled one to learn from. Rows without lang, or with a null ``doc_id``, are not learned from; a
null id is not held out. Repeated rows are scored alike. Equal probabilities go to the language that
comes first in alphabetical order. An empty table gives no rows. Other columns are ignored, whatever
their names. Language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsense.llm.tables import read
from airsense.llm.text import column_bytes, pieces

HIDDEN, WINDOW = 12, 128
#: Languages learned at most, documents of each (in expectation) and windows of a document at most.
LANGUAGES, PER_LANGUAGE, PER_DOCUMENT = 64, 500, 8
BATCHES, BATCH, RATE = 160, 256, 0.02
#: Windows that run side by side.
SIDE_BY_SIDE = 2048
UNKNOWN = "und"
PAD = 256
LETTER = np.zeros(PAD + 1, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:PAD] = True

WINDOWS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bytes", T.BinaryType())])
PREDICTED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
])
SPANS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType()),
])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights; the first axis of the recurrent ones is the direction. Gates stand in the order
    keep, reset, candidate. Arrays have the windows last, so that a step is one matrix product."""

    table: np.ndarray  # 2, 3 * hidden, 257
    recurrent: np.ndarray  # 2, 3 * hidden, hidden
    offset: np.ndarray  # 2, hidden, 1
    out: np.ndarray  # languages, 2 * hidden
    bias: np.ndarray  # languages, 1

    @classmethod
    def start(cls, languages: int, hidden: int = HIDDEN, seed: int = 7, kind: type = np.float32) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.3, (2, 3 * hidden, PAD + 1)).astype(kind), rng.normal(0, hidden**-0.5, (2, 3 * hidden, hidden)).astype(kind),
            np.zeros((2, hidden, 1), kind), rng.normal(0, hidden**-0.5, (languages, 2 * hidden)).astype(kind), np.zeros((languages, 1), kind),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.offset, self.out, self.bias]

    def states(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Hidden states (steps, 2, hidden, windows) of ``x`` (steps, windows). The backward
        direction starts at a window's last byte: padding leaves its state at zero."""
        steps, width = x.shape
        hidden = self.out.shape[1] // 2
        h = np.zeros((2, hidden, width), self.out.dtype)
        all_states = np.empty((steps, 2, hidden, width), self.out.dtype)
        given = np.empty((2, 3 * hidden, width), self.out.dtype)
        padded = bool((x == PAD).any())
        for s in range(steps):
            back = steps - 1 - s
            np.take(self.table[0], x[s], 1, out=given[0])
            np.take(self.table[1], x[back], 1, out=given[1])
            carried = self.recurrent @ h
            gates = sigmoid(given[:, : 2 * hidden] + carried[:, : 2 * hidden])
            keep, reset = gates[:, :hidden], gates[:, hidden:]
            inner = carried[:, 2 * hidden :] + self.offset
            candidate = np.tanh(given[:, 2 * hidden :] + reset * inner)
            new = candidate + keep * (h - candidate)
            if padded:
                new[1] *= x[back] != PAD
            if trace is not None:
                trace.append((h, keep, reset, inner, candidate))
            h = new
            all_states[s, 0], all_states[back, 1] = h[0], h[1]
        return all_states

    def probabilities(self, all_states: np.ndarray) -> np.ndarray:
        """(steps, languages, windows)"""
        steps, _, hidden, width = all_states.shape
        logits = self.out @ all_states.reshape(steps, 2 * hidden, width) + self.bias
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, language: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the positions with letters, and its gradients by
        backpropagation through time."""
        steps, width = x.shape
        hidden = self.out.shape[1] // 2
        trace: list = []
        all_states = self.states(x, trace)
        p = self.probabilities(all_states)
        counts = LETTER[x]
        total = max(1, int(counts.sum()))
        right = np.take_along_axis(p, language[None, None, :].repeat(steps, 0), 1)[:, 0]
        loss = float(-(np.log(np.maximum(right, 1e-30)) * counts).sum() / total)
        d_logits = p.copy()
        rows = np.arange(width)
        d_logits[:, language, rows] -= 1
        d_logits *= (counts / total).astype(p.dtype)[:, None]
        flat = all_states.reshape(steps, 2 * hidden, width)
        d_out = np.einsum("scb,shb->ch", d_logits, flat, optimize=True)
        d_bias = d_logits.sum((0, 2))[:, None]
        d_states = (self.out.T @ d_logits).reshape(steps, 2, hidden, width)
        d_recurrent, d_offset = np.zeros_like(self.recurrent), np.zeros_like(self.offset)
        d_given = np.empty((steps, 2, 3 * hidden, width), self.out.dtype)
        d_h = np.zeros((2, hidden, width), self.out.dtype)
        for s in reversed(range(steps)):
            back = steps - 1 - s
            h, keep, reset, inner, candidate = trace[s]
            d_h[0] += d_states[s, 0]
            d_h[1] += d_states[back, 1]
            d_h[1] *= x[back] != PAD
            d_candidate = d_h * (1 - keep) * (1 - candidate**2)
            d_inner = d_candidate * reset
            d_keep = d_h * (h - candidate) * keep * (1 - keep)
            d_reset = d_candidate * inner * reset * (1 - reset)
            d_carried = np.concatenate((d_keep, d_reset, d_inner), 1)
            d_recurrent += d_carried @ h.transpose(0, 2, 1)
            d_offset += d_inner.sum(2, keepdims=True)
            d_given[s, 0] = np.concatenate((d_keep[0], d_reset[0], d_candidate[0]))
            d_given[back, 1] = np.concatenate((d_keep[1], d_reset[1], d_candidate[1]))
            d_h = d_h * keep + self.recurrent.transpose(0, 2, 1) @ d_carried
        order = np.argsort(x.ravel(), kind="stable")
        symbols, first = np.unique(x.ravel()[order], return_index=True)
        by_place = d_given.transpose(0, 3, 1, 2).reshape(steps * width, -1)[order]
        d_table = np.zeros_like(self.table)
        d_table[:, :, symbols] = np.add.reduceat(by_place, first).reshape(len(symbols), 2, -1).transpose(1, 2, 0)
        return loss, [d_table, d_recurrent, d_offset, d_out, d_bias]


@dataclass(frozen=True)
class Identifier:
    languages: list[str]
    network: Network | None


def windows_of(row_bytes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the windows of texts whose n + 1 offsets are given."""
    size = np.diff(row_bytes)
    count = -(-size // window)
    row = np.repeat(np.arange(len(size)), count)
    start = row_bytes[:-1][row] + window * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    return row, start


def laid_out(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(steps, windows): the bytes of the windows, padded behind their ends."""
    step = np.arange(int(length.max(initial=1)))[:, None]
    at = np.minimum(start + step, max(0, len(data) - 1))
    return np.where(step < length, data[at], np.uint16(PAD)).astype(np.intp)


def spread_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to ``PER_DOCUMENT`` windows of each text, spread evenly over it."""
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        row, start = windows_of(offsets, WINDOW)
        count = np.bincount(row, minlength=len(offsets) - 1)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        kept = np.minimum(count, PER_DOCUMENT)[row]
        # of ``count`` windows, those where place * kept / count passes an integer
        chosen = np.flatnonzero((place * kept) // count[row] != ((place - 1) * kept) // count[row])
        ends = np.minimum(start + WINDOW, offsets[1:][row])
        cells = [data[start[i] : ends[i]].tobytes() for i in chosen]
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(row[chosen])), pa.array(cells, pa.binary())], names=["lang", "bytes"])


def remainder(column: str = "doc_id", parts: int = 3):
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def learned_windows(docs: DataFrame) -> list:
    """(lang, bytes) windows of the bounded sample of labelled rows."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, PER_LANGUAGE / n))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")]
    found = labelled.where(drawn).select("lang", "text").mapInArrow(spread_windows, WINDOWS).collect()
    return sorted((r.lang, bytes(r.bytes)) for r in found)


def fit(windows: list[tuple[str, bytes]], batches: int = BATCHES) -> Identifier:
    """Adam with a falling rate over ``batches`` batches, in numpy."""
    windows = [(lang, b) for lang, b in windows if LETTER[np.frombuffer(b, np.uint8)].any()]
    languages = sorted({lang for lang, _ in windows})
    if not languages:
        return Identifier([], None)
    length = np.array([len(b) for _, b in windows])
    data, start = np.frombuffer(b"".join(b for _, b in windows), np.uint8), np.cumsum(length) - length
    language = np.searchsorted(languages, [lang for lang, _ in windows])
    own = [np.flatnonzero(language == k) for k in range(len(languages))]
    network = Network.start(len(languages))
    mean, square = ([np.zeros_like(w) for w in network.weights()] for _ in range(2))
    rng = np.random.default_rng(11)
    for t in range(batches):
        some = np.concatenate([rng.choice(o, max(1, BATCH // len(own))) for o in own])
        _, gradients = network.gradients(laid_out(data, start[some], length[some]), language[some])
        norm = np.sqrt(sum(float((g**2).sum()) for g in gradients))
        rate = RATE * (1 - t / batches)
        for w, g, m, v in zip(network.weights(), gradients, mean, square, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.99 ** (t + 1))) + 1e-6)
    return Identifier(languages, network)


def learn(docs: DataFrame) -> Identifier:
    """An identifier learned from doc_id, text and lang of ``docs``."""
    return fit(learned_windows(docs))


def labelled_windows(network: Network, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, bytes, probabilities of every position) of windows of alike length."""
    row, start = windows_of(offsets, window)
    length = np.minimum(start + window, offsets[1:][row]) - start
    by_length = np.argsort(-length, kind="stable")
    for i in range(0, len(by_length), SIDE_BY_SIDE):
        some = by_length[i : i + SIDE_BY_SIDE]
        x = laid_out(data, start[some], length[some])
        yield row[some], start[some], x, network.probabilities(network.states(x))


def pooled(network: Network, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mean probabilities over the positions with letters, by text; zeros for texts without."""
    total = np.zeros((len(offsets) - 1, len(network.bias)))
    letters = np.zeros(len(offsets) - 1)
    for row, _, x, p in labelled_windows(network, data, offsets, window):
        counts = LETTER[x]
        np.add.at(total, row, np.einsum("scb,sb->bc", p, counts.astype(p.dtype)).astype(np.float64))
        np.add.at(letters, row, counts.sum(0))
    return total / np.maximum(letters, 1)[:, None]


def predictor(model: Identifier) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column("text")
            has_letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if model.network is not None:
                data, offsets = column_bytes(texts)
                for i, j in pieces(offsets):
                    p = pooled(model.network, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    best[i:j], score[i:j] = p.argmax(1), np.clip(p.max(1), 0, 1)
            best[~has_letter], score[~has_letter] = len(names) - 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], names=PREDICTED.names)

    return predict


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text)."""
    held_out = F.coalesce(remainder() == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(predictor(model), PREDICTED)


def language_spans(docs: DataFrame, model: Identifier) -> DataFrame:
    """doc_id, start, end, lang: runs of bytes with one language, over every position of a text."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, object)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for i, j in pieces(offsets):
                part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                label = np.zeros(len(part), np.int64)
                for _, start, x, p in labelled_windows(model.network, part, local):
                    step, at = np.nonzero(x != PAD)
                    label[start[at] + step] = p.argmax(1)[step, at]
                row = np.repeat(np.arange(j - i), np.diff(local))
                first = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (row[1:] != row[:-1])))) if len(part) else np.zeros(0, np.int64)
                ends = np.append(first[1:], len(part))[: len(first)]
                ids = batch.column("doc_id").take(pa.array(i + row[first]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(first - local[row[first]]), pa.array(ends - local[row[first]]), pa.array(names[label[first]], pa.string())], names=SPANS.names)

    if model.network is None:
        return docs.sparkSession.createDataFrame([], SPANS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(spans, SPANS)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, learn(docs.where(remainder() != 1)))
