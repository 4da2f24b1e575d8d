"""N-gram Jaccard join by parity sketches: all pairs of documents with Jaccard 0.75 or more.

The distinct 5-word shingles of a document are XOR-hashed into a sketch of W 64-bit words: a
shingle XORs its 64 hash bits into one word. Two sketches differ in at most as many words as the
sets have shingles that only one of them holds. At Jaccard t that symmetric difference is at most
(1 - t) / (1 + t) of the two sizes together, and with a size of n on one side at most
d = n (1 - t) / t. Hence, of the non-empty words of a sketch in any fixed order, the first d + 1 of
both sides share one (pigeonhole over words): equality of one sketch word is the join key. W is set
per size band; a document whose partners may lie in the next band also emits that band's words. The
few sets whose shingles fall into no more than d words emit a prefix of their shingles instead, so
that no link depends on luck.

Order of words: those of more shingles first, since a word that several shingles made is rarely
shared by chance, and words made by a frequent shingle alone last. Any order gives the same links;
frequent shingles are counted over all documents.

Candidates are star-shaped (each document with the first document of its key), filtered by a
second parity sketch of one bit per shingle (its Hamming distance bounds the symmetric difference
from below; it has as many bits as the set has shingles, rounded up to a power of two, and folds to
half of them by XOR) and verified on the exact sets. Keys whose documents are in one component then need nothing more. The
rest is compared in blocks of ``BLOCK`` members, so that a key of any size is split over tasks: only
the strays, members outside the component that most of a key's documents are in, meet all others,
first for a forest of near pairs, which joins what belongs together, then for every close pair that
still lies between two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsense.llm.tables import components, partitions, read, small_side
from airsense.llm.text import mix, shingle_sets, small_batches
from airsense.sources.stored import store

#: Jaccard threshold as a fraction, in integers.
NUMERATOR, DENOMINATOR = 3, 4
#: 64-bit words that the sketch used to drop candidates has at least.
FILTER_WORDS = 16
#: Elements that a task gathers before it emits them by bucket.
FLUSH = 4_000_000
#: Rows (of 32 bytes) up to which the sets' components are broadcast to label the groups.
LABELS_BROADCAST = 400_000
#: Shingles in so many different sets of a piece of a task, and in all such pieces, are ordered last,
#: the most frequent ones if there are more than HOT_MOST; any values give the same links.
HOT_LOCAL, HOT_TOTAL, HOT_MOST = 2, 16, 200_000
BLOCK = 1024
#: Pairs of a block that are compared at a time, about.
PAIRS_AT_ONCE = 1 << 20
#: A key that more sets than this of one gathering have goes to its bucket as one entry.
RUN_MOST = 64
_ONE, _C1, _C2 = np.uint64(1), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)

SUMMARY = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("set1", T.LongType()), T.StructField("set2", T.LongType()),
    T.StructField("sketch", T.BinaryType()), T.StructField("bucket", T.IntegerType()), T.StructField("hot", T.BinaryType()), T.StructField("times", T.BinaryType()),
])
HOT = T.StructType([T.StructField("hot", T.LongType()), T.StructField("times", T.LongType())])
BUCKETS = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()),
    T.StructField("keys", T.BinaryType()), T.StructField("sids", T.BinaryType()), T.StructField("counts", T.BinaryType()),
])
MEMBERS = T.StructType([
    T.StructField("level", T.IntegerType()), T.StructField("grp", T.LongType()), T.StructField("member", T.LongType()),
    T.StructField("center", T.LongType()),
])
PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def linked(shared: int, a: int, b: int) -> bool:
    return DENOMINATOR * shared >= NUMERATOR * (a + b - shared)


def most_different(n: int) -> int:
    """The largest symmetric difference of a set of n with any linked set."""
    return n * (DENOMINATOR - NUMERATOR) // NUMERATOR


def band_of(n: int) -> int:
    """Band k holds the sizes 2**k to 2**(k+1) - 1."""
    return n.bit_length() - 1


def filter_words(n: int) -> int:
    """64-bit words of the filter sketch of ``n`` shingles: a power of two, a bit a shingle at least."""
    return max(FILTER_WORDS, 1 << (-(-n // 64) - 1).bit_length())


def filter_sketch(shingles: np.ndarray) -> np.ndarray:
    h = mix(shingles ^ _C2)
    words = filter_words(len(shingles))
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, (h >> np.uint64(6)) & np.uint64(words - 1), _ONE << (h & np.uint64(63)))
    return out


def folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches of ``words`` words and more, folded to that many: the sketches of the same sets."""
    out = np.empty((len(sketches), words), np.uint64)
    for size in {len(s) for s in sketches}:
        at = [i for i, s in enumerate(sketches) if len(s) == size]
        rows = np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1, words)
        out[at] = np.bitwise_xor.reduce(rows, axis=1)
    return out


def distances(sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hamming distances of the sketches of pairs of places, in the bits of the smaller one."""
    words = np.array([len(s) // 8 for s in sketches])
    least = np.minimum(words[i], words[j])
    out = np.empty(len(i), np.int64)
    for w in np.unique(least).tolist():
        pairs = np.flatnonzero(least == w)
        used, place = np.unique(np.concatenate((i[pairs], j[pairs])), return_inverse=True)
        rows = folded([sketches[k] for k in used], w)
        for a in range(0, len(pairs), 1 + (1 << 20) // w):
            b = min(len(pairs), a + 1 + (1 << 20) // w)
            out[pairs[a:b]] = np.bitwise_count(rows[place[a:b]] ^ rows[place[len(pairs) + a : len(pairs) + b]]).sum(1, dtype=np.int64)
    return out


def set_id(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    n = np.array([len(shingles)], np.uint64)
    one = mix(np.add.reduce(mix(shingles + _C1)) ^ (n * _C1))
    two = mix(np.bitwise_xor.reduce(mix(shingles ^ _C2)) + n)
    return one[0], two[0]


def band_words(shingles: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, shingles in it) of the words of the band's sketch that hold any. ``shingles`` are
    sorted, so words, taken from the high bits, come in order."""
    width = np.uint64(2 << band)
    at = ((shingles >> np.uint64(32)) * width) >> np.uint64(32)
    first, count = runs(at)
    word = np.bitwise_xor.reduceat(mix(shingles), first)
    return mix((at[first] * _C1) ^ (word + np.uint64(band))), count


def single_word_keys(shingles: np.ndarray, band: int) -> np.ndarray:
    """The keys that each of ``shingles`` makes alone in a word."""
    at = ((shingles >> np.uint64(32)) * np.uint64(2 << band)) >> np.uint64(32)
    return mix((at * _C1) ^ (mix(shingles) + np.uint64(band)))


class HotKeys(dict):
    """The sorted keys of frequent shingles by band, made when a band is first asked for."""

    def __init__(self, hot: np.ndarray):
        self.hot = hot

    def __missing__(self, band: int) -> np.ndarray:
        self[band] = np.sort(single_word_keys(self.hot, band)) if len(self.hot) else self.hot
        return self[band]


def keys_of(shingles: np.ndarray, hot: HotKeys) -> Iterator[np.ndarray]:
    """The join keys of one set: d + 1 words for its own band, and for the next one if a linked
    set may lie there."""
    n = len(shingles)
    own, need = band_of(n), most_different(n) + 1
    for band in (own, own + 1) if n + most_different(n) >= 2 << own else (own,):
        keys, count = band_words(shingles, band)
        if len(keys) < need:
            # any linked set shares one of the first quarter of the shingles, in one fixed order
            order = np.sort(mix(shingles + _C1))[: n - -(-n * NUMERATOR // DENOMINATOR) + 1]
            yield mix(order ^ np.uint64(band + 1000))
            keys = np.sort(keys)
        elif len(keys) > need:
            rare = np.minimum(count, 7).astype(np.uint64)
            if len(hot[band]):
                place = np.minimum(np.searchsorted(hot[band], keys), len(hot[band]) - 1)
                rare[hot[band][place] == keys] = 0
            keys = keys[np.argpartition(((np.uint64(7) - rare) << np.uint64(60)) | (keys >> np.uint64(4)), need - 1)[:need]]
        yield keys


def summariser(buckets: int):
    """A row per document; by bucket, the shingles that several different sets of a piece have."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("sketch", pa.binary()), ("bucket", pa.int32()), ("hot", pa.binary()), ("times", pa.binary())])
        held: list[np.ndarray] = []
        seen: set = set()
        size = 0

        def frequent() -> Iterator[pa.RecordBatch]:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            values, times = values[times >= HOT_LOCAL], times[times >= HOT_LOCAL]
            bucket = (values % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            values, times, bucket = values[order], times[order], bucket[order]
            if not len(values):
                return
            first, count = runs(bucket)
            none = pa.nulls(len(first))
            cells = [(int(bucket[a]), values[a : a + n].tobytes(), times[a : a + n].astype(np.int64).tobytes()) for a, n in zip(first, count, strict=True)]
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64())] * 4 + [none.cast(pa.binary())] + [pa.array(c, f.type) for c, f in zip(zip(*cells, strict=True), list(schema)[5:], strict=True)], schema=schema)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            rows: list[tuple] = []
            for k, s in shingle_sets(batch.column("text")):
                one, two = set_id(s) if len(s) else (np.uint64(0), np.uint64(0))
                rows.append((int(ids[k]), len(s), int(one.view(np.int64)), int(two.view(np.int64)), filter_sketch(s).tobytes() if len(s) else b"", None, None, None))
                if (one, two) in seen:
                    continue
                seen.add((one, two))
                held.append(s)
                size += len(s)
                if size >= FLUSH:
                    yield from frequent()
                    held, seen, size = [], set(), 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if held:
            yield from frequent()

    return summarise


def add_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frequent shingles of the task's buckets."""
    cells = [(np.frombuffer(h, np.uint64), np.frombuffer(t, np.int64)) for batch in batches for h, t in zip(batch.column("hot").to_pylist(), batch.column("times").to_pylist(), strict=True)]
    if not cells:
        return
    values, back = np.unique(np.concatenate([c[0] for c in cells]), return_inverse=True)
    times = np.bincount(back, np.concatenate([c[1] for c in cells])).astype(np.int64)
    keep = np.flatnonzero(times >= HOT_TOTAL)
    for i in range(0, len(keep), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(signed(values[keep[i : i + 100_000]])), pa.array(times[keep[i : i + 100_000]])], names=["hot", "times"])


def group_ids(members: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the set of members of each run; ``first`` has the runs' starts."""
    if not len(first):
        return np.zeros(0, np.uint64)
    length = np.diff(np.append(first, len(members))).astype(np.uint64)
    return mix(np.add.reduceat(mix(members ^ _C1), first) ^ mix(np.bitwise_xor.reduceat(mix(members + _C2), first) + length))


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return first, np.diff(np.append(first, len(key)))


def emitter(buckets: int, hot: np.ndarray):
    """Keys of all sets, packed by bucket: kind 0 has (key, set). Where many sets of one gathering
    share a key, the bucket gets one entry for them, and kind 1 has the group that it stands for."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_band = HotKeys(hot)
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("sids", pa.binary()), ("counts", pa.binary())])
        keys: list[np.ndarray] = []
        sids: list[np.uint64] = []
        seen: set = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key = np.concatenate(keys)
            sid = np.repeat(np.array(sids, np.uint64), [len(x) for x in keys])
            order = np.lexsort((sid, key))
            key, sid = key[order], sid[order]
            first, length = runs(key)
            rows = []
            long = length > RUN_MOST
            if long.any():
                inside = np.repeat(long, length)
                heads, lengths = runs(key[inside])
                names = group_ids(sid[inside], heads)
                _, once = np.unique(names, return_index=True)
                for k in once:
                    group = sid[inside][heads[k] : heads[k] + lengths[k]]
                    rows.append((int(names[k] % np.uint64(buckets)), 1, names[k].tobytes(), group.tobytes(), b""))
                key = np.concatenate((key[~inside], key[first[long]]))
                sid = np.concatenate((sid[~inside], names))
            bucket = (key % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((sid, bucket))
            key, sid, bucket = key[order], sid[order], bucket[order]
            for a, n in zip(*runs(bucket), strict=True):
                k, s = key[a : a + n], sid[a : a + n]
                heads, counts = runs(s)
                rest = k // np.uint64(buckets)
                packed = (rest & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((rest >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes()
                rows.append((int(bucket[a]), 0, packed, s[heads].tobytes(), counts.astype(np.uint32).tobytes()))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 64], strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for _, s in shingle_sets(batch.column("text")):
                if not len(s):
                    continue
                ident = set_id(s)
                if ident in seen:
                    continue
                seen.add(ident)
                own = np.unique(np.concatenate(list(keys_of(s, by_band))))
                keys.append(own)
                sids.append(ident[0])
                size += len(own)
                if size >= FLUSH:
                    yield from flush()
                    keys, sids, size, seen = [], [], 0, set()
        if keys:
            yield from flush()

    return emit


def gatherer(buckets: int):
    """Groups of sets that share a key, each distinct group of a bucket once. Level 1: groups whose
    members are sets or level 0 groups; level 0: the groups that a gathering made."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("level", pa.int32()), ("grp", pa.int64()), ("member", pa.int64()), ("center", pa.int64())])

        def out(level: int, group: np.ndarray, member: np.ndarray, center: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(group), 100_000):
                part = [pa.array(x[i : i + 100_000].view(np.int64)) for x in (group, member, center)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), level, np.int32)), *part], schema=schema)

        keys, sids = [], []
        for batch in batches:
            kinds, ks, ss, cs = (batch.column(c).to_pylist() for c in ("kind", "keys", "sids", "counts"))
            for p, kind, k, s, c in zip(batch.column("bucket").to_pylist(), kinds, ks, ss, cs, strict=True):
                sid = np.frombuffer(s, np.uint64)
                if kind:
                    yield from out(0, np.repeat(np.frombuffer(k, np.uint64), len(sid)), sid, np.repeat(sid[:1], len(sid)))
                    continue
                counts = np.frombuffer(c, np.uint32)
                n = int(counts.sum())
                rest = np.frombuffer(k, np.uint32, n).astype(np.uint64) | (np.frombuffer(k, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))
                keys.append(rest * np.uint64(buckets) + np.uint64(p))
                sids.append(np.repeat(sid, counts))
        if not keys:
            return
        key, sid = np.concatenate(keys), np.concatenate(sids)
        order = np.lexsort((sid, key))
        key, sid = key[order], sid[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])))
        key, sid = key[new], sid[new]
        _, length = runs(key)
        sid = sid[np.repeat(length > 1, length)]
        length = length[length > 1]
        first = np.cumsum(length) - length
        names, once = np.unique(group_ids(sid, first), return_index=True)
        kept = np.zeros(len(first), bool)
        kept[once] = True
        inside = np.repeat(kept, length)
        length = length[kept]
        sid = sid[inside]
        first = np.cumsum(length) - length
        yield from out(1, np.repeat(group_ids(sid, first), length), sid, np.repeat(sid[first], length))

    return gather


def close(different: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """False where sizes or the sketches' distances rule a link out."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (DENOMINATOR * small >= NUMERATOR * large) & (different * (DENOMINATOR + NUMERATOR) <= (DENOMINATOR - NUMERATOR) * (n_a + n_b))


def keep_close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketches = [*batch.column("sketch_a").to_pylist(), *batch.column("sketch_b").to_pylist()]
        n, at = batch.num_rows, np.arange(batch.num_rows)
        keep = close(distances(sketches, at, at + n), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def block_comparer(forest: bool):
    """Close pairs of different components in each block: its strays (members outside the group's
    main component) with the members that are at home in it. With ``forest``, of those only as many
    as may join the components of the task's rows, nearest first. Rows come sorted by block; a block
    has about ``BLOCK`` rows besides the strays."""

    def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[pa.RecordBatch] = []
        above: dict[int, int] = {}
        given: set[tuple[int, int]] = set()

        def top(x: int) -> int:
            while above.get(x, x) != x:
                above[x] = x = above.get(above[x], above[x])
            return x

        def compare(table: pa.Table) -> pa.RecordBatch:
            group, low, doc, n, comp, home, stray = (table.column(c).to_numpy() for c in ("grp", "low", "doc_id", "n_shingles", "component", "home", "stray"))
            sketches = table.column("sketch").to_pylist()
            cuts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (low[1:] != low[:-1]), [True])))
            found = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                strays = x + np.flatnonzero(stray[x:y])
                homes = x + np.flatnonzero(home[x:y])
                homes = homes[np.argsort(n[homes], kind="stable")]
                # partners by size
                since = np.searchsorted(DENOMINATOR * n[homes], NUMERATOR * n[strays])
                until = np.searchsorted(NUMERATOR * n[homes], DENOMINATOR * n[strays], "right")
                step = max(1, PAIRS_AT_ONCE // max(1, len(homes)))
                for a in range(0, len(strays), step):
                    count = np.maximum(until - since, 0)[a : a + step]
                    i = np.repeat(strays[a : a + step], count)
                    j = homes[np.repeat(since[a : a + step] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
                    # two strays meet twice, in the home of either
                    apart = (comp[i] != comp[j]) & (~stray[j] | (doc[i] < doc[j]))
                    i, j = i[apart], j[apart]
                    if not len(i):
                        continue
                    far = distances(sketches, i, j)
                    keep = np.flatnonzero(close(far, n[i], n[j]))
                    for k in keep[np.argsort(far[keep], kind="stable")]:
                        if forest:
                            one, two = top(int(comp[i[k]])), top(int(comp[j[k]]))
                            if one == two:
                                continue
                            above[max(one, two)] = min(one, two)
                        pair = int(min(doc[i[k]], doc[j[k]])), int(max(doc[i[k]], doc[j[k]]))
                        # a task gives out a pair once, however many groups it has it from
                        if pair not in given:
                            given.add(pair)
                            found.append(pair)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            group, low = (table.column(c).to_numpy() for c in ("grp", "low"))
            last = int(np.argmax((group == group[-1]) & (low == low[-1])))
            if last:
                yield compare(table.slice(0, last))
            held = table.slice(last).to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))

    return compare_blocks


def verify_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linked pairs. Rows are sorted by group, each group's center first."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    group, center = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, part, role, doc = (batch.column(c).to_pylist() for c in ("a", "part", "role", "doc_id"))
        found = []
        for k, s in shingle_sets(batch.column("text")):
            if role[k] == 0:
                group, center = (a[k], part[k]), s
                continue
            if group != (a[k], part[k]):
                raise RuntimeError("a group of candidate pairs came without its center")
            shared = len(s) + len(center) - len(np.union1d(s, center))
            if linked(shared, len(s), len(center)):
                found.append((a[k], doc[k]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=schema)


def verify(docs: DataFrame, pairs: DataFrame, per_part: int = 64) -> DataFrame:
    """The pairs (a, b) of ``pairs``, a stored table, whose exact shingle sets are linked.

    Texts are gathered by the pairs' first document; one with many partners is dealt to several
    parts, each with its own copy of that text.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_part).alias("parts"))
    dealt = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    need = store(
        dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("doc_id"))
        .union(dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("doc_id")).distinct()),
        "jaccard-need",
    )
    rows = docs.select("doc_id", "text").join(small_side(need), "doc_id")
    n = partitions(docs.sparkSession)
    return (
        rows.repartition(n, "a", "part").sortWithinPartitions("a", "part", "role", "doc_id")
        .select("a", "part", "role", "doc_id", "text").mapInArrow(verify_stream, PAIRS)
    )


def close_pairs(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Candidates (a, b) that sizes and sketches do not rule out."""
    one = reps.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(keep_close, PAIRS)


def rest_pairs(members: DataFrame, made: DataFrame, reps: DataFrame, labels: DataFrame, forest: bool) -> DataFrame:
    """Close pairs within groups whose documents are not yet all in one component. ``made``: the
    sets of the groups that gatherings made."""
    inner = members.where("level = 1").select("grp", "member").join(small_side(made), F.col("member") == F.col("made"), "left")
    known = store(
        reps.select("sid", "doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("sid", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")),
        "jaccard-known",
    )
    labelled = (
        inner.select("grp", F.coalesce("sid", "member").alias("sid")).union(made.select(F.col("made").alias("grp"), "sid"))
        .join(small_side(known, LABELS_BROADCAST), "sid")
    )
    # groups of several components, with the component that most of their members are in
    sizes = labelled.groupBy("grp", "component").agg(F.count("*").alias("size"))
    several = store(
        sizes.groupBy("grp").agg(F.sum("size").alias("size"), F.max(F.struct("size", "component"))["component"].alias("main"), F.count("*").alias("parts"))
        .where("parts > 1").select("grp", "main", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")),
        "jaccard-several",
    )
    rows = (
        labelled.join(small_side(several), "grp").distinct()
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
        .withColumn("stray", F.col("component") != F.col("main"))
        .join(reps.select("doc_id", "sketch"), "doc_id")
    )
    # members of the main component stay at home; strays visit every block
    seen_in = F.when(F.col("stray"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = rows.withColumn("low", F.explode(seen_in)).select(
        "grp", "low", (F.col("low") == F.col("block")).alias("home"), "stray", "doc_id", "n_shingles", "component", "sketch"
    )
    n = partitions(members.sparkSession)
    return (
        dealt.repartition(n, "grp", "low").sortWithinPartitions("grp", "low")
        .mapInArrow(block_comparer(forest), PAIRS).distinct()
    )


def link_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, labels): a row per document with its set's size and class representative; and
    (node, component) of every representative that has a link.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null and empty texts have
    no shingles and no links. Documents with equal sets are linked by definition and stand behind
    one representative, the smallest id. Ids are expected to be unique.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    buckets = 2 * partitions(spark)
    found = store(docs.mapInArrow(summariser(buckets), SUMMARY), "jaccard-summary")
    summary = found.where("bucket is null").drop("bucket", "hot", "times")
    hot = [
        r.hot for r in found.where("bucket is not null").select("bucket", "hot", "times").repartition(buckets, "bucket").mapInArrow(add_frequencies, HOT)
        .orderBy(F.desc("times"), "hot").limit(HOT_MOST).select("hot").collect()
    ]
    classes = store(
        summary.where("n_shingles > 0").groupBy("set1", "set2").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("r"))
        .select(F.col("set1").alias("sid"), F.col("set2").alias("set2"), "r.*"),
        "jaccard-classes",
    )
    members = store(
        docs.mapInArrow(emitter(buckets, np.array(hot, np.int64).view(np.uint64)), BUCKETS)
        .repartition(buckets, "bucket").mapInArrow(gatherer(buckets), MEMBERS),
        "jaccard-members",
    )
    # a group made in a task is known by its center
    ids = classes.select("sid", "doc_id")
    made = members.where("level = 0 and member = center").select("grp", F.col("member").alias("sid")).distinct()
    ids = ids.union(made.join(ids, "sid").select("grp", "doc_id"))
    stars = (
        members.where("member <> center").select(F.col("member").alias("sid"), "center").distinct()
        .join(ids, "sid").join(ids.select(F.col("sid").alias("center"), F.col("doc_id").alias("other")), "center")
        .select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).where("a < b").distinct()
    )
    links = store(verify(docs, store(close_pairs(stars, classes), "jaccard-stars")), "jaccard-links")
    labels = components(links, "jaccard")
    made = store(members.where("level = 0").select(F.col("grp").alias("made"), F.col("member").alias("sid")).distinct(), "jaccard-made")
    # first as few pairs as may join what is close, then every close pair that is left
    for forest in (True, False):
        rest = store(rest_pairs(members, made, classes, labels, forest), "jaccard-more")
        if rest.isEmpty():
            break
        more = store(verify(docs, rest), "jaccard-links")
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links, "jaccard")
    return summary.join(classes.select(F.col("sid").alias("set1"), "set2", F.col("doc_id").alias("rep")), ["set1", "set2"], "left"), labels


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest document reachable by links) per document."""
    summary, labels = link_documents(docs)
    named = summary.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are linked to one with a smaller id in their component."""
    kept = jaccard_classes(docs).where("doc_id = component_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi")
