"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders on both sides, so that a question with other
values has the same template. Windows of ``WIDTH`` template words of the benchmark are joined by
hash with the documents' windows. A document holds an item if enough of the item's windows are
found in it and the slots agree: where the item names one value twice, so must the document.

Slots are judged per place: hits of an item whose distance between document place and item place is
about the same are one occurrence, so that a copy beside a variant with other values does not excuse
either. Windows found word for word count whatever the slots say, and an item that is scattered over a
document is found if its hits agree as a whole.

Only DataFrame expressions. Documents are first reduced to those that share one of the benchmark's
anchor words (of each window, its longest plain word), which every matching window holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airsense.llm.tables import read, small_side
from airsense.sources.stored import store

WIDTH = 8
#: Share of an item's windows that a document must hold.
COVERAGE = 0.4
#: Words by which the distance may drift between two neighbouring hits of one occurrence.
DRIFT = 4
#: Anchor words that are tested as a literal list; beyond that all documents are windowed.
ANCHORS = 50_000
# Units of measure and currency.
UNITS = (
    "mm", "cm", "m", "km", "g", "kg", "mg", "t", "l", "ml", "s", "min", "h", "hours", "minutes", "seconds", "days", "years", "miles",
    "meters", "metres", "feet", "inches", "percent", "dollars", "euros", "usd", "eur", "degrees",
)
NAME = "\x01"


def words(text: Column) -> Column:
    """Words as they stand. A capitalised word after a small letter, a digit or a comma, a blank
    between, is a name and gets a mark."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[\p{Ll}\p{N},;] )(\p{Lu}[\p{L}]*)", NAME + "$1")
    return F.filter(F.split(marked, r"[^\p{L}\p{N}\x01]+"), lambda w: w != "")


def plain(word: Column) -> Column:
    return ~(word.startswith(NAME) | word.rlike("^[0-9]") | F.lower(word).isin(*UNITS))


def template(word: Column) -> Column:
    return (
        F.when(word.startswith(NAME), "<name>").when(word.rlike("^[0-9]"), "<number>").when(F.lower(word).isin(*UNITS), "<unit>")
        .otherwise(F.lower(word))
    )


def windows(df: DataFrame, key: str) -> DataFrame:
    """(key, place, window hash, raw words) of every window of ``WIDTH`` words; shorter texts have none."""
    one = F.explode(F.transform(places(), lambda i: F.struct(
        i.alias("place"), window_hash(i).alias("window"), F.slice("raw", i, WIDTH).alias("raw"),
    ))).alias("w")
    return typed_words(df.select(key, "text")).select(key, one).select(key, "w.place", "w.window", "w.raw")


def typed_words(df: DataFrame) -> DataFrame:
    raw = df.withColumn("raw", words(F.col("text"))).where(F.size("raw") >= WIDTH)
    return raw.withColumn("typed", F.transform("raw", template)).drop("text")


def places() -> Column:
    return F.sequence(F.lit(1), F.size("typed") - (WIDTH - 1))


def window_hash(i: Column) -> Column:
    return F.xxhash64(F.slice("typed", i, WIDTH))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (distinct windows of the item found), coverage, n_slots and
    consistent, for documents that hold at least ``COVERAGE`` of an item's windows consistently; of several such places
    the one with most windows, ties to the larger number of slots.

    Null and empty texts match nothing; items of fewer than ``WIDTH`` words are not searched.
    Rows of one item_id are one item, as are rows of one doc_id one document; a repeated item under another id gets rows of its own.
    """
    bench = store(windows(benchmark, "item_id"), "decontamination-windows")
    # windows without a plain word (all slots) say nothing about an item: neither searched nor counted
    bench = bench.where(F.exists("raw", plain))
    size = bench.groupBy("item_id").agg(F.countDistinct("window").alias("of"))
    anchor = bench.select(F.explode(F.slice(F.array_sort(F.transform(F.filter("raw", plain), lambda w: F.struct((-F.length(w)).alias("n"), F.lower(w).alias("word")))), 1, 1)).alias("a"))
    anchors = [r.word for r in anchor.select("a.word").distinct().limit(ANCHORS + 1).collect()]
    docs = docs.select("doc_id", "text")
    if len(anchors) <= ANCHORS:
        own = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
        docs = docs.where(F.arrays_overlap(own, F.lit(anchors) if anchors else F.array().cast("array<string>")))
    keys = bench.select("window").distinct()
    chosen = store(docs, "decontamination-candidates")
    # hashes alone are exploded; the words of a window are cut out where it matched
    found = typed_words(chosen).select("doc_id", F.explode(F.transform(places(), window_hash)).alias("window"))
    wanted = store(
        found.join(small_side(store(keys, "decontamination-keys")), "window").groupBy("doc_id").agg(F.collect_set("window").alias("wanted")),
        "decontamination-wanted",
    )
    hit = F.filter(F.transform(places(), lambda i: F.struct(i.alias("at"), window_hash(i).alias("window"), F.slice("raw", i, WIDTH).alias("own"))), lambda x: F.array_contains("wanted", x["window"]))
    hits = store(
        typed_words(chosen.join(small_side(wanted), "doc_id")).select("doc_id", F.explode(hit).alias("h")).select("doc_id", "h.at", "h.window", "h.own"),
        "decontamination-hits",
    )
    asked = bench.select("item_id", "place", "window", F.col("raw").alias("asked")).distinct()
    both = hits.distinct().join(small_side(asked), "window").where(F.transform("own", template) == F.transform("asked", template))
    # an occurrence: hits in the order of their distance, cut where it drifts
    order = Window.partitionBy("doc_id", "item_id").orderBy("offset")
    cut = F.col("offset") - F.lag("offset").over(order) > DRIFT
    both = both.withColumn("offset", F.col("at") - F.col("place"))
    both = both.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("occurrence", F.sum("cut").over(order))
    both = store(both.select("doc_id", "item_id", "occurrence", "window", "own", "asked"), "decontamination-both")
    # every hit counts for its occurrence, for the document as a whole (-1), and there again if it is word for word (-2)
    verbatim = F.transform("own", F.lower) == F.transform("asked", F.lower)
    groups = F.array_compact(F.array(F.col("occurrence"), F.lit(-1).cast("long"), F.when(verbatim, F.lit(-2).cast("long"))))
    placed = both.withColumn("occurrence", F.explode(groups))
    by = ["doc_id", "item_id", "occurrence"]
    count = placed.groupBy(*by).agg(F.countDistinct("window").alias("n_windows"))
    slots = (
        placed.select(*by, F.explode(F.arrays_zip("asked", "own")).alias("s")).where(~plain(F.col("s.asked")))
        .groupBy(*by, F.col("s.asked").alias("asked")).agg(F.countDistinct("s.own").alias("values"))
        .groupBy(*by).agg(F.count("*").alias("n_slots"), F.max("values").alias("most"))
    )
    share = F.col("n_windows") / F.col("of")
    found = (
        count.join(small_side(size), "item_id").where(share >= COVERAGE).join(slots, by, "left")
        .where((F.coalesce("most", F.lit(1)) == 1) | (F.col("occurrence") == -2))
        .groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", F.round(share, 6).alias("coverage"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"))).alias("best"))
    )
    return found.select("doc_id", "item_id", "best.n_windows", "best.coverage", "best.n_slots", F.lit(True).alias("consistent"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return docs.join(matches(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
