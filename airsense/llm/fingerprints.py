"""Document fingerprints by consistent weighted sampling.

Terms are white-space words, weighted by their count. For each of ``SAMPLES`` samples a term has
r and c from Gamma(2, 1) and b from [0, 1), all by hash; with weight w, t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r. The term of the smallest a, with its t, is the sample: two texts have
equal samples with the probability of their generalised Jaccard similarity.

Only DataFrame expressions; a sample is one long, rank above identity, so that min() finds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airsense.llm.tables import partitions, read, small_side
from airsense.sources.stored import store

SAMPLES = 16
#: Ids up to which the order of documents is broadcast (24 bytes each).
ORDER_ROWS = 400_000
RANGES = 128
SPREAD = 4


def terms(text: Column) -> Column:
    return F.split(F.translate(text, "\t\n\r\x0b\x0c", "     "), " ")


def sample(term: Column, log_weight: Column, k: Column) -> Column:
    """The k-th sample's rank and identity for a term, given as a hash."""
    one, two = F.xxhash64(term, k), F.xxhash64(term, k + 1000)
    uniform = lambda h, shift, bits: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5) / float(1 << bits)
    r = -F.log(uniform(one, 0, 21) * uniform(one, 21, 21))
    b = uniform(one, 42, 21)
    c = -F.log(uniform(two, 0, 31) * uniform(two, 31, 31))
    t = F.floor(log_weight / r + b)
    rank = F.log(c) - r * (t - b) - r
    return F.shiftleft(F.floor((rank + 128.0) * float(1 << 24)).cast("long"), 30).bitwiseOR(F.xxhash64(term, t, k).bitwiseAND(F.lit((1 << 30) - 1)))


def signatures(pieces: DataFrame, kinds: int) -> DataFrame:
    """``pieces`` (doc_id, kind, word) to one row per document with samples s{kind}_{k}. The kind
    ``kinds`` is no text but 64 hexadecimal digits to carry, as the eight longs carried{j}.

    Samples are rows, not columns: sixteen of these expressions in one generated method are more
    than the JVM compiles.
    """
    carried = F.col("kind") == kinds
    counted = pieces.where("word <> ''").groupBy("doc_id", "kind", "word").agg(F.count("*").cast("double").alias("n"))
    number = F.explode(F.when(carried, F.array(*map(F.lit, range(8)))).otherwise(F.array(*map(F.lit, range(SAMPLES))))).alias("k")
    rows = counted.select("doc_id", "kind", F.xxhash64("word").alias("term"), F.log("n").alias("log_weight"), F.when(carried, F.col("word")).alias("digits"), number)
    value = F.when(carried, F.conv(F.substring(F.col("digits"), 8 * F.col("k") + 1, F.lit(8)), 16, 10).cast("long")).otherwise(sample(F.col("term"), F.col("log_weight"), F.col("k")))
    least = rows.select("doc_id", "kind", "k", value.alias("value")).groupBy("doc_id", "kind", "k").agg(F.min("value").alias("value"))
    pick = lambda kind, k: F.min(F.when((F.col("kind") == kind) & (F.col("k") == k), F.col("value")))
    return least.groupBy("doc_id").agg(
        *(pick(kind, k).alias(f"s{kind}_{k}") for kind in range(kinds) for k in range(SAMPLES)),
        *(pick(kinds, j).alias(f"carried{j}") for j in range(8)),
    )


def printed(kind: int) -> Column:
    """The samples as hexadecimal text; a text without words has zeros."""
    low = lambda k: F.coalesce(F.col(f"s{kind}_{k}").bitwiseAND(F.lit((1 << 30) - 1)), F.lit(0))
    return F.lower(F.concat(*(F.lpad(F.hex(low(k)), 8, "0") for k in range(SAMPLES))))


def alike(one: Column, two: Column) -> Column:
    """Share of equal samples of two printed fingerprints."""
    same = [F.when(F.substring(one, 8 * k + 1, 8) == F.substring(two, 8 * k + 1, 8), 1.0).otherwise(0.0) for k in range(SAMPLES)]
    return sum(same[1:], same[0]) / float(SAMPLES)


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, n_chars, next_id): the next smaller id; after the smallest comes the largest.

    Ids are cut into ranges by approximate quantiles; the order within a range is a window, and the
    last of a range looks up the largest id of the range below. Only the cuts reach the driver.
    """
    cuts = ids.agg(F.percentile_approx("doc_id", [k / RANGES for k in range(1, RANGES)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    lot = F.size(F.filter(F.lit(cuts), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    lots = store(ids.withColumn("lot", lot), "fingerprints-ids")
    inside = lots.withColumn("below", F.lag("doc_id").over(Window.partitionBy("lot").orderBy("doc_id")))
    tops = lots.groupBy("lot").agg(F.max("doc_id").alias("top"))
    # one row per range: a bounded table
    tops = tops.select("lot", F.coalesce(F.lag("top").over(Window.partitionBy().orderBy("lot")), F.max("top").over(Window.partitionBy())).alias("top_below"))
    return inside.join(F.broadcast(tops), "lot").select("doc_id", "n_chars", F.coalesce("below", "top_below").alias("next_id"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    Null texts are empty. Texts without words have the zero fingerprint, and are alike. A single
    document is its own next. Ids must be unique.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = store(following(docs.select("doc_id", F.length("text").cast("long").alias("n_chars"))), "fingerprints-order")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    given = (
        docs.withColumnRenamed("doc_id", "next_id").join(small_side(order, ORDER_ROWS), "next_id")
        .select("doc_id", third.alias("third"), F.substring("text", F.lit(1), third).alias("given"))
    )
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("third")), "given")
    # more partitions than usual: each counts its documents' words in memory
    n = SPREAD * partitions(docs.sparkSession)
    both = docs.repartition(n, "doc_id").join(given.repartition(n, "doc_id"), "doc_id").select("doc_id", "text", edited.alias("edited"))
    kinds = F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")),
        F.struct(F.lit(2).alias("kind"), F.sha2("edited", 256).alias("text")),
    )).alias("p")
    pieces = both.select("doc_id", kinds).select("doc_id", "p.kind", F.explode(terms(F.col("p.text"))).alias("word"))
    sha = F.lower(F.concat(*(F.lpad(F.hex(f"carried{j}"), 8, "0") for j in range(8))))
    rows = store(
        signatures(pieces, 2).select("doc_id", sha.alias("edited_sha256"), printed(0).alias("fingerprint"), printed(1).alias("edited_fingerprint")),
        "fingerprints",
    )
    placed = rows.join(order, "doc_id")
    next_ = rows.select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("next_fingerprint"))
    return placed.join(next_, "next_id").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        alike(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        alike(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(read(spark, sf_dir, "documents"))
