"""Mixing sources to target weights: iterative proportional fitting of token weights.

Documents fall into cells by source, language and topic. Each round scales the cells' weights so
that one marginal after the other meets its target share of tokens. A document is then sampled with
a probability proportional to its cell's weight; the draw is a hash of its id, so that a repeated
task draws the same. Only DataFrame expressions; the cell table has a row per cell, not per document.

No cell can give more tokens than it has. Its weight is therefore the raked one or its capacity, the
weight at which its rate is 1, whichever is less: each step holds the full cells of a marginal's value
and scales its other ones to what is left of the target. Targets are first held to the capacity of their
value by a common level. Rounds go on until no marginal moves by ``TOLERANCE``; ``marginals`` reports what is left
where the targets of the three marginals can't all be met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airsense.llm.tables import read, small_side
from airsense.sources.stored import store

#: The share of all tokens that the sample aims at.
BUDGET = 0.5
#: Rounds over the three marginals between two looks at the residual, the residual that ends them, and the most rounds.
ROUNDS, TOLERANCE, MOST = 5, 1e-4, 20
#: Targets of source and topic: shares to this power, which lifts the small ones. Languages: equal shares.
POWER = 0.5
MARGINS = ("source", "lang", "topic")
SEED = "mix"


def tokens() -> Column:
    """White-space words: ends of runs of other characters."""
    text = F.coalesce("text", F.lit(""))
    return F.size(F.filter(F.split(F.translate(text, "\t\n\r\x0b\x0c", "     "), " "), lambda w: w != ""))


def topic() -> Column:
    """A topic by what a text holds; the first that fits."""
    text = F.lower(F.coalesce("text", F.lit("")))
    return (
        F.when(text.contains("license"), "legal").when(text.contains(" | "), "table").when(text.contains("http"), "web")
        .when(text.contains("@"), "contact").when(F.length(text) < 400, "short").otherwise("prose")
    )


def draw() -> Column:
    """A uniform number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def step(margin: str) -> Column:
    """``weight`` after one step: of a value's cells, those at their capacity stay, the free ones share what they leave of
    the target; where the full ones alone exceed it, all go down."""
    group = Window.partitionBy(margin)
    target, is_full = F.col(f"target_{margin}"), F.col("weight") >= F.col("most")
    full = F.sum(F.when(is_full, F.col("most")).otherwise(0.0)).over(group)
    free = F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).over(group)
    factor = F.when(target > full, F.when(free > 0, (target - full) / free).otherwise(1.0)).otherwise(target / (full + free))
    return (F.col("weight") * factor).alias("weight")


def targets(cells: DataFrame, margin: str) -> DataFrame:
    """(margin, target): raw shares to ``POWER``, languages equal, held to the capacity of each value; they sum to 1."""
    power = 0.0 if margin == "lang" else POWER
    values = cells.groupBy(margin).agg(F.sum("tokens").alias("own"))
    share = F.col("own") / F.sum("own").over(Window.partitionBy())
    values = values.withColumn("raw", F.pow(share, F.lit(power))).withColumn("most", share / BUDGET)
    # values in the order of capacity / raw: the first k stand at their capacity, the level of the rest is what these leave over their
    # raw shares; the right k is the one where the level is greatest, since every other k counts some value beyond its bound
    by = Window.orderBy(F.col("most") / F.col("raw"), margin)
    full = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    values = values.withColumn("full", full).withColumn("free", F.sum("raw").over(Window.orderBy(F.desc(F.col("most") / F.col("raw")), F.desc(margin))))
    level = F.max((1 - F.col("full")) / F.col("free")).over(Window.partitionBy())
    return values.select(margin, F.least(F.col("raw") * level, F.col("most")).alias(f"target_{margin}"))


def fitted_cells(cells: DataFrame) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``, the share of the sample's tokens, and the three targets.

    All cells come to one partition: their number is that of distinct source, language and topic,
    not of documents. Windows over it then need no shuffle.
    """
    cells = store(cells.where("tokens > 0"), "mixing-tokens")
    fitted = cells.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
    fitted = fitted.select(*MARGINS, "tokens", F.col("share").alias("weight"), (F.col("share") / BUDGET).alias("most"))
    for m in MARGINS:
        fitted = fitted.join(small_side(store(targets(cells, m), f"mixing-target-{m}")), m)
    fitted = store(fitted, "mixing-start")
    for _ in range(0, MOST, ROUNDS):
        fitted = fitted.repartition(1)
        others = [c for c in fitted.columns if c != "weight"]
        for _ in range(ROUNDS):
            for m in MARGINS:
                fitted = fitted.select(*others, step(m))
        fitted = store(fitted, "mixing-rounds")
        if residual(fitted) < TOLERANCE:
            break
    return fitted.select(*MARGINS, "tokens", F.least("weight", "most").alias("weight"), *[f"target_{m}" for m in MARGINS])


def residual(fitted: DataFrame) -> float:
    """The greatest distance of a marginal's share from its target."""
    apart = F.lit(0.0)
    for m in MARGINS:
        got = F.sum(F.least("weight", "most")).over(Window.partitionBy(m))
        apart = F.greatest(apart, F.abs(got - F.col(f"target_{m}")))
    return fitted.select(apart.alias("apart")).agg(F.max("apart")).first()[0] or 0.0


def marginals(rows: DataFrame) -> DataFrame:
    """margin, value, target, expected and drawn share of the budget, and ``residual`` (expected - target), of rows of ``rated``."""
    rows = store(rows, "mixing-rated")
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    budget = BUDGET * (rows.agg(F.sum("n_tokens")).first()[0] or 0)
    out = None
    for m in MARGINS:
        got = rows.groupBy(m).agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("expected"), F.sum(F.when(F.col("drawn"), F.col("n_tokens"))).alias("drawn"))
        part = got.join(targets(cells.where("tokens > 0"), m), m).select(
            F.lit(m).alias("margin"), F.col(m).alias("value"), F.col(f"target_{m}").alias("target"),
            (F.col("expected") / budget).alias("expected"), (F.coalesce("drawn", F.lit(0)) / budget).alias("drawn"),
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("residual", F.col("expected") - F.col("target"))


def rated(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and drawn of every document.

    A null source or language is a value of its own, ``unknown``. Texts without words have no
    tokens to weigh and are not drawn. A repeated row is a row of its own, drawn like its copy; other
    columns of ``docs`` play no part. A probability is at most 1, with which a cell gives all it has.
    """
    known = docs.select(
        "doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"),
        topic().alias("topic"), tokens().cast("long").alias("n_tokens"),
    )
    rows = store(known, "mixing-rows")
    cells = store(fitted_cells(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))), "mixing-cells")
    rates = cells.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))
    rates = rates.select(*MARGINS, F.round(F.least(F.lit(1.0), F.lit(BUDGET) * F.col("weight") * F.col("all_tokens") / F.col("tokens")), 6).alias("rate"))
    joined = rows.join(small_side(rates), list(MARGINS), "left")
    rate = F.when(F.col("n_tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0)
    return joined.select("doc_id", *MARGINS, "n_tokens", rate.alias("probability"), (draw() < rate).alias("drawn"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(read(spark, sf_dir, "documents"))


def sample(docs: DataFrame) -> DataFrame:
    """The drawn rows of ``docs`` with topic, n_tokens and probability; columns of these names that ``docs`` brings are replaced."""
    drawn = rated(docs).where("drawn").select("doc_id", "topic", "n_tokens", "probability")
    return docs.drop("topic", "n_tokens", "probability").join(drawn, "doc_id")


def oracle(documents: str = "documents") -> str:
    """The same for the engine that checks: a recursive query repeats the round until the marginals stand."""
    parts = [f"""t AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, lower(coalesce(text, '')) AS low,
 len(list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(13) || chr(11) || chr(12), '     '), ' '), lambda w: w <> ''))::BIGINT AS n_tokens FROM {documents}),
d AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN contains(low, 'license') THEN 'legal' WHEN contains(low, ' | ') THEN 'table' WHEN contains(low, 'http') THEN 'web'
 WHEN contains(low, '@') THEN 'contact' WHEN length(low) < 400 THEN 'short' ELSE 'prose' END AS topic FROM t),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"""]
    parts.append("z AS (SELECT sum(tokens) AS n FROM c)")
    for m, power in (("source", POWER), ("lang", 0.0), ("topic", POWER)):
        parts.append(f"g_{m} AS (SELECT {m}, pow(sum(tokens) / any_value(n), {power}) AS raw, sum(tokens) / any_value(n) / {BUDGET} AS most FROM c, z GROUP BY {m})")
        # water-filling: a common level for the raw shares, such that shares held to their capacity sum to 1
        parts.append(f"f_{m} AS (SELECT max((1 - coalesce((SELECT sum(most) FROM g_{m} y WHERE y.most / y.raw < x.most / x.raw), 0)) "
                     f"/ (SELECT sum(raw) FROM g_{m} y WHERE y.most / y.raw >= x.most / x.raw)) AS factor FROM g_{m} x)")
        parts.append(f"t_{m} AS (SELECT {m}, least(raw * factor, most) AS target_{m} FROM g_{m}, f_{m})")
    parts.append(f"w0 AS (SELECT c.*, tokens / n AS weight, tokens / n / {BUDGET} AS most, target_source, target_lang, target_topic "
                 "FROM c, z, t_source, t_lang, t_topic WHERE c.source = t_source.source AND c.lang = t_lang.lang AND c.topic = t_topic.topic)")
    inner = f"(SELECT * FROM rounds WHERE k < {MOST} AND (k % {ROUNDS} <> 0 OR apart >= {TOLERANCE}))"
    for m in MARGINS:
        inner = (f"(SELECT * EXCLUDE (held, free) REPLACE (weight * CASE WHEN target_{m} <= held THEN target_{m} / (held + free) "
                 f"WHEN free > 0 THEN (target_{m} - held) / free ELSE 1 END AS weight) FROM "
                 f"(SELECT *, sum(CASE WHEN weight >= most THEN most ELSE 0 END) OVER (PARTITION BY {m}) AS held, "
                 f"sum(CASE WHEN weight >= most THEN 0 ELSE weight END) OVER (PARTITION BY {m}) AS free FROM {inner}))")
    apart = ", ".join(f"abs(sum(least(weight, most)) OVER (PARTITION BY {m}) - target_{m})" for m in MARGINS)
    parts.append(f"rounds AS (SELECT 0 AS k, *, 1.0::DOUBLE AS apart FROM w0 UNION ALL SELECT k + 1, source, lang, topic, tokens, weight, most, target_source, target_lang, target_topic, "
                 f"max(one) OVER () FROM (SELECT *, greatest({apart}) AS one FROM {inner}))")
    parts.append(f"r AS (SELECT source, lang, topic, round(least(1.0, {BUDGET} * least(weight, most) * n / tokens), 6) AS rate FROM rounds, z WHERE k = (SELECT max(k) FROM rounds))")
    parts.append(
        "p AS (SELECT doc_id, d.source, d.lang, d.topic, n_tokens, CASE WHEN n_tokens > 0 THEN coalesce(rate, 0.0) ELSE 0.0 END AS probability "
        "FROM d LEFT JOIN r ON d.source = r.source AND d.lang = r.lang AND d.topic = r.topic)"
    )
    return "WITH RECURSIVE " + ",\n".join(parts) + (
        f"\nSELECT *, (('0x' || substr(md5('{SEED}' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0) < probability AS drawn FROM p"
    )
