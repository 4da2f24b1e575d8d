"""Calibrated rates, and items found per place in a document."""

import random
import re

from pyspark.sql import functions as F

from airsense.llm import decontamination, mixing

UNITS = set(decontamination.UNITS)


def test_rates_meet_reachable_targets(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        source, lang = ("hot" if hot else f"s{i % 7}"), rng.choice(["en"] * 8 + ["de", "fr"])
        rows.append((i, " ".join(["word"] * rng.randint(150, 300)) + rng.choice(["", " | ", " http "]), lang, source, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    rated = mixing.rated(docs)
    out = mixing.marginals(rated).collect()
    assert all(abs(r.residual) < 0.01 for r in out), out
    for m in mixing.MARGINS:
        assert abs(sum(r.target for r in out if r.margin == m) - 1) < 1e-9
        assert abs(sum(r.expected for r in out if r.margin == m) - 1) < 0.01
    assert rated.where("probability > 1").isEmpty()
    drawn = mixing.sample(docs)
    assert drawn.where("topic = 'x'").isEmpty() and drawn.count() == rated.where("drawn").count()


def test_values_that_have_too_little_give_all(spark):
    rows = [(i, "a b c d", "en", "big" if i else "small") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.value: r for r in mixing.marginals(mixing.rated(docs)).where("margin = 'source'").collect()}
    assert abs(out["small"].target - 0.02) < 1e-9 and abs(out["small"].expected - 0.02) < 1e-6 and abs(out["big"].expected - 0.98) < 1e-4


def marked(text):
    text = re.sub(r"(?<=[a-z0-9,;] )([A-Z][A-Za-z]*)", "\x01\\1", text or "")
    return [w for w in re.split("[^A-Za-z0-9\x01]+", text) if w]


def typed(w):
    if w[0] == "\x01":
        return "<name>"
    return "<number>" if w[0].isdigit() else "<unit>" if w.lower() in UNITS else w.lower()


def expected(docs, items):
    """The definition without joins: every pair of window places, grouped by distance."""
    k, out = decontamination.WIDTH, {}
    for item, asked in items.items():
        a = marked(asked)
        wins = {p: a[p : p + k] for p in range(len(a) - k + 1) if any(typed(w)[0] != "<" for w in a[p : p + k])}
        of = len({tuple(map(typed, w)) for w in wins.values()})
        for doc, text in docs.items():
            b = marked(text)
            hits = sorted((q - p, p, q) for q in range(len(b) - k + 1) for p, w in wins.items() if list(map(typed, b[q : q + k])) == list(map(typed, w)))
            groups, last = [[]], None
            for h in hits:
                if last is not None and h[0] - last > decontamination.DRIFT:
                    groups.append([])
                groups[-1].append(h)
                last = h[0]
            literal = [h for h in hits if [w.lower() for w in b[h[2] : h[2] + k]] == [w.lower() for w in wins[h[1]]]]
            best = 0
            for kind, g in [("place", g) for g in groups] + [("all", hits), ("literal", literal)]:
                slots = {}
                for _, p, q in g:
                    for x, y in zip(wins[p], b[q : q + k]):
                        if typed(x)[0] == "<":
                            slots.setdefault(x, set()).add(y)
                n = len({tuple(map(typed, wins[p])) for _, p, _ in g})
                if of and n / of >= decontamination.COVERAGE and (kind == "literal" or all(len(v) == 1 for v in slots.values())):
                    best = max(best, n)
            if best:
                out[doc, item] = best
    return out


def test_places_against_brute_force(spark):
    item = "a train leaves the town at 40 km and comes back at 40 km after the third long bridge of the valley"
    other = item.replace("40", "77")
    mixed = other.replace("77 km after", "99 km after")
    rows_of_numbers = "first we write 1 and 2 and 3 then we write 4 and 5 and 6 then we write 7 and 8 and 9 then we stop"
    items = {1: item, 2: "short one", 3: None, 4: rows_of_numbers, 5: item, 6: "1 2 3 4 5 6 7 8 9 10 11 12"}
    rng = random.Random(5)
    docs = {
        1: item + " . " + other, 2: mixed, 3: mixed + " and so " + item, 4: other, 5: rows_of_numbers, 6: rows_of_numbers.replace("8", "0"),
        7: None, 8: "", 9: item[:60], 10: "5 6 7 8 9 1 2 3 4 5 6 7 8", 11: item.replace(" and comes", " well and comes"), 12: " ".join([mixed] * 30 + [other]),
        13: item.replace("comes", " ".join(f"filler{i}" for i in range(40)) + " comes"),
    }
    parts = [item, other, mixed, rows_of_numbers]
    for i in range(20, 60):
        words = " . ".join(rng.sample(parts, 2)).split()
        words[rng.randrange(len(words))] = rng.choice(["12", "Anna", "km", "plain"])
        docs[i] = " ".join(words[rng.randrange(5) :])
    found = decontamination.matches(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("own", F.lit("clash")).withColumn("window", F.lit(1)),
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
    )
    got = {(r.doc_id, r.item_id): r.n_windows for r in found.collect()}
    assert got == expected(docs, items)
    assert (1, 1) in got and (3, 1) in got and (12, 1) in got and (5, 4) in got and (2, 1) not in got and not {d for d, _ in got} & {7, 8, 10}
