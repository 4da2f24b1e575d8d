"""License notices over several lines, and words that are scattered over one."""

from math import ceil

import pytest

from airsense.llm import licenses
from test_operators import words

MIT = """# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that"""
GPL = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published"""


@pytest.mark.parametrize("label, text", [("mit", MIT), ("bsd", BSD), ("gpl", GPL)])
def test_wrapped_notices(spark, label, text):
    rows = [(1, text), (2, "some words before\n\n" + text.replace(" ", "\n") + "\nand after"), (3, " ".join(text.split()[:6]))]
    out = {r.doc_id: r for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert label in out[1].labels.split(",") and label in out[2].labels.split(",") and out[3].labels == ""
    assert out[1].score >= 0.9


def test_scattered_words_are_no_notice(spark):
    text = " and so on and on ".join("redistribution and use in source and binary forms with or without modification are permitted".split())
    out = licenses.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (out[0].labels, out[0].score) == ("", 0.0)


def test_labels_are_those_of_all_blocks(spark):
    texts, x = {}, 7
    every = [t.split() for _, t in licenses.TEMPLATES]
    for k in range(300):
        picked = []
        for _ in range(3):
            x = (x * 1103515245 + 12345) % (1 << 31)
            own = list(every[(x >> 8) % len(every)])
            own[(x >> 16) % len(own)] = "other"
            own.insert((x >> 12) % len(own), "more")
            picked += own[: len(own) - (x >> 20) % 2] + ["line"] * ((x >> 24) % 3)
        texts[k] = "\n".join(" ".join(picked[i : i + 5]) for i in range(0, len(picked), 5))
    out = licenses.scan_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    some = 0
    for r in out:
        held = words(texts[r.doc_id], r"[a-z0-9]+")
        labels = set()
        for label, template in licenses.TEMPLATES:
            own, width = set(template.split()), ceil(len(template.split()) / 0.9 - 1e-9)
            if any(len(own & set(held[i : i + width])) >= 0.9 * len(own) - 1e-9 for i in range(len(held))):
                labels.add(label)
        some += bool(labels)
        assert set(r.labels.split(",")) - {""} == labels | (set(r.base_labels.split(",")) - {""})
    assert some > 30
