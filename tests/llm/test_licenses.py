"""License scan against a plain statement of its contract and rules."""

import re

from tests.llm.helpers import ODD, no_docs, odd_docs
from thinkframe.llm import licenses
from thinkframe.llm.license_rules import BASE, CONFIDENCE, rules

TEXTS = [
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0. apache license apache license",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "cc by cc by CC-BY ccé by mit-license xmit license mit licenses",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "SPDX-License-Identifier: MIT",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
    "GNU Lesser General Public License v2.1 and BSD 3-Clause License; all rights reserved. Copyright (c) 2020",
    "mit lizenz gnu general public licence apache-license",
    "All rights reserved.\nMIT License " * 3,
]


def brute(text):
    """Detections by Python's regexes over the words, suppression by all pairs."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spaced = " " + "  ".join(words) + " "
    found = []
    for r in rules():
        if words and r.literal in spaced:
            for m in re.finditer(r.regex, spaced):
                start = spaced[: m.start()].count(" ") // 2
                found.append((r, start, start + m[0].count(" ") // 2))

    def hides(e, d):
        if not (e[1] <= d[1] and e[2] >= d[2] and 0 < e[0].tier <= d[0].tier):
            return False
        return e[1:] != d[1:] or (e[0].tier, e[0].number) < (d[0].tier, d[0].number)

    kept = [d for d in found if d[0].tier == 0 or not any(hides(e, d) for e in found if e is not d)]
    base = [d for d in found if d[0].tier == 0]
    joined = lambda ds: ",".join(sorted({d[0].label for d in ds}))
    return (
        len(words), len(base), min((d[1] for d in base), default=None), max((d[1] for d in base), default=None),
        joined(base), joined(kept), max((CONFIDENCE[d[0].tier] for d in kept), default=0.0), len(kept),
    )


def scanned(df):
    return [tuple(r) for r in licenses.scan(df).collect()]


def test_scan_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    assert dict((r[0], r[1:]) for r in scanned(df)) == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_odd_rows(spark):
    got = sorted(scanned(odd_docs(spark, clashing=True)), key=str)
    assert got == sorted([(i, *brute(t)) for i, t, _, _ in ODD], key=str)


def test_repeated_rows_stay_apart(spark):
    df = spark.createDataFrame([(1, TEXTS[0])] * 3 + [(None, TEXTS[3])] * 2, "doc_id long, text string")
    assert sorted(scanned(df), key=str) == sorted([(1, *brute(TEXTS[0]))] * 3 + [(None, *brute(TEXTS[3]))] * 2, key=str)


def test_many_detections_in_one_text(spark):
    text = "mit license or apache license version 2 0 " * 3000
    row = scanned(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0]
    assert row[1:5] == (24000, 6000, 0, 23995) and row[5] == "apache,mit"


def test_no_documents(spark):
    assert licenses.scan(no_docs(spark)).count() == 0


def test_base_phrases_as_places(spark):
    for label, phrase in BASE:
        row = brute(f"x {phrase.upper()} {phrase}")
        assert row[1] == 2 and row[2] == 1 and label in row[4].split(",")


def test_there_are_hundreds_of_rules_with_unique_numbers():
    table = rules()
    assert len(table) > 300 and [r.number for r in table] == list(range(len(table)))
    assert all(re.fullmatch(r"[0-9a-zé ]+", r.keyword) for r in table)
