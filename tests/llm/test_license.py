import re

import pytest

from tidemill.llm import license


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@pytest.mark.parametrize("text", ["", "Cc  BY cc-by: CC by", "GNU General Public\nLicense, general public license", "All rightsé reserved. ALL RIGHTS RESERVED", "É cc by É", "cc cc by by", "a_b 1.2"])
def test_base(text):
    w, found = words(text), []
    for phrase, label in license.BASE_PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    r = license.scan_text(text.encode())
    assert (r["n_words"], r["n_base"]) == (len(w), len(found))
    assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
    assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and set(x for _, x in found) <= set(r["labels"].split(","))


@pytest.mark.parametrize(("text", "label"), [("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"), ("licensed under CC BY-NC 4.0", "cc-by-nc-4.0"), ("SPDX-License-Identifier: MPL-2.0", "mpl"), ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("GNU Lesser General Public License v2.1", "lgpl-2.1")])
def test_rules(text, label):
    assert label in license.scan_text(text.encode())["labels"].split(",")


def test_contained_detections_are_suppressed():
    kept = license.detect(b"licensed under the apache license version 2 0")
    assert [r.label for r, _, _ in kept] == ["apache-2.0"]
    assert len(license.rules()) > 300


def test_operator(spark):
    rows = [(1, None), (2, ""), (3, "all rights reserved"), (3, "all rights reserved"), (None, "x"), (4, "lorem " * 50000 + "cc by")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, labels string, n_words int")
    got = {(r["doc_id"], r["n_words"]): r for r in license.scan(df).collect()}
    assert got[1, 0]["labels"] == got[2, 0]["labels"] == "" and got[1, 0]["first_word"] is None and got[1, 0]["score"] == 0
    assert got[4, 50002]["first_word"] == 50000 and got[4, 50002]["base_labels"] == "cc-by"
    assert license.scan(df).count() == 6 and license.scan(df.limit(0)).count() == 0
