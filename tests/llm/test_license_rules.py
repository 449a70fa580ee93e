"""Every rule behind its prefilter, suppression against a plain form, and long texts."""

import random
import re
import time

import pytest

from tidemill.llm import license

try:
    from re import _parser as parser
except ImportError:
    import sre_parse as parser


def sample(pattern, rng):
    """A random text that a pattern matches."""
    out = []
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "IN":
            kind, value = rng.choice(arg)
            out.append(chr(value if str(kind) == "LITERAL" else rng.randint(*value)))
        elif name == "ANY":
            out.append("z")
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            out += [sample(inner, rng) for _ in range(rng.randint(low, min(high, low + 3)))]
        elif name == "SUBPATTERN":
            out.append(sample(arg[3], rng))
        elif name == "BRANCH":
            out.append(sample(rng.choice(arg[1]), rng))
        elif name != "ASSERT_NOT":
            raise ValueError(name)
    return "".join(out)


@pytest.mark.parametrize("part", range(4))
def test_keywords_hide_no_alternative(part):
    """Texts drawn from each pattern hold one of its keywords at the start of a word: the prefilter loses nothing."""
    rng = random.Random(part)
    found = license.rules()[part::4]
    assert len(license.rules()) > 500
    for rule in found:
        tree = parser.parse(rule.pattern.pattern)
        for _ in range(12):
            text = sample(tree, rng).encode("latin-1")
            text = re.sub(rb" +", b" ", text).strip()
            if not rule.pattern.search(text):
                continue  # a drawn blank that the words' joining does not have
            assert any(b" " + k in b" " + text for k in rule.keywords), (rule.label, text)
            assert any(r is rule for r, _, _ in license.hits(b"some words " + text + b" and more")), (rule.label, text)


def test_hits_without_prefilter(spark, sf):
    texts = [license.normalised((r[0] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for words in texts[::5]:
        plain = [(r.label, m.start(), m.end()) for r in license.rules() for m in r.pattern.finditer(words)]
        assert sorted(plain) == sorted((r.label, a, b) for r, a, b in license.hits(words))


def test_suppression_against_plain_form():
    rng = random.Random(5)
    rules = license.rules()
    for _ in range(200):
        found = []
        for _ in range(rng.randrange(30)):
            a = rng.randrange(60)
            found.append((rng.choice(rules), a, a + rng.randrange(1, 25)))
        kept = []
        for hit in sorted(found, key=lambda h: (-h[0].priority, h[1] - h[2], h[1], h[0].label)):
            if not any(a <= hit[1] and hit[2] <= b for _, a, b in kept):
                kept.append(hit)
        assert license.unsuppressed(found) == kept


def test_named_alternatives():
    for text, label in (("Released under the Expat License", "mit"), ("do what the fuck you want to public license", "wtfpl"), ("licensed under an open rail license", "openrail"), ("for noncommercial use only", "non-commercial"), ("Tous droits réservés", "reserved")):
        assert label in license.scan_text(text.encode())["labels"].split(","), text


def test_long_text_with_many_hits():
    text = b"all rights reserved. " * 16_000
    began = time.process_time()
    got = license.scan_text(text)
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (48_000, 16_000, 0, 47_997) and len(got["detections"]) == 16_000
    assert time.process_time() - began < 5
