import re

import pytest

from latewing.llm import licenses as L


def plain_scan(text, entries):
    """Every entry tried at every place."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = lambda i: words[i] if 0 <= i < len(words) else None
    found = []
    for e in entries:
        for start in range(-len(e.words), len(words)):
            if all(at(start + n) == w for n, w in e.key_words()):
                share = sum(at(start + n) == w for n, w in enumerate(e.words)) / len(e.words)
                found.append((e.label, e.base, start, share))
    return len(words), sorted(found)


TEXTS = [
    "Released under the MIT License. Or the mit  LICENSE, mit-license", "MIT\nLicense", "permit license mit licenses",
    "x Licensed under the Apache License, Version 2.0. GNU General Public License version 3 general public license",
    "Apache License version 2 0", "license version 2.0 apache", "Mozilla Public License, v. 2.0", "cc by nc 4 0 all rights reserved",
    "reserved all rights", "mitKicense mit LicenseK mit license", "été MIT Licenseé mit license", "mit", "license",
]


def test_places_equal_brute_force(spark, edge):
    rows = [(i, t, "old") for i, t in enumerate(TEXTS)]
    rows += [(90, None, "old"), (91, "", "old"), (92, " \n", "old"), (93, "ab mit license " * 30_000, "old"), (0, TEXTS[0], "old")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, labels string")
    found = L.scan(docs)
    assert found.columns == ["doc_id", "text", "n_words", "places", "base_labels", "labels", "score"]
    seen = found.collect()
    assert len(seen) == len(rows)
    for r in seen:
        count, places = (90_000, None) if r["doc_id"] == 93 else plain_scan(r["text"], (*L.PHRASES, *L.NOTICES))
        assert r["n_words"] == count
        if places is None:
            assert sum(p["base"] for p in r["places"]) == 30_000 and r["labels"] == ["mit"]
            continue
        assert sorted(tuple(p) for p in r["places"]) == places
        assert r["score"] == max((s for _, base, _, s in places if not base), default=0)
        assert r["base_labels"] == sorted({p[0] for p in places if p[1]})
        assert r["labels"] == sorted({p[0] for p in places if p[1] or p[3] >= L.MIN_SHARE})
    assert L.scan(edge).count() == edge.count() and L.scan(docs.limit(0)).count() == 0


def test_rarest_word_is_searched(spark):
    docs = spark.createDataFrame([("mit",), ("mit license",), ("general public",), ("general",), (None,)], "text string")
    rarity = L.word_rarity(docs, L.PHRASES)
    assert rarity == {"mit": 2, "license": 1, "apache": 0, "general": 2, "public": 1}
    _, anchors = L._index(L.PHRASES, rarity)
    assert anchors == ["apache", "license"]


def test_key_phrases_must_stand_in_the_notice():
    with pytest.raises(ValueError, match="does not stand"):
        L.Entry("x", "a b c", ("a c",)).key_words()
