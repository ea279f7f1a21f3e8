"""License scan: a positional index of rare licence words, verified by mandatory key phrases.

Everything is DataFrame expressions; texts are read where they lie and never shuffled.
Rows are documents (``text``); other columns are kept, and columns of the result replace
older ones of the same name. Words are runs of ASCII letters (A-Z lower-cased), digits and
all characters beyond ASCII.

An entry of the index is a notice with key phrases, which stand at fixed places in it. The
corpus says which of its key words is the rarest (fewest documents, ties by word); a file's
words are looked up among those rarest words, each hit names the entry's place in the file,
and there the other key words, rarest first, must stand at their relative positions. An
entry that holds there is scored by the share of all its words that stand at their places.

A NULL, empty or blank text has no words, no places and score 0. Rows are judged on their
own, repeated rows alike; very long texts are read whole, with work in proportion to their
words and hits. Entries that stand in a text several times, or tie, all count; equal labels
are named once. No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .quality_rules import bound

#: Separators of words, in regular expressions of the JVM and of SQL.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Least share of a notice's words in place for its label; its key phrases must hold anyway.
MIN_SHARE = 0.5


@dataclass(frozen=True)
class Entry:
    """A notice and its key phrases, all in lower-case words parted by single blanks.

    A ``base`` entry is a bare phrase: it names places and labels, but has no score.
    """

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_words(self) -> list[tuple[int, str]]:
        """Places in the notice and words of all key phrases."""
        words, found = self.words, {}
        for key in self.keys:
            own = key.split()
            starts = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
            if not own or not starts:
                raise ValueError(f"key phrase {key!r} does not stand in {self.text!r}")
            found.update((starts[0] + n, w) for n, w in enumerate(own))
        return sorted(found.items())


def phrase(label: str, text: str) -> Entry:
    return Entry(label, text, (text,), base=True)


# The words of public licence notices.
PHRASES = (
    phrase("mit", "mit license"),
    phrase("apache", "apache license"),
    phrase("gpl", "general public license"),
)
NOTICES = (
    Entry("mit", "released under the mit license", ("mit license",)),
    Entry("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
          " associated documentation files the software to deal in the software without restriction",
          ("permission is hereby granted free of charge", "associated documentation files")),
    Entry("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Entry("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Entry("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Entry("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as"
          " published by the free software foundation",
          ("redistribute it and or modify it", "gnu general public license as published")),
    Entry("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Entry("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Entry("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"
          " that the following conditions are met",
          ("redistribution and use in source and binary forms", "are permitted provided that")),
    Entry("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is"
          " hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Entry("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
          ("mozilla public license v 2 0",)),
    Entry("unlicense", "this is free and unencumbered software released into the public domain",
          ("free and unencumbered software",)),
    Entry("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Entry("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Entry("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Entry("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Entry("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


def words_of(text: Column) -> Column:
    """Words of a text; an empty array for NULL.

    U+212A is the one other letter whose lower case is in ASCII; it must not become a ``k``.
    """
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def word_rarity(docs: DataFrame, entries: tuple[Entry, ...], text: str = "text") -> dict[str, int]:
    """Documents that hold each key word, over all documents; one row for each key word is fetched."""
    known = sorted({w for e in entries for _, w in e.key_words()})
    held = F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, known)))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(known, 0) | {r["word"]: r["count"] for r in rows}


def _index(entries: tuple[Entry, ...], rarity: dict[str, int]) -> tuple[Column, list[str]]:
    """The entries as one array, key words rarest first, and the words that files are searched for."""
    rows, anchors = [], set()
    for entry in entries:
        keys = sorted(entry.key_words(), key=lambda k: (rarity[k[1]], k[1], k[0]))
        anchors.add(keys[0][1])
        pair = lambda k: F.struct(F.lit(k[0]).alias("at"), F.lit(k[1]).alias("word"))
        rows.append(F.struct(
            F.lit(entry.label).alias("label"), F.lit(entry.base).alias("base"),
            F.lit(keys[0][1]).alias("anchor"), F.lit(keys[0][0]).alias("at"),
            F.array(*map(pair, keys[1:] or keys)).alias("keys"),
            F.array(*map(pair, enumerate(entry.words))).alias("words"),
        ))
    return F.array(*rows), sorted(anchors)


def _places(words: Column, entries: Column, anchors: list[str]) -> Column:
    """Where entries hold: their label, whether they are bare phrases, first word, and share of words in place."""
    stands = lambda start: lambda k: F.get(words, start + k["at"]) == k["word"]
    hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(anchors))
    named = F.flatten(F.transform(hits, lambda i: F.transform(
        F.filter(entries, lambda e: e["anchor"] == F.get(words, i)),
        lambda e: F.struct(e.alias("entry"), (i - e["at"]).alias("start")),
    )))
    held = F.filter(named, lambda c: F.forall(c["entry"]["keys"], stands(c["start"])))
    return F.transform(held, lambda c: F.struct(
        c["entry"]["label"].alias("label"), c["entry"]["base"].alias("base"), c["start"].alias("start"),
        (F.size(F.filter(c["entry"]["words"], stands(c["start"]))) / F.size(c["entry"]["words"])).alias("share"),
    ))


def _labels(places: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(places, lambda p: p["label"])))


def scan(
    docs: DataFrame, phrases: tuple[Entry, ...] = PHRASES, notices: tuple[Entry, ...] = NOTICES, text: str = "text"
) -> DataFrame:
    """``docs`` with ``n_words``, ``places`` (of bare phrases and notices), ``base_labels``, ``labels`` and ``score``.

    ``places`` is an array of label, ``base``, ``start`` (word, from 0) and ``share``; the score
    is the largest share of a notice.
    """
    every = (*phrases, *notices)
    entries, anchors = _index(every, word_rarity(docs, every, text))
    none = F.array().cast("array<struct<label:string,base:boolean,start:int,share:double>>")

    def judge(words: Column) -> Column:
        some = F.arrays_overlap(words, F.array(*map(F.lit, anchors)))
        places = bound(entries, lambda index: _places(words, index, anchors))
        return bound(F.when(some, places).otherwise(none), lambda p: F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            p.alias("places"),
            _labels(F.filter(p, lambda x: x["base"])).alias("base_labels"),
            _labels(F.filter(p, lambda x: x["base"] | (x["share"] >= MIN_SHARE))).alias("labels"),
            F.coalesce(F.array_max(F.transform(F.filter(p, lambda x: ~x["base"]), lambda x: x["share"])), F.lit(0.0)).alias("score"),
        ))

    names = ("n_words", "places", "base_labels", "labels", "score")
    kept = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in names]
    return docs.select(*kept, F.inline(F.array(bound(words_of(F.col(f"`{text}`")), judge))))
