"""Licence scans by a positional index of rare tokens.

A licence is known by templates: a phrase or sentence of its text with the words that must stand there (its
key).  The index has, for each template, the two of its words with the highest inverse document frequency,
counted over all files, and their positions.

1. Of each file only those rare words are looked up, with the places where they stand.
2. A place of a rare word less its position in the template is where the template would begin.  The
   postings of a template's two rare words are intersected by that relative position; what is left are
   the alignments.
3. An alignment is a match if all words of the template's key stand in their places, and at least
   ``LEAST_SHARE`` of all its words do.  A template whose key is the whole phrase (``base``) is found
   exactly: every place of the phrase has both rare words, so it is among the alignments.

Words are runs of letters, digits and non-ASCII characters; A-Z count as a-z.

All of it is DataFrame functions on one row at a time: a scan counts the files of each template word, a
second one looks the rare words up.  Only those counts, one for each word of the templates, reach the
driver; nothing else is shuffled.

Defined cases: a null or empty text has no words, no places, empty label lists and score 0; equal document
frequencies are told apart by the position; overlapping places all count; repeated rows, and rows with equal
or null doc_id, get one row each; an empty table gives no rows; other columns are ignored, whatever their
names.  A text of any length is one row with its words as an array.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.llm.text import ascii_lower

#: Words of lower-cased texts.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's words that must stand in their places.
LEAST_SHARE = 0.8


@dataclass(frozen=True)
class Template:
    """``label``, the words of a passage, and the phrases of it that must stand there (none: all of it)."""

    label: str
    text: str
    keys: tuple[str, ...] = ()

    @property
    def base(self) -> bool:
        return not self.keys

    @property
    def words(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.text)

    @property
    def must(self) -> list[int]:
        """Positions of the words of the keys."""
        words, found = self.words, set()
        for key in self.keys or (self.text,):
            k = re.findall("[a-z0-9]+", key)
            at = next(i for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k)
            found.update(range(at, at + len(k)))
        return sorted(found)


# Phrases that licences are known by.
TEMPLATES = [
    Template("cc-by", "cc by"),
    Template("gpl", "general public license"),
    Template("reserved", "all rights reserved"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc0", "has waived all copyright and related or neighboring rights to this work", ("waived all copyright", "neighboring rights")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """The number of rows with each word of ``vocabulary``; a row for each such word reaches the driver."""
    known = F.array(*map(F.lit, vocabulary))
    found = docs.select(F.explode(F.array_intersect(tokens(F.col("text")), known)).alias("word"))
    return {r.word: r.n for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def rare_positions(template: Template, frequency: dict[str, int]) -> list[int]:
    """Positions of the template's two words in the fewest files, each word's first one."""
    words = template.words
    first = [k for k, w in enumerate(words) if words.index(w) == k]
    return sorted(first, key=lambda k: (frequency.get(words[k], 0), k))[:2]


def index_of(templates: list[Template], frequency: dict[str, int]) -> tuple[Column, list[str]]:
    """The index, an array with an entry for each template, and its rare words."""
    entries, rare = [], set()
    for t in templates:
        at = rare_positions(t, frequency)
        one, other = at[0], at[-1]
        rare |= {t.words[one], t.words[other]}
        fields = {"label": F.lit(t.label), "base": F.lit(t.base), "words": F.array(*map(F.lit, t.words)), "must": F.array(*map(F.lit, t.must))}
        fields |= {"word1": F.lit(t.words[one]), "at1": F.lit(one), "word2": F.lit(t.words[other]), "at2": F.lit(other)}
        entries.append(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return F.array(*entries), sorted(rare)


def alignments(words: Column, hits: Column, index: Column) -> Column:
    """An array of (label, base, start, share, match) for each template and place where its rare words agree."""
    starts = lambda t, n: F.transform(F.filter(hits, lambda h: h["word"] == t[f"word{n}"]), lambda h: h["at"] - t[f"at{n}"])

    def place(t: Column, s: Column) -> Column:
        stands = lambda k: F.get(words, s + k).eqNullSafe(F.get(t["words"], k))
        share = F.size(F.filter(F.sequence(F.lit(0), F.size(t["words"]) - 1), stands)) / F.size(t["words"])
        match = F.forall(t["must"], stands) & (share >= LEAST_SHARE)
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), s.alias("start"), share.alias("share"), match.alias("match"))

    return F.flatten(F.transform(index, lambda t: F.transform(F.array_intersect(starts(t, 1), starts(t, 2)), lambda s: place(t, s))))


def scan_licences(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and found (label, first
    word and share of words in place of each match) of every row.

    ``n_base`` counts the places of the base templates, ``first_word`` and ``last_word`` are the least and
    greatest of them; ``labels`` are those of all matches; ``score`` is the greatest share of words in place
    of any alignment.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    index, rare = index_of(templates, document_frequencies(docs, vocabulary))
    looked_up = F.array(*map(F.lit, rare))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("words"))
    placed = F.filter(F.transform("words", lambda w, k: F.struct(k.alias("at"), w.alias("word"))), lambda h: F.array_contains(looked_up, h["word"]))
    hits = split.withColumn("hits", F.when(F.arrays_overlap("words", looked_up), placed))
    aligned = hits.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.col("hits").isNotNull(), alignments(F.col("words"), F.col("hits"), index)).alias("found"))
    matches = F.coalesce(F.filter("found", lambda a: a["match"]), F.array().cast("array<struct<label:string,base:boolean,start:int,share:double,match:boolean>>"))
    kept = aligned.select("doc_id", "n_words", F.coalesce(F.array_max(F.transform("found", lambda a: a["share"])), F.lit(0.0)).alias("score"), matches.alias("found"))
    base = kept.withColumn("base", F.filter("found", lambda a: a["base"]))
    starts = F.transform("base", lambda a: a["start"].cast("long"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda a: a["label"]))), ",")
    return base.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("found").alias("labels"),
        "score",
        F.transform("found", lambda a: F.struct(a["label"].alias("label"), a["start"].alias("start"), a["share"].alias("share"))).alias("found"),
    )
