"""Licence scan with a positional rare-token index, in Spark SQL functions only.

Templates are phrases and passages of licences: words with relative positions
and a mandatory key phrase. The scan reduces each file to its licence words
with their positions (its part of the index) and counts in how many files each
word occurs. A template can be in a file only if all words of its key phrase
are. The words that a file looks up are its own with the highest inverse
document frequency, down to those that cover each such template. An occurrence
at p of a word that stands at r in a template proposes that the template starts
at p - r. The template's expected postings are intersected with those of the
file around it; it is found where the key phrase is whole and enough of its
weight is in place. Templates are data (array literals), so the plan does not
grow with them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstats.sources import keep

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's weight that must be in place.
LEAST_SHARE = 0.6

@dataclass(frozen=True)
class Template:
    """``words`` with ``_`` for a word that is not looked at; the key phrase must be in place."""

    label: str
    words: str
    key: str
    base: bool = False

    def places(self) -> list[tuple[int, str, bool]]:
        """Position, word and whether it belongs to the key phrase."""
        words, key = self.words.split(), self.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return [(i, w, at <= i < at + len(key)) for i, w in enumerate(words) if w != "_"]


# The phrases and labels that every scan reports.
BASE = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
)
OWN = (
    Template("gpl-2.0", "gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("apache-2.0", "apache license version 2 0", "apache license version 2"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd", "cc by nd"),
    Template("cc-by-nc-sa", "cc by nc sa", "cc by nc sa"),
    Template("cc-by-nc-nd", "cc by nc nd", "cc by nc nd"),
    Template("creative-commons", "creative commons attribution", "creative commons attribution"),
    Template("bsd", "redistribution _ use _ source _ binary forms", "binary forms"),
    Template("bsd", "bsd license", "bsd license"),
    Template("mit", "permission _ hereby granted free _ charge", "hereby granted free"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("isc", "isc license", "isc license"),
)


# Words of passages that are not looked at, since most texts have them.
COMMON = set(
    """a all an and any are as at be but by for from if in including is it its may no not of on one or other
    shall that the their this to under was were which with within without you your""".split()
)


def passage(label: str, text: str, key: str) -> Template:
    """A template of running text: punctuation and common words are not looked at."""
    words = re.findall(WORD, text.lower())
    return Template(label, " ".join("_" if w in COMMON else w for w in words), key)


# Passages of licence texts, cut where names or years are filled in.
PASSAGES = (
    passage(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions""",
        "merge publish distribute sublicense",
    ),
    passage(
        "mit",
        """The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software""",
        "substantial portions",
    ),
    passage(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met""",
        "binary forms",
    ),
    passage(
        "bsd",
        """Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer""",
        "source code must retain",
    ),
    passage(
        "bsd",
        """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution""",
        "binary form must reproduce",
    ),
    passage(
        "bsd-3-clause",
        """contributors may be used to endorse or promote products derived from this software without specific
        prior written permission""",
        "specific prior written permission",
    ),
    passage(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies""",
        "hereby granted provided",
    ),
    passage(
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at""",
        "apache license version 2 0",
    ),
    passage(
        "apache-2.0",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied""",
        "unless required",
    ),
    passage(
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation""",
        "gnu general public license",
    ),
    passage(
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation""",
        "gnu lesser general public license",
    ),
    passage(
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation""",
        "gnu affero general public license",
    ),
    passage(
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at""",
        "mozilla public license",
    ),
    passage(
        "epl",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public
        License""",
        "eclipse public license",
    ),
    passage(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software""",
        "unencumbered software released",
    ),
    passage(
        "zlib",
        """Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software""",
        "altered source versions must",
    ),
    passage(
        "cc0",
        """has waived all copyright and related or neighboring rights to this work""",
        "neighboring rights",
    ),
    passage(
        "creative-commons",
        """This work is licensed under a Creative Commons Attribution International License""",
        "creative commons attribution",
    ),
)
TEMPLATES = BASE + OWN + PASSAGES


def lowered(text: str) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower())


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for _, w, _ in t.places()})


def index(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """``doc_id``, ``n_words`` and ``occ``, the file's postings in order.

    A posting is one number: the position times the size of the vocabulary,
    plus the word's place in it.
    """
    known = vocabulary(templates)
    listed = literal(known, "array<string>")
    words = F.regexp_extract_all(lowered("text"), F.lit(f"({WORD})"), F.lit(0))
    split = docs.select(F.col("doc_id").cast("bigint"), words.alias("words"))
    posted = F.transform(
        "words",
        lambda w, i: F.when(
            w.isin(known), i.cast("bigint") * len(known) + F.array_position(listed, w) - 1
        ),
    )
    return split.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.filter(posted, lambda o: o.isNotNull()).alias("occ"),
    )


def weights(indexed: DataFrame, size: int) -> list[float]:
    """Inverse document frequency of each licence word over all files; one row per word comes to the driver."""
    found = F.explode(F.array_distinct(F.transform("occ", lambda o: F.pmod(o, F.lit(size))))).alias("word")
    frequency = {r["word"]: r["count"] for r in indexed.select(found).groupBy("word").count().collect()}
    files = indexed.count()
    return [math.log(1.0 + (files + 1) / (frequency.get(w, 0) + 1)) for w in range(size)]


def literal(values: list, kind: str) -> Column:
    """A constant array of any depth, as one expression."""

    def nested(value) -> str:
        return f"array({', '.join(map(nested, value))})" if isinstance(value, list) else repr(value)

    return F.expr(f"cast({nested(values)} as {kind})")


def scan(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least_share: float = LEAST_SHARE
) -> DataFrame:
    """Licence phrases and passages of every whole text.

    Returns a row per row: ``doc_id``, ``n_words``, ``n_base`` (places of base
    phrases), ``first_word`` and ``last_word`` (smallest and largest start of
    one, from 0; null if there is none), ``base_labels``, ``labels`` (both
    sorted, distinct, joined by commas; empty if there is none), ``score``
    (largest share of a template's weight in place, 0 to 1) and ``spans``, the
    places found as label, start and length (one for each label, start and
    length). A null text is empty. Other columns are not read; no row is
    dropped.
    """
    known = vocabulary(templates)
    size, many = len(known), len(templates)
    number = {w: i for i, w in enumerate(known)}
    indexed = keep(index(docs, templates))
    weight = weights(indexed, size)

    expected, keys, postings = [], [], [[] for _ in known]
    for n, template in enumerate(templates):
        places = [(at, number[w], is_key) for at, w, is_key in template.places()]
        expected.append([at * size + w for at, w, _ in places])
        keys.append([at * size + w for at, w, is_key in places if is_key])
        # A file with the whole key phrase has its rarest word, which is then the file's word of
        # highest weight that covers the template.
        at, rarest, _ = min((p for p in places if p[2]), key=lambda p: (-weight[p[1]], p[0]))
        postings[rarest].append(at * many + n)
    all_expected, all_keys = literal(expected, "array<array<bigint>>"), literal(keys, "array<array<bigint>>")
    key_words = literal([[k % size for k in key] for key in keys], "array<array<bigint>>")
    totals = literal([sum(weight[e % size] for e in one) for one in expected], "array<double>")
    lengths = literal([len(t.words.split()) for t in templates], "array<int>")
    all_weights, all_postings = literal(weight, "array<double>"), literal(postings, "array<array<bigint>>")
    labels = literal([t.label for t in templates], "array<string>")
    base = [n for n, t in enumerate(templates) if t.base]
    looked_up = [w for w in range(size) if postings[w]]

    def pick(array: Column, at: Column) -> Column:
        return F.get(array, at.cast("int"))

    def word(posting: Column) -> Column:
        return F.pmod(posting, F.lit(size))

    possible = F.filter(
        F.sequence(F.lit(0), F.lit(many - 1)),
        lambda n: F.size(F.array_except(pick(key_words, n), F.col("present"))) == 0,
    )

    def proposals(posting: Column, at: Column) -> Column:
        """Templates and starts that one posting proposes, with its place in the index."""
        mine = F.filter(
            pick(all_postings, word(posting)),
            lambda q: F.array_contains("possible", F.pmod(q, F.lit(many)).cast("int")),
        )
        return F.transform(
            F.when(word(posting).isin(looked_up), mine),
            lambda q: F.struct(
                F.pmod(q, F.lit(many)).cast("int").alias("kind"),
                (F.floor(posting / size) - F.floor(q / many)).alias("start"),
                F.floor(q / many).cast("int").alias("before"),
                at.alias("at"),
            ),
        )

    def share(proposal: Column) -> Column:
        """The proposal with its share of weight in place; null where the key phrase is not whole."""
        kind, shift = proposal["kind"], proposal["start"] * size
        first = F.greatest(proposal["at"] + 1 - proposal["before"], F.lit(1))
        near = F.slice("occ", first, pick(lengths, kind))
        wanted = pick(all_expected, kind)
        held = F.array_intersect(F.transform(wanted, lambda e: e + shift), near)
        key = F.transform(pick(all_keys, kind), lambda e: e + shift)
        mass = F.aggregate(held, F.lit(0.0), lambda total, h: total + pick(all_weights, word(h)))
        part = F.when(F.size(held) == F.size(wanted), 1.0).otherwise(mass / pick(totals, kind))
        sure = F.size(F.array_except(key, held)) == 0
        return F.struct(kind.alias("kind"), proposal["start"].alias("start"), F.when(sure, part).alias("share"))

    def some(values: Column) -> Column:
        """Only files in which a template is possible are looked at."""
        return F.when(F.size("possible") > 0, values).otherwise(F.slice(values, 1, 0))

    rows = indexed.withColumn("present", F.array_distinct(F.transform("occ", word)))
    rows = rows.withColumn("possible", F.when(F.size("occ") > 0, possible).otherwise(F.array().cast("array<int>")))
    looked = F.flatten(F.filter(F.transform(some(F.col("occ")), proposals), lambda x: x.isNotNull()))
    rows = rows.withColumn("looked", looked)
    found = F.filter(F.transform("looked", share), lambda f: f["share"] >= least_share - 1e-9)
    rows = rows.select("doc_id", "n_words", found.alias("found"))
    starts = F.transform(F.filter("found", lambda f: f["kind"].isin(base)), lambda f: f["start"])
    rows = rows.withColumn("starts", starts)

    def named(found: Column) -> Column:
        one = F.array_distinct(F.transform(found, lambda f: pick(labels, f["kind"])))
        return F.array_join(F.array_sort(one), ",")

    return rows.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("bigint").alias("n_base"),
        F.array_min("starts").cast("bigint").alias("first_word"),
        F.array_max("starts").cast("bigint").alias("last_word"),
        named(F.filter("found", lambda f: f["kind"].isin(base))).alias("base_labels"),
        named(F.col("found")).alias("labels"),
        F.aggregate("found", F.lit(0.0), lambda a, f: F.least(F.greatest(a, f["share"]), F.lit(1.0))).alias("score"),
        spans("found", labels, lengths).alias("spans"),
    )


def spans(found: str, labels: Column, lengths: Column) -> Column:
    """Places as label, start and length, in order of start and length."""

    def place(f: Column) -> Column:
        length, label = F.get(lengths, f["kind"]), F.get(labels, f["kind"])
        return F.struct(f["start"].alias("start"), length.alias("length"), label.alias("label"))

    ordered = F.array_sort(F.array_distinct(F.transform(found, place)))
    return F.transform(ordered, lambda s: F.struct(s["label"], s["start"], s["length"]))
