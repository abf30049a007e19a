"""Licence notices in texts: a positional index of rare licence words."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The patterns and labels of the base scan
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]  # phrases without which the notice is not reported


# Notices as their authors ask to print them, shortened to the sentences that name the licence
TEMPLATES = [
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the \"Software\"), to deal in the Software without restriction",
             ("permission is hereby granted free of charge", "without restriction")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted", ("with or without fee is hereby granted",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl", "This work is licensed under the GNU General Public License", ("gnu general public license",)),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             ("gnu affero general public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license v 2 0",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
             ("creative commons attribution 4 0",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
             "to this work", ("waived all copyright and related or neighboring rights",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("free and unencumbered software released into the public domain",)),
    Template("reserved", "All rights reserved. No part of this publication may be reproduced, distributed or transmitted",
             ("all rights reserved", "no part of this publication may be reproduced")),
]
TEMPLATE_WORDS = 6  # rarest words of a template that are posted
FILE_WORDS = 16  # rarest posted words of a file that are looked up
ALIGNED = 3  # different rare words that must keep their distances


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def words(text: Column) -> Column:
    """The words of a text in lower case; null has none.

    Letters beyond ASCII are lower-cased as well, which is much faster than leaving them: they
    stay letters of their words, and the words that are looked for have none of them.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rarity(docs: DataFrame, text: str = "text", templates: list[Template] = TEMPLATES) -> list[str]:
    """The licence words that occur in the texts, those of highest inverse document frequency
    first, ties by name.

    The frequencies come from all texts; what reaches the driver is one row per word of the
    templates at most.
    """
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), words(F.col(text)))
    counts = docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    return [r.w for r in sorted(counts.collect(), key=lambda r: (r.df, r.w))]


def postings(ranked: list[str], templates: list[Template] = TEMPLATES,
             per_template: int = TEMPLATE_WORDS) -> list[tuple[str, list[tuple[int, int]]]]:
    """The index: (word, [(template, place), …]) of the rarest words of each template, in
    the order of `ranked`. Words that occur in no text cannot be looked up; a template whose
    key phrases hold such a word cannot be verified anywhere and is not posted."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        if not set(" ".join(template.keys).split()) <= set(ranked):
            continue
        own = words_of(template.text)
        chosen = set([w for w in ranked if w in own][:per_template])
        for q, w in enumerate(own):
            if w in chosen:
                index.setdefault(w, []).append((t, q))
    return [(w, index[w]) for w in ranked if w in index]


def _votes(ws: Column, top: Column, index: list[tuple[str, list[tuple[int, int]]]]) -> Column:
    """(template, start, word) wherever a looked-up word stands: the start that the template
    would have if the word were at its place. Distinct, in this order."""
    placed = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                      lambda x: F.array_contains(top, x["w"]))
    listing = ",".join(
        "array(" + ",".join(f"named_struct('t',{t},'q',{q})" for t, q in places) + ")" for _, places in index)
    posted, order = F.expr(f"array({listing})"), F.array(*[F.lit(w) for w, _ in index])
    hits = F.flatten(F.transform(placed, lambda x: let(
        F.array_position(order, x["w"]).cast("int"), lambda k: F.transform(
            F.element_at(posted, k), lambda p: F.struct(
                p["t"].alias("t"), (x["i"] - p["q"]).alias("start"), k.alias("k"))))))
    return F.array_sort(F.array_distinct(hits))


def _aligned(votes: Column, n: int) -> Column:
    """(template, start) that `n` different words agree on. Votes are sorted and distinct,
    so n agreeing ones are neighbours: the first and the last of n in a row have the same start."""
    def same(a: Column, b: Column) -> Column:
        alike = (a["t"] == b["t"]) & (a["start"] == b["start"])
        return F.when(alike, F.struct(a["t"].alias("t"), a["start"].alias("start")))

    later = F.slice(votes, n, F.greatest(F.size(votes) - n + 1, F.lit(0)))
    return F.array_distinct(F.filter(F.zip_with(
        F.slice(votes, 1, F.size(later)), later, same), lambda x: x.isNotNull()))


def _verified(ws: Column, found: Column, templates: list[Template]) -> Column:
    """(label, share) of the candidates whose key phrases stand at their places; share: how
    many of the template's words do."""
    texts = [words_of(t.text) for t in templates]

    def listing(rows: list[str]) -> Column:
        return F.expr(f"array({','.join(rows)})")

    def quoted(ws: list[str]) -> str:
        return "array(" + ",".join(f"'{w}'" for w in ws) + ")"

    bodies = listing([quoted(t) for t in texts])
    labels = F.array(*[F.lit(t.label) for t in templates])
    keys = []
    for template, own in zip(templates, texts):
        places = []
        for key in template.keys:
            k = key.split()
            at = next(q for q in range(len(own)) if own[q:q + len(k)] == k)
            places.append(f"named_struct('q',{at},'w',{quoted(k)})")
        keys.append(f"array({','.join(places)})")
    phrases = listing(keys)

    def stands(start: Column, phrase: Column) -> Column:
        first = start + phrase["q"]
        return F.when(first >= 0, F.slice(ws, F.greatest(first, F.lit(0)) + 1, F.size(phrase["w"])) == phrase["w"]
                      ).otherwise(False)

    def share(start: Column, body: Column) -> Column:
        here = F.slice(ws, F.greatest(start, F.lit(0)) + 1, F.size(body) + F.least(start, F.lit(0)))
        there = F.slice(body, F.greatest(-start, F.lit(0)) + 1, F.size(body))
        return F.size(F.filter(F.zip_with(here, there, lambda a, b: a == b), lambda x: x)) / F.size(body)

    sound = F.filter(found, lambda c: F.forall(
        F.element_at(phrases, c["t"] + 1), lambda p: stands(c["start"], p)))
    return F.transform(sound, lambda c: F.struct(
        F.element_at(labels, c["t"] + 1).alias("label"),
        share(c["start"], F.element_at(bodies, c["t"] + 1)).alias("share")))


def _places(ws: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after the other, from 0."""
    key = phrase.split()
    here = F.transform(ws, lambda w, i: F.when(w == key[0], i))
    return F.filter(here, lambda i: i.isNotNull() & (F.slice(ws, i + 1, len(key)) == F.array(*map(F.lit, key))))


def scan(docs: DataFrame, text: str = "text", templates: list[Template] = TEMPLATES,
         per_template: int = TEMPLATE_WORDS, per_file: int = FILE_WORDS, aligned: int = ALIGNED) -> DataFrame:
    """(row, n_words, base, notices) for every row; `row` holds all columns of `docs`.

    `base` lists (label, start) of the fixed phrases, places in words from 0. `notices` lists
    (label, share) of the templates found: each file's rarest licence words are looked up in
    the index, their postings are intersected by the start they imply, and where `aligned`
    different words agree, the mandatory key phrases are verified at their places. `share` is
    the part of the template's words that stand at theirs.

    Null texts count as empty and hold nothing. Rows are scanned one by one where they lie:
    nothing is shuffled but the document frequencies, so ids may repeat or be null. If too
    few licence words occur in all texts, only the base is found. Whole texts are scanned.
    """
    index = postings(rarity(docs, text, templates), templates, per_template)
    no_base = F.expr("cast(array() as array<struct<label:string,start:int>>)")
    no_notice = F.expr("cast(array() as array<struct<label:string,share:double>>)")

    def based(ws: Column, joined: Column) -> Column:
        def found(phrase: str, label: str) -> Column:
            places = F.transform(_places(ws, phrase), lambda i: F.struct(F.lit(label).alias("label"), i.alias("start")))
            return F.when(F.contains(joined, F.lit(f" {phrase} ")), places).otherwise(no_base)

        return F.concat(*[found(*p) for p in PHRASES.items()])

    def noticed(ws: Column) -> Column:
        posted = [[w for w, places in index if any(t == own for own, _ in places)] for t in range(len(templates))]
        posted = [p for p in posted if len(p) >= aligned]
        if not posted:
            return no_notice
        rare = F.array(*[F.lit(w) for w, _ in index])
        top = F.slice(F.array_intersect(rare, ws), 1, per_file)
        # only templates of which enough words are there at all; their words are placed
        lists = F.array(*[F.array(*map(F.lit, p)) for p in posted])
        wanted = let(top, lambda known: F.array_distinct(F.flatten(F.filter(
            F.transform(lists, lambda p: F.array_intersect(known, p)), lambda p: F.size(p) >= aligned))))
        return let(wanted, lambda known: F.when(F.size(known) > 0, let(
            _votes(ws, known, index), lambda votes: _verified(
                ws, _aligned(votes, aligned), templates))).otherwise(no_notice))

    rows = docs.select(F.struct("*").alias("row"), words(F.col(text)).alias("ws"))
    # a generator keeps the words apart: merged into one projection, they would be split anew for every use
    rows = rows.select("row", F.explode(F.array("ws")).alias("ws"))
    joined = F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" "))
    return rows.select("row", F.size("ws").cast("bigint").alias("n_words"),
                       let(joined, lambda j: based(F.col("ws"), j)).alias("base"), noticed(F.col("ws")).alias("notices"))
