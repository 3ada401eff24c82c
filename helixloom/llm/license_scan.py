"""License scans with a positional index of rare tokens.

The index holds postings (template, position) for the words of the templates that are rarest in the corpus (highest
IDF), and, for each key phrase, for its rarest word. A file's words are looked up in it; postings are intersected by
relative position (word position minus template position), which gives the places where a template can start; the
share of a template's indexed IDF that agrees on one start, within SLACK words, is its coverage. A template is reported
where its coverage is at least `min_coverage` and all its mandatory key phrases stand word for word. Key phrases that
carry a label of their own (the base labels) are reported wherever they stand.

Only DataFrame functions are used. The templates are a bounded parameter (MAX_TEMPLATES), so the index is a constant of
the plan; document frequencies of its words are counted over all documents (one row per indexed word). Judging is row by
row: nothing is shuffled, and one hot source or many copies do not matter.

Defined results: a null or empty text has no words and no labels, null positions and score 0; very long texts are judged
whole, in time that follows their words; equal coverages are all reported; repeated rows are judged one by one; an empty
table gives an empty result; other columns stay, whatever their names, and one already named like the output is replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, put_back, set_aside

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_TEMPLATES = 200
SLACK = 16
#: Layout of a hit: template, stretch of starts (moved by OFFSET, so that starts before the text count), token.
TOKEN_BITS, STRETCH_BITS = 14, 30
TOKENS, STRETCHES, OFFSET = 1 << TOKEN_BITS, 1 << STRETCH_BITS, 1 << 16
COVER = "struct<t:int,cover:double>"


@dataclass(frozen=True)
class Template:
    """label, text to match, key phrases that must all stand in a file."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening notices of public licences, abridged to the sentences that identify them.
TEMPLATES = [
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge",)),
    Template("apache-2-notice", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", ("apache license version 2", "except in compliance with the license")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms",)),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("lgpl", "This library is licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", "This work is licensed under the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("under the terms of the gnu general public license",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related rights; CC0 1.0 Universal", ("waived all copyright and related",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike International License", ("creative commons attribution sharealike",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
]


def tokens(text: str) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(SEPARATORS, lower) if w]


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(ascii_lower(F.col(f"`{text}`")), SEPARATORS), "")


def idf_of(df: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """IDF over all rows of df; the result has as many rows as the vocabulary at most (and one for the row count)."""
    own = F.array_distinct(F.filter(words(text), lambda w: w.isin(vocabulary)))
    counts = df.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    n = {r["w"]: r["n"] for r in counts.collect()}
    total = n.pop("", 0)
    return {w: math.log((total + 1) / (n.get(w, 0) + 1)) + 1e-6 for w in vocabulary}


def scan(df: DataFrame, text: str = "text", out: str = "licenses", phrases: dict[str, str] | None = None, templates: list[Template] | None = None, n_rare: int = 12, min_coverage: float = 0.6) -> DataFrame:
    """df with column `out`: struct(n_words, base_starts array<int>, base_labels array, labels array, coverage of the templates
    with a hit, score)."""
    phrases = BASE_PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    if len(templates) + len(phrases) > MAX_TEMPLATES:
        raise ValueError(f"the index is made for {MAX_TEMPLATES} templates at most")
    keys = list(dict.fromkeys([*phrases, *(k for t in templates for k in t.keys)]))
    key_words = [tokens(k) for k in keys]
    bodies = [tokens(t.text) for t in templates]
    df, named = set_aside(df, "_l_")
    text, keep = named[text], [c for c in df.columns if c != out]
    idf = idf_of(df, sorted({w for ws in [*key_words, *bodies] for w in ws}), text)
    rarest = lambda ws, n: sorted(set(ws), key=lambda w: (-idf[w], w))[:n]
    # Postings of key phrases (t, place of its rarest word) and of templates. A hit of a template is one number: template,
    # stretch of SLACK words in which the template would start, token. Weights are whole millionths of IDF, so that sums
    # do not depend on their order.
    of_keys: dict[str, list[tuple[int, int]]] = {}
    for t, ws in enumerate(key_words):
        for w in rarest(ws, 1):
            of_keys.setdefault(w, []).append((t, ws.index(w)))
    indexed = [rarest(ws, n_rare) for ws in bodies]
    rare = sorted({*of_keys, *(w for ws in indexed for w in ws)})
    weights = [max(1, round(idf[w] * 1_000_000)) for w in rare]
    totals = [sum(weights[rare.index(w)] for w in ws) or 1 for ws in indexed]
    of_bodies = [[(t, at) for t, ws in enumerate(bodies) if w in indexed[t] for at, x in enumerate(ws) if x == w] for w in rare]
    posting = lambda t, at: F.struct(F.lit(t).alias("t"), F.lit(at).alias("at"))
    postings = lambda ps: F.array(*[posting(t, at) for t, at in ps]).cast("array<struct<t:int,at:int>>")
    key_index, body_index = (F.array(*[postings(ps) for ps in x]).cast("array<array<struct<t:int,at:int>>>") for x in ([of_keys.get(w, []) for w in rare], of_bodies))

    work = df.select(*[F.col(f"`{c}`") for c in keep], words(text).alias("_l_words"))
    names = F.array(*[F.lit(x) for x in rare]).cast("array<string>")
    found = F.transform("_l_words", lambda x, i: F.when(x.isin(rare), F.struct((F.array_position(names, x) - 1).cast("int").alias("tok"), i.alias("i"))))
    work = work.withColumn("_l_found", F.array_compact(found) if rare else F.array().cast("array<struct<tok:int,i:int>>"))

    starts = lambda f: F.transform(F.get(key_index, f["tok"]), lambda p: F.struct(p["t"].alias("t"), (f["i"] - p["at"]).alias("start")))
    key_hits = F.filter(F.flatten(F.transform("_l_found", starts)), _stands(key_words, F.col("_l_words"))) if keys else F.array()
    work = work.withColumn("_l_keys", key_hits.cast("array<struct<t:int,start:int>>"))
    hit = lambda f, p, less: (p["t"].cast("bigint") * STRETCHES + F.floor((f["i"] - p["at"]) / SLACK) - less + OFFSET) * TOKENS + f["tok"]
    hits = lambda f: F.flatten(F.transform(F.get(body_index, f["tok"]), lambda p: F.array(hit(f, p, 0), hit(f, p, 1))))
    work = work.withColumn("_l_hits", F.sort_array(F.array_distinct(F.flatten(F.transform("_l_found", hits)))).cast("array<bigint>"))
    work = work.withColumn("_l_cover", _covers(F.col("_l_hits"), weights, totals))

    n_base = len(phrases)  # the base phrases come first among the keys
    base_labels = F.array(*[F.lit(phrases[k]) for k in keys[:n_base]]).cast("array<string>")
    base = F.array_sort(F.array_distinct(F.transform(F.filter("_l_keys", lambda h: h["t"] < n_base), lambda h: F.get(base_labels, h["t"]))))
    work = work.withColumn("_l_base", base)
    titles = F.array(*[F.lit(t.label) for t in templates]).cast("array<string>")
    needs = F.array(*[F.array(*[F.lit(keys.index(k)) for k in t.keys]).cast("array<int>") for t in templates]).cast("array<array<int>>")
    whole = lambda c: (c["cover"] >= min_coverage) & F.forall(F.get(needs, c["t"]), lambda k: F.exists("_l_keys", lambda h: h["t"] == k))
    told = F.transform(F.filter("_l_cover", whole), lambda c: F.get(titles, c["t"]))
    labels = F.array_sort(F.array_union("_l_base", told))
    score = F.when(F.size("_l_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("_l_cover", lambda c: c["cover"])), F.lit(0.0)))
    done = work.select(
        *[F.col(f"`{c}`") for c in keep],
        F.struct(
            F.size("_l_words").cast("bigint").alias("n_words"),
            F.array_sort(F.transform(F.filter("_l_keys", lambda h: h["t"] < n_base), lambda h: h["start"])).alias("base_starts"),
            F.col("_l_base").alias("base_labels"),
            labels.alias("labels"),
            F.transform("_l_cover", lambda c: F.struct(F.get(titles, c["t"]).alias("label"), c["cover"].alias("cover"))).alias("coverage"),
            score.alias("score"),
        ).alias(out),
    )
    return put_back(done, named)


def _stands(phrases: list[list[str]], w: Column):
    """Whether the words of a hit's key phrase stand at the start that the posting of its rarest word points to."""
    texts = F.array(*[F.array(*[F.lit(x) for x in p]) for p in phrases])
    sizes = F.array(*[F.lit(len(p)) for p in phrases])
    return lambda h: (h["start"] >= 0) & (F.slice(w, F.greatest(h["start"], F.lit(0)) + 1, F.get(sizes, h["t"])) == F.get(texts, h["t"]))


def _covers(hits: Column, weights: list[int], totals: list[int]) -> Column:
    """array(struct(t, cover)): for each template with a hit, the largest share of its IDF whose distinct tokens agree on a
    stretch of starts. One fold over the sorted hits; every token was filed under the stretch of its start and the one
    before, so starts that are SLACK words apart or less share one."""
    if not totals:
        return F.array().cast(f"array<{COVER}>")
    weight, total = F.array(*[F.lit(n).cast("bigint") for n in weights]), F.array(*[F.lit(float(n)) for n in totals])
    zero = F.lit(0).cast("bigint")
    none = F.struct(F.lit(-1).cast("bigint").alias("at"), zero.alias("sum"), zero.alias("best"), F.array().cast(f"array<{COVER}>").alias("done"))

    def closed(acc: Column) -> Column:
        t = F.floor(acc["at"] / STRETCHES).cast("int")
        return F.concat(acc["done"], F.array(F.struct(t.alias("t"), (acc["best"] / F.get(total, t)).alias("cover"))))

    def step(acc: Column, x: Column) -> Column:
        at, n = F.shiftright(x, TOKEN_BITS), F.get(weight, x.bitwiseAND(F.lit(TOKENS - 1).cast("bigint")).cast("int"))
        row = lambda sum_, best, done: F.struct(at.alias("at"), sum_.alias("sum"), best.alias("best"), done.alias("done"))
        same = F.shiftright(acc["at"], STRETCH_BITS) == F.shiftright(at, STRETCH_BITS)
        return (
            F.when(acc["at"] == at, row(acc["sum"] + n, F.greatest(acc["best"], acc["sum"] + n), acc["done"]))
            .when(same, row(n, F.greatest(acc["best"], n), acc["done"]))
            .when(acc["at"] < 0, row(n, n, acc["done"]))
            .otherwise(row(n, n, closed(acc)))
        )

    return F.when(F.size(hits) > 0, F.aggregate(hits, none, step, closed)).otherwise(F.array().cast(f"array<{COVER}>"))
