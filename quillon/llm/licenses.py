"""Licence texts and notices in documents, by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, plain
from .decontamination import words_of

DICE = 0.8
MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
# Public licences' own notices, as (licence, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", MIT_BODY),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def bigrams_of(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def telling(templates: list[tuple[str, str]], dice: float) -> list[str]:
    """Words of which any text with that coefficient has one: of each template so many, longest first, that too few bigrams lack all."""
    out = []
    for _, text in templates:
        left = bigrams_of(text)
        least = math.ceil(dice / (2 - dice) * len(left) - 1e-9)
        need = math.ceil(dice * (least + len(left)) / 2 - 1e-9)
        for word in sorted({w for b in left for w in b.split()}, key=lambda w: (-len(w), w)):
            if len(left) < need:
                break
            left = [b for b in left if word not in b.split()]
            out.append(word)
    return sorted(set(out))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """One row per input row and licence found in it: doc_id, license, dice, n_places.

    Lines, paragraphs, the whole text, and windows of as many words as a template has, wherever a bigram that they share
    puts its beginning, are compared, lower-cased and without punctuation, each place once; dice is that of the best
    place, n_places how many lines, paragraphs and texts reach the limit, or how many windows that don't overlap, if
    those are more. Of overlapping windows the one with the highest coefficient counts. A place is compared only with templates of a size with
    which the coefficient can reach the limit, and only if it has a word without which none can; it counts for the
    licences with the highest coefficient only. Null, empty and
    unrelated texts give no row; repeated rows give theirs each.
    """
    words = telling(templates, dice)
    some = r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{N}])"
    text = F.coalesce(F.col("text"), F.lit(""))
    places = F.array_distinct(F.concat(F.split(text, r"\n", -1), F.split(text, r"\n\s*\n", -1), F.array(text)))
    pairs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))
    none = F.array().cast("array<string>")
    sets = F.array_distinct(F.transform(F.filter(places, lambda p: p.rlike(some)), lambda p: let(words_of(p), lambda w: F.when(F.size(w) >= 2, F.array_sort(pairs(w))).otherwise(none))))

    def against(a: Column) -> Column:
        found = []
        for name, template in templates:
            own = bigrams_of(template)
            fits = (F.size(a) >= dice / (2 - dice) * len(own) - 1e-9) & (F.size(a) <= (2 - dice) / dice * len(own) + 1e-9)
            score = 2 * F.size(F.array_intersect(a, F.array(*map(F.lit, own)))) / (F.size(a) + len(own))
            found.append(F.when(fits, F.struct(F.lit(name).alias("license"), score.alias("dice"))))
        return let(F.filter(F.array(*found), lambda x: x.isNotNull() & (x["dice"] >= dice)), lambda f: F.filter(f, lambda x: x["dice"] == F.array_max(F.transform(f, lambda y: y["dice"]))))

    def windows(words: Column) -> Column:
        """(dice, start, end, license) of the windows that reach the limit and don't overlap a better one."""
        ordered = [(name, [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)]) for name, w in ((n, re.findall(r"[^\W_]+", t.lower())) for n, t in templates)]
        every = sorted({b for _, own in ordered for b in own})

        def of(b: Column, at: Column, name: str, own: list[str]) -> Column:
            distinct, place = F.array(*map(F.lit, sorted(set(own)))), F.array(*map(F.lit, own))
            last = F.greatest(F.lit(0), F.size(b) - len(own))
            begun = lambda i: F.greatest(F.lit(0), F.least(last, (i - F.array_position(place, F.get(b, i)) + 1).cast("int")))
            starts = F.array_distinct(F.transform(F.filter(at, lambda i: F.get(b, i).isin(own)), begun))
            score = lambda i: let(F.array_distinct(F.slice(b, i + 1, len(own))), lambda x: 2 * F.size(F.array_intersect(x, distinct)) / (F.size(x) + len(set(own))))
            scored = F.transform(starts, lambda i: F.struct(score(i).alias("dice"), i.alias("start"), (i + len(own) + 1).alias("end"), F.lit(name).alias("license")))
            return F.filter(scored, lambda x: x["dice"] >= dice)

        def clear(found: Column) -> Column:
            none = F.array().cast("array<struct<dice:double,start:int,end:int,license:string>>")
            over = lambda k, x: (k["start"] < x["end"]) & (k["end"] > x["start"]) & ((k["dice"] > x["dice"]) | (k["license"] == x["license"]))
            return F.aggregate(F.sort_array(found, False), none, lambda kept, x: F.when(F.exists(kept, lambda k: over(k, x)), kept).otherwise(F.concat(kept, F.array(x))))

        grams = let(words, lambda w: F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>")))
        seen = lambda b: F.filter(F.sequence(F.lit(0), F.size(b)), lambda i: F.get(b, i).isin(every))
        return let(grams, lambda b: let(seen(b), lambda at: clear(F.concat(*[of(b, at, *x) for x in ordered]))))

    rows = plain(docs, doc_id=id_col, text=text_col).where(F.col("text").rlike(some))
    hits = rows.select("doc_id", F.filter(F.transform(sets, against), lambda x: F.size(x) > 0).alias("hits"), windows(words_of(F.col("text"))).alias("windows")).where((F.size("hits") > 0) | (F.size("windows") > 0))
    names = F.array(*[F.lit(x) for x in sorted({n for n, _ in templates})])
    top = lambda found, n: F.array_max(F.transform(F.filter(found, lambda x: x["license"] == n), lambda x: x["dice"]))
    places = lambda n: F.greatest(F.size(F.filter("hits", lambda h: F.exists(h, lambda x: x["license"] == n))), F.size(F.filter("windows", lambda x: x["license"] == n)))
    best = F.transform(names, lambda n: F.struct(n.alias("license"), F.greatest(top(F.flatten("hits"), n), top(F.col("windows"), n)).alias("dice"), places(n).cast("long").alias("n_places")))
    return hits.select("doc_id", F.explode(F.filter(best, lambda x: x["dice"].isNotNull())).alias("x")).select("doc_id", "x.*")
