"""Licence notices by Dice coefficient over word bigrams, with DataFrame functions only.

A unit (a line or a paragraph, or a sentence of one that matches nothing) is compared with templates whose size allows the
coefficient: ``2 * min(n, m) >= least * (n + m)``. Before that, a template
names anchor words that meet more of its bigrams than a match may lack; a text
without any anchor holds no match and is passed over.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdrift.llm.common import texts_of

LEAST = 0.8

# Public licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
    "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, '
    "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
# Siblings: of licences that differ in a word or two each has its own notice, so that the right one is nearest.
TEMPLATES |= {
    f"{name}{suffix}": text.format(licence)
    for name, licence in {
        "gpl-2.0": "GNU General Public License, version 2", "gpl-3.0": "GNU General Public License, version 3",
        "lgpl-2.1": "GNU Lesser General Public License, version 2.1", "lgpl-3.0": "GNU Lesser General Public License, version 3",
        "agpl-3.0": "GNU Affero General Public License, version 3",
    }.items()
    for suffix, text in {"": "This work is licensed under the {}.", "-short": "Licensed under the {}."}.items()
}
TEMPLATES |= {
    f"{name}{suffix}": f"{verb} under the {licence}."
    for name, licence in {
        "bsd-2-clause": "BSD 2-Clause License", "bsd-3-clause": "BSD 3-Clause License", "isc": "ISC License", "mit": "MIT License",
        "mpl-2.0": "Mozilla Public License, Version 2.0",
    }.items()
    for suffix, verb in {"-released": "Released", "-licensed": "Licensed"}.items()
    if (name, verb) != ("mit", "Released")
}
_GRANTS = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
for _grant, _long in _GRANTS.items():
    for _version, _port in {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}.items():
        _texts = f"This work is licensed under a Creative Commons {_long} {_version} {_port} License.", f"Licensed under CC {_grant.upper()} {_version}."
        for _suffix, _text in zip(("-long", "-short"), _texts):
            _name = f"cc-{_grant}-{_version}"
            if TEMPLATES.get(_name) != _text:
                TEMPLATES[f"{_name}{_suffix}"] = _text
for _name, _old, _new in (("lgpl-3.0-header", "Lesser", "version 3"), ("agpl-3.0-header", "Affero", "version 3")):
    TEMPLATES[_name] = TEMPLATES["gpl-3.0-header"].replace("GNU General", f"GNU {_old} General").replace("version 3", _new)
TEMPLATES["bsd-3-clause-text"] = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission."
)
BETWEEN = r"[^\p{L}\p{N}\n]+"
END = "\x01"  # stands for the end of a sentence
PARAGRAPHS = rf"\n[ {END}]*\n"  # the same with ends marked
SENTENCE_END = r"[.!?;](?=\s)"


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def anchors(bigrams: list[str], least: float, every: list[list[str]]) -> list[str]:
    """Words, long ones and then those of few templates first, that together meet more bigrams than a match may lack."""
    known = Counter(w for other in every for w in {w for b in other for w in b.split()})
    lack = len(bigrams) - math.ceil(least * len(bigrams) / (2 - least) - 1e-9)
    words = sorted({w for b in bigrams for w in b.split()}, key=lambda w: (-len(w), known[w], w))
    chosen: list[str] = []
    for word in words:
        if sum(any(w in chosen for w in b.split()) for b in bigrams) > lack:
            return chosen
        chosen.append(word)
    return chosen


def _best(unit: Column, templates: Column, least: float) -> Column:
    """``(dice, -rank)`` of the best template of a unit, or null."""
    words = F.filter(F.split(unit, "[ \n]"), lambda w: w != "")
    return _once(words, lambda w: _once(_bigrams(w), lambda g: _scored(g, templates, least)))


def _matches(unit: Column, templates: Column, least: float, anchored: str) -> Column:
    """The match of a unit with ends of sentences marked; if there is none, those of its sentences.

    Of a paragraph only sentences that cross lines are taken: others belong to a line.
    """
    whole = _best(F.translate(unit, END, " "), templates, least)
    paragraph = F.contains(F.btrim(unit, F.lit(f" \n{END}")), F.lit("\n"))
    crossing = lambda s: F.contains(F.btrim(s, F.lit(" \n")), F.lit("\n"))
    sentences = F.filter(F.split(unit, END), lambda s: s.rlike(anchored) & (~paragraph | crossing(s)))
    parts = F.filter(F.transform(sentences, lambda s: _best(s, templates, least)), lambda s: s.isNotNull())
    return _once(whole, lambda w: F.when(w.isNotNull(), F.array(w)).when(F.contains(unit, F.lit(END)), parts).otherwise(F.array().cast("array<struct<dice:double,order:int>>")))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` evaluated once, however often it is named."""
    return F.get(F.transform(F.array(value), of), 0)


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs))


def _scored(grams: Column, templates: Column, least: float) -> Column:
    n = F.size(grams)
    fit = F.filter(templates, lambda t: 2 * F.least(t["n"], n) >= F.lit(least) * (t["n"] + n))
    dice = lambda t: 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (t["n"] + n)
    scored = F.transform(fit, lambda t: F.struct(dice(t).alias("dice"), (-t["rank"]).alias("order")))
    return F.array_max(F.filter(scored, lambda s: s["dice"] >= least))


def licence_notices(docs: DataFrame, least: float = LEAST, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, notices`` for each row of ``docs (doc_id, text)``.

    Texts are lower-cased and runs of other than letters, digits and line feeds
    become spaces. Units are lines, and paragraphs of more than one line.
    ``notices`` lists ``(dice, licence)`` of the best template (ties: the first
    by name) of every unit with a coefficient of at least ``least`` over sets of
    word bigrams, in the order of lines and then of paragraphs; a unit without
    one gives those of its sentences. Texts that are
    null, empty or without bigrams have none; repeated rows and null ids come
    out as they came in; no rows give no rows.
    """
    named = sorted((templates or TEMPLATES).items())
    grams = [template_bigrams(text) for _, text in named]
    known = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for i, g in enumerate(grams)
    ])
    words = sorted({w for g in grams for w in anchors(g, least, grams)})
    anchored = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])"
    rows = texts_of(docs).select("doc_id", F.lower("text").alias("text"))
    marked = F.regexp_replace(F.translate("text", END, " "), SENTENCE_END, END)
    plain = F.when(F.col("text").rlike(anchored), F.regexp_replace(marked, BETWEEN.replace(r"\n", rf"\n{END}"), " "))
    several = F.filter(F.split("plain", PARAGRAPHS), lambda p: F.contains(F.btrim(p, F.lit(f" \n{END}")), F.lit("\n")))
    units = F.filter(F.concat(F.split("plain", "\n"), several), lambda u: u.rlike(anchored))
    rows = rows.select("doc_id", plain.alias("plain")).select("doc_id", F.coalesce(units, F.array().cast("array<string>")).alias("units"))
    found = F.flatten(F.transform("units", lambda u: _matches(u, known, least, anchored)))
    names = F.array(*[F.lit(name) for name, _ in named])
    told = F.transform(found, lambda s: F.struct(s["dice"].alias("dice"), F.element_at(names, 1 - s["order"]).alias("licence")))
    return rows.select("doc_id", told.alias("notices"))
