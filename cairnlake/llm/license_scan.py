"""License scan (operator 2, DataFrame functions only).

A unit (a line, a paragraph between blank lines, or the whole text) is normalised
and compared with each template by the Dice coefficient of their sets of word
bigrams.  Three prunings, all without loss:

* ``dice >= t`` bounds the size of a unit's set to [t / (2 - t), (2 - t) / t] times
  the template's, so other templates are not compared;
* it also leaves at most a share (2 - 2t) / (2 - t) of a template's bigrams unmet, so
  a unit holds one of any words that occur in more of them: texts without such a word
  are not even split;
* and at least a share t / (2 - t) of a unit's bigrams are the template's, so with fewer
  in a Bloom literal of all templates' bigrams it is not compared with any.

Templates are short notices, and licence texts whole and by paragraph.

Everything is an expression on the row: no shuffle, whatever the size of the table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Shorter paragraphs of a licence ("Terms and conditions") are headings and names, not notices.
PARAGRAPH_BIGRAMS = 15
BLOOM_BITS = 1 << 20

# Notices and short licence texts as their holders word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> set[str]:
    words = words_of(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def _with_texts(notices: dict[str, str]) -> dict[str, str]:
    """``notices``, and the licence texts beside this module whole and by paragraph.

    A paragraph that several licences have is named for all of them, and after their own
    ones in order, so that what only one licence has names a text.
    """
    out, seen, owners = dict(notices), {frozenset(bigrams_of(t)) for t in notices.values()}, {}
    files = {f.stem: f.read_text("utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    for name, text in files.items():
        out[f"{name}-text"] = text
        seen.add(frozenset(bigrams_of(text)))
    for name, text in files.items():
        for k, part in enumerate(re.split(r"\n[ \t\r\f]*\n", text.strip()), 1):
            pairs = frozenset(bigrams_of(part))
            if len(pairs) >= PARAGRAPH_BIGRAMS and pairs not in seen:
                owners.setdefault(pairs, []).append((name, k, part))
    for found in owners.values():
        names = sorted({name for name, _, _ in found})
        name, k, part = found[0]
        out[f"{name}-paragraph-{k}" if len(names) == 1 else f"part-of-{'-or-'.join(names)}-{k}"] = part
    return out


TEMPLATES = _with_texts(TEMPLATES)


def markers(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every unit that is near enough to a template has one.

    Long words first where they do, for they are in the fewest other texts.
    """
    where: dict[str, list[tuple[int, str]]] = {}
    need: list[float] = []
    for k, text in enumerate(templates.values()):
        pairs = bigrams_of(text)
        need.append(int(len(pairs) * (2 - 2 * threshold) / (2 - threshold) + 1e-9) + 1)
        for pair in pairs:
            for word in set(pair.split()):
                where.setdefault(word, []).append((k, pair))
    whole, met, out = need[:], set(), []
    while any(n > 0 for n in need):
        best, gain = "", 0.0
        for word in sorted(where):
            fresh = Counter(k for k, pair in where[word] if need[k] > 0 and (k, pair) not in met)
            worth = sum(min(n, need[k]) / whole[k] for k, n in fresh.items()) * min(len(word), 10) ** 2
            if worth > gain:
                best, gain = word, worth
        if not best:
            break
        out.append(best)
        for k, pair in where.pop(best):
            if (k, pair) not in met:
                met.add((k, pair))
                need[k] -= 1
    return sorted((w for w in out if not any(v != w and v in w for v in out)), key=lambda w: (len(w), w))


def _normal(low: Column) -> Column:
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def _bigrams(unit: Column) -> Column:
    words = F.split(_normal(unit), " ")
    return F.when(F.size(words) >= 2, F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>"))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Find the licence notices in each text.

    Adds ``license`` (the nearest template's name; the first in order of names of
    equals; null if none is near enough), ``dice`` (its coefficient, 0 if none) and
    ``n_units`` (different units that match a template).  A null or empty text has
    none; each repeated row gets the same; columns of those names are replaced.
    """
    templates = TEMPLATES if templates is None else templates
    names = sorted(templates)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sets = {n: sorted(bigrams_of(templates[n])) for n in names}
    bits = bytearray(BLOOM_BITS // 8)
    for pair in {x for pairs in sets.values() for x in pairs}:
        spot = zlib.crc32(pair.encode()) % BLOOM_BITS
        bits[spot >> 3] |= 1 << (spot & 7)
    # strings that are split are one literal each once folded, however long
    bloom = F.split(F.lit(" ".join(str(int.from_bytes(bits[i : i + 4], "little")) for i in range(0, len(bits), 4))), " ").cast("array<bigint>")
    known = F.array(*[F.struct(F.lit(len(sets[n])).alias("n"), F.lit(-k).alias("rank"), F.lit(n).alias("name"), F.split(F.lit("|".join(sets[n])), "[|]").alias("pairs")) for k, n in enumerate(names)])
    has = lambda c: F.exists(F.array(*map(F.lit, marks)), lambda w: F.contains(c, w))
    marks = markers(templates, threshold)
    t = F.col(text)
    any_mark = F.lit(False)
    for w in marks:
        any_mark = any_mark | F.contains(F.col("__low"), F.lit(w))
    units = F.array_distinct(F.concat(F.split(t, "\n", -1), F.split(t, r"\n[ \t\r]*\n", -1), F.array(t)))

    def listed(pair: Column) -> Column:
        spot = F.pmod(F.crc32(F.encode(pair, "utf-8")), F.lit(BLOOM_BITS))
        return F.getbit(F.element_at(bloom, (F.shiftright(spot, 5) + 1).cast("int")), F.pmod(spot, F.lit(32))) == 1

    def score(g: Column) -> Column:
        def one(t: Column) -> Column:
            fits = (F.size(g) >= t["n"] * low - 1e-9) & (F.size(g) <= t["n"] * high + 1e-9)
            return F.when(fits, F.struct((F.lit(2.0) * F.size(F.array_intersect(g, t["pairs"])) / (F.size(g) + t["n"])).alias("dice"), t["rank"].alias("rank"), t["name"].alias("name")))

        return F.transform(known, one)

    least = min(map(len, sets.values())) * low - 1e-9
    grams = F.filter(F.transform(F.filter(F.transform(units, F.lower), has), _bigrams), lambda g: (F.size(g) >= least) & (F.size(F.filter(g, listed)) >= F.size(g) * low - 1e-9))
    best = F.transform(grams, lambda g: F.array_max(F.filter(score(g), lambda s: s["dice"] >= threshold)))
    best = F.filter(best, lambda s: s.isNotNull())
    rest = [c for c in docs.columns if c not in ("license", "dice", "n_units")]
    return (
        docs.select(*[F.col(f"`{c}`") for c in rest], F.lower(t).alias("__low"))
        .select(*[F.col(f"`{c}`") for c in rest], F.when(any_mark, best).alias("__best"))
        .select(*[F.col(f"`{c}`") for c in rest], F.array_max("__best")["name"].alias("license"), F.coalesce(F.array_max("__best")["dice"], F.lit(0.0)).alias("dice"), F.coalesce(F.size("__best"), F.lit(0)).cast("long").alias("n_units"))
    )
