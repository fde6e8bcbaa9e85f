"""License scan: normalised text against license templates by Dice coefficient of word bigrams.

Normalising lower-cases and turns everything but letters and digits into single spaces. The
units compared are the lines and the paragraphs (between blank lines) of a whole text, and the
word windows of a text without regard to its line ends. Two bags of word bigrams A and B are
alike by 2 |A and B| / (|A| + |B|); reaching ``LEAST`` needs |A| to lie within LEAST / (2 - LEAST)
of |B| and its inverse, so a unit meets only the templates its size allows, and most units none.
Repeats are numbered, which makes bags comparable as sets.

Windows: the best window of a template begins and ends with bigrams of it, so at each known bigram
one window of each template counts, the one of highest Dice. Of overlapping windows the best
counts, by Dice, then shared bigrams, then license name. Bigrams that a matching line or paragraph
has from templates of its license belong to that unit and are in no window, so windows tell what
lines and paragraphs do not: notices inside longer lines, over line ends, or in a text of one line.

Main path: one scan, no shuffle, built-in functions only. Templates are literals in the plan, a
fixed set of short public notices and passages. A text with none of a few words, of which every
match must have one, ends before its windows.

Defined cases: null or empty text has no match; a unit with fewer than two words has no bigram
and matches nothing; of several templates reaching ``LEAST`` the best counts, of equal ones the
first by license name; repeated units of a document count once; repeated rows give repeated
results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

# --- fixed values: public license notices and characteristic passages, as their owners give them
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
# --- end of fixed values

# only a preference of _signs: any words give the same result
_EVERYDAY = frozenset(
    "a all an and any are as at be but by can either everyone for free from have if in into is it its later may"
    " must no not obtain of on one or other out possible program provided public published related see source"
    " subject such that the then this to under use version was which with without work you 0 1 2 3 4".split()
)
_NOT_WORD = r"[^\p{L}\p{N}\n]+"
_APART = re.compile(r"[\W_]+")


def normal_words(template: str) -> list[str]:
    """Words of a template, normalised as texts are (templates are ASCII)."""
    return [w for w in _APART.split(template.lower()) if w]


def bigrams(template: str) -> list[str]:
    """The bag of word bigrams, the k-th repeat of one marked with k."""
    words = normal_words(template)
    pairs = list(zip(words, words[1:], strict=False))
    return [f"{a} {b} {pairs[:i].count((a, b))}" for i, (a, b) in enumerate(pairs)]


def _ratio(least: float) -> tuple[int, int]:
    """least / (2 - least) as a fraction of whole numbers, so no bound is lost to rounding."""
    whole = Fraction(str(least))
    return (whole / (2 - whole)).as_integer_ratio()


def _bounds(n: int, least: float) -> tuple[int, int]:
    """Sizes of a set that can reach ``least`` with one of n bigrams."""
    a, b = _ratio(least)
    return -(-n * a // b), n * b // a


def _signs(rows: list[tuple[str, ...]], least: float) -> list[str]:
    """Words of which every match of every template has one, everyday ones last.

    A match lacks at most n - ceil(n * ratio) of the n bigrams, so one of any more than these is in.
    """
    pairs = [[set(b.split(" ")[:2]) for b in row[1:]] for row in rows]
    open_ = [len(p) - _bounds(len(p), least)[0] + 1 for p in pairs]
    signs: list[str] = []
    for skipped in (_EVERYDAY, frozenset()):
        while True:
            gain: dict[str, int] = {}
            for p, left in zip(pairs, open_, strict=True):
                for w in {w for b in p for w in b} - skipped:
                    gain[w] = gain.get(w, 0) + min(max(left, 0), sum(w in b for b in p))
            top = max(gain, key=lambda w: (gain[w], len(w), w), default=None)
            if top is None or not gain[top]:
                break
            signs.append(top)
            open_ = [left - sum(top in b for b in p) for p, left in zip(pairs, open_, strict=True)]
            pairs = [[b for b in p if top not in b] for p in pairs]
    return signs


def scanned(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, hits): hits are the distinct matching units with their words, best license and Dice."""
    rows = sorted({(name, *bigrams(body)) for name, body in templates})
    fixed = F.array(
        *[
            F.struct(
                F.lit(row[0]).alias("license"), F.lit(i).alias("template"),
                F.array(*[F.lit(b) for b in row[1:]]).alias("grams"),
            )
            for i, row in enumerate(rows)
        ]
    )
    low = min(_bounds(len(row) - 1, least)[0] for row in rows)
    high = max(_bounds(len(row) - 1, least)[1] for row in rows)
    num, den = _ratio(least)
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), _NOT_WORD, " ")
    # a text of one paragraph, or paragraphs of one line, give the same unit twice: once is enough
    texts = docs.select("doc_id", plain.alias("plain")).select(
        "doc_id", F.concat(F.lit(" "), F.replace("plain", F.lit("\n"), F.lit(" ")), F.lit(" ")).alias("flat"),
        F.split("plain", "\n").alias("lines"), F.split("plain", r"\n ?\n[ \n]*").alias("blocks")
    )
    sign = F.lit(False)
    for w in _signs(rows, least):
        sign = sign | F.contains(F.col("flat"), F.lit(f" {w} "))
    blocks = F.transform("blocks", lambda b: F.replace(b, F.lit("\n"), F.lit(" ")))
    units = texts.select(
        "doc_id", F.array_distinct(F.concat("lines", blocks)).alias("units"),
        F.when(sign, F.col("blocks")).otherwise(F.array().cast("array<string>")).alias("blocks"),
    )

    def words(unit: Column) -> Column:
        return F.filter(F.split(unit, " "), lambda w: w != "")

    # the spaces of a unit bound its words from above, so most units end here, unsplit
    spaced = F.filter(
        "units",
        lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit(""))) >= low,
    )
    fit = units.select(
        "doc_id", "blocks",
        F.filter(
            F.transform(spaced, words), lambda w: (F.size(w) - 1).between(low, high)
        ).alias("units"),
    )

    def bag(w: Column) -> Column:
        pairs = F.zip_with(
            F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        return pairs

    # at most 1 - num / den of a matching unit's bigrams are foreign, so its first ones tell: a look
    # into a constant set ends nearly all units before they are numbered and compared
    known = sorted({b.rpartition(" ")[0] for row in rows for b in row[1:]})

    def familiar(p: Column) -> Column:
        foreign = F.size(p) * (den - num)
        first = ((foreign - foreign % den) / den).cast("int") + 1
        return F.exists(F.slice(p, 1, first), lambda g: g.isin(known))

    paired = fit.select("doc_id", "blocks", F.filter(F.transform("units", bag), familiar).alias("units"))
    number = F.expr(
        "transform(units, p -> transform(p, (g, i) ->"
        " concat(g, ' ', size(filter(slice(p, 1, i), x -> x = g)))))"
    )
    # the words of a bag in order: the first of each bigram and the last of all
    said = F.transform(
        "units",
        lambda p: F.concat(
            F.array_join(F.transform(p, lambda g: F.substring_index(g, " ", 1)), " "),
            F.lit(" "), F.substring_index(F.element_at(p, -1), " ", -1),
        ),
    )
    grams = paired.select("doc_id", "blocks", F.arrays_zip(number.alias("grams"), said.alias("said")).alias("units"))

    def best(unit: Column) -> Column:
        """Highest Dice of the templates whose size allows it; of equals the first license."""
        own = unit["grams"]
        near = F.filter(
            fixed,
            lambda t: (F.size(t["grams"]) * den >= F.size(own) * num) & (F.size(t["grams"]) * num <= F.size(own) * den),
        )
        scored = F.transform(
            near,
            lambda t: F.struct(
                (2 * F.size(F.array_intersect(own, t["grams"])) / (F.size(own) + F.size(t["grams"]))).alias("dice"),
                F.struct(t["license"].alias("license"), t["template"].alias("template")).alias("of"),
            ),
        )
        good = F.filter(scored, lambda x: x["dice"] >= least)
        top = F.array_max(F.transform(good, lambda x: x["dice"]))
        names = F.transform(F.filter(good, lambda x: x["dice"] >= top), lambda x: x["of"])
        return F.struct(unit["said"].alias("said"), F.array_min(names).alias("of"), F.round(top, 6).alias("dice"))

    hits = F.filter(F.transform("units", best), lambda x: x["of"].isNotNull())
    found = grams.select("doc_id", "blocks", hits.alias("hits"))

    # --- windows
    owned = F.array(*[F.array(*[F.lit(b) for b in sorted({b.rpartition(" ")[0] for b in row[1:]})]) for row in rows])
    counted = []
    for row in rows:
        times = Counter(b.rpartition(" ")[0] for b in row[1:])
        size = len(row) - 1
        counted.append(
            F.struct(
                F.lit(row[0]).alias("license"), F.lit(size).alias("size"),
                F.lit(_bounds(size, least)[0]).alias("low"), F.lit(_bounds(size, least)[1]).alias("high"),
                F.create_map(*[x for g, k in sorted(times.items()) for x in (F.lit(g), F.lit(k))]).alias("times"),
            )
        )
    fewest = min(_bounds(len(row) - 1, least)[0] for row in rows)

    def owner(said: Column) -> Column:
        return F.get(F.filter("hits", lambda h: h["said"] == said), F.lit(0))["of"]["template"]

    # words in order, each with the templates of its line and its paragraph, if these match; one
    # step after another, as a value named in a lambda is worked out again for every element
    def flat_words(block: Column) -> Column:
        return words(F.replace(block, F.lit("\n"), F.lit(" ")))

    cut = F.transform(
        "blocks",
        lambda b: F.struct(F.split(b, "\n").alias("lines"), F.array_join(flat_words(b), " ").alias("said")),
    )
    cut = F.transform(cut, lambda c: F.struct(c["lines"], owner(c["said"]).alias("block")))
    lines = F.flatten(
        F.transform(cut, lambda c: F.transform(c["lines"], lambda x: F.struct(words(x).alias("w"), c["block"])))
    )
    lines = F.transform(lines, lambda x: F.struct(x["w"], x["block"], F.array_join(x["w"], " ").alias("said")))
    lines = F.transform(lines, lambda x: F.struct(x["w"], x["block"], owner(x["said"]).alias("line")))
    owned_words = F.flatten(
        F.transform(lines, lambda x: F.transform(x["w"], lambda w: F.struct(w.alias("word"), x["line"], x["block"])))
    )

    def bare(block: Column) -> Column:
        none = F.lit(None).cast("int")
        return F.transform(
            flat_words(block),
            lambda x: F.struct(x.alias("word"), none.alias("line"), none.alias("block")),
        )

    told = F.when(F.size("hits") > 0, owned_words).otherwise(
        F.flatten(F.transform("blocks", bare))
    )
    spoken = found.select("doc_id", "hits", told.alias("told"))
    at = F.zip_with(
        F.slice("told", 1, F.greatest(F.size("told") - 1, F.lit(0))),
        F.slice("told", 2, F.greatest(F.size("told") - 1, F.lit(0))),
        lambda a, b: F.struct(
            F.concat(a["word"], F.lit(" "), b["word"]).alias("gram"), a["line"].alias("line"), a["block"].alias("block")
        ),
    )
    placed = F.transform(at, lambda e, i: F.struct(i.alias("pos"), *[e[k].alias(k) for k in ("gram", "line", "block")]))

    def free(e: Column) -> Column:
        taken = [F.coalesce(F.array_contains(F.get(owned, e[k]), e["gram"]), F.lit(False)) for k in ("line", "block")]
        return e["gram"].isin(known) & ~taken[0] & ~taken[1]

    marks = spoken.select("doc_id", "hits", "told", F.filter(placed, free).alias("marks"))

    def member(t: Column) -> Column:
        own = F.transform("marks", lambda e: F.struct(e["pos"], e["gram"], t["times"][e["gram"]].alias("times")))
        return F.struct(
            *[t[k].alias(k) for k in ("license", "size", "low", "high")],
            F.filter(own, lambda e: e["times"].isNotNull()).alias("own"),
        )

    members = F.when(
        F.size("marks") >= fewest,
        F.filter(F.transform(F.array(*counted), member), lambda t: F.size(t["own"]) >= t["low"]),
    )
    owns = marks.select("doc_id", "hits", "told", members.alias("members"))

    # where the bigram stood as often as the template has it, counted back from here: in a window
    # that begins after that place this one is shared, in others it is a repeat too many
    def backed(t: Column) -> Column:
        def back(e: Column, i: Column) -> Column:
            before = F.filter(F.sequence(F.greatest(i - t["high"], F.lit(0)), i), lambda k: k < i)
            same = F.filter(F.transform(before, lambda k: F.get(t["own"], k)), lambda x: x["gram"] == e["gram"])
            place = F.try_element_at(same, -e["times"])["pos"]
            return F.struct(e["pos"], F.coalesce(place, F.lit(-1)).alias("back"))

        return F.struct(
            *[t[k].alias(k) for k in ("license", "size", "high")], F.transform(t["own"], back).alias("own")
        )

    p, q = Fraction(str(least)).as_integer_ratio()

    def windows_of(t: Column) -> Column:
        def window(e: Column, i: Column) -> Column:
            after = F.sequence(i, F.least(i + t["high"], F.size(t["own"])) - 1)
            run = F.filter(
                F.transform(after, lambda k: F.get(t["own"], k)),
                lambda x: (x["back"] < e["pos"]) & (x["pos"] - e["pos"] < t["high"]),
            )
            ends = F.transform(
                run,
                lambda x, k: F.struct(
                    (2 * (k + 1) / (t["size"] + x["pos"] - e["pos"] + 1)).alias("dice"),
                    (k + 1).alias("shared"), x["pos"].alias("end"),
                ),
            )
            good = F.filter(ends, lambda x: 2 * q * x["shared"] >= p * (t["size"] + x["end"] - e["pos"] + 1))
            top = F.array_max(good)
            return F.struct(
                e["pos"].alias("start"), top["end"].alias("end"), top["dice"].alias("dice"),
                top["shared"].alias("shared"), t["license"].alias("license"),
            )

        return F.filter(F.transform(t["own"], window), lambda x: x["end"].isNotNull())

    backs = owns.select("doc_id", "hits", "told", F.transform("members", backed).alias("members"))
    windows = F.array_sort(F.flatten(F.transform("members", windows_of)))
    shown = backs.select("doc_id", "hits", "told", windows.alias("windows"))
    cell = "struct<start:int,end:int,dice:double,shared:int,license:string>"
    nothing = F.lit(None).cast(cell)

    # windows come by their first word: one is held until the next begins behind it, a better one
    # takes its place; a window given up for one that was itself given up comes back if it is clear
    def step(acc: Column, x: Column) -> Column:
        held, spare = acc["held"], acc["spare"]
        rank = lambda w: F.struct(w["dice"], w["shared"])
        better = (rank(x) > rank(held)) | ((rank(x) == rank(held)) & (x["license"] < held["license"]))
        clear = spare.isNotNull() & (spare["end"] < x["start"])
        return (
            F.when(held.isNull(), F.struct(acc["out"].alias("out"), x.alias("held"), nothing.alias("spare")))
            .when(
                x["start"] > held["end"],
                F.struct(F.concat(acc["out"], F.array(held)).alias("out"), x.alias("held"), nothing.alias("spare")),
            )
            .when(
                better,
                F.struct(
                    F.when(clear, F.concat(acc["out"], F.array(spare))).otherwise(acc["out"]).alias("out"),
                    x.alias("held"), F.when(held["end"] < x["end"], held).alias("spare"),
                ),
            )
            .otherwise(acc)
        )

    start = F.struct(
        F.array().cast(f"array<{cell}>").alias("out"), nothing.alias("held"), nothing.alias("spare")
    )
    chosen = F.aggregate(
        "windows", start, step,
        lambda acc: F.when(acc["held"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["held"]))),
    )
    picked = shown.select("doc_id", "hits", "told", F.when(F.size("windows") > 0, chosen).alias("chosen"))
    spelt = F.transform(
        "chosen",
        lambda w: F.struct(
            F.array_join(
                F.transform(F.sequence(w["start"], w["end"] + 1), lambda k: F.get("told", k)["word"]), " "
            ).alias("said"),
            w["license"].alias("license"), F.round(w["dice"], 6).alias("dice"),
        ),
    )
    fresh = F.filter(
        F.array_distinct(spelt), lambda w: ~F.exists("hits", lambda h: h["said"] == w["said"])
    )
    whole = F.transform(
        "hits", lambda h: F.struct(h["said"].alias("said"), h["of"]["license"].alias("license"), h["dice"].alias("dice"))
    )
    return picked.select("doc_id", F.when(F.size("chosen") > 0, F.concat(whole, fresh)).otherwise(whole).alias("hits"))


def licenses(docs: DataFrame) -> DataFrame:
    """Per document: number of matching units, its licenses in order, and the best match."""
    hits = scanned(docs)
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"])))
    best = F.array_max(F.transform("hits", lambda h: h["dice"]))
    return hits.select(
        "doc_id", F.size("hits").cast("long").alias("n_hits"),
        F.array_join(names, ",").alias("licenses"), best.alias("best_dice"),
    )
