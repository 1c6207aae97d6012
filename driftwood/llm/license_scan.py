"""Licence scans: Dice coefficient over word bigrams, in DataFrame functions alone."""

from __future__ import annotations

import re
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.llm.quality import let

#: Least coefficient of a match.
THRESHOLD = 0.8

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(license: str, version: str) -> str:
    """The notice that a licence of the GNU project asks for."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {license} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {license} for more details. "
        f"You should have received a copy of the GNU {license} along with this program. If not, see https://www.gnu.org/licenses/."
    )


# Published licence texts and the notices that name them.
TEMPLATES: dict[str, str] = {
    "agpl-3.0": _gnu("Affero General Public License", "3"),
    "bsd-2-clause": _BSD_TERMS + _BSD_WARRANTY,
    "bsd-3-clause": _BSD_TERMS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY,
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
    "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, "
    "must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "cc0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. "
    "You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0": _gnu("General Public License", "2"),
    "lgpl-2.1": _gnu("Lesser General Public License", "2.1"),
    "lgpl-3.0": _gnu("Lesser General Public License", "3"),
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": _gnu("General Public License", "3"),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def bigrams_of(text: str) -> set[str]:
    """A template's bigrams, normalised as texts are."""
    w = re.sub(r"[^0-9a-z]+", " ", text.lower()).split()
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def _length(text: str) -> int:
    """A template's bigrams, repeats included."""
    return len(re.sub(r"[^0-9a-z]+", " ", text.lower()).split()) - 1


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The least and most bigrams of a text whose coefficient with n bigrams can reach the threshold."""
    t = Fraction(str(threshold))
    low, high = n * t / (2 - t), n * (2 - t) / t
    return -int(-low // 1), int(high // 1)


def telling_words(sets: Mapping[str, set[str] | list[str]], threshold: float) -> list[str]:
    """Words of which a text that reaches the threshold with any template must hold at least one.

    A match shares at least t/(2-t) of a template's bigrams, so it holds a word of any choice of words that occur in
    more than the rest of them.  Words are chosen that serve the most templates, short ones last.
    """
    t = Fraction(str(threshold))
    spare = {name: len(g) - len(g) * t / (2 - t) for name, g in sets.items()}
    chosen: list[str] = []
    while left := {n: [g for g in sets[n] if not set(g.split()) & set(chosen)] for n in sets if sum(bool(set(g.split()) & set(chosen)) for g in sets[n]) <= spare[n]}:
        gain: dict[str, float] = {}
        for name, grams in left.items():
            for g in grams:
                for w in set(g.split()):
                    if len(w) > 1:
                        gain[w] = gain.get(w, 0) + (1 if len(w) > 5 else 0.01) / (spare[name] + 1)
        if not gain:
            return [""]
        chosen.append(max(gain, key=lambda w: (gain[w], len(w), w)))
    return sorted(chosen)


def _words(text: Column) -> Column:
    """Words of a text when normalised."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def _grams(w: Column) -> Column:
    """Distinct bigrams of words."""
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def _run(w: Column) -> Column:
    """Bigrams of words in their order, repeats included."""
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _window(run: Column, t: Column, shared: Column) -> Column:
    """The best window of a text's bigrams for a template: dice, size, at (place of its first bigram, from 1), license.

    A best window begins and ends with bigrams of the template.  From each of them that has enough others within
    reach, the coefficient is told at every end; a bigram counts where it first occurs in the window.
    """
    places = F.filter(F.transform(run, lambda x, k: F.when(F.array_contains(shared, x), k + 1)), lambda k: k.isNotNull())

    def from_place(p: Column, here: Column) -> Column:
        steps = F.transform(here, lambda x, k: F.when(F.array_position(here, x) == k + 1, F.array_contains(shared, x)))
        state = F.struct(F.lit(0).alias("c"), F.lit(0).alias("g"), F.lit(0).alias("k"), F.lit(0.0).cast("double").alias("dice"), F.lit(0).alias("size"))

        def step(s: Column, hit: Column) -> Column:
            c, g = s["c"] + F.when(hit, 1).otherwise(0), s["g"] + F.when(hit.isNotNull(), 1).otherwise(0)
            dice = (2.0 * c / (g + t["n"])).cast("double")
            more = dice > s["dice"]
            return F.struct(c.alias("c"), g.alias("g"), (s["k"] + 1).alias("k"), F.when(more, dice).otherwise(s["dice"]).alias("dice"), F.when(more, s["k"] + 1).otherwise(s["size"]).alias("size"))

        return let(F.aggregate(steps, state, step), lambda b: F.struct(b["dice"].alias("dice"), b["size"].alias("size"), p.alias("at"), t["name"].alias("license")))

    def windows(ps: Column) -> Column:
        starts = F.filter(ps, lambda p, k: F.get(ps, k + t["low"] - 1) - p < t["reach"])
        return F.array_max(F.transform(starts, lambda p: let(F.slice(run, p, t["reach"]), lambda here: from_place(p, here))))

    return let(places, windows)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (of the best match; null if none), dice (its coefficient) and n_matches (texts' units that match), one row per input row.

    A text's units are its lines, if it has several the whole, and windows of words: for each template the best window
    of the whole text, across lines, of up to (2-t)/t times the template's own length.  Of windows that
    overlap the longer one counts, or the better match if they are about as long (within a quarter).  A window in one
    line that matches or in a whole that matches is no unit of its own, and a line in a window of several lines that
    matches is none either.  A unit is lower-cased, runs of other than letters
    and digits become a space, and its distinct word bigrams are compared to each template whose number of bigrams
    allows the threshold; templates of other sizes are never intersected.  A text that
    holds none of the words a match needs is not cut up at all.  Units longer than any template allows are
    left out by their size alone.  The later name wins a tie.  Null and blank texts match nothing.  Templates are a
    fixed list, written into the plan; there is no shuffle.
    """
    sets = {name: sorted(bigrams_of(t)) for name, t in sorted(templates.items()) if bigrams_of(t)}
    bounds = {name: size_bounds(len(g), threshold) for name, g in sets.items()}
    least, most = min(b[0] for b in bounds.values()), max(b[1] for b in bounds.values())
    held = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.lit(bounds[name][0]).alias("low"), F.lit(bounds[name][1]).alias("high"), F.lit(size_bounds(_length(templates[name]), threshold)[1]).alias("reach"), F.array(*map(F.lit, g)).alias("grams")) for name, g in sets.items()])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    every = F.array(*map(F.lit, sorted(set().union(*sets.values()))))

    def match(g: Column) -> Column:
        near = F.filter(held, lambda t: F.size(g).between(t["low"], t["high"]))
        return F.array_max(F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).alias("dice"), t["name"].alias("license"))))

    def unit(w: Column) -> Column:
        """Its match, null if none."""
        best = F.when(F.size(w) > least, let(_grams(w), lambda g: F.when(F.size(g).between(least, most), match(g))))
        return let(best, lambda m: F.when(m["dice"] >= threshold, m))

    def windows(run: Column) -> Column:
        """Windows that match, none within a longer one."""
        shared = F.array_intersect(run, every)
        near = let(shared, lambda x: F.filter(F.transform(held, lambda t: F.struct(t.alias("t"), F.array_intersect(x, t["grams"]).alias("shared"))), lambda y: F.size(y["shared"]) >= y["t"]["low"]))
        best = F.filter(F.transform(near, lambda y: _window(run, y["t"], y["shared"])), lambda m: m["dice"] >= threshold)

        def better(a: Column, b: Column) -> Column:
            """Whether window b stands for a too: they overlap, and b is longer, or about as long and a better match."""
            meet = (b["at"] < a["at"] + a["size"]) & (a["at"] < b["at"] + b["size"])
            alike = (4 * b["size"] <= 5 * a["size"]) & (4 * a["size"] <= 5 * b["size"])
            return meet & F.when(alike, F.struct(b["dice"], b["license"]) > F.struct(a["dice"], a["license"])).otherwise(b["size"] > a["size"])

        return let(best, lambda b: F.filter(b, lambda x: ~F.exists(b, lambda y: better(x, y))))

    def joined(own: Column, all_of_it: Column, wide: Column) -> Column:
        """Matches of the units; own: n (words), before (words of earlier lines) and m (match) of each line."""
        def in_line(x: Column) -> Column:
            return F.exists(own, lambda o: o["m"].isNotNull() & (o["before"] < x["at"]) & (x["at"] + x["size"] <= o["before"] + o["n"]))

        kept = F.when(all_of_it.isNotNull(), F.slice(wide, 1, 0)).otherwise(F.filter(wide, lambda x: ~in_line(x)))

        def together(k: Column) -> Column:
            alone = F.filter(own, lambda o: o["m"].isNotNull() & ~F.exists(k, lambda x: (x["at"] <= o["before"] + 1) & (x["at"] + x["size"] >= o["before"] + o["n"])))
            return F.concat(F.transform(alone, lambda o: o["m"]), F.filter(F.array(all_of_it), lambda m: m.isNotNull()), F.transform(k, lambda x: F.struct(x["dice"].alias("dice"), x["license"].alias("license"))))

        return let(kept, together)

    def units(ws: Column) -> Column:
        own = F.transform(ws, lambda w: F.struct(F.size(w).alias("n"), unit(w).alias("m")))
        zero = F.array().cast("array<struct<n:int,before:int,m:struct<dice:double,license:string>>>")
        placed = F.aggregate(own, F.struct(F.lit(0).alias("sum"), zero.alias("rows")), lambda s, o: F.struct((s["sum"] + o["n"]).alias("sum"), F.concat(s["rows"], F.array(F.struct(o["n"].alias("n"), s["sum"].alias("before"), o["m"].alias("m")))).alias("rows")))["rows"]
        whole = let(F.flatten(ws), lambda w: F.struct(F.when(F.size(ws) > 1, unit(w)).alias("m"), let(_run(w), windows).alias("wide")))
        return let(F.struct(placed.alias("own"), whole.alias("whole")), lambda x: joined(x["own"], x["whole"]["m"], x["whole"]["wide"]))

    lowered = F.lower(text)
    may = F.lit(False)
    for w in telling_words(sets, threshold):
        here = F.contains(lowered, F.lit(w))
        # a short word is often part of others
        may = may | (here if len(w) > 3 else here & lowered.rlike(rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])"))
    best = F.when(may, let(F.transform(lines, _words), units)).otherwise(F.array().cast("array<struct<dice:double,license:string>>"))
    found = let(best, lambda f: F.struct(F.array_max(f).alias("best"), F.size(f).cast("long").alias("n")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("f")).select("doc_id", "f.best.license", "f.best.dice", F.col("f.n").alias("n_matches"))
