"""Licence statements in texts, by the Dice coefficient of word bigrams with templates.

Texts are normalised (A-Z lower-cased, everything but letters a-z and digits to one blank) and the distinct word
bigrams of their parts are compared with those of the templates. Parts are the lines, the whole text, and windows of
words across line ends of at most (2 - t) / t times a template's words, which is where a coefficient of t ends.

A part that reaches t holds at least n t / (2 - t) of a template's n bigrams. So texts that hold none of some words,
which stand in more of each template's bigrams than it can miss, go first; then a text meets the templates of
which it holds enough bigrams. Each bigram is looked up once in the templates' sets, which leaves a bit mask, and knows
the last place where it stood before; from then on lines and windows are counts over these two numbers. A window's
counts grow along one pass from its first bigram, so that a text costs its length times the length of a window. The
templates are literals of the plan. Everything is DataFrame functions.

Defined cases: null and empty texts and parts with fewer than two words match nothing; ties between templates go to
the smaller name; repeated rows are reported each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8

# Passages that several licences share.
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see https://www.gnu.org/licenses/."
_MIT_RIGHTS = "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"

# Common public licence statements, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause/notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0/notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
    "MIT/notice": "Released under the MIT License.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary/notice": "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited.",
    "Apache-2.0/full-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause/full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _BSD_DISCLAIMER,
    "BSD-3-Clause/full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_DISCLAIMER,
    "GPL-2.0/full-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. " + _GNU_WARRANTY.format(""),
    "GPL-3.0/full-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _GNU_WARRANTY.format(""),
    "ISC/full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0/full-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _GNU_WARRANTY.format("Lesser "),
    "MIT/full-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, " + _MIT_RIGHTS,
    "MIT/full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, " + _MIT_RIGHTS + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0/full-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Proprietary/reserved": "All rights reserved.",
}


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised text."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)})


def least_shared(n: int, least: float) -> int:
    """Bigrams of a template of n that a part with a coefficient of `least` holds: 2 s >= least (n + m), m >= s."""
    return max(1, math.ceil(n * least / (2 - least) - 1e-9))


def anchors(templates: dict[str, str], least: float) -> list[str]:
    """Words that stand in so many bigrams of each template that a match holds one of them, rare words first."""
    listed = {name: bigrams(text) for name, text in templates.items()}
    left = {name: set(pairs) for name, pairs in listed.items()}
    missing = {name: len(pairs) - least_shared(len(pairs), least) + 1 for name, pairs in listed.items()}
    chosen: list[str] = []
    while any(n > 0 for n in missing.values()):
        gain: dict[str, int] = {}
        for name in (x for x, n in missing.items() if n > 0):
            for pair in left[name]:
                for word in set(pair.split()):
                    gain[word] = gain.get(word, 0) + 1
        best = max(gain, key=lambda w: (len(w) > 4 and w not in _COMMON, gain[w], w))
        chosen.append(best)
        for name, pairs in left.items():
            gone = {p for p in pairs if best in p.split()}
            left[name] = pairs - gone
            missing[name] -= len(gone)
    return chosen


_COMMON = set("a all an and any are as at be by can even for from if in is it may not of on or other out see that the this to use whom with without you".split())
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.translate(text, *_LOWER), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def _dice(shared: Column, n: Column, m: Column) -> Column:
    return 2 * shared / (n + m)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _can_match(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of some words. It is lower-cased once for all of them. Words of up to three letters are
    part of many others, so that they must stand alone."""

    def any_of(low: Column) -> Column:
        held = F.lit(False)
        for word in words:
            one = F.contains(low, F.lit(word))
            held = held | (one if len(word) > 3 else one & text.rlike(f"(?i)(?:^|[^a-z0-9]){word}(?:$|[^a-z0-9])"))
        return held

    return _let(F.lower(text), any_of)


def _earlier(pairs: Column) -> Column:
    """For each place of an array the last earlier place of the same value, -1 without one: equal values are neighbours
    once the places are sorted by value."""

    def linked(s: Column) -> Column:
        before = lambda k: F.get(s, k - 1)
        return F.transform(s, lambda x, k: F.struct(x["k"], F.when((k > 0) & (before(k)["p"] == x["p"]), before(k)["k"]).otherwise(-1).alias("earlier")))

    placed = F.array_sort(F.transform(pairs, lambda p, k: F.struct(p.alias("p"), k.alias("k"))))
    return F.transform(F.array_sort(_let(placed, linked)), lambda x: x["earlier"])


def _runs(lines: Column) -> Column:
    """line, base, stop of each line that has words: its number, its first word and the one behind its last."""
    bases = F.filter(F.transform(lines, lambda x, k: F.when((k == 0) | (F.get(lines, k - 1) != x), k)), lambda k: k.isNotNull())
    return _let(bases, lambda b: F.transform(b, lambda at, k: F.struct(F.get(lines, at).alias("line"), at.alias("base"), F.coalesce(F.get(b, k + 1), F.size(lines)).alias("stop"))))


def _held(cell: Column) -> Column:
    return cell["mask"].bitwiseAND(F.col("bit")) != 0


def _distinct(cells: Column, base: Column, test) -> Column:
    """How many values of a stretch that begins at base pass a test, each counted where it stands first."""
    return F.aggregate(cells, F.lit(0), lambda n, c: n + F.when((c["earlier"] < base) & test(c), 1).otherwise(0))


def _windows(least: float) -> Column:
    """Windows that reach `least`, the best one of each first bigram, and the whole text. A window that begins or ends at
    another bigram than a template's is never better. From each start one pass over at most `most` places keeps the
    counts of distinct bigrams, all and shared."""

    def best(marked: Column, a: Column) -> Column:
        start = F.struct(F.lit(0).alias("all"), F.lit(0).alias("shared"), F.lit(None).cast("struct<worse: double, fewer: int, a: int, e: int>").alias("best"))

        def step(s: Column, c: Column) -> Column:
            every = s["all"] + F.when(c["earlier"] < a, 1).otherwise(0)
            shared = s["shared"] + F.when(c["held"] & (c["earlier"] < a), 1).otherwise(0)
            here = F.struct((-_dice(shared, F.col("n"), every)).alias("worse"), (-shared).alias("fewer"), a.alias("a"), c["at"].alias("e"))
            return F.struct(every.alias("all"), shared.alias("shared"), F.when(c["held"], F.least(s["best"], here)).otherwise(s["best"]).alias("best"))

        return F.aggregate(F.slice(marked, a + 1, F.col("most")), start, step, lambda s: s["best"])

    def found(hits: Column, marked: Column) -> Column:
        starts = F.filter(hits, lambda h, k: F.coalesce(F.get(hits, k + F.col("shared") - 1) < h + F.col("most"), F.lit(False)))
        shared = _distinct(F.col("cells"), F.lit(0), _held)
        whole = F.struct((-_dice(shared, F.col("n"), F.col("all"))).alias("worse"), (-shared).alias("fewer"), F.lit(0).alias("a"), (F.size("cells") - 1).alias("e"))
        return F.array_sort(F.filter(F.concat(F.transform(starts, lambda a: best(marked, a)), F.array(whole)), lambda x: x["worse"] <= -least))

    marked = F.transform("cells", lambda c, k: F.struct(c["earlier"], _held(c).alias("held"), k.alias("at")))
    at = lambda cells: F.transform(F.filter(cells, lambda c: c["held"]), lambda c: c["at"])
    return _let(marked, lambda cells: _let(at(cells), lambda hits: found(hits, cells)))


def _of_lines(least: float) -> Column:
    """Lines that reach `least` as wholes, with the first and the last bigram that the template has there."""

    def line(x: Column) -> Column:
        cells = F.slice("cells", x["base"] + 1, x["stop"] - x["base"] - 1)
        at = F.filter(F.transform(cells, lambda c, k: F.when(_held(c), x["base"] + k)), lambda k: k.isNotNull())
        worse = -_dice(_distinct(cells, x["base"], _held), F.col("n"), x["all"])
        return F.struct(x["line"], worse.alias("worse"), F.col("licence"), F.array_min(at).alias("a"), F.array_max(at).alias("e"))

    return F.filter(F.transform("runs", line), lambda x: x["worse"] <= -least)


def _apart(items: Column) -> Column:
    """Fold: of items in order of preference, those that share no bigram's place with an earlier one."""
    clash = lambda done, x: F.exists(done, lambda y: (x["a"] <= y["e"]) & (y["a"] <= x["e"]))
    return F.aggregate(items, F.slice(items, 1, 0), lambda done, x: F.when(clash(done, x), done).otherwise(F.concat(done, F.array(x))))


def scan(docs: DataFrame, least: float = LEAST_DICE, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 1), licence, dice: of every line that reaches `least` its best template, and other passages.

    A passage (a window or the whole text) is reported at the line where it begins; of passages that overlap the one
    with the most of its template's bigrams stays. A passage that overlaps what a reported line's template matches there
    is not reported again when it has the same template or lies inside that line."""
    templates = templates or TEMPLATES
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(_can_match(F.col("text"), anchors(templates, least)))
    split = some.select("doc_id", F.transform(F.split("text", "\n"), _words).alias("rows"))
    listed = [(name, pairs, len(re.findall("[a-z0-9]+", text.lower()))) for name, text in templates.items() if (pairs := bigrams(text))]
    # As one text, since a literal at a time takes seconds; bigrams hold letters, digits and blanks only.
    of = lambda pairs: "p IN (" + ", ".join(f"'{x}'" for x in pairs) + ")"
    bits = " + ".join(f"IF({of(pairs)}, {1 << k}L, 0L)" for k, (_, pairs, _) in enumerate(listed))
    masks = F.expr(f"transform(pairs, p -> IF({of(sorted({x for _, pairs, _ in listed for x in pairs}))}, {bits}, 0L))")
    texts = split.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", _pairs(F.flatten("rows")).alias("pairs"),
        F.flatten(F.transform("rows", lambda w, k: F.array_repeat(k, F.size(w)))).alias("lines"),
    )
    some = texts.select("row", "doc_id", "pairs", "lines", masks.alias("masks")).filter(F.exists("masks", lambda m: m != 0))
    cells = F.zip_with("masks", _earlier(F.col("pairs")), lambda m, e: F.struct(m.alias("mask"), e.alias("earlier")))
    marked = some.select("row", "doc_id", "lines", cells.alias("cells"), _runs(F.col("lines")).alias("runs"))
    stretch = lambda x: F.slice("cells", x["base"] + 1, x["stop"] - x["base"] - 1)
    runs = F.transform(F.filter("runs", lambda x: F.exists(stretch(x), lambda c: c["mask"] != 0)), lambda x: x.withField("all", _distinct(stretch(x), x["base"], lambda _: F.lit(True))))
    first = F.transform(F.filter("cells", lambda c: (c["earlier"] < 0) & (c["mask"] != 0)), lambda c: c["mask"])
    marked = marked.select("row", "doc_id", "lines", "cells", runs.alias("runs"), first.alias("first"), _distinct(F.col("cells"), F.lit(0), lambda _: F.lit(True)).alias("all"))
    known = F.array(*(F.struct(F.lit(name).alias("licence"), F.lit(1 << k).cast("long").alias("bit"), F.lit(len(pairs)).alias("n"), F.lit(int((n - 1) * (2 - least) / least + 1e-9)).alias("most"), F.lit(least_shared(len(pairs), least)).alias("shared")) for k, (name, pairs, n) in enumerate(listed)))
    enough = F.filter(known, lambda t: F.size(F.filter("first", lambda m: m.bitwiseAND(t["bit"]) != 0)) >= t["shared"])
    met = marked.select("row", "doc_id", "lines", "cells", "runs", "all", F.explode(enough).alias("t")).select("row", "doc_id", "lines", "cells", "runs", "all", "t.*")
    found = met.withColumn("found", _windows(least))
    spans = F.transform(_apart(F.col("found")), lambda x: F.struct(x["fewer"], x["worse"], F.col("licence"), x["a"], x["e"], F.element_at("lines", x["a"] + 1).alias("line"), F.element_at("lines", x["e"] + 2).alias("last")))
    parts = found.select("row", "doc_id", spans.alias("spans"), _of_lines(least).alias("whole")).filter((F.size("spans") > 0) | (F.size("whole") > 0))
    one = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.collect_list("whole")).alias("whole"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    beaten = lambda x: F.exists("whole", lambda y: (y["line"] == x["line"]) & (F.struct(y["worse"], y["licence"]) < F.struct(x["worse"], x["licence"])))
    one = one.select("doc_id", F.filter("whole", lambda x: ~beaten(x)).alias("whole"), _apart(F.col("spans")).alias("spans"))
    told = lambda x, y: (x["a"] <= y["e"]) & (y["a"] <= x["e"]) & ((x["licence"] == y["licence"]) | ((x["line"] == y["line"]) & (x["last"] == y["line"])))
    fresh = F.filter("spans", lambda x: ~F.exists("whole", lambda y: told(x, y)))
    shown = lambda items: F.transform(items, lambda x: F.struct(x["line"].alias("line"), x["licence"].alias("licence"), x["worse"].alias("worse")))
    out = one.select("doc_id", F.explode(F.concat(shown(F.col("whole")), shown(fresh))).alias("x"))
    return out.select("doc_id", (F.col("x.line") + 1).cast("long").alias("line_no"), F.col("x.licence").alias("licence"), F.round(-F.col("x.worse"), 6).alias("dice"))


def oracle_sql(least: float = LEAST_DICE) -> str:
    """The same scan as SQL for DuckDB, without size bounds."""
    quoted = ", ".join("('" + name + "', [" + ", ".join(f"'{b}'" for b in bigrams(text)) + "])" for name, text in TEMPLATES.items())
    return f"""
        WITH t(licence, wanted) AS (VALUES {quoted}),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
        w AS (SELECT doc_id, line_no, string_split(trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM l),
        b AS (SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS pairs FROM w WHERE len(words) >= 2),
        d AS (SELECT doc_id, line_no, licence, 2.0 * len(list_intersect(pairs, wanted)) / (len(pairs) + len(wanted)) AS dice FROM b, t WHERE len(pairs) > 0)
        SELECT doc_id, line_no, licence, round(dice, 6) AS dice FROM d WHERE dice >= {least}
        QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, licence) = 1"""
