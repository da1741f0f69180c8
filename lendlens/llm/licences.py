"""License scans: passages of text against licence templates by the Dice coefficient of word bigrams.

Units are lines, the whole text where it has several lines, and passages: windows of as many words
as a template has (fewer at the text's end), over line breaks, which begin where one of the
template's words that stand in it only once would place its first word. Units and templates are
lower case letters and digits, all else being one blank. With sets A and B of word bigrams, the
score 2|A n B| / (|A| + |B|) reaches t only if |A| t / (2 - t) <= |B| <= |A| (2 - t) / t, so the
sizes choose the templates a unit is compared to. A unit that reaches t holds the share t / (2 - t)
of a template's bigrams at least, so it holds one of any words that touch more than the other
bigrams; texts and lines without such words are passed over, and passages are looked for only
where the text shares bigrams enough. DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.8
# Customary notices, headers and bodies of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                         "except in compliance with the License.",
    "MIT-body": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
    """,
    "ISC-body": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
        AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.
    """,
    "BSD-2-Clause-body": """
        Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE
        IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
        FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
        NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
    """,
    "BSD-3-Clause-body": """
        Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither
        the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission. THIS SOFTWARE IS
        PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
        FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
        NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
    """,
    "Apache-2.0-full-header": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.
    """,
    "GPL-3.0-header": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version. This program is distributed in the hope that it will
        be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
        received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.
    """,
    "MPL-2.0-header": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
    """,
    "Zlib-body": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the
        authors be held liable for any damages arising from the use of this software. Permission is granted
        to anyone to use this software for any purpose, including commercial applications, and to alter it
        and redistribute it freely, subject to the following restrictions: 1. The origin of this software
        must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any
        source distribution.
    """,
    "Unlicense-opening": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means.
    """,
}


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    found = {}
    for name, text in sorted(templates.items()):
        words = words_of(text)
        found[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
    return {name: pairs for name, pairs in found.items() if pairs}


def least_shared(pairs: list[str], threshold: float) -> int:
    """How many of a template's bigrams a unit that reaches the threshold holds at least."""
    return math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9)


def telling_words(known: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which a unit holds one at least if it reaches the threshold for any template.

    Words are taken until those left touch too few bigrams in each template: first such that
    touch many bigrams still needed and are long, as long words are rarer in other texts.
    """
    open_ = {name: set(pairs) for name, pairs in known.items()}
    chosen: list[str] = []
    while True:
        spare = {name: len(open_[name]) - least_shared(known[name], threshold) + 1 for name in known}
        gain: Counter = Counter()
        for name, most in spare.items():
            touched = Counter(w for p in open_[name] for w in set(p.split()))
            for word, times in touched.items() if most > 0 else ():
                gain[word] += min(times, most) * max(len(word) - 3, 0.01)
        if not gain:
            return sorted(chosen)
        chosen.append(min(gain, key=lambda w: (-gain[w], w)))
        open_ = {name: {p for p in pairs if chosen[-1] not in p.split()} for name, pairs in open_.items()}


def may_hold(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def padded(body: Column) -> Column:
    """A normalised body with blanks around it."""
    return F.concat(F.lit(" "), body, F.lit(" "))


def has_word(body: Column, words: list[str]) -> Column:
    """Whether the normalised, padded body holds one of the words."""
    return may_hold(body, [f" {w} " for w in words])


def anchors(words: list[str]) -> dict[str, int]:
    """Words of four signs or more that stand once in the template, with their places; else all words that stand once."""
    once = {w: i for i, w in enumerate(words) if words.count(w) == 1}
    return {w: i for w, i in once.items() if len(w) >= 4} or once


def normal(text: Column) -> Column:
    """Letters and digits of a lower-case text with single blanks; line breaks stay."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")


def bigrams(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                      F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def fixed(values: list) -> Column:
    """A literal array after constant folding."""
    return F.split(F.lit("|".join(map(str, values))), "[|]")


def best_passage(name: str, template: list[str], pairs: list[str], threshold: float) -> Column:
    """(licence, found: dice and place) of the template's best window in a text's `words` and `pairs`; null where none can reach the threshold.

    `held` are those of the text's bigrams that any template has.
    """
    offsets = anchors(template)
    known, heads, steps = fixed(pairs), fixed(list(offsets)), fixed(list(offsets.values())).cast("array<int>")

    def place(word: Column, at: Column) -> Column:
        return at - F.get(steps, F.array_position(heads, word).cast("int") - 1)  # null where it is no anchor

    def score(start: Column) -> Column:
        window = F.slice("pairs", start + 1, len(template) - 1)
        dice = 2 * F.size(F.array_intersect(window, known)) / (F.size(F.array_distinct(window)) + len(pairs))
        return F.struct(dice.alias("dice"), (-start).alias("place"))

    found = F.filter(F.transform("words", place), lambda x: x.isNotNull())
    starts = F.array_distinct(F.transform(found, lambda x: F.greatest(x, F.lit(0))))
    best = F.array_max(F.transform(starts, score))
    return F.when(F.size(F.array_intersect("held", known)) >= least_shared(pairs, threshold),
                  F.struct(F.lit(name).alias("licence"), best.alias("found")))


def passages(texts: DataFrame, templates: dict[str, str], key: str, threshold: float) -> DataFrame:
    """Of each normalised `body` and template the best window that reaches the threshold."""
    known = template_bigrams(templates)
    rows = texts.select(key, F.explode(F.array(F.split(F.trim("body"), " "))).alias("words"))
    # Generators keep Spark from working out the words anew inside each window.
    rows = rows.select(key, "words", F.explode(F.array(bigrams(F.col("words")))).alias("pairs"))
    # The bigrams of a text meet those of all templates once; what is left is short.
    held = F.array_intersect("pairs", fixed(sorted({p for pairs in known.values() for p in pairs})))
    rows = rows.select(key, "words", "pairs", F.explode(F.array(held)).alias("held")) \
        .where(F.size("held") >= min(least_shared(pairs, threshold) for pairs in known.values()))
    found = rows.select(key, F.explode(F.array(*[
        best_passage(name, words_of(templates[name]), pairs, threshold) for name, pairs in known.items()])).alias("best"))
    return found.where(F.col("best.found.dice") >= threshold).select(
        key, F.lit(-1).cast("long").alias("unit"), (1 - F.col("best.found.place")).cast("long").alias("first_word"),
        "best.licence", "best.found.dice")


def scan_licences(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per unit that reaches the threshold: key, unit, first_word, licence, dice.

    `unit` is the number of the line from 1, 0 for the whole text, or -1 for a passage, whose first
    word has the number `first_word` (else 0). Of several templates that fit a line or text the one
    with the greatest score is named, then the first by name. Of each template the best passage of a
    text has a row, the first of equals. Null and empty texts have no rows, rows that repeat are
    reported each, null keys stay null; without templates there are no rows.
    """
    templates = TEMPLATES if templates is None else templates
    known = template_bigrams(templates)
    if not known:
        return docs.where(F.lit(False)).select(key, F.lit(0).cast("long").alias("unit"), F.lit(0).cast("long").alias("first_word"),
                                               F.lit("").alias("licence"), F.lit(0.0).alias("dice"))
    sizes, telling = sorted({len(p) for p in known.values()}), telling_words(known, threshold)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = math.ceil(sizes[0] * low - 1e-9), math.floor(sizes[-1] * high + 1e-9)
    # Filters of many words would work out their text for each word: generators make it once.
    lower = docs.select(key, F.explode(F.array(F.lower(F.col(text)))).alias("lower")).where(may_hold(F.col("lower"), telling))
    chosen = lower.select(key, F.explode(F.array(F.split(normal(F.col("lower")), "\n", -1))).alias("lines"))
    whole = F.regexp_replace(F.concat_ws(" ", "lines"), " +", " ")
    bodies = F.transform(F.concat(F.array(F.when(F.size("lines") > 1, whole).otherwise("")), "lines"), padded)
    units = chosen.select(key, F.posexplode(bodies).alias("unit", "body")) \
        .where(has_word(F.col("body"), telling))
    units = units.withColumn("words", F.split(F.trim("body"), " ")).where(F.size("words") > least) \
        .where(F.size(F.array_distinct("words")) <= most + 1)
    units = units.select(key, "unit", F.array_distinct(bigrams(F.col("words"))).alias("pairs")).withColumn("n", F.size("pairs"))
    # The templates of each size are compared only where that size is in bounds.
    scores = []
    for name, pairs in known.items():
        size = len(pairs)
        fits = (F.col("n") >= size * low - 1e-9) & (F.col("n") <= size * high + 1e-9)
        shared = F.size(F.array_intersect("pairs", F.array(*map(F.lit, pairs))))
        dice = 2 * shared / (F.col("n") + size)
        scores.append(F.when(fits, F.struct(dice.alias("dice"), F.lit(-len(scores)).alias("place"), F.lit(name).alias("licence"))))
    best = units.where(F.col("n").between(least, most)).select(key, "unit", F.greatest(*scores).alias("best")) \
        if len(scores) > 1 else units.select(key, "unit", scores[0].alias("best"))
    best = best.where(F.col("best.dice") >= threshold).select(
        key, F.col("unit").cast("long").alias("unit"), F.lit(0).cast("long").alias("first_word"), "best.licence", "best.dice")
    return best.unionByName(passages(chosen.select(key, F.explode(F.array(padded(whole))).alias("body")).where(has_word(F.col("body"), telling)), templates, key, threshold))
