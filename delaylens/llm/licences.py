"""Licence notices in documents, by Dice coefficient over word bigrams.

Each line of a text and the text as a whole are normalised to lower-case words
and held against the licence templates.  A unit's number of distinct bigrams
bounds its coefficient with a template, so templates of unfit size are never
compared.  Where neither matches, runs of words inside the text are tried.
A match needs two thirds of a template's bigrams at least, so texts and units
without the words that touch more than the rest of each template fall out
first.  All of it is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Least coefficient of a match.
DICE = 0.8

#: Public licence notices and short licence texts.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "lgpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

#: Complete licences by paragraph; the whole is a template, and so is each paragraph under the name with its number.
PARAGRAPHS = {
    "bsd-2-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
}
TEMPLATES |= {name: " ".join(parts) for name, parts in PARAGRAPHS.items()}
TEMPLATES |= {f"{name}/{k}": part for name, parts in PARAGRAPHS.items() for k, part in enumerate(parts, 1)}

#: Words too common to tell a licence by.
COMMON = frozenset("a above all an and any are as at be by even following for from if in including is it may must not of on one or other see shall should software that the this to under use was will with without you your".split())

#: Short words that hardly occur outside of licences.
SHORT = frozenset("cc gnu mit mpl nc sa".split())


def words(text: Column) -> Column:
    """The words of a text: A-Z in lower case, runs of ASCII letters and digits and of what lies outside ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def bigrams(word_list: Column) -> Column:
    """The distinct pairs of neighbouring words; a single word is a pair with nothing."""
    pairs = F.transform(F.arrays_zip(word_list.alias("a"), F.slice(word_list, 2, F.greatest(F.size(word_list), F.lit(1))).alias("b")), lambda p: F.concat_ws(" ", p.a, p.b))
    return F.array_distinct(F.slice(pairs, 1, F.greatest(F.size(word_list) - 1, F.least(F.size(word_list), F.lit(1)))))


def template_bigrams(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[str]]]:
    """Each template's name and bigrams; as many rows as templates."""
    rows = spark.createDataFrame(sorted(templates.items()), "licence string, text string")
    return [(r[0], r[1]) for r in rows.select("licence", bigrams(words(F.col("text")))).orderBy("licence").collect()]


def telling_words(wanted: list[tuple[str, list[str]]], dice: float) -> list[tuple[list[str], list[str]]]:
    """Groups of words (all of these, one of those): every text that matches a template meets one group.

    A match has ``dice / (2 - dice)`` of the template's bigrams at least.  A
    word that touches more than the rest of them cannot be missing, and of
    words that together do so one must be there.  A word counts as there if a
    longer one holds it.
    """
    groups: list[tuple[list[str], list[str]]] = []
    left: dict[str, tuple[set[str], int]] = {}
    for name, own in wanted:
        spare = len(own) - math.ceil(len(own) * dice / (2 - dice) - 1e-9)
        touched = {w: {g for g in own if any(w in x for x in g.split(" "))} for w in {x for g in own for x in g.split(" ") if len(x) > 2 or x in SHORT}}
        required = sorted((w for w, t in touched.items() if len(t) > spare), key=lambda w: (-len(w), w))
        if not required:
            left[name] = (set(own), spare + 1)
            continue
        rest, some = {w: t for w, t in touched.items() if w not in required}, []
        hit: set[str] = set()
        while rest and len(hit) <= spare:
            word = max(rest, key=lambda w: (len(rest[w] - hit) * _rarity(w), w))
            hit |= rest.pop(word)
            some.append(word)
        groups.append((required, some if len(hit) > spare else []))
    chosen: list[str] = []
    while left:
        gain: Counter = Counter()
        for grams, need in left.values():
            for word in {w for g in grams for w in g.split(" ") if len(w) > 2 or w in SHORT} or {w for g in grams for w in g.split(" ")}:
                gain[word] += min(sum(any(word in x for x in g.split(" ")) for g in grams), need) * _rarity(word)
        word = max(gain, key=lambda w: (gain[w], w))
        chosen.append(word)
        for name, (grams, need) in list(left.items()):
            touched = {g for g in grams if any(word in x for x in g.split(" "))}
            left[name] = (grams - touched, need - len(touched))
            if need <= len(touched):
                del left[name]
    return [(required, some) for required, some in groups if not set(required) & set(chosen)] + ([([], chosen)] if chosen else [])


def _rarity(word: str) -> float:
    """How much a word tells: long words are rare in other texts, ``COMMON`` ones are not."""
    return 0.01 if word in COMMON else 6.0 if word in SHORT else max(len(word) - 5, 0.1)


def has_word(text: Column, groups: list[tuple[list[str], list[str]]]) -> Column:
    """Whether a text can meet one of the groups of ``telling_words``."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def there(x: Column, word: str) -> Column:
        held = F.contains(x, F.lit(word))
        return held & x.rlike(rf"(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])") if len(word) < 4 else held

    def meets(x: Column) -> Column:
        tests = []
        for required, some in groups:
            needed = sorted(required, key=lambda w: -_rarity(w))
            parts = [F.contains(x, F.lit(w)) for w in needed]
            if some:
                parts.append(reduce(lambda a, b: a | b, [there(x, w) for w in some]))
            tests.append(reduce(lambda a, b: a & b, parts))
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    # a variable of its own, so that the text is put into lower case once
    return F.exists(F.array(lower), meets)


def _constant(grams: list[str]) -> Column:
    return F.split(F.lit("\n".join(grams)), "\n")


def scan_runs(docs: DataFrame, wanted: list[tuple[str, list[str]]], lengths: dict[str, int], dice: float) -> DataFrame:
    """The best run of words for each template: ``doc_id``, ``licence``, ``dice`` (at least ``dice``).

    A run has at most ``(2 - dice) / dice`` times as many bigrams as the
    template and begins with one of the template's.  Bigrams are compared as
    64-bit hashes.
    """
    share, most = dice / (2 - dice), (2 - dice) / dice
    # the explodes are outer because a filter, also one that Spark infers from an inner one, would be pushed down and work out the arrays at each use
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    each = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", pairs(F.col("w")).alias("g"))
    each = each.withColumn("own", F.array_distinct("g"))
    fit = [F.when(F.size(F.array_intersect("own", _constant(own))) >= len(own) * share - 1e-9, F.struct(F.lit(name).alias("licence"), F.transform(_constant(own), lambda x: F.xxhash64(x)).alias("t"), F.lit(math.floor(max(lengths[name], len(own)) * most + 1e-9)).alias("most"))) for name, own in wanted]
    each = each.select("doc_id", F.transform("g", lambda x: F.xxhash64(x)).alias("g"), F.explode_outer(F.filter(F.array(*fit), lambda x: x.isNotNull())).alias("m")).where("m is not null").select("doc_id", "g", "m.*")
    # a bigram counts in a run if it was not there before: if its last place is before the run's first
    last = lambda i: F.array_position(F.reverse(F.slice("g", F.greatest(i - F.col("most"), F.lit(0)) + 1, F.least(i, F.col("most")))), F.get("g", i))
    seen = F.transform(F.sequence(F.lit(0), F.size("g") - 1), lambda i: F.struct(i.alias("i"), F.when(last(i) > 0, i - last(i)).otherwise(F.lit(-1)).alias("last"), F.array_contains("t", F.get("g", i)).cast("int").alias("in")))
    each = each.withColumn("s", seen)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(0.0).alias("best"))

    def step(first: Column):
        def add(a: Column, x: Column) -> Column:
            new = (x["last"] < first["i"]).cast("int")
            n, c = a["n"] + new, a["c"] + new * x["in"]
            return F.struct(n.alias("n"), c.alias("c"), F.greatest(a["best"], F.lit(2.0) * c / (n + F.size("t"))).alias("best"))

        return add

    runs = F.transform(F.filter("s", lambda x: x["in"] == 1), lambda x: F.aggregate(F.slice("s", x["i"] + 1, F.col("most")), zero, step(x), lambda a: a["best"]))
    best = F.filter(F.array(F.array_max(runs)), lambda x: x >= dice)
    return each.select("doc_id", "licence", F.explode_outer(best).alias("dice")).where("dice is not null")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The licences found: ``doc_id``, ``licence``, ``n_units`` (lines, or the whole text, that match), ``best_dice``.

    A document's units are its lines and, if it has several, the whole of it;
    a unit matches a template when the Dice coefficient of their bigrams is at
    least ``dice``.  Where no unit matches a template, the document's best run
    of words is the one unit; a run that matches a paragraph alone counts only
    if the licence as a whole is not found.  Licences that differ in a few
    words match together; ``best_dice`` tells them apart.  Documents without a match, null and empty texts give no
    row.  Repeated ids are counted together.
    """
    templates = TEMPLATES if templates is None else templates
    wanted = template_bigrams(docs.sparkSession, templates)
    wanted = [(name, own) for name, own in wanted if own]
    lengths = {name: len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", templates[name])) for name, _ in wanted}
    chosen = telling_words(wanted, dice)
    docs = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(has_word(F.col("text"), chosen)), "telling")
    slack = 1e-9  # a unit just at a bound is compared
    low, high = dice / (2 - dice) - slack, (2 - dice) / dice + slack
    least, most = min(len(own) for _, own in wanted) * low, max(len(own) for _, own in wanted) * high
    own = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    units = F.when(F.size(own) > 1, F.concat(own, F.array(F.coalesce(F.col("text"), F.lit(""))))).otherwise(own)
    # a bigram takes two bytes at least, so short units fall out before they are cut into words
    each = docs.select("doc_id", F.explode(F.filter(units, lambda u: F.octet_length(u) >= int(least) * 2)).alias("unit")).where(has_word(F.col("unit"), chosen))
    # each distinct word but the first ends a bigram of its own, so too many of them rule a unit out before its bigrams are made
    sized = each.select("doc_id", words(F.col("unit")).alias("w")).where((F.size("w") >= int(least)) & (F.size(F.array_distinct("w")) - 1 <= most)).select("doc_id", bigrams(F.col("w")).alias("b")).where(F.size("b").between(least, most))
    score = lambda grams: F.lit(2.0) * F.size(F.array_intersect("b", _constant(grams))) / (F.size("b") + len(grams))
    held = F.array(*[F.struct(F.lit(name).alias("licence"), F.when(F.size("b").between(len(grams) * low, len(grams) * high), score(grams)).alias("dice")) for name, grams in wanted])
    found = sized.select("doc_id", F.explode(F.filter(held, lambda x: x.dice >= dice)).alias("m")).select("doc_id", "m.licence", "m.dice")
    units = found.groupBy("doc_id", "licence").agg(F.count("*").alias("n_units"), F.max("dice").alias("best"), F.lit(0).alias("run"))
    runs = scan_runs(docs, wanted, lengths, dice)
    runs = runs.groupBy("doc_id", "licence").agg(F.count("*").alias("n_units"), F.max("dice").alias("best"), F.lit(1).alias("run"))
    both = units.unionByName(runs).groupBy("doc_id").agg(F.collect_list(F.struct("licence", "n_units", "best", "run")).alias("m"))
    named = lambda run: F.transform(F.filter("m", lambda x: x["run"] <= run), lambda x: x["licence"])
    extra = lambda x: ~F.array_contains(named(0), x["licence"]) & (~F.contains(x["licence"], F.lit("/")) | ~F.array_contains(named(1), F.substring_index(x["licence"], "/", 1)))
    kept = both.select("doc_id", F.explode(F.filter("m", lambda x: (x["run"] == 0) | extra(x))).alias("m"))
    return kept.select("doc_id", "m.licence", "m.n_units", F.round("m.best", 6).alias("best_dice"))
