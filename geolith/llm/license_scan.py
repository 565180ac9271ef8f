"""License scans: passages against licence templates by the Dice coefficient of their word bigrams.

A text's passages are its whole, its paragraphs (between blank lines), its lines, and windows: runs of as many words as a
template has, over lines and paragraphs, that begin with a bigram of the template. A passage is normalised:
lower case, and everything but letters and digits separates words. With a and b different bigrams on the two sides,
the Dice coefficient is at most 2 min(a, b) / (a + b), so a template is compared only with passages whose number of
bigrams is between b * t / (2 - t) and b * (2 - t) / t at threshold t. All of it is column expressions
within a row: nothing is joined, shuffled or exploded.

A passage that reaches t shares at least b * t / (2 - t) bigrams with the template, so it lacks few of the template's words,
and a text that lacks more has no such passage: only the others are cut into passages.

Windows are looked for only in texts that hold enough different bigrams of the template, and only where enough of them are
near. Of windows of one template that overlap, the one with the highest coefficient counts (then the first); a window
within one of a longer template doesn't count.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices and short licence texts, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ISC text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
}


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    """The different word bigrams of a template, in order."""
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def least_words(text: str, threshold: float) -> int:
    """How many of a template's different words a passage that reaches the threshold has at least.

    It lacks at most m of the bigrams. A word is missing only if all bigrams it is in are, and a bigram is in the way of two words at most."""
    grams = [g.split() for g in bigrams(text)]
    lacks = 2 * (len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9))
    times = sorted(Counter(w for g in grams for w in set(g)).values())
    missing = sum(upto <= lacks for upto in itertools.accumulate(times))
    return max(len(times) - missing, 1)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, license (of the passage nearest to a template; null if none reaches the
    threshold), dice (null likewise), n_matches (different passages that reach it): one row per row of docs.

    Ties go to the template listed first. Passages that are the same after normalising count once. Null and empty texts have no
    passages. A window at the text's end may be shorter. A template needs two words at least. Other columns are ignored. An empty table gives no rows.
    """
    grams = {name: bigrams(t) for name, t in (templates or TEMPLATES).items()}
    if not all(grams.values()):
        raise ValueError("a template needs two words at least")
    lengths = {name: len(words_of(t)) - 1 for name, t in (templates or TEMPLATES).items()}
    least = math.ceil(min(len(g) for g in grams.values()) * threshold / (2 - threshold) - 1e-9)
    low = min(len(g) for g in grams.values()) * threshold / (2 - threshold)
    high = max(len(g) for g in grams.values()) * (2 - threshold) / threshold

    def normal(x: Column) -> Column:
        return F.split(F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")), " ")

    def pairs(w: Column) -> Column:
        return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))

    def bound(x: Column, f) -> Column:
        """f of x, with x worked out once."""
        return F.transform(F.array(x), f)[0]

    def windows(b: Column, seen: Column, g: list[str], n: int) -> Column:
        """The windows of n bigrams (start, stop, dice, p) that reach the threshold for a template with bigrams g."""
        need, of = math.ceil(len(g) * threshold / (2 - threshold) - 1e-9), F.array(*map(F.lit, g))

        def window(i: Column) -> Column:
            return bound(F.array_distinct(F.slice(b, i + 1, n)), lambda p: F.struct(i.alias("start"), (i + n).alias("stop"), (2.0 * F.size(F.array_intersect(p, of)) / (F.size(p) + len(g))).alias("dice"), p.alias("p")))

        def beaten(x: Column, k: Column, every: Column) -> Column:
            near = F.slice(every, F.greatest(k + 1 - n, F.lit(1)), 2 * n + 1)
            return F.exists(near, lambda y: (F.abs(y["start"] - x["start"]) <= n) & ((y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & (y["start"] < x["start"]))))

        at = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: F.array_contains(of, F.get(b, i)))
        at = bound(at, lambda a: F.filter(a, lambda i, k: F.coalesce(F.get(a, k + need - 1) - i < n, F.lit(False))))
        found = F.filter(F.transform(at, window), lambda x: x["dice"] >= threshold)
        found = bound(found, lambda every: F.filter(every, lambda x, k: ~beaten(x, k, every)))
        return F.when(F.size(F.array_intersect(seen, of)) >= need, found).otherwise(F.array().cast("array<struct<start:int,stop:int,dice:double,p:array<string>>>"))

    def best(p: Column) -> Column:
        n = F.size(p)
        of = []
        for k, (name, g) in enumerate(grams.items()):
            fits = n.between(len(g) * threshold / (2 - threshold) - 1e-9, len(g) * (2 - threshold) / threshold + 1e-9)
            dice = F.when(fits, 2.0 * F.size(F.array_intersect(p, F.array(*map(F.lit, g)))) / (n + len(g))).otherwise(F.lit(0.0))
            of.append(F.struct(dice.alias("dice"), F.lit(-k).alias("rank"), F.lit(name).alias("license")))
        return F.array_max(F.array(*of)) if len(of) > 1 else of[0]

    text = F.coalesce(F.col("text"), F.lit(""))
    terms = {name: list(dict.fromkeys(words_of(t))) for name, t in (templates or TEMPLATES).items()}
    known = F.array(*map(F.lit, dict.fromkeys(w for t in terms.values() for w in t)))
    close = lambda seen: F.array(*[F.size(F.array_intersect(seen, F.array(*map(F.lit, terms[name])))) >= least_words(t, threshold) for name, t in (templates or TEMPLATES).items()])
    base = docs.select("doc_id", text.alias("text"), normal(text).alias("w"))
    base = base.select("*", F.array_contains(bound(F.array_intersect("w", known), close), True).alias("near"))
    some = list(dict.fromkeys(x for g in grams.values() for x in g))
    every = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    of = lambda b, seen: F.concat(*[windows(b, seen, grams[name], n) for name, n in lengths.items()])
    inside = lambda x, y: (y["stop"] - y["start"] > x["stop"] - x["start"]) & (y["start"] <= x["start"]) & (x["stop"] <= y["stop"])
    outer = lambda ws: F.transform(F.filter(ws, lambda x: ~F.exists(ws, lambda y: inside(x, y))), lambda x: x["p"])
    none = F.array().cast("array<array<string>>")
    runs = bound(F.col("w"), lambda w: F.when(~F.col("near") | (F.size(w) < 2), none).otherwise(bound(every(w), lambda b: bound(F.array_intersect(b, F.array(*map(F.lit, some))), lambda seen: F.when(F.size(seen) < least, none).otherwise(bound(of(b, seen), outer))))))
    passages = F.array_distinct(F.concat(F.array("text"), F.split("text", r"\n[ \t\r]*\n"), F.split("text", "\n")))
    out = base.select("doc_id", runs.alias("runs"), F.when(F.col("near"), passages).otherwise(F.array().cast("array<string>")).alias("p"))
    out = out.select("doc_id", "runs", F.transform("p", normal).alias("p"))
    # There are no more bigrams than words less one, and no fewer than different words less one.
    out = out.select("doc_id", "runs", F.filter("p", lambda w: (F.size(w) - 1 >= low) & (F.size(w) >= 2)).alias("p"))
    out = out.select("doc_id", "runs", F.filter("p", lambda w: F.size(F.array_distinct(w)) - 1 <= high).alias("p"))
    out = out.select("doc_id", F.array_distinct(F.concat(F.transform("p", pairs), "runs")).alias("p"))
    out = out.select("doc_id", F.filter(F.transform("p", best), lambda m: m["dice"] >= threshold).alias("m"))
    top = F.array_max("m")
    return out.select("doc_id", top["license"].alias("license"), top["dice"].alias("dice"), F.size("m").cast("long").alias("n_matches"))
