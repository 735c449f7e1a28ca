"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Only DataFrame functions: each row is worked on within itself, so nothing is shuffled or joined.
A text is compared as a whole, by paragraphs and by lines; templates that match none of these are
then looked for in runs of consecutive sentences, across paragraphs.  Bounds on size leave out
templates that can't reach the threshold, and a unit that has none of the words that every match
must have some of is left out before that.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

THRESHOLD = 0.8

# Public licence texts and notices, as published (wording without names and years).
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
    "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. ")
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ")
TEMPLATES: dict[str, str] = {
    "agpl-3-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied. See the License for the specific language governing permissions and limitations under the License."),
    "apache-2-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2": _BSD_TERMS + _BSD_WARRANTY,
    "bsd-3": _BSD_TERMS + (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. ") + _BSD_WARRANTY,
    "cc-by-4-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see <https://www.gnu.org/licenses/>."),
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "mit": _MIT + _WARRANTY,
    "mit-notice": "Released under the MIT License.",
    "mpl-2-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
}


def normalised(text: str) -> str:
    """ASCII letters and digits in lower case, anything else one space."""
    return re.sub("[^A-Za-z0-9]+", " ", text).strip(" ").lower()


def numbered(words: list[str]) -> list[str]:
    """The bigrams of some words, each with the number of times it came before, so that repeats count."""
    seen: Counter = Counter()
    out = []
    for pair in zip(words, words[1:]):
        g = " ".join(pair)
        out.append(f"{g} {seen[g]}")
        seen[g] += 1
    return out


class Template:
    """A template's bigrams, the sizes that can reach the threshold, and words of which any match has one."""

    def __init__(self, name: str, text: str, threshold: float):
        self.name, self.threshold, self.grams = name, threshold, numbered(normalised(text).split(" "))
        size = len(self.grams)
        if not size:
            raise ValueError(f"template {name} has fewer than two words")
        # 2 min(n, size) / (n + size) >= threshold; a little room for rounding, as the coefficient itself decides
        self.least = max(1, math.ceil(size * threshold / (2 - threshold) - 1e-9))
        self.most = math.floor(size * (2 - threshold) / threshold + 1e-9)
        # a match shares self.least bigrams or more, so it has at least one of any size - least + 1 of them
        rare = sorted(self.grams, key=lambda g: (-max(map(len, g.split(" ")[:2])), g))[: size - self.least + 1]
        self.words = {max(g.split(" ")[:2], key=lambda w: (len(w), w)) for g in rare}


def templates(texts: dict[str, str] | None = None, threshold: float = THRESHOLD) -> list[Template]:
    return [Template(k, t, threshold) for k, t in sorted((texts or TEMPLATES).items())]


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _pairs(w: Column) -> Column:
    return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))


def _tagged(unit: Column) -> Column:
    def tag(grams: Column) -> Column:
        return F.transform(grams, lambda g, i: F.concat_ws(" ", g, F.size(F.filter(F.slice(grams, 1, i), lambda x: x == g))))

    return _with(_with(F.split(unit, " "), _pairs), tag)


_NONE = "array<struct<name:string,dice:double>>"
#: Between sentences: white space after an end mark, or a line without letters or digits.
_SENTENCE = r"(?<=[.!?])\s+|\n[^A-Za-z0-9\n]*\n"


def _wide(t: Template) -> Column:
    """A template as runs of sentences need it: its different bigrams, those it has several times, and how many different ones a match shares."""
    counts = Counter(g.rsplit(" ", 1)[0] for g in t.grams)
    several = [F.struct(F.lit(g).alias("pair"), F.lit(n).alias("n")) for g, n in sorted(counts.items()) if n > 1]
    return F.struct(
        F.lit(t.name).alias("name"), F.lit(sorted(counts)).alias("pairs"), F.array(*several).cast("array<struct<pair:string,n:int>>").alias("several"),
        F.lit(len(t.grams)).alias("size"), F.lit(t.least).alias("least"), F.lit(t.most).alias("most"), F.lit(t.threshold).alias("threshold"),
        F.lit(max(1, t.least - len(t.grams) + len(counts))).alias("differing"))


def _dice_of_runs(t: Column, hits: Column, pairs: Column, before: Column) -> Column:
    """The coefficients of the runs of sentences that may reach the threshold.

    ``hits`` has a byte for each of the text's bigrams, whether the template has it; ``before`` the
    words before each sentence and, last, all.  A run shares at most as many bigrams as are hits in
    it.  One begins only where the largest window has enough of them, and begins and ends with
    sentences that have one, their links to the next and the previous included: without others it
    would be nearer.  So work is linear in the text, and runs are made near a licence alone.
    """
    text = lambda at, n: F.decode(F.substr(hits, at + 1, n), "US-ASCII")
    n_hits = lambda at, n: F.length(F.replace(text(at, n), F.lit("0"), F.lit("")))
    words = lambda k: before[k + 1] - before[k]
    last = F.size(before) - 2
    begins = F.filter(F.sequence(F.lit(0), last), lambda a: (n_hits(before[a], t["most"]) >= t["least"]) & (n_hits(before[a], words(a)) > 0))

    def dice(a: Column, n: Column) -> Column:
        several = lambda g: F.aggregate(t["several"], F.lit(0), lambda s, x: s + F.greatest(F.least(F.size(F.filter(g, lambda y: y == x["pair"])), x["n"]) - 1, F.lit(0)))
        return _with(F.slice(pairs, before[a] + 1, n), lambda g: 2.0 * (F.size(F.array_intersect(g, t["pairs"])) + several(g)) / (n + t["size"]))

    def runs(a: Column) -> Column:
        size = lambda b: before[b + 1] - before[a] - 1
        ends = F.filter(F.sequence(a, F.least(last, a + t["most"])), lambda b: size(b).between(t["least"], t["most"]))
        link = lambda b: F.when(b > a, 1).otherwise(0)
        able = F.filter(ends, lambda b: (n_hits(before[b] - link(b), words(b) - 1 + link(b)) > 0) & (2.0 * n_hits(before[a], size(b)) / (size(b) + t["size"]) >= t["threshold"]))
        return F.transform(able, lambda b: dice(a, size(b)))

    return F.flatten(F.transform(begins, runs))


def with_matches(df: DataFrame, text_col: str, name: str, texts: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``name``, an ``array<struct<name, dice>>`` of its texts' units and templates that reach the threshold.

    A template that no unit reaches is there once if some run of sentences does, with the best run's
    coefficient.  Only texts with enough of its different bigrams are looked through for runs.

    The normalised text and whether it has any of the words are columns of their own on the way, so
    each is made once; only texts that have one are cut up.
    """
    known = templates(texts, threshold)
    table = F.array(*[F.struct(F.lit(t.name).alias("name"), F.lit(t.grams).alias("grams"), F.lit(len(t.grams)).alias("size"), F.lit(t.least).alias("least"), F.lit(t.most).alias("most")) for t in known])
    words = "(?:^|[ \n])(?:" + "|".join(sorted(set().union(*(t.words for t in known)))) + ")(?:[ \n]|$)"
    low, high = min(t.least for t in known), max(t.most for t in known)
    text_, plain_, units_, sentences_, found_, pairs_, before_, rest_ = (common.free(df.columns, f"_{c}") for c in ("text", "plain", "units", "sentences", "found", "pairs", "before", "rest"))
    plain = F.col(plain_)
    size = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))  # noqa: E731  of bigrams
    tidy = lambda u: F.trim(F.regexp_replace(u, "[ \n]+", " "))
    cut = F.concat(F.array(plain), F.split(plain, "\n *\n"), F.split(plain, "\n"))
    units = F.array_distinct(F.transform(F.filter(cut, lambda u: u.rlike(words)), tidy))

    fitting = F.filter(F.col(units_), lambda u: size(u).between(low, high))
    ready = F.transform(fitting, lambda u: F.struct(size(u).alias("n"), _tagged(u).alias("grams")))

    def compare(unit: Column) -> Column:
        fit = F.filter(table, lambda t: unit["n"].between(t["least"], t["most"]))
        return F.transform(fit, lambda t: F.struct(t["name"].alias("name"), (2.0 * F.size(F.array_intersect(unit["grams"], t["grams"])) / (unit["n"] + t["size"])).alias("dice")))

    found = F.filter(F.flatten(F.transform(ready, compare)), lambda m: m["dice"] >= threshold)

    plain_sentence = lambda u: F.trim(F.lower(F.regexp_replace(u, "[^A-Za-z0-9]+", " ")))
    sentences = F.filter(F.transform(F.split(F.col(text_), _SENTENCE), plain_sentence), lambda u: u != "")
    wide = F.array(*[_wide(t) for t in known])
    # each sentence is a bar and a mark for each word, so the bar's place tells how many words come before it
    marks = F.encode(F.array_join(F.transform(F.col(sentences_), lambda u: F.concat(F.lit("|"), F.regexp_replace(u, "[^ ]+ ?", "x"))), ""), "US-ASCII")
    bars = lambda m: F.filter(F.sequence(F.lit(1), F.length(m) + 1), lambda k: (k > F.length(m)) | (F.substr(m, k, F.lit(1)) == F.encode(F.lit("|"), "US-ASCII")))
    before = _with(marks, lambda m: F.transform(bars(m), lambda k, i: k - i - 1))
    pairs = _with(F.split(F.array_join(sentences_, " "), " "), _pairs)
    in_text = _with(F.array_distinct(F.col(pairs_)), lambda g: F.filter(wide, lambda t: (F.size(F.array_intersect(g, t["pairs"])) >= t["differing"]) & ~F.exists(found_, lambda m: m["name"] == t["name"])))

    def best_run(t: Column) -> Column:
        hits = F.encode(F.array_join(F.transform(F.col(pairs_), lambda g: F.when(F.array_contains(t["pairs"], g), "1").otherwise("0")), ""), "US-ASCII")
        return _with(hits, lambda h: F.struct(t["name"].alias("name"), F.array_max(_dice_of_runs(t, h, F.col(pairs_), F.col(before_))).alias("dice")))

    by_run = F.filter(F.transform(rest_, best_run), lambda m: m["dice"] >= threshold)
    none = F.array().cast(_NONE)
    keep = [f"`{c}`" for c in df.columns if c != name]
    return (
        df.select(*keep, F.col(text_col).alias(text_), F.lower(F.regexp_replace(text_col, "[^A-Za-z0-9\n]+", " ")).alias(plain_))
        .select(*keep, F.when(plain.rlike(words), units).alias(units_), F.when(plain.rlike(words), sentences).alias(sentences_))
        .select(*keep, sentences_, F.coalesce(found, none).alias(found_))
        .select(*keep, sentences_, found_, F.when(F.size(sentences_) > 0, pairs).alias(pairs_))
        .select(*keep, sentences_, found_, pairs_, F.when(F.col(pairs_).isNotNull(), in_text).alias(rest_))
        .select(*keep, found_, pairs_, rest_, F.when(F.size(rest_) > 0, before).alias(before_))
        .select(*keep, F.concat(found_, F.coalesce(by_run, none)).alias(name))
    )


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(id_col, n_matches, licences, best, best_dice)`` for each row.

    ``n_matches`` counts (unit, template) pairs, equal units once, and templates found in runs of
    sentences alone; ``licences`` has the templates'
    names, sorted and comma-joined; ``best`` is the one with the highest coefficient, of equals the
    last by name (null without any).  Null and empty texts match nothing; repeated rows get equal
    results; an empty table gives none.  Words are ASCII letters and digits.
    """
    found = with_matches(df.select(id_col, text_col), text_col, "_m", texts, threshold).select(id_col, "_m")
    best = F.array_max(F.transform("_m", lambda m: F.struct(m["dice"].alias("dice"), m["name"].alias("name"))))
    return found.select(
        id_col, F.size("_m").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_m", lambda m: m["name"]))), ",").alias("licences"),
        best["name"].alias("best"), best["dice"].alias("best_dice"))


def sql() -> str:
    """The same over the table ``documents``, without the pruning by words and hits, in DuckDB's SQL."""
    known = templates()
    rows = ", ".join(f"('{t.name}', [{', '.join(repr(g) for g in t.grams)}], {len(t.grams)}, {t.least}, {t.most})" for t in known)
    return f"""
    WITH t(name, grams, size, least, most) AS (VALUES {rows}),
    d AS (SELECT row_number() OVER () AS r, doc_id, text, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9' || chr(10) || ']+', ' ', 'g')) AS p FROM documents),
    raw AS (SELECT r, p AS u FROM d UNION ALL SELECT r, unnest(regexp_split_to_array(p, chr(10) || ' *' || chr(10))) FROM d
            UNION ALL SELECT r, unnest(string_split(p, chr(10))) FROM d),
    u AS (SELECT DISTINCT r, trim(regexp_replace(u, '[ ' || chr(10) || ']+', ' ', 'g')) AS u FROM raw),
    w AS (SELECT row_number() OVER () AS k, r, string_split(u, ' ') AS w FROM u),
    c AS (SELECT k, r, w, name, grams, size FROM w JOIN t ON len(w) - 1 BETWEEN least AND most),
    g AS (SELECT DISTINCT k, w[i] || ' ' || w[i + 1] AS g, i FROM c, unnest(range(1, len(w))) x(i)),
    n AS (SELECT k, g || ' ' || (row_number() OVER (PARTITION BY k, g ORDER BY i) - 1) AS g FROM g),
    l AS (SELECT k, list(g) AS l FROM n GROUP BY k),
    m AS (SELECT r, name, 2.0::DOUBLE * len(list_intersect(l, grams)) / (len(w) - 1 + size) AS dice FROM c JOIN l USING (k)),
    near AS (SELECT r, name, dice FROM m WHERE dice >= {THRESHOLD}),
    tp AS (SELECT name, regexp_replace(g, ' [0-9]+$', '') AS g, count(*) AS n FROM (SELECT name, unnest(grams) AS g FROM t) GROUP BY ALL),
    cut AS (SELECT r, regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(10) || chr(10), 'g'), '\\n[^A-Za-z0-9\\n]*\\n') AS s FROM d),
    said AS (SELECT r, k, trim(lower(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))) AS u FROM (SELECT r, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM cut)),
    s AS (SELECT r, k, string_split(u, ' ') AS w, sum(len(string_split(u, ' '))) OVER (PARTITION BY r ORDER BY k) AS hi FROM said WHERE u <> ''),
    a AS (SELECT r, flatten(list(w ORDER BY k)) AS w FROM s GROUP BY r),
    ag AS (SELECT r, i, w[i] || ' ' || w[i + 1] AS g FROM a, unnest(range(1, len(w))) x(i)),
    able AS (SELECT r, name FROM (SELECT DISTINCT r, g FROM ag) JOIN tp USING (g) JOIN (SELECT name, least - size + count(*) AS differing FROM t JOIN tp USING (name) GROUP BY name, least, size) USING (name)
             GROUP BY r, name, differing HAVING count(*) >= differing),
    runs AS (SELECT f.r, name, size, f.hi - len(f.w) AS lo, e.hi AS hi FROM able JOIN t USING (name) JOIN s f ON f.r = able.r JOIN s e ON e.r = f.r AND e.k >= f.k AND e.hi - f.hi + len(f.w) - 1 BETWEEN least AND most
             WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.r = able.r AND near.name = able.name)),
    shared AS (SELECT r, name, size, lo, hi, g, count(*) AS n FROM runs JOIN ag USING (r) WHERE i > lo AND i < hi GROUP BY ALL),
    by_run AS (SELECT r, name, 2.0::DOUBLE * sum(least(shared.n, tp.n)) / (hi - lo - 1 + size) AS dice FROM shared JOIN tp USING (name, g) GROUP BY r, name, size, lo, hi),
    every AS (SELECT * FROM near UNION ALL SELECT r, name, max(dice) FROM by_run GROUP BY r, name HAVING max(dice) >= {THRESHOLD}),
    o AS (SELECT r, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max({{'dice': dice, 'name': name}}) AS best FROM every GROUP BY r)
    SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(names, '') AS licences, best.name AS best, best.dice AS best_dice FROM d LEFT JOIN o USING (r)"""
