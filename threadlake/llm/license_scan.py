"""Licence templates found by the Dice coefficient over word bigrams; DataFrame functions only.

A unit (a line, a whole text of several lines, or a run of lines) is normalised to lower-case words
of letters and digits.  With A and B the sets of distinct bigrams of a unit and a template, the
coefficient 2 |A & B| / (|A| + |B|) can reach the threshold t only if |A| lies between
t / (2 - t) |B| and (2 - t) / t |B|; these size bounds prune the templates of a unit
before any intersection.  Before bigrams are built, two bounds that follow from them prune
units by their words: d distinct words have d - 1 distinct bigrams at least, and, as at least
t / (2 - t) of a matching unit's bigrams are the template's and each other bigram holds
two words, only so many distinct words can be foreign to all templates.  Runs begin and
end at lines of whose bigrams (with those over the side that lies within the run) at least t / 2 are some template's: a run at
the threshold only comes closer without other lines at its ends.  They have no more words than the largest template allows.
Templates are constants of the plan, so nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import table

THRESHOLD = 0.8

#: Paragraphs that several licence texts have.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_GPL_GRANT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>."


def _gpl(name: str, version: int) -> tuple[str, ...]:
    grant = _GPL_GRANT.format(name, version)
    return f"This work is licensed under the GNU {name}, version {version}.", grant, f"{grant} {_GPL_WARRANTY.format(name, name)}"


#: Public licence notices and texts by SPDX name: what pages say, the notice of a file, and the whole text where it is short.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        _MIT_GRANT,
        f"{_MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": _gpl("General Public License", 3),
    "GPL-2.0": _gpl("General Public License", 2),
    "LGPL-3.0": _gpl("Lesser General Public License", 3),
    "AGPL-3.0": _gpl("Affero General Public License", 3),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", _BSD_GRANT, f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THREE} {_BSD_WARRANTY}"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_WARRANTY}"),
    "ISC": (
        _ISC_GRANT,
        f"{_ISC_GRANT} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}


def _bigrams(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _table(templates) -> list[tuple[str, int, list[str]]]:
    """(licence, template number, bigrams)"""
    return [(name, i, _bigrams(t)) for name, texts in sorted(templates.items()) for i, t in enumerate(texts)]


def _bounds(n: int, threshold: float) -> tuple[float, float]:
    return threshold / (2 - threshold) * n - 1e-9, (2 - threshold) / threshold * n + 1e-9


def _words(text: Column) -> Column:
    # only ASCII letters and digits are words' characters, as in the templates
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9]+"), "")


def _all_pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def _pairs(words: Column) -> Column:
    return F.array_distinct(_all_pairs(words))


def _likely(words: Column, known: list[str], share: float) -> Column:
    """Whether a line has words enough of the templates to be a mark; without bigrams."""
    return F.size(F.filter(words, lambda w: w.isin(known))) + 1 >= share * (F.size(words) + 1) - 1e-9


def _marks(lines: Column, known: list[str], grams: list[str], share: float) -> Column:
    """Places of the lines that a run can begin or end with: at least ``share`` of their bigrams, with those over the side that lies within the run, are some template's."""
    edge = lambda x, i: F.coalesce(F.slice(x, i, 1), F.array().cast("array<string>"))
    enough = lambda pairs: (F.size(pairs) > 0) & (F.size(F.filter(pairs, lambda g: g.isin(grams))) >= share * F.size(pairs) - 1e-9)

    def marked(i):
        words = F.concat(edge(F.get(lines, i - 1)["words"], -1), F.get(lines, i)["words"], edge(F.get(lines, i + 1)["words"], 1))
        begins = lambda pairs: F.slice(pairs, 1 + (i > 0).cast("int"), F.size(pairs))
        ends = lambda pairs: F.slice(pairs, 1, F.size(pairs) - (i < F.size(lines) - 1).cast("int"))
        return _likely(F.get(lines, i)["words"], known, share) & F.exists(F.transform(F.array(words), _all_pairs), lambda pairs: enough(begins(pairs)) | enough(ends(pairs)))

    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), marked)


def _found_runs(lines: Column, marks: Column, most: int, match) -> Column:
    """For each mark, what match finds in the runs of lines from it to a mark, itself included, with at most so many words; no two runs are held at once.

    Each line has a word, so a run has at most ``most`` lines, and work grows with the marks, not with their square.
    """

    def ends(p):
        sizes = F.transform(F.slice(lines, p + 1, most), lambda x: F.size(x["words"]))
        return F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("words")), lambda a, n: F.struct((a["n"] + (a["words"] + n <= most).cast("int")).alias("n"), (a["words"] + n).alias("words")))["n"]

    def run(p, q):
        grams = _pairs(F.flatten(F.transform(F.slice(lines, p + 1, q - p + 1), lambda x: x["words"])))
        return F.flatten(F.transform(F.array(F.struct(p.alias("first"), q.alias("last"), grams.alias("grams"))), match))

    def runs(p, i):
        last = F.flatten(F.transform(F.array(p + ends(p) - 1), lambda z: F.filter(F.slice(marks, i + 1, most), lambda q: q <= z)))
        return F.flatten(F.transform(last, lambda q: run(p, q)))

    return F.transform(marks, runs)


def _best(lines: Column, found: Column) -> Column:
    """The found runs of several lines that are not the whole text, hold no found line, and overlap no better run of the same template.

    ``found`` has the runs of each mark, in order.  As no run has more lines than the longest one found, those that overlap one
    begin at most so many marks before or after its own.
    """

    def better(o, m):
        dice = lambda x: 2 * x["shared"] / (x["unit_bigrams"] + x["size"])
        rank = lambda x: F.struct(-dice(x), x["last"] - x["first"], x["first"])
        same = (o["license"] == m["license"]) & (o["template_no"] == m["template_no"]) & (o["first"] <= m["last"]) & (m["first"] <= o["last"])
        return same & ((o["first"] == o["last"]) | (rank(o) < rank(m)))

    several = lambda m: (m["first"] < m["last"]) & ((m["first"] > 0) | (m["last"] < F.size(lines) - 1))
    longest = F.aggregate(found, F.lit(1), lambda a, of_mark: F.greatest(a, F.coalesce(F.array_max(F.transform(of_mark, lambda m: m["last"] - m["first"] + 1)), F.lit(1))))

    def unbeaten(of_mark, i, reach):
        near = F.flatten(F.slice(found, F.greatest(i - reach + 1, F.lit(0)) + 1, 2 * reach))
        kept = lambda n: F.filter(of_mark, lambda m: several(m) & ~F.exists(n, lambda o: better(o, m)))
        # the neighbours are put together once for a mark
        return F.when(F.exists(of_mark, several), F.flatten(F.transform(F.array(near), kept))).otherwise(F.slice(of_mark, 1, 0))

    return F.flatten(F.flatten(F.transform(F.array(longest), lambda reach: F.transform(found, lambda of_mark, i: unbeaten(of_mark, i, reach)))))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit and template at or over the threshold: doc_id, line_no, license, template_no, shared, unit_bigrams, dice.

    line_no counts from 0; -1 is the whole text, a unit of its own if it has more than
    one line.  A notice wrapped over several lines of a longer text is found as a run of
    lines, empty ones left out, with the number of its first line: the best one of those that
    overlap, unless a line of it reaches the threshold itself.  Lines are not divided: a notice
    within a line of other prose is found only if that line reaches the threshold.  Null, empty and one-word units match nothing.  All templates that reach
    the threshold are reported, ties included; rows that repeat an id are scanned each.
    An empty table gives an empty result.
    """
    rows = _table(templates)
    lowest = min(_bounds(len(b), threshold)[0] for *_, b in rows)
    highest = max(_bounds(len(b), threshold)[1] for *_, b in rows)
    known = sorted({w for *_, b in rows for pair in b for w in pair.split()})
    foreign = 2 * (2 - 2 * threshold) / (2 - threshold)
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), _words)
    whole = F.when(F.size("lines") > 1, F.array(F.struct(F.lit(-1).alias("line_no"), F.flatten("lines").alias("words")))).otherwise(F.array().cast("array<struct<line_no:int,words:array<string>>>"))
    units = F.concat(F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("words"))), whole)
    # n distinct bigrams take n + 1 words
    long_enough = F.filter(units, lambda u: F.size(u["words"]) > int(lowest))
    unit = lambda line_no, words, lines: F.struct(line_no.cast("int").alias("line_no"), words.alias("words"), lines.alias("lines"))
    nothing = F.array().cast("array<struct<line_no:int,words:array<string>>>")
    filled = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("words"))), lambda x: F.size(x["words"]) > 0)
    share = threshold / 2
    wrapped = F.when((F.size("lines") > 1) & F.exists("lines", lambda x: (F.size(x) > 0) & _likely(x, known, share)), F.array(unit(F.lit(-2), F.array().cast("array<string>"), filled)))
    wrapped = F.coalesce(wrapped, F.array().cast("array<struct<line_no:int,words:array<string>,lines:array<struct<line_no:int,words:array<string>>>>>"))
    units = F.concat(F.transform(long_enough, lambda u: unit(u["line_no"], u["words"], nothing)), wrapped)
    sized = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines")).select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.line_no", "u.words", "u.lines")
    several = F.size("lines") > 1
    small = (F.size(F.array_distinct("words")) - 1 <= int(highest) + 1) & (F.size(F.filter(F.array_distinct("words"), lambda w: ~w.isin(known))) <= foreign * (F.size("words") - 1) + 1e-9)
    sized = sized.where(F.when(F.col("line_no") == -2, several).otherwise(small))
    all_grams = sorted({g for *_, b in rows for g in b})
    marks = F.when(F.col("line_no") == -2, _marks(F.col("lines"), known, all_grams, share))
    sized = sized.select("doc_id", "line_no", "lines", F.explode(F.array(F.struct(_pairs(F.col("words")).alias("grams"), marks.alias("marks")))).alias("u")).select("doc_id", "line_no", "lines", "u.grams", "u.marks")
    sized = sized.where(F.when(F.col("line_no") == -2, F.size("marks") > 1).otherwise(F.size("grams").between(int(lowest), int(highest) + 1)))

    def match(unit):
        n, fits = F.size(unit["grams"]), []
        for name, i, grams in rows:
            low, high = _bounds(len(grams), threshold)
            shared = F.size(F.array_intersect(unit["grams"], F.lit(grams)))
            made = F.struct(unit["first"].alias("first"), unit["last"].alias("last"), n.cast("long").alias("unit_bigrams"), F.lit(name).alias("license"), F.lit(i).alias("template_no"), shared.cast("long").alias("shared"), F.lit(len(grams)).alias("size"))
            fits.append(F.when(n.between(int(low) + (low > int(low)), int(high)), made))
        return F.filter(F.array(*fits), lambda m: m.isNotNull() & (m["shared"] > 0) & (2 * m["shared"] / (m["unit_bigrams"] + m["size"]) >= threshold))

    one = F.transform(F.array(F.struct(F.col("line_no").alias("first"), F.col("line_no").alias("last"), F.col("grams").alias("grams"))), match)
    runs = F.when(F.col("line_no") == -2, _found_runs(F.col("lines"), F.col("marks"), int(highest) + 2, match)).otherwise(one)
    sized = sized.select("doc_id", "line_no", "lines", F.explode(F.array(runs)).alias("found"))
    best = F.when(F.col("line_no") == -2, _best(F.col("lines"), F.col("found"))).otherwise(F.flatten("found"))
    found = sized.select("doc_id", "line_no", "lines", F.explode(best).alias("m"))
    found = found.select("doc_id", F.when(F.col("line_no") == -2, F.get("lines", F.col("m.first"))["line_no"]).otherwise(F.col("line_no")).alias("line_no"), "m", F.col("m.unit_bigrams").alias("unit_bigrams"))
    dice = 2 * F.col("m.shared") / (F.col("unit_bigrams") + F.col("m.size"))
    return found.select("doc_id", "line_no", "m.license", "m.template_no", "m.shared", "unit_bigrams", dice.alias("dice")).where(F.col("dice") >= threshold)


def op10_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = _table(TEMPLATES)
    values = ", ".join(f"('{n}', {i}, [{', '.join(repr(g) for g in grams)}])" for n, i, grams in rows)
    most = int(max(_bounds(len(b), THRESHOLD)[1] for *_, b in rows)) + 2
    grams = "list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
    match = "len(g.grams) <= 2 * len(t.grams) AND 2 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) >= " + str(THRESHOLD)
    found = "license, template_no, len(list_intersect(g.grams, t.grams)) AS shared, len(g.grams) AS unit_bigrams, 2 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice"
    return f"""
WITH t(license, template_no, grams) AS (VALUES {values}),
k AS (SELECT DISTINCT unnest(grams) AS gram FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (
  SELECT r, doc_id, unnest(generate_series(0, len(lines) - 1))::INTEGER AS line_no, unnest(lines) AS unit FROM d
  UNION ALL SELECT r, doc_id, -1, text FROM d WHERE len(lines) > 1),
w AS (SELECT r, doc_id, line_no, regexp_extract_all(lower(unit), '[a-z0-9]+') AS words FROM u),
g AS (SELECT doc_id, line_no, {grams} AS grams FROM w WHERE len(words) > 1),
m AS (SELECT doc_id, line_no, {found} FROM g, t WHERE {match}),
-- runs of lines with words, of one or more; i counts them
f AS (
  SELECT r, doc_id, line_no, words, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY r) AS n, sum(len(words)) OVER o AS upto, lag(words[-1]) OVER o AS before, lead(words[1]) OVER o AS after
  FROM w WHERE line_no >= 0 AND len(words) > 0 WINDOW o AS (PARTITION BY r ORDER BY line_no)),
v AS (
  SELECT r, i, 'ends' AS side, list_filter(list_concat([before], words), lambda x: x IS NOT NULL) AS around FROM f
  UNION ALL SELECT r, i, 'begins', list_filter(list_concat(words, [after]), lambda x: x IS NOT NULL) FROM f),
b AS (SELECT r, i, side, unnest(list_transform(range(1, len(around)), lambda j: around[j] || ' ' || around[j + 1])) AS gram FROM v),
k2 AS (SELECT DISTINCT r, i FROM (SELECT r, i FROM b LEFT JOIN k ON b.gram = k.gram GROUP BY r, i, side HAVING count(k.gram) >= {THRESHOLD / 2} * count(*))),
e AS (SELECT f.* FROM f JOIN k2 USING (r, i)),
p AS (SELECT x.r, x.doc_id, x.line_no, x.n, x.i AS low, y.i AS high FROM e x JOIN e y ON x.r = y.r AND x.i <= y.i AND y.upto - x.upto + len(x.words) <= {most}),
q AS (SELECT p.r, p.doc_id, p.line_no, p.n, low, high, flatten(list(words ORDER BY i)) AS words FROM p JOIN f ON f.r = p.r AND f.i BETWEEN low AND high GROUP BY ALL),
qg AS (SELECT r, doc_id, line_no, n, low, high, {grams} AS grams FROM q WHERE len(words) > 1),
c AS (SELECT r, doc_id, line_no, n, low, high, {found} FROM qg g, t WHERE {match})
SELECT doc_id, line_no, license, template_no, shared, unit_bigrams, dice FROM m
UNION ALL
SELECT doc_id, line_no, license, template_no, shared, unit_bigrams, dice FROM c
WHERE low < high AND (low > 0 OR high < n - 1) AND NOT EXISTS (
  SELECT 1 FROM c o WHERE o.r = c.r AND o.license = c.license AND o.template_no = c.template_no AND o.low <= c.high AND c.low <= o.high
    AND (o.low = o.high OR (-o.dice, o.high - o.low, o.low) < (-c.dice, c.high - c.low, c.low)))
"""


OP10_SQL = _sql()
