"""Licence scan: Dice coefficient over word bigrams against templates.

DataFrame functions only.  A unit of text (a line, or a whole document for the
long templates) is normalised to lower-case words of a-z and 0-9; its distinct
word bigrams A and a template's B give 2 |A and B| / (|A| + |B|).  As the
coefficient is at most 2 min / (|A| + |B|), a unit can only reach `threshold`
if |A| lies between |B| t / (2 - t) and |B| (2 - t) / t: other templates are
not tried, and units outside all bounds are never cut into bigrams.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8

# Public licence notices and texts.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Distributed under the terms of the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "all-rights-reserved": "Copyright. All rights reserved.",
}
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
}
# BSD-3-Clause is the text of BSD-2-Clause with one more condition before the disclaimer.
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace(
    "THIS SOFTWARE IS PROVIDED",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED",
)


def bigrams_of(text: str) -> list[str]:
    """The distinct word bigrams of a template, sorted."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Least and most distinct bigrams of a unit that can reach `threshold`."""
    least = next(a for a in range(1, n + 1) if 2 * a / (a + n) >= threshold)
    most = n
    while 2 * n / (most + 1 + n) >= threshold:
        most += 1
    return least, most


def _normalised(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def _bigrams(words: Column) -> Column:
    """Distinct bigrams of two words or more."""
    n = F.size(words) - 1
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def _best(units: Column, templates: dict[str, str], threshold: float) -> Column:
    """The best (dice, -template number) over an array of normalised units.

    Null where no unit reaches the threshold.
    """
    told = [(k, bigrams_of(t), *bounds(len(bigrams_of(t)), threshold)) for k, t in enumerate(templates.values())]
    low, high = min(t[2] for t in told), max(t[3] for t in told)
    # n words have n - 1 bigrams at most, and d distinct words d - 1 at least
    words = F.filter(F.transform(units, lambda u: F.split(u, " ")), lambda w: (F.size(w) > low) & (F.size(F.array_distinct(w)) <= high + 1))
    grams = F.filter(F.transform(words, _bigrams), lambda g: F.size(g).between(low, high))

    def dice(g: Column) -> Column:
        each = [
            F.when(F.size(g).between(lo, hi), F.struct((F.lit(2.0) * F.size(F.array_intersect(g, F.array(*map(F.lit, b)))) / (F.size(g) + F.lit(len(b)))).alias("dice"), F.lit(-k).alias("rank")))
            for k, b, lo, hi in told
        ]
        return F.array_max(F.filter(F.array(*each), lambda s: s.isNotNull() & (s["dice"] >= threshold)))

    return F.array_max(F.transform(grams, dice))


def scan_licenses(df: DataFrame, threshold: float = THRESHOLD, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """doc_id, license, dice, scope of each row of `df`.

    `scope` is "notice" if a line matches a notice, "text" if the document as a
    whole matches a licence text (which wins).  The best coefficient counts, the
    first template on ties.  No match, an empty or a null text: nulls.  Repeated
    rows, empty tables and clashing columns: see `common`.
    """
    rows = common.id_text(df, id_col, text_col)
    lines = rows.select("doc_id", F.filter(F.transform(F.split("text", "\n"), _normalised), lambda u: u != "").alias("lines"))
    found = lines.select("doc_id", _best(F.col("lines"), NOTICES, threshold).alias("notice"), _best(F.array(F.array_join("lines", " ")), TEXTS, threshold).alias("whole"))
    name = lambda of, names: F.element_at(F.array(*map(F.lit, names)), F.lit(1) - of["rank"])
    return found.select(
        "doc_id",
        F.when(F.col("whole").isNotNull(), name(F.col("whole"), TEXTS)).when(F.col("notice").isNotNull(), name(F.col("notice"), NOTICES)).alias("license"),
        F.coalesce("whole.dice", "notice.dice").alias("dice"),
        F.when(F.col("whole").isNotNull(), "text").when(F.col("notice").isNotNull(), "notice").alias("scope"),
    )


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for `scan_licenses` over documents, without any pruning."""
    text = lambda t: "'" + t.replace("'", "''") + "'"
    told = ", ".join(f"('{scope}', {k}, '{name}', {text(t)})" for scope, group in (("notice", NOTICES), ("text", TEXTS)) for k, (name, t) in enumerate(group.items()))
    clean = lambda c: f"trim(regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
        units AS (
            SELECT rid, 'notice' AS scope, {clean("line")} AS u FROM (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM d)
            UNION ALL SELECT rid, 'text', {clean("body")} FROM d
        ),
        grams AS (SELECT rid, scope, {grams} AS g FROM (SELECT rid, scope, string_split(u, ' ') AS w FROM units) WHERE len(w) > 1),
        templates AS (
            SELECT scope, rank, id, {grams} AS b FROM (
                SELECT scope, rank, id, string_split({clean("body")}, ' ') AS w FROM (VALUES {told}) AS v(scope, rank, id, body))
        ),
        scored AS (SELECT rid, scope, rank, id, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM grams JOIN templates USING (scope)),
        best AS (
            SELECT rid, scope, id, dice, row_number() OVER (PARTITION BY rid ORDER BY scope DESC, dice DESC, rank) AS k
            FROM scored WHERE dice >= {threshold}
        )
        SELECT doc_id, id AS license, dice, scope FROM d LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (rid)
    """
