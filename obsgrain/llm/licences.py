"""License scans: normalised text compared to licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
LEAST = 0.8

# Public licence notices and texts, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "GPL-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    ),
    (
        "LGPL-2.1",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    ),
    (
        "LGPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "AGPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSL-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
]
#: Templates that scan() takes at most; their bigrams travel in the plan.
MOST_TEMPLATES = 1000


def normal_words(text: str) -> list[str]:
    """The driver's form of words(): lower case, runs of ASCII letters and digits and of other letters; a dot stays between digits."""
    return re.sub(r"[^a-z0-9À-ɏ]+", " ", re.sub(r"([0-9])\.(?=[0-9])", r"\1", text.lower())).split()


def words(low: Column) -> Column:
    """Normalised words of a text in lower case: whatever is no letter or digit separates; a dot between digits vanishes ('2.0' is '20')."""
    said = F.regexp_replace(low, "([0-9])\\.(?=[0-9])", "$1")
    return F.filter(F.split(said, "[^a-z0-9À-ɏ]+"), lambda w: w != "")


def bigrams(of: Column) -> Column:
    """The different word bigrams; a single word stands for itself."""
    return F.when(F.size(of) < 2, of).otherwise(F.array_distinct(F.zip_with(F.slice(of, 1, F.greatest(F.size(of) - 1, F.lit(1))), F.slice(of, 2, F.greatest(F.size(of) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))))


@lru_cache(maxsize=4)
def _sets(templates: tuple[tuple[str, str], ...]) -> list[tuple[int, str, list[str]]]:
    out = []
    for k, (name, text) in enumerate(templates):
        w = normal_words(text)
        out.append((k, name, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} or set(w))))
    return out


def bounds(least: float, n: int) -> tuple[float, float]:
    """Bigrams that a passage must have for a Dice coefficient of `least` with a template of n."""
    return n * least / (2 - least) - 1e-9, n * (2 - least) / least + 1e-9


def _anchors(text: str, least: float) -> list[str]:
    """Words of a template such that a text without any of them has too few of its bigrams for a match; none if a text may have no such word.

    Longest words first, since these are rare. Only words of ASCII letters, which stand in a text in lower case as they are.
    """
    w = normal_words(text)
    left = {(a, b) for a, b in zip(w, w[1:], strict=False)} or {(x,) for x in w}
    need, out = bounds(least, len(left))[0], []
    for x in sorted({x for x in w if x.isascii() and x.isalpha()}, key=lambda x: (-len(x), x)):
        if len(left) < need:
            break
        out.append(x)
        left = {g for g in left if x not in g}
    return out if len(left) < need else []


def anchor_pattern(templates: tuple[tuple[str, str], ...], least: float) -> str | None:
    """A pattern that any passage matches which any template may match, or None if a template has no anchors.

    Alternatives are gathered by their first letters, so that most places of a text are passed by one test.
    """
    found = [_anchors(t, least) for _, t in templates]
    if not all(found):
        return None
    every = sorted({x for xs in found for x in xs}, key=lambda x: (len(x), x))
    some = [x for k, x in enumerate(every) if not any(o in x for o in every[:k])]
    by: dict[str, list[str]] = {}
    for x in sorted(some):
        by.setdefault(x[:1], []).append(x[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" if len(rest) > 1 else c + rest[0] for c, rest in by.items())


def _window(g: Column, k: int, name: str, template: list[str], length: int, least: float) -> Column:
    """The best window of a template in the bigrams of a text, as an array of one hit or none.

    A window has as many bigrams as the template's text. Only windows with enough positions of its bigrams are compared.
    """
    n, t, need = len(template), F.lit(template), max(1, math.ceil(bounds(least, len(template))[0]))
    at = F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(t, x), i)), lambda i: i.isNotNull())
    # `need` positions in a row that fit into one window, and the starts of the windows that hold them
    dense = lambda p: F.transform(F.slice(p, 1, F.greatest(F.size(p) - (need - 1), F.lit(0))), lambda first, j: F.struct(first.alias("first"), F.get(p, j + (need - 1)).alias("last")))
    near = F.filter(dense(at), lambda d: d["last"] - d["first"] < length)
    low = lambda d: F.greatest(d["last"] - (length - 1), F.lit(0))
    high = lambda d: F.least(d["first"], F.size(g) - length)
    starts = F.array_distinct(F.flatten(F.transform(near, lambda d: F.when(low(d) <= high(d), F.sequence(low(d), high(d))).otherwise(F.array().cast("array<int>")))))
    dice = F.transform(starts, lambda i: F.transform(F.array(F.slice(g, i + 1, length)), lambda b: F.lit(-2.0) * F.size(F.array_intersect(b, t)) / (F.size(F.array_distinct(b)) + n))[0])
    return F.transform(F.filter(F.array(F.array_min(dice)), lambda x: x <= -least), lambda x: F.struct(x.alias("less"), F.lit(k).alias("k"), F.lit(name).alias("name")))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """Licences of every whole text; one row per row of docs.

    Columns: doc_id, licence (the best match's, null if none), dice (its coefficient, 0 if none), n_matches (pairs of passage
    and template), licences (all matched names, sorted, comma-joined). Passages are the whole text, its paragraphs (between
    empty lines) and its lines. For a licence that none of them matches, every window of a template's length in the words of the
    text is a passage too, whatever lines or paragraphs it covers; a template's best window counts as one match. Ties go
    to the earlier template. A null or empty text has no match; a null doc_id stays null;
    repeated rows give repeated rows; a table without rows gives none; columns other than doc_id and text are not read.

    Texts, paragraphs and lines without any anchor word of a template cannot match one and are dropped by one pattern before
    words are made. Size bounds on the number of words drop, for each template, passages that cannot reach `least` before any
    bigram is built; what is left is compared within its row. Windows are built only in texts with enough of a template's
    bigrams. A very long text takes time in proportion. No shuffle; the templates, a fixed list, travel in the plan.
    """
    listed = tuple(templates or TEMPLATES)
    if len(listed) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    sets = _sets(listed)
    anchors = anchor_pattern(listed, least)
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    rows = rows.select("doc_id", F.when(F.rlike("low", F.lit(anchors)), F.col("low")).otherwise("").alias("low")) if anchors else rows
    # lines of a passage never match what the passage does not, so they are cut from texts that do; the whole text comes first
    few = lambda parts: F.filter(parts, lambda p: F.rlike(p, F.lit(anchors))) if anchors else parts
    cuts = F.array_distinct(F.concat(F.array("low"), few(F.split("low", "\n[ \t\r]*\n")), few(F.split("low", "\n"))))
    rows = rows.select("doc_id", F.when(F.col("low") == "", F.array(F.lit(""))).otherwise(cuts).alias("cuts"))
    # the number of words bounds that of bigrams from above, and no bigram is shorter than three letters
    fewest = min(bounds(least, len(s))[0] for _, _, s in sets)
    most = max(bounds(least, len(s))[1] for _, _, s in sets)
    # used twice: kept in a column, so that words are made once; the whole text comes first
    rows = rows.select("doc_id", F.transform("cuts", lambda p: words(p)).alias("said"))
    # so many different words make at least as many different bigrams, less one
    said = F.filter("said", lambda w: (F.size(w) >= max(1, fewest)) & (F.size(F.array_distinct(w)) <= most + 1))
    rows = rows.select("doc_id", F.transform(said, lambda w: bigrams(w)).alias("passages"), _sequence(F.get("said", F.lit(0)), listed).alias("g"))
    # passages with more different bigrams than any template allows, or fewer, are gone
    rows = rows.select("doc_id", F.filter("passages", lambda b: (F.size(b) >= fewest) & (F.size(b) <= most)).alias("passages"), "g", F.array_intersect("g", F.lit(sorted({x for _, _, t in sets for x in t}))).alias("had"))

    def against(k: int, name: str, template: list[str]) -> Column:
        low, high = bounds(least, len(template))
        dice = lambda b: F.struct((F.lit(-2.0) * F.size(F.array_intersect(b, F.lit(template))) / (F.size(b) + len(template))).alias("less"), F.lit(k).alias("k"), F.lit(name).alias("name"))
        return F.transform(F.filter("passages", lambda b: F.size(b).between(low, high)), dice)

    found = [against(*s) for s in sets]
    hits = F.filter(F.concat(*found), lambda x: x["less"] <= -least)
    rows = rows.select("doc_id", hits.alias("hits"), "g", "had")
    none = F.array().cast("array<struct<less:double,k:int,name:string>>")
    more = []
    for (k, name, template), (_, said_by) in zip(sets, listed, strict=True):
        enough = F.size(F.array_intersect("had", F.lit(template))) >= bounds(least, len(template))[0]
        length = max(len(normal_words(said_by)) - 1, 1)
        more.append(F.when((F.size("had") > 0) & enough & ~F.exists("hits", lambda x: x["name"] == name), _window(F.col("g"), k, name, template, length, least)).otherwise(none))
    rows = rows.select("doc_id", F.concat("hits", *more).alias("hits"))
    best = F.array_min("hits")
    return rows.select(
        "doc_id", best["name"].alias("licence"), F.round(F.coalesce(-best["less"], F.lit(0.0)), 6).alias("dice"), F.size("hits").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["name"]))), ",").alias("licences"),
    )


def _sequence(w: Column, templates: tuple[tuple[str, str], ...]) -> Column:
    """All bigrams of a text's words in order; words too if a template is a single word."""
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(pairs(w), w) if any(len(normal_words(t)) == 1 for _, t in templates) else pairs(w)


def read_templates(table: DataFrame, most: int = MOST_TEMPLATES) -> list[tuple[str, str]]:
    """Templates from a table (name, text), by name and text; raises if there are more than `most`. Nulls are left out."""
    rows = table.where("name is not null and text is not null").select("name", "text").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    return sorted((r["name"], r["text"]) for r in rows)


def templates_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """k, name and bigrams of each template."""
    return spark.createDataFrame(_sets(tuple(templates or TEMPLATES)), "k int, name string, bigrams array<string>")


def oracle(templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> str:
    """The same in SQL, templates as a list of values."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quote(name)}, [{', '.join(map(quote, s))}])" for k, name, s in _sets(tuple(templates or TEMPLATES)))
    return rf"""
WITH t(k, name, b) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT r, unnest(list_distinct(list_concat([lower(text)], string_split_regex(lower(text), '\n[ \t\r]*\n'), string_split(lower(text), chr(10))))) AS p FROM d),
w AS (
  SELECT r, p, list_filter(string_split_regex(regexp_replace(regexp_replace(p, '([0-9])\.([0-9])', '\1\2', 'g'), '([0-9])\.([0-9])', '\1\2', 'g'), '[^a-z0-9À-ɏ]+'), lambda x: x <> '') AS w FROM c),
g AS (SELECT r, p, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w WHERE len(w) > 0),
h AS (
  SELECT r, k, name, 2.0 * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM g JOIN t
  ON len(g) BETWEEN len(b) * {least} / (2 - {least}) - 1e-9 AND len(b) * (2 - {least}) / {least} + 1e-9),
m AS (SELECT * FROM h WHERE dice >= {least}),
b AS (SELECT r, first(name ORDER BY dice DESC, k) AS licence, max(dice) AS dice, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM m GROUP BY r)
SELECT doc_id, licence, round(coalesce(dice, 0), 6) AS dice, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licences, '') AS licences FROM d LEFT JOIN b USING (r)
"""
