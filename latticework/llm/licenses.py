"""Operator 5 (native): licence notices and texts, by Dice coefficient over word bigrams.

Texts and templates are normalised alike: lower-cased runs of letters and digits. A template of m bigrams, b of them
different, is held against windows of m bigrams of the text (against all of a text that has fewer), whatever line breaks,
marks or other sentences stand in or around it: 2 c / (a + b) of THRESHOLD or more is a match, where the window has a
different bigrams and c of them are the template's. Windows begin at a bigram of the template, or are the text's last.
The best window of each template is told, of equals the first.

As c is at most a, a match has b t / (2 - t) of the template's bigrams or more. So a template is pruned by size if the
text, or the bigrams in it that any template has, are fewer; of the others, only windows with that many hits are compared.

Templates are a stated table, taken BLOCK_BIGRAMS bigrams at a time, and go into the plan as a literal: a scan does all
the work, with no shuffle and no Python.

Defined cases: a null or blank text, or one of one word, has no match; a text that matches several templates names each;
templates of fewer than two words are refused; repeated rows are each returned; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import math
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, sql_string

THRESHOLD, BLOCK_BIGRAMS = 0.8, 50_000
_TEMPLATE = "array<struct<name:string,m:int,least:int,hashes:array<bigint>>>"
_FOUND = "array<struct<place:bigint,template:string,dice:double>>"
_MIT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
#: Notices, file headers and licence texts as their licences or their licensors word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT short": "Licensed under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL": "This library is licensed under the GNU Lesser General Public License.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Reserved": "All rights reserved.",
    "Apache-2.0 file header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT text": f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: {_MIT} {_AS_IS}",
    "BSD-2-Clause text": _BSD + _BSD_END,
    "BSD-3-Clause text": _BSD + _BSD_NAMES + _BSD_END,
    "ISC text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "GPL-3.0 file header": _GNU.format(""),
    "LGPL-3.0 file header": _GNU.format("Lesser "),
    "AGPL-3.0 file header": _GNU.format("Affero "),
    "MPL-2.0 file header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def normal(text: str) -> list[str]:
    """The words of a template: lower-cased runs of letters and digits, as the texts' are."""
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split()


def _hash(first: str, second: str) -> int:
    """What xxhash64(first, second) gives."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(second.encode(), xxh64_intdigest(first.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def _least(b: int, threshold: float) -> int:
    """Template bigrams that a match has at least."""
    return math.ceil(b * threshold / (2 - threshold) - 1e-9)


def _blocks(templates: dict[str, str], threshold: float) -> list[list[dict]]:
    """The templates' bigrams, in blocks of BLOCK_BIGRAMS or of one template."""
    blocks: list[list[dict]] = [[]]
    size = 0
    for name in sorted(templates):
        ws = normal(templates[name])
        hashes = sorted({_hash(a, b) for a, b in zip(ws, ws[1:], strict=False)})
        if not hashes:
            raise ValueError(f"template {name!r} has fewer than two words")
        if size and size + len(hashes) > BLOCK_BIGRAMS:
            blocks.append([])
            size = 0
        size += len(hashes)
        blocks[-1].append({"name": name, "m": len(ws) - 1, "least": _least(len(hashes), threshold), "hashes": hashes})
    return blocks


def _with_matches(df: DataFrame, block: list[dict], threshold: float, out: str) -> DataFrame:
    """Adds the matches of some templates to rows with hs, the text's bigrams in order."""
    known = ", ".join(f"{h}L" if h != -(2**63) else "-9223372036854775807L - 1" for h in sorted({h for t in block for h in t["hashes"]}))
    hits = F.expr(f"filter(sequence(0, size(hs) - 1), i -> hs[i] IN ({known}))")
    table = F.from_json(F.lit(json.dumps(block)), _TEMPLATE)
    fewest = min(t["least"] for t in block)
    df = df.withColumn("hits", F.when(F.size("hs") >= fewest, hits)).withColumn("hits", F.when(F.size("hits") >= fewest, F.col("hits")))
    n = F.size("hs")

    def best(t: Column) -> Column:
        last = F.greatest(F.lit(0), n - t["m"])

        def starts(places: Column) -> Column:
            within = F.filter(places, lambda p, i: F.coalesce(F.get(places, i + t["least"] - 1) < p + t["m"], F.lit(False)))
            ending = F.when(F.coalesce(F.get(places, F.size(places) - t["least"]) >= last, F.lit(False)), F.array(last)).otherwise(F.array().cast("array<int>"))
            return F.array_distinct(F.concat(F.transform(within, lambda p: F.least(p, last)), ending))

        def scored(at: Column) -> Column:
            # the window is bound by a one-entry array, as each use of an expression in a lambda's body computes it again
            own = F.array(F.array_distinct(F.slice("hs", at + 1, t["m"])))
            dice = F.transform(own, lambda w: 2 * F.size(F.array_intersect(w, t["hashes"])) / (F.size(w) + F.size(t["hashes"])))
            return F.struct(F.get(dice, F.lit(0)).alias("dice"), (-at).alias("back"))

        places = F.filter("hits", lambda i: F.array_contains(t["hashes"], F.get("hs", i)))
        return F.array_max(F.flatten(F.transform(F.array(places), lambda own: F.transform(starts(own), scored))))

    worth = F.filter(table, lambda t: F.size("hits") >= t["least"])
    found = F.transform(worth, lambda t: F.struct(t["name"].alias("name"), best(t).alias("best")))
    good = F.filter(found, lambda x: x["best"]["dice"] >= threshold)
    told = F.transform(good, lambda x: F.struct((-x["best"]["back"]).cast("long").alias("place"), x["name"].alias("template"), x["best"]["dice"].alias("dice")))
    return df.withColumn(out, F.coalesce(F.when(F.col("hits").isNotNull(), told), F.array().cast(_FOUND))).drop("hits")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and `found`: an array of (place, template, dice), by place and template. Places are words, from 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    rows = rows.select("doc_id", F.array_remove(F.split("text", r"[^\p{L}\p{N}]+"), "").alias("ws"))
    m = F.size("ws") - 1
    pairs = F.zip_with(F.slice("ws", 1, m), F.slice("ws", 2, m), lambda a, b: F.xxhash64(a, b))
    rows = rows.select("doc_id", F.when(m > 0, pairs).otherwise(F.array().cast("array<bigint>")).alias("hs"))
    blocks = _blocks(templates or TEMPLATES, threshold)
    for k, block in enumerate(blocks):
        rows = _with_matches(rows, block, threshold, f"found{k}")
    return rows.select("doc_id", F.array_sort(F.concat(*(f"found{k}" for k in range(len(blocks))))).alias("found"))


def op5_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_matches, licenses (place:template, comma-joined) and best_dice, the greatest coefficient (to 9 digits)."""
    found = scan(documents(spark, sf_dir))
    told = F.array_join(F.transform("found", lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x["template"])), ",")
    best = F.round(F.array_max(F.transform("found", lambda x: x["dice"])), 9)
    return found.select("doc_id", F.size("found").cast("long").alias("n_matches"), told.alias("licenses"), best.alias("best_dice"))


def _template_rows() -> str:
    def one(name: str, ws: list[str]) -> str:
        pairs = sorted({f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)})
        return f"SELECT {sql_string([name])} AS template, {len(ws) - 1} AS m, {len(pairs)} AS b, {_least(len(pairs), THRESHOLD)} AS least, unnest([{sql_string(pairs)}]) AS pair"

    return " UNION ALL ".join(one(name, normal(t)) for name, t in TEMPLATES.items())


OP5_SQL = f"""
WITH t AS ({_template_rows()}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, len(ws) - 1 AS n, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS pairs FROM d WHERE len(ws) > 1),
e AS (SELECT doc_id, n, unnest(pairs) AS pair, unnest(range(0, n)) AS i FROM g),
h AS MATERIALIZED (SELECT doc_id, template, n, m, b, least, i, greatest(0, n - m) AS last FROM e JOIN t USING (pair)),
s AS (SELECT DISTINCT doc_id, template, m, b, least, unnest([least(i, last), last]) AS begins FROM h),
w AS (SELECT s.doc_id, s.template, s.m, s.b, begins FROM s JOIN h ON h.doc_id = s.doc_id AND h.template = s.template AND i >= begins AND i < begins + s.m GROUP BY ALL HAVING count(*) >= any_value(s.least)),
c AS (SELECT w.doc_id, template, begins, list_distinct(pairs[begins + 1:begins + m]) AS own, b FROM w JOIN g ON g.doc_id = w.doc_id),
x AS (SELECT c.doc_id, c.template, begins, 2 * len(list_intersect(own, any_value(tb))) / (len(own) + any_value(b)) AS dice FROM c JOIN (SELECT template, list(pair) AS tb FROM t GROUP BY 1) k ON k.template = c.template GROUP BY c.doc_id, c.template, begins, own),
m AS (SELECT doc_id, template, max(dice) AS dice, arg_min(begins, struct_pack(x := -dice, y := begins)) AS begins FROM x GROUP BY 1, 2 HAVING max(dice) >= {THRESHOLD})
SELECT d.doc_id, count(template) AS n_matches, coalesce(string_agg(begins || ':' || template, ',' ORDER BY begins, template), '') AS licenses, round(max(dice), 9) AS best_dice
FROM d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""
