"""License scans (operator 6) by patience alignment.

Words that occur once in the text and once in the template are anchors; the longest
increasing subsequence of their places is kept, and the gaps between kept anchors are aligned
in the same way, with equal words at both ends of a gap matched first. Coverage is the share
of the template's words matched within one stretch of text not much longer than the template.

Only a text that has at least the wanted share of a template's words is aligned with it: the
coverage can't exceed that share. The words that tell a license from its kin, such as the
version, have to stand in the matched stretch, and those of its kin mustn't; nor may a denial stand
within four words before it.

Defined results: a null or wordless text has no license; templates without words are left
out; ties go to the longer template, then to the name; a null doc_id is carried; repeated rows are
scanned each; no rows give no rows. Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

#: Notices and texts of public licenses, without names and years.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0-short": "Licensed under the GNU GPL v3.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSD-4-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
}
#: Fixed value: the notice of a program under a GNU license.
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You should have received a copy of the GNU {kind} along with this program."
KINDS = {"GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3")}
TEMPLATES |= {f"{name}-notice": GNU.format(kind=kind, version=v) for name, (kind, v) in KINDS.items()}
#: Words of a template without which a text isn't of that license, whatever the coverage: its family
#: and its version or kind. The BSD sentence is of all BSD licenses, hence its name.
DISTINCT = {"Apache-2.0": ["apache", "2.0"], "Apache-2.0-header": ["apache", "2.0"], "MIT": ["mit"], "GPL-3.0": ["gnu", "general", "public", "3"], "CC-BY-NC-4.0": ["cc", "by-nc", "4.0"], "BSD-3-Clause": ["endorse", "promote"], "BSD-4-Clause": ["endorse", "advertising"], "GPL-3.0-short": ["gnu", "gpl", "v3"]}
DISTINCT |= {name: ["subject", "conditions", "notice", "substantial"] for name in ("MIT-text", "MIT-full")}  # MIT without its condition is another license
DISTINCT |= {f"{name}-notice": ["gnu", *kind.lower().split(), v] for name, (kind, v) in KINDS.items()}
#: Words that make a stretch one of a kin: it isn't of this license then.
KIN = {name: ["lesser", "affero", "library"] for name in ("GPL-3.0", "GPL-2.0-notice", "GPL-3.0-notice")} | {"BSD-2-Clause": ["endorse", "advertising"], "BSD-3-Clause": ["advertising"], "BSD": ["advertising"]}
#: Words of a denial shortly before a notice: the text says then that it isn't of this license.
DENIALS, NEAR = {"not", "never", "isn", "aren", "nicht", "pas"}, 4
COVERAGE = 0.8
words = re.compile(r"[\w.+-]*\w", re.UNICODE).findall


def tokens(text: str | None) -> list[str]:
    return words((text or "").lower())


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    where: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            where.append(i)
        else:
            tops[k], where[k] = v, i
        back[i] = where[k - 1] if k else -1
    out, i = [], where[-1] if where else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (place in text, place in template), increasing in both."""
    out = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        mine = Counter(template[c:d])
        once = {template[k]: k for k in range(c, d) if mine[template[k]] == 1}
        seen = Counter(w for w in text[a:b] if w in once)
        anchors = [(k, once[text[k]]) for k in range(a, b) if seen.get(text[k]) == 1]
        kept = [anchors[i] for i in increasing([y for _, y in anchors])]
        if not kept:
            continue
        out += kept
        ends = [(a - 1, c - 1), *kept, (b, d)]
        gaps += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(ends, ends[1:], strict=False) if q > p + 1 and s > r + 1]
    return sorted(out)


def coverage(text: list[str], template: list[str]) -> tuple[float, int, int]:
    """(share of the template matched, first word, word after the last) in the best stretch.

    The text is cut at the template's words into stretches first: an anchor must be unique
    near its place, not in the whole of a long text.
    """
    wanted, reach = set(template), 2 * len(template)
    places = [k for k, w in enumerate(text) if w in wanted]
    best = (0.0, 0, 0)
    i = 0
    while i < len(places):
        j = i
        while j + 1 < len(places) and places[j + 1] - places[j] <= max(4, len(template) // 4):
            j += 1
        for f in range(places[i], places[j] + 1, max(1, len(template) // 2)):
            part = text[f : min(f + reach, places[j] + 1)]
            matched = align(part, template)
            share = len(matched) / len(template)
            if share > best[0]:
                best = (share, f + matched[0][0], f + matched[-1][0] + 1)
        i = j + 1
    return best


def scan_text(text: str | None, templates: dict[str, list[str]], least: float, must: dict[str, list[str]] | None = None, kin: dict[str, list[str]] | None = None) -> list[tuple[str, float, int, int]]:
    """(name, coverage, from, to) of the templates that are covered, the best first."""
    own = tokens(text)
    have = set(own)
    out = []
    for name, template in templates.items():
        if sum(w in have for w in template) >= least * len(template) and have.issuperset((must or {}).get(name, ())):
            share, s, e = coverage(own, template)
            stretch = set(own[s:e])
            if not DENIALS.isdisjoint(own[max(0, s - NEAR) : s]):
                continue
            if share >= least and stretch.issuperset((must or {}).get(name, ())) and stretch.isdisjoint((kin or {}).get(name, ())):
                out.append((name, share, s, e))
    return sorted(out, key=lambda x: (-x[1], -len(templates[x[0]]), x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE, must: dict[str, list[str]] | None = None, kin: dict[str, list[str]] | None = None) -> DataFrame:
    """must, kin: words that a template's stretch has to have and mustn't have; those of DISTINCT and KIN
    for the default templates.
    Gives doc_id, license (the best, or null), coverage, first_word, end_word, licenses."""
    ready(docs.sparkSession)
    if templates is None:
        must, kin = DISTINCT if must is None else must, KIN if kin is None else kin
    split = {k: w for k, v in (TEMPLATES if templates is None else templates).items() if (w := tokens(v))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                found = scan_text(text, split, least, must, kin)
                name, share, s, e = found[0] if found else (None, 0.0, None, None)
                rows.append((doc_id, name, share, s, e, [x[0] for x in found]))
            out = pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "first_word", "end_word", "licenses"])
            yield out.astype({"first_word": "Int64", "end_word": "Int64"})

    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, license string, coverage double, first_word long, end_word long, licenses array<string>")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))
