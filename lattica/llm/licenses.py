"""Licence scan: sparse TF-IDF cosine to licence templates, then inheritance from the nearest directory.

Every line of a text, the text as a whole, and for each template every run of as many words as it has, across lines
and sentences, is a vector of its words. Weights of words come from their document frequency over all texts. A task
compares its texts' spans with the templates. Only texts with an anchor are compared: a template's anchors are its heaviest words, as many
as it takes that no span without them can reach the threshold. A file without a licence takes the one of the nearest directory
above it that holds a licence file: a file that is as a whole a licence's text or header of ``LONG`` words or more, that
begins with a licence's title, or whose name says so. A file that only mentions a licence is none.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, settled, table

THRESHOLD = 0.75
#: Words that a template has at least for a text alike to be a licence file.
LONG = 20
#: Statements by which texts name their licence, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"],
    "MIT": ["Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or (at your option) any later version"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Licensed under CC0 1.0 Universal", "This work is dedicated to the public domain under CC0 1.0"],
    "ISC": ["Licensed under the ISC License"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "LicenseRef-proprietary": ["All rights reserved"],
}
#: The usual sentences that name a licence, and the names that stand in them.
_STATEMENTS = (
    "Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}", "Published under {}", "Licensed under the terms of {}", "Released under the terms of {}",
    "Distributed under the terms of {}", "This work is licensed under {}", "This work is released under {}", "This project is licensed under {}",
)
_NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 License"],
    "MIT": ["the MIT License"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GPL version 3", "the GPLv3"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GPL version 2", "the GPLv2"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the LGPLv3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the AGPLv3"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the MPL 2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "ISC": ["the ISC License"],
    "Unlicense": ["the Unlicense"],
}
for _id, _names in _NAMES.items():
    TEMPLATES[_id] += [x for n in _names for x in (form.format(n) for form in _STATEMENTS) if x not in TEMPLATES[_id]]
#: Headers and whole texts of licences; names and years of holders vary.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"
_GNU = "{p} is free software: you can redistribute it and/or modify it under the terms of the GNU {n} as published by the Free Software Foundation"
_GNU_END = "{p} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {n} for more details. You should have received a copy of the GNU {n} along with this {q}"
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD = f"{_BSD_START}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_END = "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_END = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_FSF = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."


def _gnu(name: str, version: str) -> list[str]:
    """The standard header of a GNU licence: with any later version and without, by its first sentence and as a whole."""
    out = []
    for p, q in (("This program", "program"), ("This library", "library"), ("This file", "program")):
        start = _GNU.format(p=p, n=name)
        for sentence in (f"{start}; either version {version} of the License, or (at your option) any later version.", f"{start}; version {version} of the License.", f"{start}, version {version}."):
            out += [sentence, f"{sentence} {_GNU_END.format(p=p, q=q, n=name)}"]
    return out


_TEXTS = {
    "Apache-2.0": [_APACHE, f"{_APACHE} {_APACHE_END}"],
    "MIT": [_MIT, f"{_MIT} {_AS_IS} {_MIT_END}", f"MIT License Copyright (c) {_MIT} {_AS_IS} {_MIT_END}"],
    "GPL-3.0": _gnu("General Public License", "3"),
    "GPL-2.0": _gnu("General Public License", "2"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "BSD-3-Clause": [f"{_BSD} {_BSD_3}", f"{_BSD} {_BSD_3} {_BSD_END}", f"BSD 3-Clause License Copyright (c) All rights reserved. {_BSD} {_BSD_3} {_BSD_END}"],
    "BSD-2-Clause": [_BSD, f"{_BSD} {_BSD_END}", f"BSD 2-Clause License Copyright (c) All rights reserved. {_BSD} {_BSD_END}"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "ISC": [_ISC, f"{_ISC} {_ISC_END}", f"ISC License Copyright (c) {_ISC} {_ISC_END}"],
    "Unlicense": [_UNLICENSE],
}
#: Heads of licence files too long to stand here; a text that begins with one is a licence file.
_TITLES = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "Apache License Version 2.0, January 2004"],
    "GPL-3.0": [f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_FSF}", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0": [f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_FSF}", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0": [f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_FSF}", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": [f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_FSF}", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "AGPL-3.0": [f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_FSF}", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal"],
    "Unlicense": [_UNLICENSE],
    "MIT": ["The MIT License (MIT) Copyright (c)"],
}
TEMPLATES |= {"LGPL-2.1": [x.format("the GNU Lesser General Public License, version 2.1") for x in _STATEMENTS], "BSD-2-Clause": [x.format("the BSD 2-Clause License") for x in _STATEMENTS]}
#: SPDX tags; all words of the identifier must be in a span, as the rest of a tag alone comes near the threshold.
_TAGS = {n: [f"SPDX-License-Identifier: {n}{x}" for x in (("", "-only", "-or-later") if "GPL" in n else ("",))] for n in TEMPLATES if not n.startswith("LicenseRef")}
for _of in (_TEXTS, _TITLES, _TAGS):
    for _id, _names in _of.items():
        TEMPLATES[_id] += [x for x in _names if x not in TEMPLATES[_id]]
_FILE = r"(?i)^(licen[cs]e|copying|notice|copyright)([.-].*)?$"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+", -1), "")


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def frequencies(files: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """The number of texts, and of those with each word of the templates (a few hundred words at most)."""
    vocabulary = sorted({w for forms in TEMPLATES.values() for form in forms for w in _words(form)})
    held = files.select(F.array_intersect(words_of(F.coalesce(text, F.lit(""))), F.lit(vocabulary)).alias("w"))
    total = files.count()
    counts = {r["w"]: r["count"] for r in held.select(F.explode("w").alias("w")).groupBy("w").count().collect()}
    return total, {w: counts.get(w, 0) for w in vocabulary}


def vectors(total: int, seen: dict[str, int]) -> tuple[dict[tuple[str, int], dict[str, float]], dict[str, float], float]:
    """Unit vectors of the templates' forms, the words' idf, and the idf of all other words: that of the rarest."""
    idf = {w: math.log((total + 1) / (n + 1)) + 1 for w, n in seen.items()}
    out = {}
    for name, forms in TEMPLATES.items():
        for i, form in enumerate(forms):
            v: dict[str, float] = {}
            for w in _words(form):
                v[w] = v.get(w, 0) + idf[w]
            size = math.sqrt(sum(x * x for x in v.values()))
            out[name, i] = {w: x / size for w, x in v.items()}
    return out, idf, max(idf.values())


def anchors(forms: dict[tuple[str, int], dict[str, float]], threshold: float) -> list[str]:
    """Words of which every line that reaches the threshold has one."""
    out = set()
    for v in forms.values():
        rest = 1.0
        for w, x in sorted(v.items(), key=lambda e: (-e[1], e[0])):
            if rest < threshold**2 - 1e-9:
                break
            out.add(w)
            rest -= x * x
    return sorted(out)


def _compared(forms: dict[tuple[str, int], dict[str, float]], idf: dict[str, float], other: float, threshold: float):
    """(key, path, license, license_score, whole) of each text with a span that reaches the threshold; whole: it is a licence file."""
    keys = list(forms)
    place = {w: i for i, w in enumerate(idf)}
    y = np.zeros((len(keys), len(place) + 1))  # the last column is any other word
    for k, v in enumerate(forms.values()):
        for w, x in v.items():
            y[k, place[w]] = x
    weights = np.array([*idf.values(), other])
    text_of = [TEMPLATES[n][i] for n, i in keys]
    length = [len(_words(t)) for t in text_of]
    title = [t in _TITLES.get(n, ()) for (n, _), t in zip(keys, text_of, strict=True)]
    # a tag's identifier, and what the clause has that makes three of two
    needed = [{place[w] for w in (_words(n) if t in _TAGS.get(n, ()) else ("neither", "endorse") if _BSD_3 in t else ())} for (n, _), t in zip(keys, text_of, strict=True)]
    # inside a longer text a run of a few words is a statement only with all of them
    within = [{place[w] for w in _words(t)} if n <= 4 else must for t, n, must in zip(text_of, length, needed, strict=True)]
    marks = [np.array([place[w] for w in anchors({k: v}, threshold)]) for k, v in forms.items()]
    every = {place[w] for w in anchors(forms, threshold)}
    # what texts of other licences hold too counts only without a better sign: a text that names a licence may reserve rights; of equals the first identifier
    turn = {n: -i for i, n in enumerate(sorted(TEMPLATES))}
    rank = [(0 if n == "LicenseRef-proprietary" else 1 if t == _BSD_START else 2 if t == _BSD else 3, turn[n]) for (n, _), t in zip(keys, text_of, strict=True)]

    def size(ids: list[int]) -> float:
        return math.sqrt(sum((c * weights[min(i, len(place))]) ** 2 for i, c in Counter(ids).items()))

    def best(text: str) -> tuple[str, float, bool] | None:
        local: dict[str, int] = {}
        lines = [[place[w] if w in place else local.setdefault(w, len(place) + len(local)) for w in _words(line)] for line in text.split("\n")]
        tokens = [i for line in lines for i in line]
        if not tokens:
            return None
        ids = np.array(tokens, np.int64)
        col = np.minimum(ids, len(place))
        top = ()

        def offer(k: int, cosine: float) -> None:
            nonlocal top
            top = max(top, (rank[k][0], round(cosine, 9), rank[k][1], keys[k][0]))

        def spans(line: list[int]) -> bool:
            at, c = np.unique(np.minimum(line, len(place)), return_counts=True)
            cosines = y[:, at] @ (c * weights[at]) / size(line)
            hit = [k for k in np.flatnonzero(cosines >= threshold - 1e-9).tolist() if round(cosines[k], 9) >= threshold and needed[k] <= set(line)]
            for k in hit:
                offer(k, cosines[k])
            return any(length[k] >= LONG for k in hit)

        have = np.zeros(len(place) + 1, bool)
        have[col] = True
        whole = spans(tokens)
        for line in {tuple(x) for x in lines}:
            if not every.isdisjoint(line):
                spans(list(line))
        x = weights[col]
        squares = np.concatenate(([0.0], np.cumsum(x * x)))
        for k, n in enumerate(length):
            if n > len(ids) or not have[marks[k]].any():
                continue
            dots = np.concatenate(([0.0], np.cumsum(x * y[k, col])))
            # repeated words make a span only longer than this, so no cosine is greater
            bound = (dots[n:] - dots[:-n]) / np.sqrt(squares[n:] - squares[:-n])
            able = np.flatnonzero(bound >= threshold - 1e-9)
            found = 0.0
            for s in able[np.argsort(-bound[able], kind="stable")].tolist():
                if found >= bound[s]:
                    break
                span = tokens[s : s + n]
                cosine = (dots[s + n] - dots[s]) / size(span)
                if cosine > found and round(cosine, 9) >= threshold and within[k] <= set(span):
                    found = cosine
            if found:
                offer(k, found)
            if title[k] and bound[0] >= threshold - 1e-9:
                whole |= round((dots[n] - dots[0]) / size(tokens[:n]), 9) >= threshold
        return (top[3], top[1], whole) if top else None

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [(k, b) for k, t in enumerate(part.column("text").to_pylist()) if (b := best(t))]
                own = part.select(["key", "path"]).take(pa.array([k for k, _ in found], pa.int64()))
                yield pa.record_batch(
                    [*own.columns, *(pa.array([b[i] for _, b in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))],
                    names=["key", "path", "license", "license_score", "whole"],
                )
        settled()
    return run


def scan(files: DataFrame, *, path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """files with license, license_score, license_from (own, a directory's path, or null).

    A text's licence is that of its line, of its run of as many words as a template has, or of itself as a whole, of greatest
    cosine with a template, from threshold on; ties go to the first identifier, and reserved rights count only where no
    other is found. Null and empty texts have none of their own; a null path inherits
    nothing. Rows that repeat give a row each. Columns of files stay, whatever their names, but for the three of the result.
    A text may be of any length: it is compared in one piece, in memory in proportion to it.
    """
    files = files.drop("license", "license_score", "license_from")
    forms, idf, other = vectors(*frequencies(files, text))
    # 128 bits of path and text: equal keys are equal rows
    key = F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col(path), F.lit("\x1e")), F.coalesce(text, F.lit("")))))
    own = files.select(F.col(path).alias("path"), F.coalesce(text, F.lit("")).alias("text"), key.alias("key"))
    some = own.where(F.arrays_overlap(words_of(F.col("text")), F.lit(anchors(forms, threshold)))).dropDuplicates(["key"])
    scored = some.select("key", "path", "text").mapInArrow(_compared(forms, idf, other, threshold), "key binary, path string, license string, license_score double, whole boolean")
    named = F.regexp_extract("path", "([^/]*)$", 1).rlike(_FILE)
    found = table(scored.withColumn("whole", F.col("whole") | F.coalesce(named, F.lit(False))), "licences")
    above = found.where("whole and path is not null").select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "license", "license_score", F.col("path").alias("file"))
    above = above.groupBy("dir").agg(F.max_by(F.struct("license", "license_score"), F.struct("license_score", "file")).alias("above"))
    parts = F.split("path", "/")
    upward = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")))
    up = files.select(F.col(path).alias("path")).where("path like '%/%'").distinct().select("path", F.explode(upward).alias("u"))
    near = up.select("path", "u.depth", "u.dir").join(above, "dir").groupBy("path").agg(F.max_by(F.struct("dir", "above"), "depth").alias("near"))
    at = free(files)
    columns = [F.col(f"`{c}`") for c in files.columns]
    out = files.withColumn(f"{at}key", key)
    out = out.join(found.select(*(F.col(c).alias(f"{at}{c}") for c in ("key", "license", "license_score"))), f"{at}key", "left")
    out = out.join(near.select(F.col("path").alias(f"{at}path"), F.col("near").alias(f"{at}near")), F.col(path) == F.col(f"{at}path"), "left")
    above = F.col(f"{at}near.above")
    return out.select(
        *columns, F.coalesce(f"{at}license", above["license"]).alias("license"), F.coalesce(f"{at}license_score", above["license_score"]).alias("license_score"),
        F.when(F.col(f"{at}license").isNotNull(), F.lit("own")).otherwise(F.col(f"{at}near.dir")).alias("license_from"),
    )
