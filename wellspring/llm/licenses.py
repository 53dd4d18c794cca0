"""License scans with DataFrame functions alone: MinHash bands over windows, then exact containment.

Words are runs of letters or digits, lower-cased; shingles are five words.  Templates of S shingles are
sought in windows of about 1.5 S shingles that start every S/2, so every occurrence lies whole in one of
them.  Each window and template has ``BANDS`` min-hashes of one row each; an occurrence that keeps four
fifths of the template's shingles has a Jaccard similarity of at least 0.47 with its window, so that some
band collides but for a chance of 0.53^16, under 1 in 20,000.  A collision is verified by the exact share
of the template's distinct shingles in the window; from ``CONTAINED`` on it is a match.

What is not computed.  Each template has anchor words that together stand in over a fifth of its shingles;
a match keeps four fifths, so at least one anchor must occur.  Documents without any anchor, and windows
without an anchor of their size's templates, cannot match and are passed by; nothing else is.

Defined results.  Null texts or ids yield nothing; repeated rows are reported once; a document gets one
row per template that it holds, with the best window (ties: the earliest).  Other columns are ignored.  An
empty table gives an empty result.  Templates of under five words are refused.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import words

SHINGLE = 5
CONTAINED = 0.8
BANDS = 16

#: Notices and grants as their licenses publish them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT notice": "Released under the MIT License",
    "MIT grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "BSD grant": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Proprietary": "All rights reserved. No part of this publication may be reproduced without prior written permission",
    "Apache-2.0 project notice": "This project is licensed under the Apache License 2.0",
    "MIT project notice": "This project is licensed under the MIT License",
    "MIT use notice": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file",
    "MIT disclaimer": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD use notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "BSD-3-Clause names": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "BSD disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC disclaimer": """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "GPL-2.0-or-later clause": "either version 2 of the License, or (at your option) any later version",
    "GPL-3.0-or-later clause": "either version 3 of the License, or (at your option) any later version",
    "LGPL header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "EPL-2.0 notice": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "CC0-1.0 notice": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.""",
    "CC-BY-ND-4.0 notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "Zlib grant": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0 notice": "Distributed under the Boost Software License, Version 1.0",
    "BSL-1.0 grant": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
    "WTFPL notice": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION",
}


def anchors(text: str, contained: float = CONTAINED) -> list[str]:
    """Words that together stand in more than ``1 - contained`` of the template's distinct shingles; long ones first."""
    w = re.findall(r"[^\W_]+", text.lower())
    if len(w) < SHINGLE:
        raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
    grams = {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
    covered: set[tuple[str, ...]] = set()
    out: list[str] = []
    while len(covered) <= (1 - contained) * len(grams) + 1e-9:
        gain = Counter(x for g in grams - covered for x in set(g))
        best = max(gain, key=lambda x: (gain[x] if len(x) >= 6 else 0, gain[x], x))
        out.append(best)
        covered |= {g for g in grams if best in g}
    return out


def _template_frame(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, size (of its windows' kind), tsh (distinct shingles), tmins: a row for each template."""
    rows = [(k, v) for k, v in sorted(templates.items())]
    t = spark.createDataFrame(rows, "license string, t string").select("license", F.transform(words(F.col("t")), lambda w: F.xxhash64(w)).alias("hs"))
    t = t.select("license", F.array_distinct(_shingles("hs")).alias("tsh"), F.size(_shingles("hs")).alias("size"))
    return t.select("license", "size", "tsh", _mins("tsh").alias("tmins"))


def _shingles(hs: str):
    n = F.size(hs) - SHINGLE + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def _mins(column: str):
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(column, lambda x: F.xxhash64(x, k))))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment, start_word, end_word (exclusive) of each template that a document holds."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    sizes: dict[int, set[str]] = {}
    for text in templates.values():
        n = len(re.findall(r"[^\W_]+", text.lower())) - SHINGLE + 1
        sizes.setdefault(n, set()).update(anchors(text))
    every = sorted(set().union(*sizes.values()))
    text = F.lower("t")
    may = F.lit(False)
    for a in every:
        may = may | text.contains(a)
    d = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t")).where(may)
    d = d.select("doc_id", words(F.col("t")).alias("w"))
    known = F.array(*[F.lit(a) for a in every])
    at = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.array_contains(known, s["x"]))
    d = d.select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("hs"), at.alias("at"))
    d = d.select("doc_id", _shingles("hs").alias("sh"), "at")
    # a row for each window size: its stride, length and anchor words
    kinds = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(max(1, s // 2)).alias("stride"), F.lit(s + max(1, s // 2) - 1).alias("long"), F.array(*[F.lit(a) for a in sorted(x)]).alias("known")) for s, x in sorted(sizes.items())])
    d = d.select("doc_id", "sh", "at", F.explode(kinds).alias("kind")).select("doc_id", "sh", "at", "kind.*")
    own = F.transform(F.filter("at", lambda s: F.array_contains("known", s["x"])), lambda s: s["i"])

    def starts(p):
        low = F.greatest(p - F.col("long") - SHINGLE + 2, F.lit(0))
        first = (F.floor((low + F.col("stride") - 1) / F.col("stride")) * F.col("stride")).cast("int")
        last = F.least(p, F.size("sh") - 1)
        return F.when(first <= last, F.sequence(first, last, F.col("stride"))).otherwise(F.array().cast("array<int>"))

    d = d.select("doc_id", "sh", "size", "long", F.explode(F.array_distinct(F.flatten(F.transform(own, starts)))).alias("start"))
    d = d.select("doc_id", "size", "start", F.slice("sh", F.col("start") + 1, F.col("long")).alias("win"))
    d = d.select("doc_id", "size", "start", "win", _mins("win").alias("mins"))
    bands = d.select("doc_id", "size", "start", "win", "mins", F.posexplode_outer("mins").alias("band", "low"))
    t = _template_frame(spark, templates)
    t = t.select("license", F.col("size").alias("tsize"), "tsh", "tmins", F.posexplode("tmins").alias("tband", "tlow"))
    # of the bands that collide the first one counts
    first = F.array_position(F.zip_with("mins", "tmins", lambda a, b: a == b), True) == F.col("band") + 1
    met = bands.join(F.broadcast(t), (F.col("low") == F.col("tlow")) & (F.col("band") == F.col("tband")) & (F.col("size") == F.col("tsize"))).where(first)
    held = F.transform(F.filter(F.transform("win", lambda x, i: F.struct(F.array_contains("tsh", x).alias("in"), i.alias("i"))), lambda s: s["in"]), lambda s: s["i"])
    met = met.select("doc_id", "license", "start", (F.size(F.array_intersect("tsh", "win")) / F.size("tsh")).alias("containment"), held.alias("held")).where(F.col("containment") >= CONTAINED)
    row = F.struct("containment", (-F.col("start") - F.element_at("held", 1)).alias("back"), (F.col("start") + F.element_at("held", -1) + SHINGLE).alias("end_word"))
    best = met.groupBy("doc_id", "license").agg(F.max(row).alias("b"))
    return best.select("doc_id", "license", F.round("b.containment", 6).alias("containment"), (-F.col("b.back")).alias("start_word"), F.col("b.end_word").alias("end_word"))
