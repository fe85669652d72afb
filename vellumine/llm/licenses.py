"""License scans: windows of normalised text against license templates by Dice over word bigrams.

Text is cut into lower-case words; numbers count as one and the same word. A window scores
``2 * shared / (its bigrams + the template's)`` over bigram multisets. From a score of ``LEAST``
follow the size bounds: a window has between n * t / (2 - t) and n * (2 - t) / t bigrams, and
shares at least n * t / (2 - t) of the template's n. As a window's score only grows when an end
outside the template is cut, windows between shared bigrams are all that need be tried: templates
without enough shared bigrams close together are pruned at once. The best windows that don't overlap are reported.

Covered are the notices, headers and short texts of ``TEMPLATES``; of licenses whose texts are long (Apache, GPL,
LGPL, AGPL, MPL, CC0, EPL) the headers and notices are. Other templates can be given as a parameter.

Edge cases: null and empty texts hold no license; texts are scanned whole at any length; ties go
to the longer window, then the earlier, then the template's name; repeated rows repeat results.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.columns import append

LEAST = 0.8

#: License notices and texts (fixed values).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "LGPL-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. "
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>."
    ),
    "AGPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. "
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-work": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. "
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "CC-BY-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
}

WORD = re.compile(r"\d+(?:[.,-]\d+)*|[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return ["0" if w[0].isdigit() else w for w in WORD.findall(text.lower())]


def dice(a: Counter, b: Counter) -> float:
    n = a.total() + b.total()
    return 2 * (a & b).total() / n if n else 0.0


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


class Templates:
    def __init__(self, templates: dict[str, str], least: float = LEAST) -> None:
        self.least = least
        self.own = {name: bigrams(words_of(text)) for name, text in templates.items()}
        self.own = {name: b for name, b in self.own.items() if b}
        self.holders: dict[tuple, list[str]] = defaultdict(list)
        for name, b in self.own.items():
            for g in b:
                self.holders[g].append(name)
        self.bounds = {}
        for name, b in self.own.items():
            n, t = b.total(), least
            self.bounds[name] = (max(1, -int(-n * t / (2 - t) // 1)), int(n * (2 - t) / t))

    def windows(self, words: list[str]) -> list[tuple[float, int, int, str]]:
        """(score, first word, last word, template) of the best windows, none over another."""
        holders = self.holders
        at: dict[str, list[int]] = defaultdict(list)
        for i in [i for i, g in enumerate(zip(words, words[1:])) if g in holders]:
            for name in holders[words[i], words[i + 1]]:
                at[name].append(i)
        found: list[tuple[float, int, int, str]] = []
        for name, hits in at.items():
            least, most = self.bounds[name]
            if len(hits) < least:
                continue
            own = self.own[name]
            n = own.total()
            for a in range(len(hits) - least + 1):
                if hits[a + least - 1] - hits[a] >= most:
                    continue  # too few shared bigrams within the largest window
                left, shared, best = own.copy(), 0, None
                for b in range(a, len(hits)):
                    size = hits[b] - hits[a] + 1
                    if size > most:
                        break
                    g = words[hits[b]], words[hits[b] + 1]
                    if left[g] > 0:
                        left[g] -= 1
                        shared += 1
                    score = 2 * shared / (n + size)
                    if score >= self.least and (best is None or score >= best[0]):
                        best = (score, hits[a], hits[b] + 1, name)
                if best:
                    found.append(best)
        found.sort(key=lambda f: (-f[0], f[1] - f[2], f[1], f[3]))
        kept: dict[int, tuple[float, int, int, str]] = {}
        begins: list[int] = []  # of the kept windows, in order: none lies over another, so a window meets its neighbours only
        for f in found:
            k = bisect_right(begins, f[2])
            if not k or kept[begins[k - 1]][2] < f[1]:
                begins.insert(k, f[1])
                kept[f[1]] = f
        return [kept[b] for b in begins]

    def scan(self, text: str | None) -> list[dict]:
        """license, start and end (code points of the lower-cased text, end exclusive) and dice of each."""
        if not text:
            return []
        low = text.lower()
        found = self.windows(["0" if w[0].isdigit() else w for w in WORD.findall(low)])
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(low)]
        return [{"license": name, "start": spans[a][0], "end": spans[b][1], "dice": score} for score, a, b, name in found]


SPANS = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("dice", T.DoubleType())]))


def find_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """``docs`` with ``licenses``: an array of (license, start, end, dice), empty where none is."""
    own = TEMPLATES if templates is None else templates

    def make() -> Callable[[list], list[list]]:
        held = Templates(own, least)
        return lambda texts: [[held.scan(t) for t in texts]]

    return append(docs, text, [T.StructField("licenses", SPANS)], make, keep)


def op10(spark, sf_dir: str) -> DataFrame:
    """A row for each license found in a whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_licenses(docs, keep=["doc_id"]).select("doc_id", F.explode("licenses").alias("l")).select("doc_id", "l.license", "l.start", "l.end", "l.dice")
