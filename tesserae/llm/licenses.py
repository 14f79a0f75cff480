"""Licence scans: text compared to licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised to lower-case words of letters and digits. A template is sought as a whole text, and as a stretch of
one: from each start, the stretch of any length that sizes allow whose coefficient is best. Sizes prune: sets of m and n bigrams reach a coefficient c only if
each has at least c / (2 - c) times the other's, and at least c / 2 * (m + n) in common, so a text with fewer of a template's bigrams than that is not compared.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept
from .decontaminate import words

DICE = 0.8
#: Notices, grants and opening sentences of common licences, by SPDX identifier (BSD: the clause that all of its forms begin with).
NOTICES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Whole texts of short licences, but for titles and copyright lines.
BODIES: list[tuple[str, str]] = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
]
TEMPLATES = NOTICES + BODIES


class Templates:
    """Templates' words and bigrams as numbers."""

    def __init__(self, templates: list[tuple[str, str]], dice: float):
        self.dice = dice
        self.word: dict[bytes, int] = {}
        self.names: list[str] = []
        self.lengths: list[int] = []
        self.bigrams: list[set[tuple[int, int]]] = []
        self.having: dict[tuple[int, int], list[int]] = {}
        for name, text in templates:
            own = [self.word.setdefault(w, len(self.word) + 1) for w in words(text.encode())]
            grams = set(zip(own, own[1:]))
            if not grams:
                raise ValueError(f"a template of {name} has fewer than two words")
            for g in grams:
                self.having.setdefault(g, []).append(len(self.names))
            self.names.append(name)
            self.lengths.append(len(own))
            self.bigrams.append(grams)

    def matches(self, text_words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first word, last word + 1), best first, no two overlapping."""
        get = self.word.get
        ids = [get(w, 0) for w in text_words]
        hits: dict[int, list[tuple[int, tuple[int, int]]]] = {}
        for p, g in enumerate(zip(ids, ids[1:])):
            if g[0] and g[1]:
                for k in self.having.get(g, ()):
                    hits.setdefault(k, []).append((p, g))
        found = []
        whole = None
        for k, own in hits.items():
            size, length = len(self.bigrams[k]), self.lengths[k]
            # What is in common is part of the stretch, so a template's share of c / (2 - c) is needed at least.
            if (2 - self.dice) * len({g for _, g in own}) < self.dice * size:
                continue
            most, at = size * (2 - self.dice) / self.dice, dict(own)
            # The whole text, where the sizes of the sets allow it, however often it repeats itself.
            whole = set(zip(text_words, text_words[1:])) if whole is None else whole
            if len(whole) <= most:
                c = 2 * len({g for _, g in own}) / (size + len(whole))
                if c >= self.dice:
                    found.append((c, -length, 0, len(text_words), k))
            for p, start in own:
                # A stretch that meets its first bigram again is no better than the one from the template's next bigram on, so the end goes no further.
                stretch, common, best, end = set(), set(), 0.0, p
                for q in range(p, len(ids) - 1):
                    if q > p and at.get(q) == start:
                        break
                    stretch.add((text_words[q], text_words[q + 1]))
                    if len(stretch) > most:
                        break
                    if q in at:
                        common.add(at[q])
                        c = 2 * len(common) / (size + len(stretch))
                        if c > best:
                            best, end = c, q + 2
                if best >= self.dice:
                    found.append((best, -length, p, end, k))
        found.sort(key=lambda f: (-f[0], f[1], f[2], f[4]))
        out: list[tuple[str, float, int, int]] = []
        taken: list[tuple[int, int]] = []
        busy: set[int] = set()
        for c, _, a, b, k in found:
            if not any(i in busy for i in range(a, b)):
                busy.update(range(a, b))
                taken.append((a, b))
                out.append((self.names[k], c, a, b))
        return sorted(out, key=lambda m: m[2])


_MATCH = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """The columns in keep with n_words and matches (license, dice, first word, end) of each row's whole text, in text order.

    Stretches start at a bigram of their template; of overlapping matches the one of higher coefficient stays, then the longer template, then the
    earlier. A null or empty text has no words and an empty array of matches. Repeated rows get equal matches; an empty table gives an empty table; other columns
    are not read. A kept column named like one of the results gives way to it. templates: (name, text), of two words or more each; a ValueError otherwise.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates, dice))
    kept = Kept(docs, keep, ["n_words", "matches"])

    def run(batches):
        for batch in batches:
            own = [words(t) for t in batch.column("text").to_pylist()]
            made = [[{"license": n, "dice": c, "first": a, "end": b} for n, c, a, b in shared.value.matches(w)] for w in own]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array([len(w) for w in own], pa.int64()), pa.array(made, pa.list_(_MATCH))], names=["kept", "n_words", "matches"])

    rows = docs.select(kept.column, F.col(text).cast("binary").alias("text"))
    return kept.out(rows.mapInArrow(run, kept.schema("n_words long, matches array<struct<license: string, dice: double, first: bigint, end: bigint>>")))
