"""License scans: MinHash bands over overlapping windows find templates, containment verifies them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanflow.llm.common import give_back, runs_of
from urbanflow.llm.packed import grams, mix, word_hashes

# Public license texts and notices.
_NO_WARRANTY_MIT = (
    "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of "
    "merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any "
    "claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software "
    "or the use or other dealings in the Software."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, "
    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or "
    "contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, "
    "procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of "
    "liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, "
    "even if advised of the possibility of such damage."
)
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the "
    "hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. "
    "See the GNU {kind}General Public License for more details."
)
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-3.0-line": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "bsd-line": "Use of this source code is governed by a BSD-style license.",
    "bsd-file-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
    "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-1.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
    "accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
    "available at https://www.eclipse.org/legal/epl-2.0/",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. " + _NO_WARRANTY_MIT,
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies. The software is provided \"as is\" and the author disclaims "
    "all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be "
    "liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, "
    "whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
    "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented "
    "as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
    "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "bsl-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare "
    "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The "
    "copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must "
    "be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works "
    "are solely in the form of machine-executable object code generated by a source language processor.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met",
    "bsd-2-text": _BSD_START + _BSD_END,
    "bsd-3-text": _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. " + _BSD_END,
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License "
    "at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
    "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
    "implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0-notice": _GPL_NOTICE.format(kind="", version="2"),
    "gpl-3.0-notice": _GPL_NOTICE.format(kind="", version="3"),
    "lgpl-2.1-notice": _GPL_NOTICE.format(kind="Lesser ", version="2.1"),
    "lgpl-3.0-notice": _GPL_NOTICE.format(kind="Lesser ", version="3"),
    "agpl-3.0-notice": _GPL_NOTICE.format(kind="Affero ", version="3"),
}

SHINGLE = 5
#: Shingles of a window for templates that have more: from those, every such run of the template is looked for.
WINDOW = 16
_WORD = re.compile(rb"[a-z0-9]+")
_VARIANT = re.compile(r"^[al](?=gpl)|-\d[\d.]*")


def license_words(text: str | None) -> list[bytes]:
    """Runs of the letters a to z and digits after lower-casing; marks part words."""
    return _WORD.findall(text.lower().encode("utf-8", "surrogatepass")) if text else []


def family(template: str) -> str:
    """A template's name without version and GPL variant: of one family, the best match of a stretch counts."""
    return _VARIANT.sub("", template)


class Plan:
    """What to look for: by window size, the band keys of templates.

    A template is looked for by windows of its own size, at most ``WINDOW`` shingles. A longer one is cut
    into runs of that size, side by side: if the text holds a share ``least`` of its shingles, it holds
    that share of one of the runs at least. A text window that starts at most half a step from the run's
    copy shares at least n - step / 2 of its n shingles with it; further ones may differ up to what
    containment allows. ``bands`` of ``rows`` hashes each are as many as it takes for a collision chance
    of ``sure`` at that similarity.
    """

    def __init__(self, templates: dict[str, str], least: float, sure: float, rows: int):
        self.least, self.names, self.sets, self.sizes = least, [], [], []
        runs: dict[int, list[tuple[int, np.ndarray]]] = {}
        for name, text in templates.items():
            words = license_words(text)
            if len(words) < SHINGLE:
                continue
            g = grams(word_hashes(words), SHINGLE)
            n = min(len(g), WINDOW)
            for a in range(0, len(g) - n + 1, n):
                runs.setdefault(n, []).append((len(self.names), g[a : a + n]))
            self.names.append(name)
            self.sets.append(np.unique(g))
            self.sizes.append(len(g))
        #: window size, step, rows, bands, keys (bands x runs), template of each run
        self.classes = []
        for n, own in sorted(runs.items()):
            step = max(1, n // 4)
            alike = (n - (off := step // 2 + int(n * (1 - least)))) / (n + off)
            r = 1 if alike == 1 else rows
            bands = 1 if alike == 1 else math.ceil(math.log(1 - sure) / math.log(1 - alike**r))
            keys = np.stack([self.keys(g, np.zeros(1, np.int64), n, r, bands)[:, 0] for _, g in own], 1)
            self.classes.append((n, step, r, bands, keys, np.array([t for t, _ in own])))

    @staticmethod
    def keys(shingles: np.ndarray, at: np.ndarray, n: int, rows: int, bands: int) -> np.ndarray:
        """Band keys (bands x windows) of the windows of ``n`` shingles that start ``at`` these places."""
        out = np.zeros((bands, len(at)), np.uint64)
        for band in range(bands):
            for row in range(rows):
                h = mix(shingles + np.uint64((band * rows + row + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                width = 1
                while 2 * width <= n:
                    h = np.minimum(h[:-width], h[width:])
                    width *= 2
                own = h[at]
                if width < n:
                    own = np.minimum(own, h[at + n - width])
                out[band] = mix(out[band] ^ own) + np.uint64(row)
        return out

    def candidates(self, shingles: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, template, place) where a window of a text collides with a run of the template.

        Texts lie end to end, their shingles too, so windows are placed text by text: from its first
        place on at every step, and at its last. Texts with fewer shingles than a window go to every
        template that they could hold enough of.
        """
        out, last = [], np.maximum(ends[1:] - SHINGLE + 1, ends[:-1])  # end of each text's own shingles
        have = last - ends[:-1]
        for n, step, r, bands, keys, of in self.classes:
            fit = np.flatnonzero(have >= n)
            count = -(-(have[fit] - n) // step) + 1
            text = np.repeat(fit, count)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            at = np.minimum(ends[text] + nth * step, last[text] - n)
            if len(at):
                mine = self.keys(shingles, at, n, r, bands)
                for band in range(bands):
                    known, order = np.unique(keys[band]), np.argsort(keys[band], kind="stable")
                    for w in np.flatnonzero(np.isin(mine[band], known)):
                        a, b = np.searchsorted(keys[band][order], mine[band][w], "left"), np.searchsorted(keys[band][order], mine[band][w], "right")
                        out += [(int(text[w]), int(of[k]), int(at[w])) for k in order[a:b]]
            for t in np.flatnonzero((have > 0) & (have < n)):
                out += [(int(t), int(k), int(ends[t])) for k in set(of.tolist()) if have[t] >= self.least * len(self.sets[k])]
        return list(dict.fromkeys(out))

    def hits(self, texts: list[str | None]) -> list[tuple[int, str, int, int, float]]:
        """(text, template, start, end, containment), start and end in words, in order."""
        words, counts = [], [0]
        for t in texts:
            words += license_words(t)
            counts.append(len(words))
        shingles, ends = grams(word_hashes(words), SHINGLE), np.array(counts)
        found = {}
        for doc, k, at in self.candidates(shingles, ends):
            # a run may be any part of the template: what lies a template's length to either side may hold the rest
            a, b = max(ends[doc], at - self.sizes[k]), min(ends[doc + 1] - SHINGLE + 1, at + 2 * self.sizes[k])
            own = shingles[a:b]
            inside = np.flatnonzero(np.isin(own, self.sets[k]))
            if not len(inside):
                continue
            # the densest stretch of the template's length
            lead = np.searchsorted(inside, inside + self.sizes[k] + self.sizes[k] // 4, "left")
            best = int(np.argmax(lead - np.arange(len(inside))))
            stretch = inside[best : lead[best]]
            held = len(np.unique(own[stretch])) / len(self.sets[k])
            if held >= self.least:
                place = (doc, k, int(a + stretch[0] - ends[doc]), int(a + stretch[-1] + SHINGLE - ends[doc]))
                found[place] = held
        return self._best([(d, self.names[k], s, e, float(h)) for (d, k, s, e), h in found.items()])

    @staticmethod
    def _best(hits: list[tuple]) -> list[tuple]:
        """Of overlapping stretches of one family, those with the most of their template."""
        out: list[tuple] = []
        for h in sorted(hits, key=lambda h: (h[0], -h[4], h[2], h[1])):
            rivals = (o for o in reversed(out) if o[0] == h[0] and family(o[1]) == family(h[1]) and o[2] < h[3] and h[2] < o[3])
            if all(o[1] != h[1] and o[4] <= h[4] for o in rivals):
                out.append(h)
        return sorted(out)


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    least: float = 0.8,
    sure: float = 0.999,
    rows: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, row_key, template, start, end, containment: the stretches of words that hold a template.

    Overlapping windows of each text are hashed to MinHash bands; windows that share a band with a run
    of a template are verified: at least ``least`` of the template's distinct five-word shingles must
    occur in a stretch of one and a quarter times its length. Of overlapping stretches of templates that
    differ by version or GPL variant alone, the best is given, and ties all.

    Rows don't move; templates travel with the task. A text's results depend on that text alone.
    Templates of fewer than five words are not looked for. Null and empty texts hold nothing, long ones
    are scanned whole, repeated rows give repeated results. Other columns are not read.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(chosen, least, sure, rows)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in runs_of(texts):
                own = batch.slice(part.start, part.stop - part.start)
                cols = list(zip(*plan.hits(texts[part]))) or [()] * 5
                at = pa.array(cols[0], pa.int64())
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(at), own.column(1).take(at), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))],
                    ["doc_id", "row_key", "template", "start", "end", "containment"],
                )
        give_back()

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, row_key long, template string, start int, end int, containment double")


def scan_documents(docs: DataFrame, **how) -> DataFrame:
    """One row for each document: doc_id, templates (names in order), n_matches, best containment."""
    doc_id, text = how.get("doc_id", "doc_id"), how.get("text", "text")
    hits = scan(docs, **how).groupBy("row_key", "template").agg(F.max("containment").alias("c"))
    by_row = hits.groupBy("row_key").agg(
        F.sort_array(F.collect_list("template")).alias("templates"), F.count(F.lit(1)).alias("n"), F.max("c").alias("best")
    )
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"))
    return keyed.join(by_row, "row_key", "left").select(
        "doc_id",
        F.coalesce(F.concat_ws(",", "templates"), F.lit("")).alias("templates"),
        F.coalesce("n", F.lit(0)).alias("n_templates"),
        F.coalesce("best", F.lit(0.0)).alias("containment"),
    )
