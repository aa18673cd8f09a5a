"""License scan: a trained paragraph classifier with a calibrated unknown class and template check.

A paragraph is a run of lines without an empty one between them; a line of comment marks alone is
empty, so a wrapped header behind ``#``, ``*`` or ``//`` is one paragraph. Words are runs of ASCII
letters, digits and non-ASCII bytes, lower-cased, so marks and decoration between words do not
matter. Paragraphs are read in overlapping windows of 32 words; a line of its own is read
beside them, since notices also stand as one line among others.

* The classifier is a one-vs-rest logistic regression over the distinct hashed word 1-, 2- and 3-grams,
  scaled to unit length. It is trained on variants of the templates
  (words dropped, swapped, cut, framed by other words); the unknown class holds a bounded sample of
  corpus lines, lines that talk about licences without granting one, template words in random
  order, and notices of licences that are no family here.
* Calibration: on held-out variants and lines, a temperature makes the softmax over families and
  unknown fit the labels (least log loss); a window is accepted only if its family has the
  calibrated probability ``accept``.
* Touching windows of one family make one finding. Template comparison: word pairs weigh the more
  the fewer families use them. The found share of the closest template's weight (or the finding's, if
  less) must reach ``confirm``, and no other family's template may agree better. Of findings that
  overlap, confirmed before unconfirmed, the one with the most shared weight stays; a finding thus
  names one family, also where a line offers two.

The training lines are a bounded sample chosen by hash (``unknown_lines``); scanning is one map over
all rows and whole texts. A screen over prefix sums (per n-gram the best family's weight less
unknown's) bounds every family's log-odds against unknown from above, so what it leaves out could
not have been accepted.

Defined cases: null or empty text gives no rows; null doc_id is kept; repeated rows give their rows
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeframe.llm import learn
from hazeframe.llm import text as X

WINDOW, STRIDE = 32, 16
BITS = 16
UNKNOWN_LINES = 3000
ACCEPT, CONFIRM = 0.6, 0.6

# Families with SPDX ids and the names that notices call them by.
NAMES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "Apache-2.0": (("Apache-2.0",), ("Apache License, Version 2.0", "Apache 2.0 License")),
    "MIT": (("MIT",), ("MIT License",)),
    "GPL": (("GPL-2.0-only", "GPL-3.0-or-later"), ("GNU General Public License, version 2", "GNU General Public License, version 3", "GNU GPL v3")),
    "LGPL": (("LGPL-2.1-or-later", "LGPL-3.0-only"), ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU LGPL v3")),
    "AGPL": (("AGPL-3.0-only", "AGPL-3.0-or-later"), ("GNU Affero General Public License, version 3", "GNU AGPL v3")),
    "BSD": (("BSD-3-Clause", "BSD-2-Clause"), ("BSD 3-Clause License", "BSD 2-Clause License", "BSD License")),
    "MPL-2.0": (("MPL-2.0",), ("Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0")),
    "ISC": (("ISC",), ("ISC License",)),
    "CC-BY": (("CC-BY-4.0",), ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    "CC-BY-SA": (("CC-BY-SA-4.0",), ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    "CC-BY-NC": (("CC-BY-NC-4.0",), ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    "CC-BY-ND": (("CC-BY-ND-4.0",), ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License")),
    "CC-BY-NC-SA": (("CC-BY-NC-SA-4.0",), ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License")),
    "CC-BY-NC-ND": (("CC-BY-NC-ND-4.0",), ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License")),
    "CC0": (("CC0-1.0",), ("CC0 1.0", "CC0 1.0 Universal Public Domain Dedication")),
    "Unlicense": (("Unlicense",), ("Unlicense",)),
    "BSL-1.0": (("BSL-1.0",), ("Boost Software License, Version 1.0",)),
    "Zlib": (("Zlib",), ("zlib License", "zlib/libpng License")),
    "Artistic-2.0": (("Artistic-2.0",), ("Artistic License 2.0",)),
    "OFL-1.1": (("OFL-1.1",), ("SIL Open Font License, Version 1.1",)),
    "WTFPL": (("WTFPL",), ("Do What The Fuck You Want To Public License, Version 2", "WTFPL")),
    "PSF-2.0": (("PSF-2.0", "Python-2.0"), ("Python Software Foundation License Version 2", "PSF License Agreement")),
    "PostgreSQL": (("PostgreSQL",), ("PostgreSQL License",)),
    "AFL-3.0": (("AFL-3.0",), ("Academic Free License version 3.0",)),
    "CECILL-2.1": (("CECILL-2.1",), ("CeCILL license, version 2.1", "CeCILL Free Software License Agreement v2.1")),
    "GFDL": (("GFDL-1.3-or-later", "GFDL-1.2-only"), ("GNU Free Documentation License, Version 1.3", "GNU FDL 1.3")),
    "NCSA": (("NCSA",), ("University of Illinois/NCSA Open Source License",)),
    "ODbL-1.0": (("ODbL-1.0",), ("Open Data Commons Open Database License v1.0", "Open Database License (ODbL)")),
    "UPL-1.0": (("UPL-1.0",), ("Universal Permissive License v 1.0",)),
    "ECL-2.0": (("ECL-2.0",), ("Educational Community License, Version 2.0",)),
    "LPPL": (("LPPL-1.3c",), ("LaTeX Project Public License, version 1.3c",)),
}
# Paragraphs of public standard notices that a name and a rule do not give.
PARAGRAPHS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation"),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "PostgreSQL": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",),
    "GFDL": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",),
    "ODbL-1.0": ("This database is made available under the Open Database License. Any rights in individual contents of the database are licensed under the Database Contents License.",),
    "ECL-2.0": (
        "Licensed under the Educational Community License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",),
    "LPPL": (
        "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License, either version 1.3 of this license or (at your option) any later version.",),
}
# Names and ids of licences that are no family; their notices are of the unknown class.
OTHER_LICENSES = (
    ("CDDL-1.0", "Common Development and Distribution License, version 1.0"), ("EUPL-1.2", "European Union Public Licence, version 1.2"),
    ("MS-PL", "Microsoft Public License"), ("OSL-3.0", "Open Software License version 3.0"), ("QPL-1.0", "Q Public License, version 1.0"),
    ("IPL-1.0", "IBM Public License Version 1.0"), ("NPL-1.1", "Netscape Public License, version 1.1"), ("SSPL-1.0", "Server Side Public License, v 1"),
    ("BUSL-1.1", "Business Source License 1.1"), ("RPL-1.5", "Reciprocal Public License, version 1.5"),
)
# Sentences that name a licence.
NOTICES = ("Licensed under the {}.", "Released under the {}.", "This project is licensed under the {}.",
           "This work is licensed under the terms of the {}.", "Distributed under the {}.")


def _notices(ids: tuple[str, ...], names: tuple[str, ...]) -> list[str]:
    """Notice sentences by rule: every name in every sentence, and the SPDX lines."""
    bare = lambda t, n: t.replace("the {}", "{}") if n.startswith(("CC", "WTFPL")) else t
    return [bare(t, n).format(n) for n in names for t in NOTICES] + [f"SPDX-License-Identifier: {i}" for i in ids]


TEMPLATES: dict[str, tuple[str, ...]] = {f: (*_notices(*NAMES[f]), *PARAGRAPHS.get(f, ())) for f in NAMES}
# Lines that mention licences without being one of the families.
NOT_LICENSES = (
    "All rights reserved. No part of this publication may be reproduced without prior permission.",
    "You need a driving license to rent a car in this city.", "The license fee is due every year.",
    "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    "The general public was not invited to the meeting.", "Please read the terms and conditions of use.",
    "His fishing license, version or not, had expired.", "The software is distributed by post.",
    "A free copy of the work was published in May.", "The apache helicopter landed at noon.",
    "Students at MIT released a new study under embargo.", "Copyright notices are listed in the appendix.",
)
FAMILIES = tuple(TEMPLATES)


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, line, paragraph) of every word; lines and paragraphs are numbered over the slice."""
    low = X.lower(data)
    word = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    first = np.zeros(len(data) + 1, bool)
    first[off[:-1]] = True
    first = first[:len(data)]
    start = np.flatnonzero(word & (~np.concatenate(([False], word[:-1])) | first))
    end = np.flatnonzero(word & np.concatenate((~word[1:] | first[1:], [True]))) + 1
    # a row counts as two line breaks, so that no paragraph crosses rows
    line = np.cumsum((data == 10) + first * np.int64(2))[start]
    para = np.concatenate(([0], np.cumsum(np.diff(line) > 1))) if len(line) else line
    return X.span_hash(low, start, end), start, end, line, para


def windows(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[first, last) word of every window; a group of up to 32 words is one window."""
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
    b = np.concatenate((a[1:], [len(group)]))
    n = np.maximum(1, -(-(b - a - WINDOW) // STRIDE) + 1)
    first = np.repeat(a, n) + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return first, np.minimum(first + WINDOW, np.repeat(b, n))


def candidates(line: np.ndarray, para: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the paragraphs, and of the lines inside paragraphs of several lines."""
    a, b = windows(para)
    if not len(line):
        return a, b
    c, d = windows(line)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(para)) + 1, [len(para)]))
    p = np.searchsorted(cut, c, side="right") - 1
    several = line[cut[p]] != line[cut[p + 1] - 1]
    return np.concatenate((a, c[several])), np.concatenate((b, d[several]))


def _grams(h: np.ndarray) -> list[np.ndarray]:
    """Hashed feature index of the 1-, 2- and 3-gram that begins at each word."""
    out, acc = [], np.zeros(len(h), np.uint64)
    for k in range(3):
        m = len(h) - k
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        acc = acc[:m] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
        out.append((X.mix(acc) >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def _window_grams(grams: list[np.ndarray], a: int, b: int) -> np.ndarray:
    """Distinct 1-, 2- and 3-grams of the words [a, b)."""
    return np.concatenate([np.unique(g[a:max(a, b - k)]) for k, g in enumerate(grams)])


def _may_repeat(g: np.ndarray) -> np.ndarray:
    """Whether the same n-gram stands less than a window before."""
    by = np.argsort(g, kind="stable")
    out = np.zeros(len(g), bool)
    out[by[1:]] = (g[by[1:]] == g[by[:-1]]) & (by[1:] - by[:-1] < WINDOW)
    return out


def _pairs(text_words: list[str]) -> set:
    return set(zip(text_words, text_words[1:], strict=False)) or set(text_words)


@dataclass
class LicenseModel:
    """Weights per feature and class (families, then unknown), temperature, best family's weight less unknown's."""

    w: np.ndarray
    b: np.ndarray
    temperature: float
    screen: np.ndarray


def _plain(text: str) -> list[str]:
    data = np.frombuffer(text.encode(), np.uint8)
    low = X.lower(data).tobytes()
    _, s, e, _, _ = _words(data, np.array([0, len(data)])) if len(data) else (None, [], [], None, None)
    return [low[i:j].decode("utf-8", "replace") for i, j in zip(s, e, strict=True)]


def _variants(rng: np.random.Generator, times: int, filler: np.ndarray) -> list[tuple[str, int]]:
    """Training paragraphs of every family: templates with dropped, swapped, cut and framing words."""
    out = []
    for y, family in enumerate(FAMILIES):
        for i in range(times):
            t = TEMPLATES[family][i % len(TEMPLATES[family])].split()
            if i >= len(TEMPLATES[family]):
                keep = rng.random(len(t)) > rng.choice([0.0, 0.05, 0.12]) if len(t) > 5 else np.ones(len(t), bool)
                t = [w if rng.random() > 0.03 else str(rng.choice(filler)) for w, k in zip(t, keep, strict=True) if k]
                if rng.random() < 0.3 and len(t) > 12:
                    t = t[:int(len(t) * rng.uniform(0.6, 1))]
                a, b = rng.integers(0, 8, 2) if rng.random() < 0.5 else (0, 0)
                t = [*rng.choice(filler, a), *t, *rng.choice(filler, b)]
            out.append((" ".join(t), y))
    return out


def fit(lines: list[str], seed: int = 3, times: int = 150) -> LicenseModel:
    """``lines``: unlabelled corpus lines for the unknown class. Lines that agree with a template
    are left out of it."""
    rng = np.random.default_rng(seed)
    other = [x for x in lines if max(s for s, _ in agreement(_plain(x))) < CONFIRM]
    filler = np.array([w for x in (*other[:300], *NOT_LICENSES) for w in x.split()])
    unknown = [*other, *(x for x in NOT_LICENSES for _ in range(20))]
    unknown += [t for i, n in OTHER_LICENSES for t in _notices((i,), (n,)) for _ in range(4)]
    # words of the templates in random order are no licence
    for f in FAMILIES:
        for t in TEMPLATES[f]:
            w = t.split()
            if len(w) > 5:
                unknown += [" ".join(rng.permutation(w)[:rng.integers(3, len(w))]) for _ in range(4)]
    data = _variants(rng, times, filler) + [(x, len(FAMILIES)) for x in unknown]
    idx, size, ys = [], [], []
    for x, y in data:
        raw = np.frombuffer(x.encode(), np.uint8)
        if not len(raw):
            continue
        h, _, _, line, para = _words(raw, np.array([0, len(raw)]))
        g = _grams(h)
        for a, b in zip(*candidates(line, para), strict=True):
            u = _window_grams(g, a, b)
            if len(u):
                idx.append(u)
                size.append(len(u))
                ys.append(y)
    ptr, y = np.concatenate(([0], np.cumsum(size))), np.array(ys)
    flat = np.concatenate(idx)
    val = np.repeat(1.0 / np.sqrt(size), size)
    k = len(FAMILIES) + 1
    hold = rng.random(len(y)) < 0.2
    rows = np.flatnonzero(~hold)
    sub_ptr = np.concatenate(([0], np.cumsum(np.array(size)[rows])))
    take = np.concatenate([np.arange(ptr[r], ptr[r + 1]) for r in rows])
    w, b = learn.sparse_logreg(sub_ptr, flat[take], val[take], np.eye(k)[y[rows]], 1 << BITS, l2=1e-5, epochs=8, rate=0.5)
    w = w.astype(np.float32)
    held = np.flatnonzero(hold)
    z = np.stack([val[ptr[r]] * w[flat[ptr[r]:ptr[r + 1]]].sum(0) + b for r in held])

    # temperature of least log loss on the held-out rows
    def loss(t):
        s = z * t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(held)), y[held]]).mean())
    temp = min(np.geomspace(0.1, 10, 60), key=loss)
    return LicenseModel(w, b, float(temp), w[:, :-1].max(1) - w[:, -1])


def _weights() -> tuple[list[list[set]], dict]:
    """Word pairs of every template, and their weights: the fewer families use a pair, the more."""
    sets = [[_pairs(_plain(t)) for t in TEMPLATES[f]] for f in FAMILIES]
    n: dict = {}
    for own in sets:
        for p in set().union(*own):
            n[p] = n.get(p, 0) + 1
    return sets, {p: math.log(1 + len(FAMILIES) / c) for p, c in n.items()}


_SETS, _WEIGHT = _weights()
_PLAIN_PAIR = 1.0  # weight of a pair that no template holds
_TEMPLATE_WEIGHT = [[sum(map(_WEIGHT.__getitem__, q)) for q in own] for own in _SETS]


def agreement(found: list[str]) -> list[tuple[float, float]]:
    """Per family (similarity, shared weight) of the words with its closest template.

    Similarity is the shared weight over the smaller side's: a finding may hold more than the notice,
    and a cut notice must still be mostly notice. One word agrees with nothing.
    """
    p = _pairs(found)
    if len(found) < 2:
        return [(0.0, 0.0)] * len(FAMILIES)
    known = {x for x in p if x in _WEIGHT}
    size = sum(_WEIGHT[x] for x in known) + _PLAIN_PAIR * (len(p) - len(known))
    out = []
    for own, totals in zip(_SETS, _TEMPLATE_WEIGHT, strict=True):
        best = (0.0, 0.0)
        for q, total in zip(own, totals, strict=True):
            shared = sum(_WEIGHT[x] for x in known & q)
            best = max(best, (shared / min(size, total), shared))
        out.append(best)
    return out


def _accepted(m: LicenseModel, grams: list[np.ndarray], first: np.ndarray, last: np.ndarray, accept: float,
              screened: bool = True) -> list[tuple[int, int, int, float]]:
    """(first word, last word, family, probability) of the windows that the classifier accepts."""
    hits = np.arange(len(first))
    # probability p against unknown needs log-odds of at least log(p / (1 - p))
    least = math.log(accept / (1 - accept)) / m.temperature - (m.b[:-1].max() - m.b[-1]) - 1e-4
    if screened and least > 0:
        # an n-gram that may repeat counts if it helps, and not in the length: a bound from above
        total, count = np.zeros(len(first)), np.zeros(len(first))
        for k, g in enumerate(grams):
            again, value = _may_repeat(g), m.screen[g]
            a = np.minimum(first, len(g))
            b = np.maximum(a, np.clip(last - k, 0, len(g)))
            for x, to in ((np.where(again, np.maximum(value, 0), value), total), (~again, count)):
                pre = np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))
                to += pre[b] - pre[a]
        hits = np.flatnonzero(total / np.sqrt(np.maximum(count, 1)) >= least)
    out = []
    for i in hits:
        u = _window_grams(grams, first[i], last[i])
        z = (m.w[u].sum(0) / np.sqrt(len(u)) + m.b) * m.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(np.argmax(p[:-1]))
        if p[best] >= accept:
            out.append((int(first[i]), int(last[i]), best, float(p[best])))
    return out


def paragraphs(m: LicenseModel, data: np.ndarray, off: np.ndarray, accept: float = ACCEPT,
               confirm: float = CONFIRM, screened: bool = True) -> list[tuple]:
    """(row, start byte, end byte, family, probability, similarity, confirmed) of the findings."""
    if not len(data):
        return []
    h, s, e, line, para = _words(data, off)
    if not len(h):
        return []
    low = X.lower(data).tobytes()
    said: dict[tuple, list] = {}
    for a, b, y, p in sorted(_accepted(m, _grams(h), *candidates(line, para), accept, screened)):
        said.setdefault((int(para[a]), y), []).append((a, b, p))
    spans: dict[int, set] = {}
    for (at, y), got in said.items():
        joined: list[tuple] = []
        for a, b, p in got:
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]), max(p, joined[-1][2]))
            else:
                joined.append((a, b, p))
        # a window by itself may be the cleaner finding than the touching ones together
        spans.setdefault(at, set()).update((a, b, y, p) for a, b, p in (*joined, *got))
    kept = []
    for at in sorted(spans):
        rated = []
        for a, b, y, p in spans[at]:
            found = [low[i:j].decode("utf-8", "replace") for i, j in zip(s[a:b], e[a:b], strict=True)]
            every = agreement(found)
            sim, shared = every[y]
            sure = sim >= confirm and shared >= max(w for _, w in every) - 1e-9
            rated.append((not sure, -round(shared, 6), b - a, -p, a, b, y, sim))
        mine: list[tuple] = []
        for unsure, _, _, p, a, b, y, sim in sorted(rated):
            if all(b <= c or a >= d for c, d, *_ in mine):
                mine.append((a, b, y, -p, sim, not unsure))
        for a, b, y, p, sim, sure in sorted(mine):
            i, j = int(s[a]), int(e[b - 1])
            kept.append((int(np.searchsorted(off, i, side="right") - 1), i, j, FAMILIES[y], p, sim, sure))
    return kept


def scan(docs: DataFrame, accept: float = ACCEPT, confirm: float = CONFIRM, unknown_lines: int = UNKNOWN_LINES) -> DataFrame:
    """doc_id, start, length (code points), family, probability, similarity, confirmed."""
    n = max(1, docs.count())
    share = min(1.0, unknown_lines / n)
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share >= 1))
    # one line of each sampled document with the two after it, cut to a bounded size
    pick = F.split(F.coalesce("text", F.lit("")), "\n")
    at = F.pmod(F.xxhash64("text"), F.size(pick)).cast("int")
    lines = some.select(F.left(F.array_join(F.slice(pick, at + 1, 3), "\n"), F.lit(400)).alias("l"))
    m = fit(sorted(r["l"] for r in lines.limit(2 * unknown_lines).collect() if r["l"]))  # bounded training sample

    def run(batches):
        for rb, data, off in X.slices(batches, "text"):
            rows = []
            for r, a, b, family, p, sim, ok in paragraphs(m, data, off, accept, confirm):
                rows.append((rb.column(0)[r].as_py(), X.code_points(data[off[r]:a]), X.code_points(data[a:b]), family, p, sim, ok))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [rb.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[
                    "doc_id", "start", "length", "family", "probability", "similarity", "confirmed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, family string, probability double, similarity double, confirmed boolean")
