"""License scans by patience alignment.

Words that occur once in both a stretch of text and a template are anchors; the longest increasing sequence of them aligns the
two, and the gaps between anchors are aligned again by the words that are unique there.  The share of the template's words that
get a partner is its coverage.  The phrases that tell a licence from others (name, version, variant) must be aligned whole,
whatever the coverage.  A text is looked at in stretches of twice the template's length that overlap by half, so a notice
that stands several times is found each time, and the work is linear in the text.
"""

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
_EDGES = ".,;:!?\"'()[]{}<>*#/-"
_VERSION = re.compile(r"v?(\d+)(?:\.0)?")

# Notices as they are commonly written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}
# Further notices, headers and beginnings of full texts, as the licences' stewards publish them.
MORE = {
    "Apache-2.0 title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause conditions": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY"),
    "BSD-3-Clause conditions": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. Neither the name of"),
    "BSD-4-Clause conditions": (
        "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    "ISC": "Released under the ISC License.",
    "ISC grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies"),
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at"),
    "MPL-2.0 title": "Mozilla Public License Version 2.0 1. Definitions",
    **{f"{short}-{version}.0": f"This work is licensed under the GNU {name} General Public License, version {version}."
       for short, name, version in (("GPL", "", 2), ("LGPL", "Lesser", 3), ("AGPL", "Affero", 3))},
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    **{f"{name} header": (
        "is free software; you can redistribute it and/or modify it under the terms of the "
        f"GNU {kind} General Public License as published by the Free Software Foundation, either version {version} of the License")
       for name, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"),
                                   ("AGPL-3.0", "Affero", "3"))},
    **{f"GPL-{version}.0 header, one version": (
        f"under the terms of the GNU General Public License version {version} as published by the Free Software Foundation") for version in (2, 3)},
    **{f"{name} title": f"GNU {kind} GENERAL PUBLIC LICENSE Version {version}, {date} Copyright (C)"
       for name, kind, version, date in (("GPL-2.0", "", "2", "June 1991"), ("GPL-3.0", "", "3", "29 June 2007"), (
           "LGPL-2.1", "LESSER", "2.1", "February 1999"), ("LGPL-3.0", "LESSER", "3", "29 June 2007"), ("AGPL-3.0", "AFFERO", "3", "19 November 2007"))},
    **{f"CC-{kind}-4.0": f"Licensed under CC {kind} 4.0." for kind in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    **{f"CC-{kind}-4.0 deed": f"This work is licensed under a Creative Commons {name} 4.0 International License."
       for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                          ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                          ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
    "CC0-1.0": "Released under CC0 1.0 Universal.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
ALL = {**TEMPLATES, **MORE}
# By template: phrases of it that no other licence has.
REQUIRED = {
    "Apache-2.0": ["Apache", "2.0"],
    "Apache-2.0 header": ["Apache", "2.0"],
    "GPL-3.0": ["GNU General Public License", "3"],
    "MIT": ["MIT"],
    "MIT grant": ["deal in the Software"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "Apache-2.0 title": ["Apache License", "2.0"],
    "BSD-2-Clause": ["BSD 2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause"],
    "BSD": ["BSD License"],
    "BSD-2-Clause conditions": ["the distribution. THIS SOFTWARE"],
    "BSD-3-Clause conditions": ["the distribution. Neither the name"],
    "BSD-4-Clause conditions": ["advertising materials"],
    "ISC": ["ISC"],
    "ISC grant": ["for any purpose with or without fee"],
    "MPL-2.0": ["Mozilla Public License", "2.0"],
    "MPL-2.0 header": ["Mozilla Public License", "2.0"],
    "MPL-2.0 title": ["Mozilla Public License", "2.0"],
    **{f"{name}{form}": [f"GNU {kind} General Public License", version]
       for name, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"),
                                   ("AGPL-3.0", "Affero", "3")) for form in ("", " header", " title")},
    **{f"GPL-{version}.0 header, one version": [f"GNU General Public License version {version}"] for version in (2, 3)},
    **{f"CC-{kind}-4.0": [f"CC {kind} 4.0"] for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")},
    **{f"CC-{kind}-4.0 deed": [f"Creative Commons {name} 4.0"]
       for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                          ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                          ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
    "CC0-1.0": ["CC0 1.0"],
    "Unlicense": ["free and unencumbered software"],
}


def words_of(text: str) -> list[str]:
    """Lower-case words without punctuation around them; versions without a v before or a .0 behind."""
    words = (w for t in text.lower().split() if (w := t.strip(_EDGES)))
    return [m[1] if w[-1].isdigit() and (m := _VERSION.fullmatch(w)) else w for w in words]


def places_of(phrases: list[str], template: list[str]) -> list[range]:
    """Where the phrases stand in a template."""
    out = []
    for words in map(words_of, phrases):
        at = [j for j in range(len(template) - len(words) + 1) if template[j:j + len(words)] == words]
        if not words or not at:
            raise ValueError(f"{' '.join(words)!r} is not in the template {' '.join(template)!r}")
        out.append(range(at[0], at[0] + len(words)))
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of the pairs, sorted by their first number, whose second numbers increase (patience sorting)."""
    tops, heap, before = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        before[i] = heap[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            heap.append(i)
        else:
            tops[k], heap[k] = b, i
    out, i = [], heap[-1] if heap else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Partners (place in a, place in b) by patience alignment, in order."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        # Equal words at both ends need no anchors.
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if k > i + 1 and m > j + 1]
    return sorted(out)


def whole(pairs: list[tuple[int, int]], stretch: list[str], places: list[range]) -> bool:
    """Whether all places of the template have partners in a row, but for the number or letter of a clause between them."""
    partner = {j: i for i, j in pairs}

    def adjoin(j: int) -> bool:
        i, k = partner[j], partner[j + 1]
        return k == i + 1 or k == i + 2 and len(stretch[i + 1]) == 1

    return all(all(j in partner for j in p) and all(adjoin(j) for j in p[:-1]) for p in places)


def scan(text: str | None, templates: dict[str, list[str]], least: float = COVERAGE,
         required: dict[str, list[str]] | None = None) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first word, last word) of every notice, at most one per stretch; touching finds are one.

    `required` has phrases by template, by default those of REQUIRED.
    """
    words, out = words_of(text or ""), []
    known = set(words)
    required = REQUIRED if required is None else required
    for name, template in templates.items():
        n = len(template)
        # A coverage needs so many of the template's words somewhere in the text.
        if not n or sum(w in known for w in template) < least * n:
            continue
        places = places_of(required.get(name, []), template)
        if any(template[j] not in known for p in places for j in p):
            continue

        def notice(begin: int, end: int) -> list[tuple[int, int]]:
            stretch = words[begin:end]
            pairs = aligned(stretch, template)
            return [(begin + i, j) for i, j in pairs] if len(pairs) >= least * n and whole(pairs, stretch, places) else []

        found = []
        for begin in range(0, max(1, len(words) - n + 1), n):
            stretch = words[begin:begin + 2 * n]
            if sum((Counter(template) & Counter(stretch)).values()) < least * n:
                continue
            pairs = notice(begin, begin + 2 * n)
            if not pairs and places:
                # Neighbouring notices share words, which are no anchors then: stretches of one length around the first phrase.
                j = places[0][0]
                starts = (max(0, i - j) for i, w in enumerate(stretch, begin) if w == template[j])
                pairs = next((p for i in starts if (p := notice(i, i + n))), [])
            if pairs:
                first, last = pairs[0][0], pairs[-1][0]
                if found and first <= found[-1][3]:
                    best = max(found.pop(), (name, len(pairs) / n, first, last), key=lambda f: f[1])
                    found.append(best)
                else:
                    found.append((name, len(pairs) / n, first, last))
        out += found
    return sorted(out, key=lambda f: (f[2], f[3], f[0]))


def scanned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, templates: dict[str, str] | None = None,
            least: float = COVERAGE, required: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id and `notices` of every row: array of (name, coverage, first, last), places counted in words of the whole text.

    Null and empty texts and texts without notices get an empty array; repeated rows stay; other columns are not read.
    `required` has phrases by template that must be there whole: those of REQUIRED with the notices of ALL, else none by default.
    """
    known = {name: words_of(t) for name, t in (templates or ALL).items()}
    phrases = required if required is not None else {} if templates else REQUIRED
    for name, template in known.items():
        places_of(phrases.get(name, []), template)
    kind = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("name", "coverage", "first", "last"), f, strict=True)) for f in scan(t.as_py(), known, least, phrases)]
                     for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "notices"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, notices array<struct<name: string, coverage: double, first: long, last: long>>")
