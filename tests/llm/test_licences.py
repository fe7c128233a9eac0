import random

from tests.llm.cases import documents, none, rows
from triledger.llm import licences
from triledger.llm.licences import TEMPLATES, aligned, increasing, scan, scanned, words_of

KNOWN = {name: words_of(t) for name, t in TEMPLATES.items()}


def longest(pairs):
    """Length of the longest increasing part, by comparing all."""
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        for j in range(i):
            if pairs[j][1] < pairs[i][1]:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


def test_patience_finds_a_longest_increasing_sequence():
    rng = random.Random(1)
    for _ in range(200):
        order = list(range(rng.randrange(12)))
        rng.shuffle(order)
        pairs = list(enumerate(order))
        got = increasing(pairs)
        assert len(got) == longest(pairs) and got == sorted(got) and [b for _, b in got] == sorted(b for _, b in got)


def test_alignment_is_in_order_and_exact_on_equal_texts():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(15))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randrange(15))]
        pairs = aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
        assert aligned(a, a) == [(i, i) for i in range(len(a))]


def test_notices_are_found_in_prose_changed_a_little_and_repeated():
    rng = random.Random(3)
    for name, template in TEMPLATES.items():
        words = template.split()
        if len(words) > 5:
            words[rng.randrange(1, len(words))] = "changed"
        prose = [rng.choice(["the", "license", "sun", "under", "of"]) + "x" for _ in range(400)]
        text = " ".join([*prose, *words, *prose, *words])
        places = [(f[2], f[3]) for f in scan(text, KNOWN) if f[0] == name]
        if "changed" not in words or len(words) >= 6:
            assert len(places) == 2
            assert all(b - a < 2 * len(words) for a, b in places)


def test_prose_is_left_alone():
    assert scan("The license of the public house is under the general manager. " * 50, KNOWN) == []
    assert scan("Released under the MIT", KNOWN) == [("MIT", 0.8, 0, 3)]


def names(text):
    return {f[0] for f in scan(text, KNOWN)}


def test_other_licences_are_not_reported_under_a_wrong_name():
    for text, wrong in (
            ("Released under the BSD License.", "MIT"), ("Licensed under CC BY 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-NC-4.0"),
            ("Licensed under the Mozilla License, Version 2.0.", "Apache-2.0"), ("Licensed under the Apache License, Version 1.1.", "Apache-2.0"),
            ("This work is licensed under the GNU General Public License, version 2.", "GPL-3.0"),
            ("This work is licensed under the GNU Lesser General Public License, version 3.", "GPL-3.0")):
        assert wrong not in names(text) and wrong not in names("some words " * 30 + text + " more words" * 30), text


def test_versions_and_neighbours_do_not_hide_a_notice():
    assert "GPL-3.0" in names("This work is licensed under the GNU General Public License, version 3.0")
    assert "Apache-2.0" in names("Licensed under the Apache License, version 2")
    for before in range(12):
        text = "x " * before + "Released under the BSD License. Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0. Released under the MIT License."
        assert {"CC-BY-NC-4.0", "MIT"} <= names(text)
        assert names("x " * before + "Licensed under CC BY-NC 4.0. " * 3) == {"CC-BY-NC-4.0"}


PUBLISHED = {
    "BSD-3-Clause conditions": """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright
        holder nor the names of its contributors may be used to endorse or promote products derived from this software""",
    "BSD-2-Clause conditions": """2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" """,
    "ISC grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
        is distributed in the hope that it will be useful. See the GNU General Public License for more details.""",
    "GPL-2.0 header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "LGPL-2.1 header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "GPL-3.0 title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "BSD": "Released under the BSD License.", "CC-BY-4.0": "Licensed under CC BY 4.0.", "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 deed": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}


def test_published_notices_are_found_under_their_own_names(spark):
    texts = [*PUBLISHED.items(), *licences.ALL.items(), ("", PUBLISHED["BSD-3-Clause conditions"].replace(
        "3. Neither", "3. All advertising in print must name the makers. 4. Neither"))]
    docs = documents(spark, [(100 + i, "one two three four " * 30 + t + " five six seven" * 30, None, None, 0) for i, (_, t) in enumerate(texts)])
    got = {r["doc_id"]: {n["name"] for n in r["notices"]} for r in scanned(docs).collect() if (r["doc_id"] or 0) >= 100}
    for i, (name, _) in enumerate(texts):
        also = {"Apache-2.0"} if name == "Apache-2.0 header" else set()
        assert got[100 + i] == ({name} if name else set()) | also, name
    assert set(licences.REQUIRED) == set(licences.ALL)


def test_awkward_documents(spark):
    got = scanned(documents(spark, [(20, "x " * 50_000 + TEMPLATES["GPL-3.0"].upper(), None, None, 0)])).collect()
    assert len(got) == len(rows()) + 1
    assert [(n["name"], n["coverage"], n["first"]) for r in got if r["doc_id"] == 20 for n in r["notices"]] == [("GPL-3.0", 1.0, 50_000)]
    assert all(r["notices"] == [] for r in got if r["doc_id"] != 20)
    assert scanned(none(spark)).count() == 0
