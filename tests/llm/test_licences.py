import math
import random
import re
from collections import Counter

import pytest

from tablecensus.llm import licence_texts
from tablecensus.llm.licences import LETTERS_OF_NO_WORD, TEMPLATES, _weights, scan_licences

FILES = "path string, text string"


def words(text):
    return [w for w in (text or "").lower().translate(str.maketrans({c: " " for c in LETTERS_OF_NO_WORD})).split(" ") if w]


def own(texts):
    """Licence and score of each text, by comparing every line with every notice."""
    df = Counter(w for t in texts for w in set(words(t)))
    vocabulary = {w for n in TEMPLATES.values() for w in words(n)}
    idf = lambda w: math.log((len(texts) + 1) / ((df[w] if w in vocabulary else 0) + 1))

    def vector(text):
        v = {w: n * idf(w) for w, n in Counter(words(text)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    notices = {name: vector(n) for name, n in TEMPLATES.items()}
    found = []
    for t in texts:
        best = (0.0, None)
        for line in re.split(r"\n|(?<=[.!?])\s+", t or ""):
            v = vector(line)
            for name, n in sorted(notices.items()):
                score = round(sum(x * n.get(w, 0) for w, x in v.items()), 9)
                if score >= 0.75 and score > best[0] + 1e-12:
                    best = (score, name)
        found.append(best[::-1] if best[1] else (None, None))
    return found


def scanned(spark, rows, **options):
    df = spark.createDataFrame(rows, FILES)
    return {r.path: r for r in scan_licences(df, **options).collect()}


def test_lines_against_brute_force(spark, prose):
    texts = [prose(i, 60) for i in range(40)]
    notices = list(TEMPLATES.values())
    for i in range(13):
        texts[i] = [f"{notices[i]}.\n{texts[i]}", f"{texts[i]}\n# {notices[i].upper()}", f"{texts[i]}. {notices[i]}. {texts[i]}"][i % 3]
    texts[20] = "licensed " + texts[20]
    texts[21] = texts[21] + "\nThis project is licensed under terms of the MIT License by its authors"
    texts[22] = texts[22] + "\nLicensed under the Apache License"
    out = scanned(spark, [(f"d/{i}", t) for i, t in enumerate(texts)])
    want = own(texts)
    for i, (licence, score) in enumerate(want):
        assert (out[f"d/{i}"].licence, out[f"d/{i}"].licence_origin) == (licence, "own" if licence else "none")
        assert out[f"d/{i}"].licence_score == (pytest.approx(score, abs=1e-8) if licence else None)
    assert [w[0] for w in want[:13]] == list(TEMPLATES)


def test_nearest_ancestor(spark, prose):
    mit, apache, gpl = (f"{TEMPLATES[k]}.\n" for k in ("MIT", "Apache-2.0", "GPL-3.0"))
    code = lambda i: prose(i, 40)
    rows = [
        ("LICENSE", gpl + code(1)), ("top.py", code(2)), ("a/LICENSE.txt", mit + code(3)), ("a/x.py", code(4)), ("a/b/c/y.py", code(5)),
        ("a/b/z.py", apache + code(6)), ("a/b/COPYING", code(7)), ("ab/q.py", code(8)), ("a/d/notes", apache), ("a/d/w.py", code(9)),
        ("e/LICENSE", apache), ("e/COPYING", mit), ("e/v.py", code(10)),
    ]
    out = {p: (r.licence, r.licence_origin, r.licence_from) for p, r in scanned(spark, rows).items()}
    assert out["top.py"] == ("GPL-3.0", "inherited", "LICENSE") == out["ab/q.py"]
    assert out["a/x.py"] == ("MIT", "inherited", "a/LICENSE.txt") == out["a/b/c/y.py"] == out["a/b/COPYING"]
    assert out["a/b/z.py"] == ("Apache-2.0", "own", None)  # a header speaks for its file only
    assert out["a/d/w.py"] == ("Apache-2.0", "inherited", "a/d/notes")  # nothing but a notice
    assert out["e/v.py"] == ("Apache-2.0", "inherited", "e/LICENSE")


def test_odd_rows(spark, odd):
    notice = TEMPLATES["MIT"] + "."
    rows = [(f"o/{i}", t) for i, t in enumerate(odd)] + [(None, notice), (None, "x"), ("", notice), ("p", None), ("p", None), ("/r/s", "y")]
    rows += [("long/f", "word " * 50_000 + "\n" + notice), ("o//t", "z")]
    df = spark.createDataFrame(rows, FILES).selectExpr("*", "'c' AS licence", "1 AS row", "2 AS at", "3 AS file", "4 AS word", "5 AS directory")
    out = scan_licences(df).collect()
    assert len(out) == len(rows)
    got = sorted(((r.path, r.licence_origin) for r in out), key=repr)
    want = [(f"o/{i}", "inherited") for i in range(len(odd))] + [(None, "own"), (None, "none"), ("", "own"), ("p", "inherited"), ("p", "inherited")]
    want += [("/r/s", "inherited"), ("long/f", "own"), ("o//t", "inherited")]
    assert got == sorted(want, key=repr)
    assert scan_licences(df.limit(0)).count() == 0
    assert set(r.row for r in out) == {1}


def test_no_python_on_executors(spark):
    plan = scan_licences(spark.createDataFrame([("a/b", "x")], FILES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
APACHE = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

   http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def commented(mark, text):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n")) + "\n"


def test_headers_and_whole_files(spark, prose):
    code = lambda i: prose(i, 200)
    whole = licence_texts.whole
    mine = lambda name: whole(name).replace("Copyright (c)", "Copyright (c) 2021-2024 Jane Roe and others of Example Ltd")
    affero = GPL.replace("GNU General", "GNU Affero General")
    lesser = GPL.replace("GNU General", "GNU Lesser General")
    bsd = mine("BSD-3-Clause")
    cases = {
        "GPL-3.0": ["#!/bin/sh\n# Copyright 2020 J Roe\n#\n" + commented("#", GPL) + code(1), "/*\n" + commented(" *", GPL) + " */\n" + code(2),
                    "x = 1\n" + commented("//", GPL) + code(3), whole("GPL-3.0"), code(4) + "\n\n" + GPL + "\n\n" + code(5)],
        "GPL-2.0": [commented("#", GPL.replace("version 3", "version 2")) + code(6), whole("GPL-2.0"), "# SPDX-License-Identifier: GPL-2.0-only\n" + code(7)],
        "AGPL-3.0": [commented("//", affero) + code(8)],
        "LGPL-3.0": [commented(";;", lesser) + code(9), whole("LGPL-3.0")],
        "Apache-2.0": ["/*\n" + commented(" *", APACHE) + " */\n" + code(10), "<!--\n" + APACHE + "\n-->\n" + code(11), whole("Apache-2.0"),
                       whole("Apache-2.0")[:600], "// SPDX-License-Identifier: Apache-2.0\n" + code(12)],
        "MPL-2.0": ["/* " + MPL.replace("\n", "\n * ") + " */\n" + code(13), whole("MPL-2.0")],
        "MIT": [mine("MIT"), mine("MIT").split("\n", 2)[2], commented("#", mine("MIT")) + code(14), "/* SPDX-License-Identifier: MIT */\n" + code(15)],
        "BSD-3-Clause": [bsd, bsd[bsd.index("Redistribution") : bsd.index("THIS SOFTWARE")], '"""' + bsd + '"""\n' + code(16)],
        "BSD-2-Clause": [mine("BSD-2-Clause")],
        "ISC": [mine("ISC")],
        None: ["# SPDX-License-Identifier: Unheard-Of\n" + code(17), "# software of the Example foundation\n" + code(18), code(19)],
    }
    rows = [(f"{name}/{i}", t) for name, several in cases.items() for i, t in enumerate(several)]
    out = scanned(spark, rows + [(f"other/{i}", code(100 + i)) for i in range(60)])
    got = {p: (r.licence if r.licence_origin == "own" else None) for p, r in out.items()}
    assert {p: got[p] for p, _ in rows} == {f"{name}/{i}": name for name, several in cases.items() for i in range(len(several))}
    assert not any(got[f"other/{i}"] for i in range(60))


def test_whole_file_speaks_for_its_directory(spark, prose):
    text = licence_texts.whole("MIT").split("\n", 2)[2].replace("Copyright (c)", "Copyright (c) 2024 Jane Roe")
    rows = [("a/LICENSE", text), ("a/b/x.py", prose(1, 100)), ("c/terms", text), ("c/y.py", prose(2, 100)), ("d/z.py", prose(3, 100))]
    out = scanned(spark, rows + [(f"o{i}/{i}", prose(i, 50)) for i in range(10, 40)])
    assert [(out[p].licence, out[p].licence_from) for p in ("a/b/x.py", "c/y.py", "d/z.py")] == [("MIT", "a/LICENSE"), ("MIT", "c/terms"), (None, None)]


def test_templates_of_the_caller(spark, prose):
    """None of these has a word that the built-in notices have in common."""
    mine = {"Unlicense": "This is free and unencumbered software released into the public domain",
            "ISC": "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted",
            "Zlib": "This software is provided as-is, without any express or implied warranty"}
    rows = [(f"{name}/f", f"{prose(i, 40)}\n{text}.\n{prose(i + 10, 40)}") for i, (name, text) in enumerate(mine.items())]
    out = scanned(spark, rows + [(f"o/{i}", prose(i, 50)) for i in range(20, 50)], templates=mine, texts={}, tags={})
    assert {p: r.licence for p, r in out.items() if r.licence_origin == "own"} == {f"{name}/f": name for name in mine}


def test_no_match_without_an_anchor():
    draw = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)]
    for _ in range(300):
        idf = {w: draw.choice([0.0, 0.3, 1.0, draw.random() * 8]) for w in vocabulary}
        counts = Counter(draw.choices(vocabulary, k=draw.randrange(1, 15)))
        least = draw.choice([0.3, 0.75, 0.9])
        rows, anchors = _weights([("x", counts, set())], idf, least)
        # the nearest unit without an anchor is the rest of the form itself
        rest = [weight for _, _, w, weight, _, _ in rows if w not in anchors]
        assert math.sqrt(sum(x * x for x in rest)) < least
