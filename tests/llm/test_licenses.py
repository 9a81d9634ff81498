"""Licence scans against every window of every template."""

from __future__ import annotations

import re
from collections import Counter

from tidelog.llm.licenses import TEMPLATES, THRESHOLD, dice, scan

SCHEMA = "doc_id long, text string, matches string"


def normal(text):
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).split()


def pairs(words):
    return [tuple(words[i : i + 2]) for i in range(len(words) - 1)]


def brute(text):
    one = pairs(normal(text))
    found = []
    for t, (_, template) in enumerate(TEMPLATES):
        other = pairs(normal(template))
        n = min(len(other), len(one))
        for at in range(len(one) - n + 1 if n else 0):
            value = dice(Counter(one[at : at + n]), Counter(other))
            if value >= THRESHOLD:
                found.append((value, t, at, n))
    taken, chosen = set(), []
    for v, t, at, n in sorted(found, key=lambda m: (-m[0] * m[3], -m[0], m[1], m[2])):
        if not taken & set(range(at, at + n)):
            taken |= set(range(at, at + n))
            chosen.append((at, TEMPLATES[t][0], round(v, 6), n + 1))
    return [(name, v, at, n) for at, name, v, n in sorted(chosen)]


def test_same_as_brute_force(spark):
    mit, bsd = TEMPLATES[0][1], TEMPLATES[1][1]
    prose = "the of in that this was with for " * 12
    texts = [
        f"{prose}\nReleased under the MIT License.\n{prose}", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3. And so on. Licensed under the Apache License, Version 2.0.",
        mit, mit.replace("Software", "Program"), f"{prose} {mit} {prose} {bsd}", TEMPLATES[2][1].upper(), " ".join(mit.split()[:60]), prose, "", None, "license", "MIT", "Licensed under", "É Released under the MIT License. É",
        "This work is licensed under the GNU General Public License, version 3.", "released under the mit license " * 5,
    ]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[1], "x")]
    got = scan(spark.createDataFrame(rows, SCHEMA)).collect()
    ours = sorted(((r["doc_id"], r["n_matches"], [tuple(m) for m in r["matches"]]) for r in got), key=str)
    theirs = sorted(((i, len(brute(t)), brute(t)) for i, t, _ in rows), key=str)
    assert ours == theirs
    by = {r["doc_id"]: [m["license"] for m in r["matches"]] for r in got if r["doc_id"] is not None}
    assert by[0] == ["MIT"] and by[1] == ["CC-BY-NC-4.0"] and by[2] == ["GPL-3.0", "Apache-2.0"] and by[5] == ["MIT", "BSD-3-Clause"] and by[6] == ["BSD-2-Clause"] and by[8] == []


def test_empty(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_better_match_wins_and_other_wordings(spark):
    notice = TEMPLATES[6][1]
    texts = {
        "LGPL-2.1": notice.replace("GNU General", "GNU Lesser General").replace("program", "library").replace("version 2", "version 2.1"),
        "AGPL-3.0": TEMPLATES[5][1].replace("GNU General", "GNU Affero General"),
        "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.", "CC-BY-ND-3.0": "Licensed under CC BY-ND 3.0.", "MIT": "Distributed under the MIT License.",
        "GPL-3.0": "This program is licensed under the GNU General Public License, version 3.", "BSD-3-Clause": "Licensed under the BSD 3-Clause License.", "GPL-2.0": notice,
        "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    }
    rows = [(i, t, "x") for i, t in enumerate(texts.values())]
    got = {r["doc_id"]: [m["license"] for m in r["matches"]] for r in scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(rows))] == [[name] for name in texts]
