"""Small documents with the cases that matter."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed: int = 0, families: int = 12) -> list[tuple]:
    """Copies, near copies, shared passages, short, empty, null and repeated rows, odd spaces, and a long text."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ñandú", "漢字"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts: list[str | None] = []
    passages = [prose(rng.choice([30, 34, 35, 36, 60])) for _ in range(5)]
    for _ in range(families):
        base = prose(rng.choice([6, 9, 20, 60, 150, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            near = list(base)
            for _ in range(rng.randrange(0, 1 + len(near) // 20)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "\t "]).join(near))
        host = prose(80)
        at = rng.randrange(80)
        texts.append(" ".join(host[:at] + rng.choice(passages) + host[at:]))
    texts += [None, "", "   ", "one", "one two", "one two three four", "One TWO three four", "one two three four five", "a " * 120, "x y " * 90]
    texts += [" ".join(prose(6000)), "line one here\n" * 60, " \u0085 odd\x0bspaces\x1c here   too"]
    rows = [(i, t, rng.choice(["en", "de"]), "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (5, "another text under a repeated id", "en", "s", 32), (None, rows[1][1], "en", "s", 3), (None, "text without an id", None, None, None)]
    return rows
