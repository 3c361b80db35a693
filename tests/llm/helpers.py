"""Small corpora with repeats, near copies, nulls, empty and long texts."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int"


def corpus(seed: int = 5, docs: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = [a + b for a in ("ka", "to", "ri", "mé", "SU") for b in ("n", "lo", "", "st", "ü.")] + ["the", "of"]

    def prose(n: int) -> list[str]:
        return [rng.choice(words) for _ in range(n)]

    passage, rows = prose(60), []
    for i in range(docs):
        text = prose(rng.choice([0, 3, 34, 35, 36, 120, 400]))
        if i % 4 == 0:
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage[rng.randrange(30):]
        if i % 7 == 3 and rows and rows[-1][1]:
            text = rows[-1][1].split()
            if i % 2:
                text[rng.randrange(len(text))] = "edited"
        if i % 11 == 5:
            text += ["again"] * 50
        rows.append((i, rng.choice([" ", "\n", "\x0b", "  "]).join(text)))
    rows += [(docs, None), (docs + 1, ""), (docs + 2, " \t\n"), (docs + 3, " ".join(prose(9000))), (docs + 4, rows[8][1]), (docs + 5, rows[8][1]), (8, rows[8][1])]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


def documents(spark, rows: list[tuple] | None = None):
    rows = corpus() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(5)
