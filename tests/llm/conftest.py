from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, node string, removed int, score string, row string"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from ``(doc_id, text)`` with further columns of names that operators use inside."""
    def make(rows):
        return spark.createDataFrame([(i, t, "n", 7, "s", "r") for i, t in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def prose():
    """Documents with exact and near copies, shared passages, short, empty and null texts, repeated rows."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(1, 7))) for _ in range(400)]
    words = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    passage, rows = words(60), [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two three")]
    base = words(150)
    for i in range(10, 60):
        copy = list(base)
        for _ in range(draw.randrange(6)):
            copy[draw.randrange(150)] = draw.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    for i in range(60, 120):
        text = words(draw.randrange(5, 80))
        at = draw.randrange(len(text))
        rows.append((i, "  ".join(text[:at] + passage[draw.randrange(20) :] + text[at:]) + "\n"))
    rows += [(i, rows[i - 110][1]) for i in range(150, 160)]
    rows.append((200, " ".join(words(5) * 3000)))
    return rows + rows[20:23]
