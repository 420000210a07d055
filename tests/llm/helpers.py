"""Small tables for the operator tests: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, _keep string, label string, node bigint, n bigint"


def vocabulary(seed: int, n: int = 400) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["ka", "lo", "mi", "té", "ru", "Ben", "sho", "wa"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def texts(seed: int, n: int = 60) -> list[str]:
    """Random texts, with exact copies, near copies and a passage that several share."""
    r, words = random.Random(seed), vocabulary(seed)
    passage = " ".join(r.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.choice([1, 3, 5, 40, 200, 700]))]
        kind = i % 6
        if kind == 1 and out:
            out.append(r.choice(out))
            continue
        if kind == 2 and out:
            w = r.choice(out).split()
            for _ in range(r.randint(1, 1 + len(w) // 30)):
                w[r.randrange(len(w))] = r.choice(words)
        text = " ".join(w) + r.choice(["", ".", "\n"])
        if kind == 3:
            text = text + " " + passage + " " + r.choice(words)
        out.append(text)
    return out


def documents(spark, seed: int = 1, extra=()):
    """(DataFrame, [(doc_id, text)]) with columns whose names clash with the operators' own."""
    rows = [*enumerate(texts(seed)), (900, None), (901, ""), (902, " \t\n "), (903, "x"), *extra]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame([(i, t, "en", "k", "l", 5, 6) for i, t in rows], DOCS).repartition(5), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)
