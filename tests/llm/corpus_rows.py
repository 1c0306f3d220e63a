"""Rows of documents that hold every edge case at least once."""

import random


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """(doc_id, text): nulls, empty and long texts, copies, near copies, shared passages, ties."""
    rng = random.Random(3)
    passage = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "one"), (5, "Two  Words\n"), (6, "one")]
    rows += [(10 + k, prose(rng, rng.randrange(20, 200))) for k in range(20)]
    rows += [(40 + k, prose(rng, 30) + "\n" + passage + " " + prose(rng, 20)) for k in range(8)]
    base = prose(rng, 150).split()
    for k in range(12):  # near copies, each with a few words changed
        own = list(base)
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = f"new{k}"
        rows.append((60 + k, " ".join(own)))
    rows += [(80, "word " * 300), (81, ("a b c d e f g h i j k l m n o p q r s t u v " * 9).strip())]
    rows += [(82, prose(rng, 30_000, 5_000)), (90, rows[8][1]), (91, rows[8][1].upper()), (95, "ünï çödé ★ " * 20)]
    rows += [(None, prose(rng, 80)), (None, passage)]
    return rows
