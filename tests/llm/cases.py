"""Documents with every edge case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

EXTRA = ["id", "h", "th", "key", "bands", "marks", "seeds", "words", "wh", "grams", "node", "a", "b", "host", "sha1", "v", "dim", "shard", "block", "rank", "score", "lines"]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") + ("\n" if i % 40 == 39 else "") for i, w in enumerate(words))


def texts() -> list[tuple]:
    base, shared = prose(120, 1), prose(60, 2)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, base),
        (2, base),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, " ".join(near)),
        (7, "one two three"),
        (7, "one two three"),
        (None, prose(50, 3)),
        (None, None),
        (8, prose(8000, 4)),
        (9, prose(50, 5) + "\n" + shared + "\n" + prose(30, 6)),
        (10, prose(20, 7) + " " + shared),
        (11, "Ünïcödé wörds — 日本語 テキスト 😀 " * 30),
        (12, "a b c d e " * 20),
        (13, "no-break space is a word\x0b\x0cand\rthese part words"),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    fields = ", ".join(["doc_id long", "text string", *[f"{c} string" for c in EXTRA]])
    return spark.createDataFrame([(i, t, *["x"] * len(EXTRA)) for i, t in rows], fields).repartition(3)
