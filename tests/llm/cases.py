"""Hand-made documents: nulls, empty and very long texts, repeated rows, odd scripts, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, key string, score string"
WORDS = "the cat sat on a mat and the dog ran over green hills while rain fell softly upon old stone houses near rivers".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def texts() -> list[tuple]:
    long = prose(1, 30_000)
    base = prose(2, 60)
    out = [None, "", "   \n\t", "one", "two words", base, base, base.upper(), base.replace("cat", "dog", 1) + " end", long, "don't  we'll 's 'S\n\n x's １２３ naïve 中文字 😀😀   z", "aaaaaaaaaaaaaaaaaaaa", "la maison du chat est là " * 6, "\x1c\x85\r\n end", base + "\n" + base]
    return [(i, t, "en" if i % 2 else None, None if i == 3 else "src", None if i == 4 else len(t or ""), "x", "y", "z", "s") for i, t in enumerate(out)]


def frame(spark):
    rows = texts()
    rows.append(rows[5])  # a repeated row
    rows.append((None, "no key here", "en", "src", 11, "x", "y", "z", "s"))
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
