"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

WORDS = "the of and to in is that for with was stone river light house garden window paper mountain silver winter".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, size string, _id string, fp string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows():
    texts = [prose(k, 30 + k) for k in range(12)]
    made = [(k, t, ("en", "de", "fr")[k % 3], f"s{k % 4}") for k, t in enumerate(texts)]
    made += [
        (20, None, "en", "s1"), (21, "", None, None), (22, "  \t\n ", "en", "s0"), (23, texts[0].replace(" ", " \n "), "en", "s0"), (24, texts[0], "en", None), (24, texts[0], "en", None),
        (None, texts[1], "de", "s2"), (25, "1234 !!", "fr", "s3"), (26, prose(99, 6000), "en", "s0"), (27, "word", "de", "s1"), (28, texts[2] + " Σ é 日本", "fr", "s2"),
    ]
    return [(d, t, lang, s, None if t is None else len(t), "x", "x", "x", "x", "x") for d, t, lang, s in made]


def docs(spark):
    return spark.createDataFrame(rows(), DOC)


def no_docs(spark):
    return spark.createDataFrame([], DOC)
