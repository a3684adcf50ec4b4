"""Collocations against a plain count, with slices and bit filters so small that they matter."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewright.llm import collocations

from .fixtures import DOC, docs, no_docs


def expected(table, least, first, percent):
    total, f = Counter(), Counter()
    for _, text, lang, *_ in table:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            ws = [w for w in re.split("[\x20\x09]+", piece) if w]
            total[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in range(1, 5) for i in range(len(ws) - k + 1))
    candidates = {p: n for p, n in f.items() if len(p) > 2 and n >= least}
    out = []
    for lang in total:
        left = []
        for (_, *ws), a in ((p, n) for p, n in candidates.items() if p[0] == lang):
            if any(100 * n >= percent * a for (l, *other), n in candidates.items() if l == lang and len(other) > len(ws) and any(other[i : i + len(ws)] == ws for i in range(len(other)))):
                continue
            cuts = [(2_000_000 * a // (f[(lang, *ws[:k])] + f[(lang, *ws[k:])]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            left.append((-score, -a, " ".join(ws).encode(), f[(lang, *ws[:k])], f[(lang, *ws[k:])]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(left)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def made(seed, n=80):
    r = random.Random(seed)
    phrases = ["New York City", "new york", "of the", "in spite of the", "Éa ß日", "a", "b c", "to be or not", "x" * 40]
    rows = []
    for k in range(n):
        text = "".join(r.choice(phrases) + r.choice([" ", " ", " ", "\t", ", ", "\n", ".", " \x0b", "  "]) for _ in range(r.randrange(60)))
        rows.append((k if k % 9 else None, text if k % 11 else None, r.choice(["en", "en", "de", None, "und"]), "s", 1, "x", "x", "x", "x", "x"))
    return [*rows, rows[3], rows[3], (k, "", "en", "s", 1, "x", "x", "x", "x", "x")]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("seed, first", [(1, 2000), (2, 5)])
def test_collocations_equal_a_plain_count(spark, seed, first):
    table = made(seed)
    got = collocations.collocations(spark.createDataFrame(table, DOC).repartition(3), least=6, first=first)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == expected(table, 6, first, 80)


def test_slices_hold_each_phrase_once(monkeypatch):
    text = "".join(f"w{k % 7}" + " .\t;  "[k % 6] for k in range(500)).encode()
    whole = {k: dict(zip(*map(list, _plain(text, k)))) for k in (1, 2, 3, 4)}
    for size in (1, 7, 40, 333):
        monkeypatch.setattr(collocations, "SLICE", size)
        for k in (1, 2, 3, 4):
            got = Counter()
            for part in collocations._slices(text, k):
                got.update(dict(zip(*map(list, _plain(part, k)))))
            assert got == whole[k]


def test_a_full_filter_prunes_nothing_and_an_empty_one_all():
    text = "a b a c, a b a".encode()
    full, empty = np.full(1 << (collocations.FILTER_BITS - 6), ~np.uint64(0)), np.zeros(1 << (collocations.FILTER_BITS - 6), np.uint64)
    for k in (2, 3, 4):
        phrases, counts = collocations.phrase_counts("en", text, k, full)
        want = Counter()
        for piece in (b"a b a c", b"a b a"):
            ws = piece.split()
            want.update(b" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1))
        assert dict(zip(phrases.to_pylist(), counts.tolist())) == want
        assert len(collocations.phrase_counts("en", text, k, empty)[0]) == 0


def _plain(text, k):
    found = Counter()
    for piece in re.split(rb"[.,;:!?\x0a-\x0d]", text):
        ws = piece.split()
        found.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return found.keys(), found.values()


def test_no_frequent_phrase_gives_no_rows(spark):
    assert collocations.collocations(no_docs(spark)).count() == 0
    assert collocations.collocations(docs(spark), least=10**6).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9 * 10**18
    known = spark.createDataFrame([("en", "p", big), ("en", "q", big - 1), ("en", "p q", big - 2)], "lang string, phrase string, f long")
    row = collocations._scored(known.where("phrase = 'p q'").selectExpr("lang", "phrase", "f as a", "2 as size"), known).first()
    assert row["best"]["score"] == 2_000_000 * (big - 2) // (2 * big - 1)
