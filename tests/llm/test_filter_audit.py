"""The filter audit against a plain loop over documents and orders, on rows with nulls, repeats and clashing columns."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from tidewright.llm import filter_audit, words

from .fixtures import docs, no_docs, prose, rows


def fails(doc_id, text, everyone):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    found = {
        "A": len(ws) < 50,
        "B": 100 * len(set(ws)) < 65 * len(ws),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t in everyone),
    }
    return {k for k, v in found.items() if v}


def expected(table, marks):
    everyone = [(r[0], r[1]) for r in table]
    known = [(r[3] or "", fails(r[0], r[1] or "", everyone), *marks.get(r[0], (0, 0))) for r in table]
    out = set()
    for part in {k[0] for k in known}:
        own = [k[1:] for k in known if k[0] == part]
        removed_at = {o: [next((s for s, x in enumerate(o) if x in f), 9) for f, _, _ in own] for o in map("".join, permutations("ABCDE"))}
        total = {x: sum(s < 9 and o[s] == x for o, at in removed_at.items() for s in at) for x in "ABCDE"}
        for o, at in removed_at.items():
            for s, x in enumerate(o):
                here = [k for k, a in zip(own, at) if a == s]
                out.add((part, o, s + 1, sum(a > s for a in at), len(here), sum(x in k[0] and a < s for k, a in zip(own, at)), sum(k[0] == {x} for k in own), sum(k[1] for k in here), sum(k[2] for k in here), total[x]))
    return out


def test_the_audit_equals_a_plain_loop(spark):
    table = [*rows(), (30, "Aa " * 60, "en", "s0", 1, "x", "x", "x", "x", "x"), (31, "$ " + prose(5, 80), "en", "", 1, "x", "x", "x", "x", "x"), (32, "$ " + prose(5, 80), "de", None, 1, "x", "x", "x", "x", "x")]
    table += [(None, "$ " + prose(5, 80), "de", "s9", 1, "x", "x", "x", "x", "x"), (33, "ÄÖÜ ABC é", "de", "s9", 1, "x", "x", "x", "x", "x")]
    marks = {0: (1, 0), 3: (0, 1), 24: (1, 1), 31: (1, 0), 32: (0, 1)}
    labels = spark.createDataFrame([*((k, q, t) for k, (q, t) in marks.items()), (0, None, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(spark.createDataFrame(table, docs(spark).schema), labels)
    assert {tuple(r) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()} == expected(table, marks)


def test_no_documents_give_no_rows(spark):
    assert filter_audit.filter_audit(no_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_inverting_the_parity_sums_gives_the_cells(spark):
    counted = spark.createDataFrame([("p", m, 7 * m * m % 31, m % 3, m % 2) for m in range(32)], "part string, fails int, n long, n_good long, n_toxic long")
    row = filter_audit.cells(counted).first()
    assert row["n"] == [7 * m * m % 31 for m in range(32)] and row["n_good"] == [m % 3 for m in range(32)] and row["n_toxic"] == [m % 2 for m in range(32)]


def test_long_texts_are_read_whole(monkeypatch):
    text = (prose(1, 400) + " Zebra").encode()
    whole = filter_audit.text_fails(text)
    monkeypatch.setattr(words, "SLICE", 37)
    assert filter_audit.text_fails(text) == whole
    assert [w for part in words.word_lists(text) for w in part] == text.split()
    assert list(words.word_lists(b"x" * 100)) == [[b"x" * 100]] and list(words.word_lists(b"")) == [[]]


def test_more_columns_do_not_matter(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    more = docs(spark).withColumns({"part": F.lit(1), "fails": F.lit("x"), "digest": F.lit(2), "n": F.lit(3)})
    assert sorted(filter_audit.filter_audit(more, labels).collect()) == sorted(filter_audit.filter_audit(docs(spark), labels).collect())
