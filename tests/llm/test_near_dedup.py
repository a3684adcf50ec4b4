import itertools
import random

import corpus_pipeline
from tidewright.llm import near_copies

from .fixtures import prose
from .test_text_operators import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def changed(text, seed, n):
    r, words = random.Random(seed), text.split()
    for at in r.sample(range(len(words)), n):
        words[at] = f"new{r.random()}"
    return " ".join(words)


def similarity(a, b):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_stage_links_near_copies_of_similarity_0_8(spark):
    base = {k: prose(k, 120) for k in range(40)}
    texts = base | {100 + k: changed(t, k, 1 + k % 4) for k, t in base.items()} | {200 + k: prose(900, 60) + " " + prose(1000 + k, 60) for k in range(60)}
    texts |= {300 + k: changed(prose(7000, 150), k, 1) for k in range(80)} | {400: "", 401: "one two", 402: "One  two", 403: "two one"}
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], SCHEMA)
    want = brute_components(sorted(texts), lambda a, b: similarity(texts[a], texts[b]) >= 0.8)
    assert sum(want[100 + k] == k for k in range(40)) >= 20 and any(want[100 + k] != k for k in range(40))
    out = corpus_pipeline.no_near_copies(spark, df, "")
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))
    assert near_copies.near_dedup(df.where("false")).count() == 0


def test_frequent_hashes_come_last_and_change_no_result(spark, monkeypatch):
    shared = prose(5, 30)
    texts = {k: shared + " " + prose(100 + k // 2, 20) + f" x{k % 2}" for k in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = sorted(set(brute_components(sorted(texts), lambda a, b: similarity(texts[a], texts[b]) >= 0.8).values()))
    for frequent, group in ((8, 512), (10**6, 7), (1, 2)):
        monkeypatch.setattr(near_copies, "FREQUENT", frequent)
        monkeypatch.setattr(near_copies, "GROUP", group)
        assert sorted(r.doc_id for r in near_copies.near_dedup(df).collect()) == want


def test_rows_without_or_of_one_doc_id(spark):
    a, b, c, d = (prose(k, 80) for k in range(4))
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (7, d), (7, prose(9, 80)), (7, d), (8, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([("None", a), ("None", b), ("1", c), ("7", d), ("7", prose(9, 80))])
    assert sorted((str(r.doc_id), r.text) for r in near_copies.near_dedup(df).collect()) == want


def test_a_family_less_alike_than_the_links_meets_in_no_prefix(spark):
    base = prose(77, 300)
    texts = {k: changed(base, k, 12) for k in range(60)}
    assert max(similarity(texts[0], texts[k]) for k in range(1, 60)) < 0.8
    rows = near_copies._texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "text")
    met = {}
    for r in near_copies._thin(rows, 5, 0.8).collect():
        for token, place in zip(r.tokens, r.places):
            met.setdefault(token, []).append(r.n - place)
    # rows of the join: what is left of both sets, of about 300 each, may reach 0.8 / 1.8 of their sum
    made = sum(min(a, b) >= 4 / 9 * 590 for left in met.values() for k, a in enumerate(left) for b in left[:k])
    assert made < 60  # in the order of hashes, each two of the 1770 pairs share about ten


def test_a_line_shared_by_sets_that_are_not_similar_makes_no_pair_each(spark, monkeypatch):
    line, parts = prose(11, 12), [prose(20 + k, 14) for k in range(10)]
    texts = {}
    for k, left_out in enumerate(itertools.combinations(range(10), 2)):
        body = " ".join(p for at, p in enumerate(parts) if at not in left_out)
        texts |= {k: f"{line} {body} x{k}", 100 + k: f"{line} {body} y{k}", 200 + k: prose(300 + k, 12) + " " + body}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = sorted(set(brute_components(sorted(texts), lambda a, b: similarity(texts[a], texts[b]) >= 0.8).values()))
    assert 20 < len(want) < len(texts)
    compared, pairs = near_copies._compared, []
    monkeypatch.setattr(near_copies, "_compared", lambda others, *rest: pairs.append(others.count()) or compared(others, *rest))
    for part, rows, at_once in ((2048, 1 << 14, 1 << 18), (7, 50, 16)):
        monkeypatch.setattr(near_copies, "PART", part, raising=False)
        monkeypatch.setattr(near_copies, "TASK_ROWS", rows, raising=False)
        monkeypatch.setattr(near_copies, "PAIRS", at_once, raising=False)
        assert sorted(r.doc_id for r in near_copies.near_dedup(df).collect()) == want
    assert 0 < pairs[0] < len(texts)  # a forest; 4667 pairs share a hash and may be similar
