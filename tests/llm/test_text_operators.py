import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat_format, exact_dedup, html_extract, language_id, mixing, packing, quality, simhash, url_filters
from tidewright.llm.components import connected_components, spanning_forest
from tidewright.llm.queries import tokenizer_file

from .fixtures import docs, no_docs, prose, rows

NORMAL = re.compile("[\x20\x09-\x0d]+")


def brute_components(nodes, linked):
    at = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and at[a] != at[b]:
                    at[a] = at[b] = min(at[a], at[b])
                    moved = True
    return at


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (30, 30)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    u, v = spanning_forest(np.array([5, 4, 3, 9]), np.array([4, 3, 2, 9]))
    assert dict(zip(u.tolist(), v.tolist())) == {5: 2, 4: 2, 3: 2}


def test_url_filters(spark):
    urls = ["http://a.Example.COM/en/7?x", "https://example.com/en/6", "http://x.net/de/1", "http://example.net/de/81#t", "ftp://example.org/es/", "http://notcom/en/", None, "no scheme", "", "http://", "http://com/en/", "http://u.example.org?es/"]
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)] + [(0, urls[0], "mine")], "page_id long, url string, verdict string")
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("org", "/es/", "allow")], "host string, path string, verdict string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages, rules).collect()}
    assert found[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert found[1][2:] == ("com/en/", "block") and found[2][2:] == ("net/de/", "allow") and found[3][2:] == ("example.net/de/8", "block")
    assert found[4] == ("example.org", "/es/", "org/es/", "block")
    assert all(found[k] == ("", "", None, "allow") for k in (6, 7, 8, 9)) and found[5][2:] == (None, "allow") and found[10][3] == "block" and found[11] == ("u.example.org", "", None, "allow")
    assert url_filters.filter_urls(pages, rules).count() == len(urls) + 1
    assert {r.verdict for r in url_filters.filter_urls(pages, rules.where("false")).collect()} == {"allow"}
    assert url_filters.filter_urls(pages.where("false"), rules).count() == 0


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a\\b </s>[INST]"), (1, 1, "user", "<|end|>\n<|turn|>x"), (1, 2, "assistant", "<<SYS>>"), (1, 3, "assistant", ""), (1, 3, "assistant", "<"), (2, None, None, None), (None, 1, "assistant", "end\\"), (3, 5, "as<|body|>k", "|turn|>")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(df)
    read = out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans").collect()
    found = {r.conv_id: r for r in read}
    for conv in (1, 2, None, 3):
        own = sorted([t[1:] for t in turns if t[0] == conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        assert [tuple(x) for x in found[conv].t] == [(r or "", x or "") for _, r, x in own]
        assert found[conv].loss == "".join(x or "" for _, r, x in own if r == "assistant")
        assert not re.search(r"\[/?INST\]|</?s>", found[conv].formatted)
    assert found[1].formatted.count("<|turn|>") == 2 and found[1].formatted.count("<|next|>") == 3 and len(found[1].loss_spans) == 3
    assert chat_format.format_chats(df.where("false")).count() == 0


def test_chunks_join_to_the_text():
    text = prose(5, 9000).encode()
    cuts = exact_dedup.cut_points(text)
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == len(text) and sizes.max() <= exact_dedup.LONGEST and sizes[:-1].min() >= exact_dedup.SHORTEST and len(cuts) > 10
    moved = b"x" * 777 + text
    pieces = lambda t: {t[a:b] for a, b in zip([0, *exact_dedup.cut_points(t)], exact_dedup.cut_points(t))}
    assert len(pieces(text) & pieces(moved)) > len(cuts) / 2
    assert exact_dedup.cut_points(b"") == [0]
    assert len(exact_dedup.cut_points(b"a" * 3_000_000)) >= 3_000_000 // exact_dedup.LONGEST


def test_exact_dedup(spark):
    groups = defaultdict(list)
    for r in rows():
        groups[NORMAL.sub(" ", r[1] or "")].append(r[0])
    found = exact_dedup.exact_dedup(docs(spark)).collect()
    assert len(found) == len(rows())
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in found:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.keep_first(docs(spark)).count() == len(groups) and exact_dedup.keep_first(docs(spark)).columns == docs(spark).columns
    assert exact_dedup.exact_dedup(no_docs(spark)).count() == 0


def test_simhash_equals_brute_force(spark):
    import xxhash

    def brute(text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    made = docs(spark).where("doc_id is not null")
    made = made.union(made.limit(5).withColumns({"doc_id": F.col("doc_id") + 100, "text": F.concat("text", F.lit(" the"))}))
    texts = {r.doc_id: r.text for r in made.collect()}
    fps = {d: brute(t) for d, t in texts.items()}
    found = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.simhash_components(made).collect()}
    want = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert found == {d: (fps[d], want[d]) for d in fps}
    assert simhash.near_dedup(made).count() == len(set(want.values()))
    assert simhash.simhash_components(no_docs(spark)).count() == 0


@pytest.mark.parametrize("cluster", [False, True])
def test_trie_links(cluster):
    r = np.random.default_rng(3)
    x = r.integers(0, 2**63, 3000, dtype=np.uint64) if not cluster else np.uint64(12345) ^ (np.uint64(1) << r.integers(0, 40, (3000, 6), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x[:300] ^ np.uint64(1 << 63 | 1 << 20), x[:50] ^ np.uint64(7)]))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    label = np.arange(len(x))
    while not np.array_equal(new := np.where(near, label[None, :], len(x)).min(axis=1), label):
        label = new
    u, v = simhash.trie_links(x, x, 3, True)
    root = dict(zip(u.tolist(), v.tolist()))
    assert [root.get(a, a) for a in x.tolist()] == x[label].tolist()
    half = len(x) // 2
    u, v = simhash.trie_links(x[:half], x[half:], 3, False)
    cross = near[:half, half:]
    assert set(u.tolist()) | set(v.tolist()) == set(x[:half][cross.any(axis=1)].tolist()) | set(x[half:][cross.any(axis=0)].tolist())


@pytest.mark.parametrize("bounds", [(64, 200, 3), (16, 100, 1), (100, 150, 2)])
def test_each_pair_within_the_budget_meets_in_a_task(spark, monkeypatch, bounds):
    for name, bound in zip(("NODE_ROWS", "CROWDED", "MOST_LEVELS"), bounds):
        monkeypatch.setattr(simhash, name, bound)
    r = np.random.default_rng(1)
    ball = np.uint64(12345) ^ (np.uint64(1) << r.integers(0, 40, (800, 5), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    x = np.unique(np.concatenate([r.integers(0, 2**63, 800, dtype=np.uint64), ball, ball[:200] ^ np.uint64(1 << 63 | 7)]))
    dealt = simhash.deal(spark.createDataFrame([(int(f),) for f in x.view(np.int64)], "fp long"), 3).toPandas()
    met, sizes = set(), []
    for (_, _, i, j), own in dealt.groupby(["mask", "value", "i", "j"]):
        a, b = (np.unique(own.fp[own.block == k].to_numpy().view(np.uint64)) for k in (i, j))
        sizes.append(max(len(a), len(b)))
        near = np.argwhere(np.bitwise_count(a[:, None] ^ b[None, :]) <= 3)
        met |= {(min(p), max(p)) for p in zip(a[near[:, 0]].tolist(), b[near[:, 1]].tolist())}
    near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    assert met == {(min(p), max(p)) for p in zip(x[near[:, 0]].tolist(), x[near[:, 1]].tolist())}
    assert max(sizes) <= 1.5 * bounds[1]


@pytest.mark.parametrize("order", ["sorted", "shuffled", "star"])
def test_components_in_few_rounds(spark, monkeypatch, order):
    from tidewright.llm import components

    nodes = np.arange(1001) if order != "shuffled" else np.random.default_rng(4).permutation(1001)
    edges = [(int(nodes[0] if order == "star" else nodes[k]), int(nodes[k + 1])) for k in range(1000)]
    written, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df: written.append(1) or write(df))
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == dict.fromkeys(range(1001), 0)
    assert len(written) <= 3 * 14 + 2  # two writes a round, and one to put its map together


def test_targets_and_mix(spark):
    assert mixing.targets([100, 100, 0], [3, 1, 2], 300.0) == [200, 100, 0]
    found = mixing.mix(docs(spark), lambda k: (3, 1, 2)[k % 3]).collect()
    assert len(found) == len(rows())
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += len(re.findall("[^\x20\x09-\x0d]+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values()))))
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in order:
        largest = max(r.size for r in found if r.source == s)  # whole copies: one document of 6000 words can miss by half of it
        assert abs(taken[s] - want[s]) <= largest / 2 + 1
    again = mixing.mix(docs(spark).repartition(3), lambda k: (3, 1, 2)[k % 3]).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    applied = mixing.apply_mix(docs(spark).where("doc_id < 12"), lambda k: 1.0)
    assert applied.columns == docs(spark).columns and set(Counter(r.doc_id for r in applied.collect()).values()) <= {1, 2}
    assert mixing.mix(no_docs(spark), lambda k: 1.0).count() == 0


def test_many_documents_of_one_size_meet_the_target(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 15000, "hot").otherwise("cold").alias("source"))
    taken = {r.source: (r.t, r.target) for r in mixing.mix(df, lambda k: (1, 2)[k % 2]).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()}
    for got, target in taken.values():
        assert abs(got - target) <= 0.005 * target


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    found = packing.pack(docs(spark), tokenizer_file(), packing.Capacity(tokens=256), group_pieces=8).toPandas()
    for doc_id, text in {(r[0], r[1]) for r in rows() if r[0] is not None}:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        own = found[found.doc_id == doc_id].drop_duplicates("piece").sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 256)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes()) for a in range(0, len(ids), 256)]
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 256
    assert packing.pack(no_docs(spark), tokenizer_file()).count() == 0


def test_vector_capacities():
    lengths = np.sort(np.random.default_rng(2).integers(1, 300, 400))[::-1]
    for score in ("norm", "dot"):
        k = packing.Capacity(512, 4, 100_000, (1.0, 0.5, 0.5), score)
        sequence, offset = packing.best_fit(lengths, k)
        for s in np.unique(sequence):
            own = lengths[sequence == s].astype(np.int64)
            assert own.sum() <= 512 and len(own) <= 4 and (own**2).sum() <= 100_000 and sorted(offset[sequence == s].tolist()) == [0, *np.cumsum(own).tolist()[:-1]]
    tight = packing.best_fit(lengths, packing.Capacity(512))[0]
    assert len(np.unique(tight)) <= 1.03 * lengths.sum() / 512 + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([400]), packing.Capacity(512, 4, 1000))


def test_tokens_word_by_word_equal_whole_texts():
    t = packing.WordTokenizer(tokenizer_file())
    texts = ["", "It's the DON'T  'll\tx\x00y <|endoftext|> naïve ΣΑΣ", "\x00 \x00", "日本 ABC123 ... é İİ", prose(1, 50)]
    for text, raw in zip(texts, t.encode([x.encode() for x in texts])):
        assert np.frombuffer(raw, "<u4").tolist() == [*t.model.encode(text, add_special_tokens=False).ids, 0]


PAGE = '<html><head><title>T</title></head><body class="p12"><header><a href="/">Home</a></header><nav><ul><li><a>Menu</a></ul></nav><div id="main-{k}"><article class="post-{k}"><header><h1>Title &amp; {k}</h1><p>by me</p></header><p>First&nbsp;para &lt;ok&gt;<br>second   line<div class="ad">buy</div><p><b>bold<p>{text}</p><form><p>Name</p></form><section id="comments"><p>nice</p></section></article></div><div class="sidebar"><p>{text} {text} side</p></div><footer>&copy;</footer>'


def test_html_extraction(spark):
    pages = [(k, f"http://h.com/{k}", PAGE.format(k=k, text=prose(k, 40)), "mine") for k in range(4)] + [(9, None, None, "mine"), (10, "http://h.com/x", "", "mine"), (11, "http://o.com", "<p>only 3 < 5 &amp; <i>this</i><script>x('<p>')</script> <!-- c", "mine"), (11, "http://o.com", "<p>only", "mine")]
    out = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string"))
    found = {(r.page_id, r.n_chars): r.text for r in out.collect()}
    for k in range(4):
        want = f"Title & {k}\nFirst para <ok>\nsecond line\nbold\n{prose(k, 40)}"
        assert found[k, len(want)] == want
    assert found[9, 0] == found[10, 0] == "" and "only 3 < 5 & this" in found.values() and found[11, 4] == "only"
    path = html_extract.host_paths(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).where("host = 'h.com'").first()
    assert path.path.endswith("article.post-#") and path.pages == 4
    assert html_extract.extract(spark.createDataFrame([], "url string, html string")).count() == 0


def test_language_id(spark):
    made = [(k, prose(k, 40), "en", "x") for k in range(120)] + [(1000 + k, prose(k, 40).translate(str.maketrans("aeiou", "öäüßé")), "de", "x") for k in range(120)]
    df = spark.createDataFrame([*made, (2000, None, "en", "x"), (2001, "12 !!", None, "x"), (2002, "", "de", "x")], "doc_id long, text string, lang string, score string")
    model = language_id.fit(df)
    found = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert all(found[d].lang_pred == lang for d, _, lang, _ in made) and all(0 <= r.score <= 1 for r in found.values())
    assert {found[d].lang_pred for d in (2000, 2001, 2002)} == {"und"}
    kept = language_id.reject_unknown(df, model)
    assert kept.columns == df.columns and kept.count() >= len(made) - 1 and not {r.doc_id for r in kept.collect()} & {2000, 2001, 2002}
    assert language_id.predict(df.where("false"), model).count() == 0
    assert {r.lang_pred for r in language_id.predict(df, language_id.fit(df.where("false"))).collect()} == {"und"}


def test_table_means_see_every_ngram_once():
    from tidewright.llm import subword

    table = np.random.default_rng(1).normal(size=(subword.BUCKETS, 2)).astype(np.float32)
    texts = [b"", b"a", b"abc", prose(1, 300).encode(), (prose(2, 5) + " ").encode() * 40000]
    got = subword.table_means(texts, table, (2, 3))
    for text, row in zip(texts, got):
        grams = [subword.hashed(np.frombuffer(text, np.uint8), n) for n in (2, 3) if len(text) >= n]
        want = table[np.concatenate(grams)].astype(np.float64).mean(axis=0) if grams else np.zeros(2)
        assert np.allclose(row, want, atol=1e-4)
        if grams:
            buckets, shares = subword.text_features(text, (2, 3))
            assert np.allclose(shares @ table[buckets], want, atol=1e-4)


def test_quality(spark):
    good = [(k, prose(k, 50), 1 if k % 2 else None, "x") for k in range(160)]
    bad = [(1000 + k, prose(k, 50).replace(" ", "%%% $$$ "), 0 if k % 2 else None, "x") for k in range(60)]
    df = spark.createDataFrame([*good, *bad, (5000, None, None, "x"), (5001, "", None, "x")], "doc_id long, text string, quality int, score string")
    model = quality.fit(df, df)
    found = {r.doc_id: r for r in quality.score(df, model).collect()}
    assert all(found[k].predicted == 1 for k, *_ in good) and sum(found[k].predicted == 0 for k, *_ in bad) >= 55
    assert all(0 <= r.score <= 1 for r in found.values()) and len(found) == 222
    assert found[5000].score == found[5001].score == pytest.approx(1 / (1 + np.exp(-model.bias)))
    assert quality.score(df.where("false"), model).count() == 0
    assert quality.fit(df, df.withColumn("quality", F.lit(None).cast("int"))).weights.any() == False  # noqa: E712
