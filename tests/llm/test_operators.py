"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from sluice.llm import (
    attention_lm,
    common,
    decontamination,
    html_extraction,
    line_dedup,
    lm_scoring,
    packing,
    quality_rules,
    recompression,
    secret_scan,
    simhash,
)
from sluice.llm.components import components
from sluice.llm.compression_classifier import CompressionClassifier, _logistic
from sluice.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, part long"


def prose(rng, n, words=("the", "of", "and", "river", "stone", "light", "naïve", "über", "going", "house", "winter", "seven")):
    return " ".join(rng.choice(words) + (rng.choice(words) if rng.random() < 0.4 else "") for _ in range(n))


def documents(spark, texts, ids=None):
    """Texts with ids from 0 on; columns of names that the operators use themselves come along."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, ("en", "de", None)[(i or 0) % 3], f"s{(i or 0) % 4}", None, 0.5, 7) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def corpus(seed=1, n=40):
    """Texts of all kinds: empty, blank, null, short, long, copies, near copies, shared passages."""
    rng = random.Random(seed)
    texts = [None, "", " \n\t ", "one", "Two words", "a b c", prose(rng, 4)]
    passage = prose(rng, 60)
    for _ in range(n):
        t = prose(rng, rng.randint(5, 150))
        roll = rng.random()
        if roll < 0.2:
            t = f"{t} {passage} {prose(rng, 10)}"
        elif roll < 0.35 and texts[-1]:
            t = texts[-1]
        elif roll < 0.5 and texts[-1]:
            w = texts[-1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        texts.append(t)
    texts += ["x " * 400, "ab cd " * 200, "ab cd " * 150, prose(rng, 6000), "é ü x " * 70, "É" * 3000]
    return texts


# ---------------------------------------------------------------- packing


def test_packing_is_a_round_trip(spark):
    texts = [*corpus(), "<|endoftext|> is text, or is it?", " " * 500, "a" * 20_000]
    encode = packing.tokenizer(tokenizer_path())
    ids = {i: [*encode.library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for options in ({}, {"open_windows": 2, "merge": 1, "least_cut": 4}, {"size": 64, "open_windows": 3}):
        got = packing.pack(documents(spark, texts), tokenizer_path(), **options).collect()
        back = collections.defaultdict(list)
        sequences = collections.defaultdict(list)
        for r in got:
            back[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append(r)
        assert set(back) == set(ids)
        for i, pieces in back.items():
            pieces.sort(key=lambda r: r["start"])
            assert [x for r in pieces for x in np.frombuffer(r["ids"], "<u4")] == ids[i]
            assert [r["start"] for r in pieces] == [0, *itertools.accumulate(r["length"] for r in pieces)][:-1]
            assert {r["doc_tokens"] for r in pieces} == {len(ids[i])} and all(r["length"] * 4 == len(r["ids"]) for r in pieces)
        size = options.get("size", 2048)
        padding = 0
        for pieces in sequences.values():
            pieces.sort(key=lambda r: r["offset"])
            assert [r["offset"] for r in pieces] == [0, *itertools.accumulate(r["length"] for r in pieces)][:-1]
            n = sum(r["length"] for r in pieces)
            assert n <= size
            padding += 0 if n & (n - 1) == 0 else size - n
        assert padding <= 0.05 * sum(map(len, ids.values()))
    assert packing.pack(documents(spark, []), tokenizer_path()).collect() == []
    repeated = packing.pack(documents(spark, ["same text"] * 3, [5, 5, None]), tokenizer_path())
    assert sorted(str(r["doc_id"]) for r in repeated.where("start = 0").collect()) == ["5", "5", "None"]
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(documents(spark, []), tokenizer_path(), size=100)


# ---------------------------------------------------------------- secrets

_ASSIGN = re.compile(secret_scan.ASSIGN.removeprefix("(?i)"), re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24])


def test_secrets(spark):
    rng = random.Random(5)
    digest = hashlib.sha256(b"1").hexdigest()
    plain = [prose(rng, 300) + " river_stone_winter_house riverStoneWinterHouse" for _ in range(60)]
    texts = [
        *plain,
        None,
        "",
        f"é😀 token=abc token=token:abcdefgh api_key: \"AKIA{'A' * 16}\" {digest} end",
        "PASSWD = 'hunter-22' secret=secret=abcdef ſecret=abcdefg",
        "password=hunter22 " * 700,
        "f" * 24 + "g" + "0" * 23,
        "key sk-Zx81KqPv93LmTn27BcRd0GhW5 done",
    ]
    docs = documents(spark, texts)
    table = secret_scan.train(docs)
    got = {r["doc_id"]: r for r in secret_scan.scan(docs, table).withColumns({"b": secret_scan.written(F.col("base")), "s": secret_scan.written(F.col("spans"))}).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        assert got[i]["b"] == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans), i
        assert [got[i][f"n_{k}"] for k in secret_scan.KINDS[:3]] == [sum(s[1] == j for s in spans) for j in range(3)]
        assert set(filter(None, got[i]["b"].split(","))) <= set(got[i]["s"].split(","))
    assert got[len(texts) - 1]["n_markov"] == 1 and got[len(texts) - 1]["s"].startswith("markov:4:")
    assert sum(got[i]["n_markov"] for i in range(60)) == 0
    empty = documents(spark, [])
    assert secret_scan.scan(empty, secret_scan.train(empty)).collect() == []


def test_markov_spans_one_by_one(spark):
    """The spans of the models, with every run's ratio summed up character by character."""
    rng = random.Random(6)
    random_strings = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40)) for _ in range(60)]
    names = ["_".join(prose(rng, 1) for _ in range(4)) for _ in range(60)]
    texts = [f"{prose(rng, 40)} {r} {prose(rng, 5)} {n}" for r, n in zip(random_strings, names, strict=True)] + [f"secret: {random_strings[0]}", None]
    docs = documents(spark, texts)
    table = secret_scan.train(docs)
    place, width = {c: i + 1 for i, c in enumerate(secret_scan.ALPHABET)}, len(secret_scan.ALPHABET) + 1
    got = {r["doc_id"]: {(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 3} for r in secret_scan.scan(docs, table).collect()}
    for i, t in enumerate(texts):
        expected = set()
        for m in re.finditer(secret_scan.RUN, t or ""):
            ratio = sum(table[place[a] * width + place[b]] for a, b in itertools.pairwise(m[0]))
            if ratio > 12.0 and not any(a < m.end() and m.start() < b for a, _, b in base_spans(t)):
                expected.add((m.start(), m.end()))
        assert got[i] == expected, i
    found = [bool(got[i]) for i in range(60)]
    assert sum(found) >= 57 and all(texts[i][a:b] == random_strings[i] for i in range(60) for a, b in got[i])


# ---------------------------------------------------------------- pages


def test_main_text():
    article = "It was the best of times and the worst of times, for all of us in the city by the sea."
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">Home of the site</a></li></ul></nav>
    <div class="cookie-notice">We use cookies to give you the best of the web and all that is in it.</div><!-- <p>not this</p> -->
    <main><h2>A story</h2><p title="a > b">{article}<br>And <b>b</b>old &amp; sm&auml;ll&nbsp;&#8364;.<p>Short.
    <ul><li><a href=1>One of these</a><li><a href=2>And the other</a></ul><aside>Read this in the sidebar of the page as well.</aside></main>
    <section id="comments"><p>I think that this is the best of all of the articles you have written.</p></section>
    <form>Sign up for all of it</form><footer>&copy; The paper of the city, all of the rights.</footer></body>"""
    assert html_extraction.main_text(page) == f"A story\n{article} And bold & smäll €.\nShort."
    plain = f"<div class=menu><a href=1>a of the</a></div><p>{article}</p><p>Tiny</p><div class='sidebar'>{article}</div>"
    assert html_extraction.main_text(plain) == f"{article}\nTiny"
    assert html_extraction.main_text(f"<article><p>{article}</p><p>cut &am") == f"{article}\ncut &am"
    assert html_extraction.main_text(f"<article><p>{article}</p></article><foot") == article
    assert html_extraction.main_text(None) == html_extraction.main_text("") == html_extraction.main_text("<p></p>") == ""
    for hostile in ("<b>" * 50_000 + "</i>" * 50_000, '<a title="' * 50_000, "<!--" * 50_000, "<" * 100_000, "<p>x" * 50_000):
        html_extraction.main_text(hostile)


ARTICLE = "It was the best of times and the worst of times, for all of us in the city by the sea. " * 5


@pytest.mark.parametrize(
    "page",
    [
        f'<article class="post comments-open"><p>{ARTICLE}</p></article>',
        f'<div class="content no-sidebar"><p>{ARTICLE}</p></div>',
        f'<div class="post has-comments"><p>{ARTICLE}</p></div>',
        f'<div id="skip-content"><p>{ARTICLE}</p></div>',
        f'<div><p>{ARTICLE}</p></div><article><a href="/x">Read more of this</a></article>',
        f'<div class="post"><p>{ARTICLE}</p></div><div class="post-comments"><p>{ARTICLE[:170]}</p></div>',
        f'<div class="has-sidebar"><div class="entry"><p>{ARTICLE}</p></div><div class="sidebar"><p>{ARTICLE}</p></div></div>',
        f'<main><p>{ARTICLE}</p></main><section class="related-posts"><p>{ARTICLE}</p></section>',
    ],
)
def test_names_do_not_cost_an_article(page):
    assert html_extraction.main_text(page) == ARTICLE.strip()


def test_a_teaser_does_not_hide_the_story():
    teaser = "A short teaser of the other story in the paper."
    text = html_extraction.main_text(f"<div><p>{ARTICLE}</p><p>{ARTICLE}</p></div><article><h3>Next</h3><p>{teaser}</p></article>")
    assert text.startswith(f"{ARTICLE.strip()}\n{ARTICLE.strip()}")


def test_second_pass_one_by_one():
    """Nearest decided neighbours, looked for block by block."""
    rng = random.Random(2)
    for _ in range(500):
        n = rng.randint(0, 12)
        labels, inside = [rng.choice((True, False, None, None)) for _ in range(n)], [rng.random() < 0.5 for _ in range(n)]
        expected = []
        for i in range(n):
            near = sorted((abs(i - j), j) for j in range(n) if labels[j] is not None)
            first = [labels[j] for d, j in near if d == near[0][0]]
            if labels[i] is not None:
                expected.append(labels[i])
            elif not near:
                expected.append(True)
            elif all(j < i for _, j in near) or all(j > i for _, j in near):
                expected.append(first[0] or inside[i])
            else:
                expected.append(inside[i] if len(set(first)) == 2 else first[0])
        assert html_extraction.decided(labels, inside) == expected


def test_first_pass():
    block = html_extraction.Block
    assert block("the of and in it is", 0, False, False).label(False) is None  # short
    assert block("the of and in it is " * 3, 0, False, False).label(False) is True
    assert block("the of and in it is " * 3, 40, False, False).label(True) is False  # links
    assert block("the of and in it is " * 3, 40, False, True).label(True) is None  # a heading
    assert block("river stone " * 20, 0, False, False).label(False) is False and block("river stone " * 20, 0, True, False).label(True) is True


def test_pages_keep_their_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Hello of the world</p>", 3), (2, None, None, 4), (2, None, None, 4)], "page_id long, url string, html string, n_chars int")
    got = html_extraction.extracted(pages)
    assert got.columns == ["page_id", "url", "html", "n_chars", "text"]
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got.collect()) == [(1, "Hello of the world", 18), (2, "", 0), (2, "", 0)]
    assert html_extraction.extracted(pages.limit(0)).collect() == []
    clashing = spark.createDataFrame([("x", "old", f"<p>{ARTICLE}</p>", 9)], "label string, text string, html string, doubts int")
    assert [tuple(r) for r in html_extraction.extracted(clashing).collect()] == [("x", ARTICLE.strip(), f"<p>{ARTICLE}</p>", 9, len(ARTICLE.strip()))]


# ---------------------------------------------------------------- quality


def quality_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(spark):
    texts = [*corpus(2), "a\nb\na\n\n \na", "a b c a b c", "a a a a", "# % & | <>", "a b\x0bc\x0cd\re\tf"]
    got = {r["doc_id"]: r for r in quality_rules.judged(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, expected = got[i], quality_counts(t or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected, i
        assert r["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert r["kept"] == (not r["base_failed"] and not r["failed"])


def test_limits_follow_language_and_source(spark):
    rng = random.Random(3)
    texts, langs = [], []
    for i in range(400):
        langs.append("xx" if i % 2 else "yy")
        texts.append(" ".join(str(rng.randint(0, 10**9)) + ("#" if i % 2 else "") for _ in range(60)))
    texts += [" ".join("#%" + str(rng.random()) for _ in range(60))] * 2
    langs += ["xx", "yy"]
    df = spark.createDataFrame([(i, t, la, "s") for i, (t, la) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string, source string")
    bad = {r["doc_id"]: r["failed"] for r in quality_rules.judged(df).where("size(failed) > 0").collect()}
    assert bad.keys() == {400, 401} and "symbol_rate" in bad[401]
    assert quality_rules.judged(df.limit(0)).collect() == []


def test_limits_of_rates_that_are_mostly_zero(spark):
    """A quarter of repeated lines is an outlier where no text repeats lines, and none where every tenth one does."""
    rng = random.Random(4)

    def text(repeated):
        lines = [" ".join(str(rng.randint(10**6, 10**7 - 1)) for _ in range(5)) for _ in range(20 - repeated)]
        return "\n".join(lines + lines[:repeated])

    rows = [(i, text(3 if i % 20 == 1 else 0), "xx", "verse" if i % 2 else "prose") for i in range(400)]
    rows += [(400, text(5), "xx", "prose"), (401, text(5), "xx", "verse")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    bad = {r["doc_id"]: set(r["failed"]) for r in quality_rules.judged(df).where("size(failed) > 0").collect()}
    assert bad == {400: {"dup_line_rate", "repeat_rate"}}


# ---------------------------------------------------------------- near duplicates


def fingerprint_by_bits(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def links_of(found):
    return [tuple(r) for df in (found[0].where("node <> component"), found[1]) for r in df.collect()]


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components_by_pairs(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_near_duplicates(spark):
    texts = corpus(4)
    prints = [fingerprint_by_bits(t or "") for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    expected = components_by_pairs(range(len(texts)), pairs)
    got = simhash.near_duplicates(documents(spark, texts)).withColumn("hex", simhash.hexadecimal()).collect()
    assert {r["doc_id"]: r["hex"] for r in got} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    repeated = simhash.near_duplicates(documents(spark, ["a b c d e"] * 3, [9, 9, 4])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in repeated) == [(4, 4), (9, 4), (9, 4)]


@pytest.mark.parametrize("shard_rows", [60, 4096])
def test_links_of_crowded_shards(spark, shard_rows):
    rng = np.random.default_rng(1)
    points = set()
    for base in rng.integers(0, 1 << 63, 3, dtype=np.int64).tolist():
        for _ in range(120):
            x = base
            for b in rng.choice(63, rng.integers(0, 9), replace=False).tolist():
                x ^= 1 << b
            points.add(x)
    points = sorted(points)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(points)), 2) if (points[i] ^ points[j]).bit_count() <= 4]
    expected = components_by_pairs(range(len(points)), pairs)
    df = spark.createDataFrame(list(enumerate(points)), "id long, fingerprint long")
    got = {r["node"]: r["component"] for r in components(simhash.links(df, 4, shard_rows)).collect()}
    assert got == {n: c for n, c in expected.items() if n in {x for p in pairs for x in p}}


def test_vantage_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    near = rng.integers(0, 1 << 63, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 63, (2000, 5), dtype=np.uint64)).sum(1).astype(np.uint64)
    for points in (near, np.zeros(300, np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)):
        for q in points[:20]:
            tree = simhash.VantageTree(points)
            assert sorted(tree.take(q, 6).tolist()) == np.flatnonzero(np.bitwise_count(points ^ q) <= 6).tolist()
    assert 0.7 < simhash.unrelated_share() < 0.8


@pytest.mark.parametrize("rows", [10, 10**6, 10**8, 10**10])
def test_every_close_pair_shares_a_subspace(rows):
    rng = random.Random(rows)
    masks = simhash.subspaces(rows, 4)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_spanning_forest_connects_what_is_near():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (1, 3), dtype=np.uint64)
    points = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 63, (60, 3), dtype=np.uint64)), rng.integers(0, 1 << 63, (30, 3), dtype=np.uint64), base, base])
    near = [(i, j) for i, j in itertools.combinations(range(len(points)), 2) if np.bitwise_count(points[i] ^ points[j]).sum() <= 6]
    links = simhash.spanning(points, 6)
    assert components_by_pairs(range(len(points)), links) == components_by_pairs(range(len(points)), near)
    assert len(links) < len(points) and all(p in near for p in map(tuple, map(sorted, links)))


@pytest.mark.parametrize("shard_rows", [20, 2048])
def test_similar_texts(spark, shard_rows):
    rng = random.Random(12)
    texts = [None, "", "one two", "One TWO", *corpus(5)]
    for _ in range(12):
        words = prose(rng, 200).split(" ")
        for changes in (0, 1, 2, 3, 4, 30):
            own = list(words)
            for p in rng.sample(range(200), changes):
                own[p] = f"changed{rng.random()}"
            texts.append(" ".join(own))
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = links_of(simhash.similar_links(documents(spark, texts), shard_rows=shard_rows))
    expected, got = (components_by_pairs(range(len(texts)), p) for p in (pairs, found))
    assert got == expected
    assert links_of(simhash.similar_links(documents(spark, [None, ""]))) == []
    grouped = {r["doc_id"]: r["component_id"] for r in simhash.groups(documents(spark, texts)).collect()}
    assert grouped[3] == 2 and grouped[1] == 0 and simhash.groups(documents(spark, [])).collect() == []


@pytest.mark.parametrize("recall, shard_rows", [(0.02, 2048), (0.5, 40)])
def test_similar_texts_that_no_sample_finds(spark, recall, shard_rows):
    """With next to no samples, the texts connect as by all pairs; a passage that most texts share is no reason to link them."""
    rng = random.Random(31)
    passage, texts = prose(rng, 60), [None, "", "one two", "One TWO", "one"]
    for i in range(60):
        words = [f"{w}{rng.randrange(300)}" for w in prose(rng, rng.randint(40, 160)).split(" ")]
        for changes in (0, 1, 2, 4):
            own = list(words)
            for p in rng.sample(range(len(own)), changes):
                own[p] = f"changed{rng.random()}"
            texts.append(" ".join(own) + (f" {passage}" if i % 3 else ""))
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = links_of(simhash.similar_links(documents(spark, texts), recall=recall, shard_rows=shard_rows))
    assert components_by_pairs(range(len(texts)), found) == components_by_pairs(range(len(texts)), pairs)


def test_similar_texts_of_one_template(spark):
    """Texts on one template crowd the shards and are just not similar; the pairs among them that are must be found beside them."""
    rng = random.Random(33)
    template = [f"{w}{i}" for i, w in enumerate(prose(rng, 1504).split(" "))]

    def changed(places):
        own = list(template)
        for p in places:
            own[4 + 5 * p] = f"changed{rng.random()}"
        return " ".join(own)

    siblings = [rng.sample(range(300), 20) for _ in range(500)]  # a similarity of 0.77
    beside = [p[:13] + rng.sample(sorted({*range(300)} - {*p}), 7) for p in siblings[:60]]  # of 0.83 with one of them
    texts = [changed(p) for p in siblings + beside]
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = links_of(simhash.similar_links(documents(spark, texts)))
    expected = components_by_pairs(range(len(texts)), pairs)
    assert 60 <= len(pairs) and len({*expected.values()}) > 200
    assert components_by_pairs(range(len(texts)), found) == expected


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(5, 5), (None, 3)]
    real = [(a, b) for a, b in links if a is not None and a != b]
    expected = components_by_pairs({x for p in real for x in p}, real)
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()} == expected
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# ---------------------------------------------------------------- decontamination


def test_decontamination(spark):
    rng = random.Random(6)
    items = [prose(rng, n) for n in (3, 5, 8, 20, 20, 60, 200)] + [None, "", "one two three", "ONE, two; three!", "unheard", "of four unheard words"]
    texts = [*corpus(6), "one two three", "one two three four", "zero one two three four five six", "an (Unheard) word among others, long", f"{prose(rng, 50)} of four unheard words {prose(rng, 50)}"]
    for item in items[:7]:
        words = item.split(" ")
        texts.append(f"{prose(rng, 400)} {item.upper() if len(words) < 30 and item.isascii() else item} {prose(rng, 400)}")
        texts.append(f"{prose(rng, 50)} {' '.join(words[: max(3, len(words) * 9 // 10)])} {prose(rng, 9)}")
        texts.append(f"{prose(rng, 50)} {' '.join(words[: len(words) // 2])}")
    expected = {}
    plain = [re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[!-/:-@\[-`{-~]", "", (t or "").lower() if (t or "").isascii() else (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))) for t in texts + items]
    windows = lambda words, k: {tuple(words[p : p + k]) for p in range(len(words) - k + 1)}
    for d in range(len(texts)):
        for i in range(len(items)):
            item = plain[len(texts) + i]
            size = min(5, len(item))
            wanted = windows(item, size) if item else set()
            own = windows(plain[d], size)
            if wanted and len(wanted & own) >= 0.8 * len(wanted) - 1e-9:
                expected[d, i] = (len(wanted), len(wanted & own))
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    docs = documents(spark, texts)
    for size in (1 << 24, 500):
        got = decontamination.contaminated(docs, bench, block_bytes=size).collect()
        assert {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in got} == expected
        assert len(got) == len(expected) and all(r["containment"] == r["n_shared"] / r["n_shingles"] for r in got)
    kept = decontamination.clean(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in expected} and kept.columns == docs.columns
    assert decontamination.contaminated(docs, bench.limit(0)).collect() == [] == decontamination.contaminated(docs.limit(0), bench).collect()


# ---------------------------------------------------------------- lines


def test_line_dedup(spark):
    rng = random.Random(7)
    notice, copied = "All rights reserved by the house.", "Only copies of one text have this line."
    rows = []
    for i in range(60):
        own = [prose(rng, 8) for _ in range(4)]
        own.insert(rng.randrange(4), f"  {notice} ")
        rows.append((i, "\n".join([*own, "short"]), f"s{i % 14}"))
    rows += [(100 + i, f"First line of the copies here.\n{copied}\nLast line of the copies here.", f"s{i}") for i in range(14)]
    rows += [(200, None, "s1"), (201, "", "s1"), (202, notice, None), (203, notice, "s1"), (203, notice, "s1"), (204, "\n\n", "s2"), (None, f"{notice}\nA line of its own without an id.", "s3")]
    rows += [(300 + i, f"Nine sites have this line, too.\n{prose(rng, 8)}", f"s{i}") for i in range(9)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, n_removed int")
    assert line_dedup.without_boilerplate(df).columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    for listed in (10_000, 0):
        got = {r["doc_id"]: r for r in line_dedup.without_boilerplate(df, listed=listed).collect()}
        for i, text, _ in rows:
            lines = text.split("\n") if text is not None else []
            kept = [x for x in lines if x.strip(" ") != notice]
            assert got[i]["n_lines"] == len(lines) and got[i]["n_removed"] == len(lines) - len(kept)
            assert got[i]["text"] == (None if text is None else "\n".join(kept)), i
    assert line_dedup.without_boilerplate(df).where("doc_id = 203").count() == 2
    assert line_dedup.without_boilerplate(df.limit(0)).collect() == []


def test_line_dedup_of_footers_and_hot_copies(spark):
    """Footers of several lines, lines before blank ones and lines of a hot copy group go; nine different texts aren't enough."""
    rng = random.Random(8)
    footer = ["We use cookies on this site.", "Copyright of the whole house.", "Licensed under the usual terms."]
    spaced, hot, copied = "A notice before a blank line.", "On many sites and in a hot group.", "Nine different texts have this."
    rows = [("\n".join([prose(rng, 8), spaced, "", *footer]), f"s{i % 14}") for i in range(40)]
    rows += [(f"{prose(rng, 8)}\n{hot}\n{prose(rng, 8)}", f"s{i % 20}") for i in range(100)]
    rows += [(f"The hot text of two thousand copies.\n{hot}\nAnd the end of the hot text.", f"s{i % 20}") for i in range(2000)]
    rows += [(f"Text number {i % 9} of the copied ones.\n{copied}", f"s{i % 20}") for i in range(180)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_boilerplate(df).collect()}
    gone = {*footer, spaced, hot}
    assert got == {i: "\n".join(x for x in t.split("\n") if x not in gone) for i, (t, _) in enumerate(rows)}


# ---------------------------------------------------------------- substrings


def without_repeats_one_by_one(texts, length):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][p : p + length]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < i:
                gone.update(range(p, p + length))
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, seed):
    rng = random.Random(seed)
    texts = corpus(10 + seed, 60)
    texts += ["a b " * 300, "x " + "a b " * 100, "b a " * 40, "z " * 49, "z " * 50, "z " * 51, "z " * 999]
    base = prose(rng, 300).split(" ")
    for _ in range(10):
        a, b = sorted(rng.sample(range(300), 2))
        texts.append(" ".join([prose(rng, 5), *base[a:b], prose(rng, 5), *base[a : a + 55]]))
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in recompression.without_repeats(documents(spark, texts)).collect()}
    assert got == without_repeats_one_by_one(dict(enumerate(texts)), 50)


def test_repeats_of_odd_rows(spark):
    long = " ".join(map(str, range(80)))
    got = recompression.without_repeats(documents(spark, [long, long, long, None], [3, 3, None, 1])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("1", 0), ("3", 0), ("3", 0), ("None", 0)]
    # an id with two texts, one of them a copy: the other one keeps its words
    other = " ".join(f"own{i}" for i in range(70))
    rows = [(1, long), (3, long), (3, other), (3, other + " " + long), (4, other), (None, long)]
    got = recompression.without_repeats(documents(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got) == [("1", 80, 0), ("3", 70, 0), ("3", 80, 80), ("3", 150, 80), ("4", 70, 70), ("None", 80, 0)]


def test_repeats_of_words_that_defeat_polynomial_hashes(spark):
    """Two words of 1024 characters on which polynomials modulo a power of two agree, in texts that are equal but for them."""
    thue = "a"
    for _ in range(10):
        thue += thue.translate(str.maketrans("ab", "ba"))
    mirrored = thue.translate(str.maketrans("ab", "ba"))
    around = [f"word{i}" for i in range(49)]
    texts = [" ".join([thue, *around]), " ".join([mirrored, *around]), " ".join([thue, *around])]
    got = {r["doc_id"]: r["n_removed"] for r in recompression.without_repeats(documents(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 50}
    data = np.frombuffer((thue + mirrored).encode(), np.uint8)
    for seed in range(20):
        one, two = common.WordHash(seed).words(data, np.array([0, 1024]), np.array([1024, 2048])).tolist()
        assert one != two
    assert recompression.without_repeats(documents(spark, [])).collect() == []


def test_symbols_recur_with_their_reach():
    """What a symbol depends on is its reach: cut out, these words give the same symbol again."""
    rng = np.random.default_rng(3)
    words = rng.integers(1, 9, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    name, first, last = recompression.recompress(words, np.array([0, 3000]))
    assert len(name) > 100
    for k in range(0, len(name), 7):
        around = np.concatenate([rng.integers(1, 9, 5).astype(np.uint64), words[first[k] : last[k]], rng.integers(1, 9, 5).astype(np.uint64)])
        again, f, e = recompression.recompress(around, np.array([0, len(around)]))
        assert ((again == name[k]) & (f == 5) & (e == 5 + last[k] - first[k])).any()


# ---------------------------------------------------------------- language model


def lm_tokens(text):
    return [*(text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split(), None]


def base_scores(texts, learnt):
    """(n_tokens, n_known, train_tokens, base_score) of each text; learnt: which texts are counted."""
    tokens = [lm_tokens(t) for t in texts]
    count = collections.Counter(w for own, ok in zip(tokens, learnt, strict=True) if ok for w in own)
    total, distinct = sum(count.values()), len(count)
    return [(len(own), sum(count[w] > 0 for w in own), total, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own)) for own in tokens]


def same_base(row, expected):
    return (row["n_tokens"], row["n_known"], row["train_tokens"]) == expected[:3] and math.isclose(row["base_score"], expected[3], rel_tol=1e-9)


def test_language_model(spark):
    texts = [*corpus(8, 60), "a\xa0 b \xa0 \xa0\xa0 c", "<|endoftext|> Upper UPPER <|endoftext|>"]
    training = F.col("doc_id") % 4 != 2
    for frequent, task_subwords in ((20, 3000), (1 << 18, 1 << 20)):
        rows = lm_scoring.scored(documents(spark, texts), training, tokenizer_path(), frequent=frequent, task_subwords=task_subwords).collect()
        got = {r["doc_id"]: r for r in rows}
        for i, expected in enumerate(base_scores(texts, [i % 4 != 2 for i in range(len(texts))])):
            assert same_base(got[i], expected), i
            assert got[i]["score"] < 0
    assert lm_scoring.scored(documents(spark, []), training, tokenizer_path()).collect() == []
    untrained = lm_scoring.scored(documents(spark, ["a b", None]), F.col("doc_id") < 0, tokenizer_path()).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in untrained] == [(0, 0, 0.0)] * 2


def test_language_model_of_odd_rows(spark):
    """Rows without an id and ids with several texts are scored each by its own text."""
    texts = ["the river the", "the river the", None, "the stone", "a house of stone", "the river", "winter " * 300]
    ids = [3, 3, None, None, 3, 5, 9]
    learnt = [i is not None and i != 9 for i in ids]
    got = lm_scoring.scored(documents(spark, texts, ids), F.col("doc_id") != 9, tokenizer_path(), frequent=1).collect()
    left = sorted(zip(map(str, ids), base_scores(texts, learnt), strict=True), key=str)
    assert len(got) == len(texts)
    for r in got:
        match = next(x for x in left if x[0] == str(r["doc_id"]) and same_base(r, x[1]))
        left.remove(match)
    assert left == []


def test_language_model_beats_single_subwords(spark):
    """On texts that it has not seen, the model is better than the subwords' own frequencies, with one task or several."""
    rng = random.Random(17)
    words = [prose(rng, 1) + prose(rng, 1) for _ in range(300)]
    follow = {w: rng.sample(words, 4) for w in words}

    def walk(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    texts = [walk(rng.randint(30, 200)) for _ in range(600)]
    training = F.col("doc_id") % 5 != 0
    encode = packing.tokenizer(tokenizer_path())
    ids = [[*(i for w in t.split() for i in encode.ids(" " + w)), encode.size - 1] for t in texts]
    count = collections.Counter(x for i, own in enumerate(ids) if i % 5 for x in own)
    total = sum(count.values()) + encode.size
    single = {i: sum(math.log10((count[x] + 1) / total) for x in own) for i, own in enumerate(ids)}
    for task_subwords in (1 << 20, 50_000):
        got = {r["doc_id"]: r["score"] for r in lm_scoring.scored(documents(spark, texts), training, tokenizer_path(), task_subwords=task_subwords).collect()}
        held = range(0, 600, 5)
        assert sum(got[i] for i in held) > 0.95 * sum(single[i] for i in held)


@pytest.mark.parametrize("settings", [{}, {"small": 0}, {"small": 0, "task_subwords": 2000}])
def test_language_model_learns_from_every_document(spark, monkeypatch, settings):
    """Training moves the embedding of every subword that occurs in a training document."""
    held, trained = [], lm_scoring.trained

    def kept(texts, counts, path, **settings):
        held.append((counts, attention_lm.AttentionModel.new(counts, lm_scoring.neighbours(texts, path)), trained(texts, counts, path, **settings)))
        return held[0][2]

    monkeypatch.setattr(lm_scoring, "trained", kept)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(3000)]
    lm_scoring.scored(documents(spark, texts), F.col("doc_id") % 5 != 0, tokenizer_path(), **settings)
    counts, before, after = held[0]
    moved = (before.weights["E"] != after.weights["E"]).any(axis=1)
    assert (counts > 0).sum() > 1000 and (moved == (counts > 0)).all()


def pairs_of(sample):
    pairs, n = np.unique(np.stack([sample[:-1], sample[1:]]), axis=1, return_counts=True)
    return np.concatenate([pairs, n[None]]).T


def test_attention_gradient_and_windows():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 30, 500)
    model = attention_lm.AttentionModel.new(np.bincount(sample, minlength=34), pairs_of(sample), n_groups=4, n_leaves=6)

    def log_probability(before, following):
        hidden = np.append(model._attend(np.array([before]))[0][0, -1], 1)
        first, second = hidden @ model.weights["U"], hidden @ model.weights["W"][model.groups[following]]
        return first[model.groups[following]] - np.log(np.exp(first).sum()) + second[model.leaves[following]] - np.log(np.exp(second).sum()) + model.within[following]

    assert math.isclose(sum(math.exp(log_probability([1, 2, 3], x)) for x in range(34)), 1, rel_tol=1e-4)
    ids, at = rng.integers(0, 30, 200), np.array([0, 90, 90, 91, 93, 200])
    stride = attention_lm.WINDOW - attention_lm.OVERLAP
    for near in (False, True):
        model.near = near
        expected = []
        for a, b in itertools.pairwise(at.tolist()):
            x, total = ids[a:b].tolist(), 0.0
            for j in range(1, len(x)):
                begin = max(0, -(-(j - attention_lm.WINDOW) // stride)) * stride
                total += log_probability(x[begin:j], x[j])
            expected.append(total)
        assert np.allclose(model.log_probabilities(ids, at), expected, rtol=1e-4)
    model.near = False
    model.weights = {k: v.astype(float) for k, v in model.weights.items()}
    batch, following, counted = rng.integers(0, 30, (3, 10)), rng.integers(0, 30, (3, 10)), rng.random((3, 10)) < 0.7
    _, grad = model.step(batch, following, counted)
    for name in attention_lm.NAMES:
        w = model.weights[name]
        at_ = (batch[1, 4], 5) if name == "E" else (model.groups[following[counted][0]], 3, 2) if name == "W" else (3, 2)
        w[at_] += 1e-5
        up, _ = model.step(batch, following, counted)
        w[at_] -= 2e-5
        down, _ = model.step(batch, following, counted)
        w[at_] += 1e-5
        value = grad["E"][batch == at_[0]][:, 5].sum() if name == "E" else grad[name][at_]
        assert math.isclose((up - down) / 2e-5, value, rel_tol=1e-3, abs_tol=1e-7), name
    model.weights = {k: v.astype(np.float32) for k, v in model.weights.items()}
    again = attention_lm.AttentionModel.unpacked(model.packed())
    ends = np.array([0, 500])
    before = model.log_probabilities(sample, ends).sum()
    assert math.isclose(again.log_probabilities(sample, ends).sum(), before, rel_tol=1e-5)
    for _ in range(5):
        model.fit(sample, ends)
    assert model.log_probabilities(sample, ends).sum() > before
    seen = np.bincount(sample, minlength=34)
    mean = attention_lm.AttentionModel.unpacked(attention_lm.averaged([(again.packed(), seen), (model.packed(), 3 * seen)])[0])
    assert np.allclose(mean.weights["U"], again.weights["U"] / 4 + model.weights["U"] * 3 / 4, atol=1e-5)


@pytest.mark.parametrize(("name", "scale"), [("A", -30), ("A", 30), ("U", 300), ("W", 300)])
def test_attention_with_far_exponents(name, scale):
    """Exponents whose powers overflow, or all vanish, give the probabilities that exact numbers give, and weights that are numbers."""
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 30, 400)
    model = attention_lm.AttentionModel.new(np.bincount(sample, minlength=34), pairs_of(sample), n_groups=4, n_leaves=6)
    model.weights["E"] *= 2
    if name == "A":
        model.weights["A"] = np.eye(attention_lm.WIDTH, dtype=np.float32) * scale
    else:
        model.weights[name] *= scale
    model.checked()
    w = {k: v.astype(float) for k, v in model.weights.items()}

    def logs(x):
        return x - x.max() - np.log(np.exp(x - x.max()).sum())

    def log_probability(before, following):
        x = w["E"][before] + w["P"][: len(before)]
        a = logs(x[-1] @ w["A"] @ x.T)
        hidden = np.append(x[-1] + np.exp(a) @ x @ w["R"], 1)
        first, second = logs(hidden @ w["U"]), logs(hidden @ w["W"][model.groups[following]])
        return first[model.groups[following]] + second[model.leaves[following]] + model.within[following]

    ids, at = sample[:60], np.array([0, 20, 60 - attention_lm.WINDOW + 4, 60])
    expected = [sum(log_probability(ids[a:j], ids[j]) for j in range(a + 1, b)) for a, b in itertools.pairwise(at.tolist())]
    assert not model.near and np.allclose(model.log_probabilities(ids, at), expected, rtol=1e-3)
    counted = np.ones((1, 19), bool)
    loss, grad = model.step(ids[None, :19], ids[None, 1:20], counted)
    assert math.isclose(loss, -(expected[0] - model.within[ids[1:20]].sum()) / 19, rel_tol=1e-3)
    assert all(np.isfinite(g).all() for g in grad.values())
    model.fit(sample, np.array([0, 400]))
    assert all(np.isfinite(v).all() for v in model.weights.values())


def test_attention_is_computed_where_it_is_needed(monkeypatch):
    """Nothing is asked for the places that an overlap repeats, in training and in scoring, and the gradient is right nevertheless."""
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 30, 900)
    model = attention_lm.AttentionModel.new(np.bincount(sample, minlength=34), pairs_of(sample), n_groups=4, n_leaves=6)
    attend, asked = attention_lm.AttentionModel._attend, []

    def counting(self, *args):
        found = attend(self, *args)
        asked.append(found[0].shape[0] * found[0].shape[1])
        return found

    monkeypatch.setattr(attention_lm.AttentionModel, "_attend", counting)
    length, stride = attention_lm.WINDOW, attention_lm.WINDOW - attention_lm.OVERLAP
    at = np.array([0, length + 5 * stride + 1, 2 * (length + 5 * stride + 1)])  # texts that fill their windows
    for work in (model.fit, model.log_probabilities):
        asked.clear()
        work(sample, at)
        assert sum(asked) == at[-1] - 2, work.__name__
    model.weights = {k: v.astype(float) for k, v in model.weights.items()}
    batch, following = rng.integers(0, 30, (5, length)), rng.integers(0, 30, (5, length))
    counted = np.ones((5, length), bool)
    counted[[0, 2, 3], : attention_lm.OVERLAP] = False
    counted[3, -4:] = False
    _, grad = model.step(batch, following, counted)
    for name in attention_lm.NAMES:
        w = model.weights[name]
        for window, place in ((0, 2), (1, 2), (3, 20)):
            at_ = (batch[window, place], 5) if name == "E" else (model.groups[following[window, place + 8]], 3, 2) if name == "W" else (place, 2) if name == "P" else (3, 2)
            w[at_] += 1e-5
            up, _ = model.step(batch, following, counted)
            w[at_] -= 2e-5
            down, _ = model.step(batch, following, counted)
            w[at_] += 1e-5
            value = grad["E"][batch == at_[0]][:, 5].sum() if name == "E" else grad[name][at_]
            assert math.isclose((up - down) / 2e-5, value, rel_tol=1e-3, abs_tol=1e-7), name


# ---------------------------------------------------------------- classifier


def test_classifier(spark):
    rng = random.Random(9)
    good = [prose(rng, rng.randint(20, 200)) for _ in range(240)]
    bad = [" ".join(prose(rng, 1).upper() + "!!" for _ in range(rng.randint(20, 200))) for _ in range(240)]
    texts = [t for pair in zip(good, bad, strict=True) for t in pair] + [None, ""]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(480)], "doc_id long, quality int, toxic int")
    held = common.crc32_of_id() % 5 == 0
    model = CompressionClassifier.fit(docs, labels, allowed=~held)
    scored = model.score(docs)
    assert scored.columns == docs.columns  # score is replaced
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(texts)
    apart = [(got[i] >= 0.3) == (i % 2 == 0) for i in range(480) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(apart) / len(apart) > 0.97
    sizes = []
    for dictionary in (model.bad, model.good):
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append([sum(len(squeeze.compress((t or "").encode()[p : p + 512])) for p in range(0, len((t or "").encode()), 512)) for t in texts])
    for i, t in enumerate(texts):  # the score by its definition
        bad_size, good_size, n = sizes[0][i], sizes[1][i], len((t or "").encode())
        d, r, size = (bad_size - good_size) / max(bad_size + good_size, 1), good_size / max(n, 1), math.log1p(n) / 10
        z = sum(w * x for w, x in zip(model.weights, (1, d, r, size, d * d, r * r, d * r, size * d, size * r), strict=True))
        assert math.isclose(got[i], 1 / (1 + math.exp(-min(max(z, -30), 30))), rel_tol=1e-6), i
    few = CompressionClassifier.fit(docs, labels, max_bytes=1000)  # next to nothing to learn from
    assert all(0 <= r["score"] <= 1 for r in few.score(docs).collect())
    one_class = CompressionClassifier.fit(docs, labels.where("quality = 1"))
    assert {round(r["score"], 6) for r in one_class.score(docs).collect()} == {round(241 / 242, 6)}
    assert {r["score"] for r in CompressionClassifier.fit(docs, labels.limit(0)).score(docs).collect()} == {0.5}
    assert model.score(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [10, 68, 77])
def test_calibration_of_classes_that_hardly_overlap(seed):
    """Whole Newton steps run away to weights of ten million, which give half of the rows the other class."""
    rng = np.random.default_rng(seed)
    y = np.arange(20) % 2
    d, r, size = rng.normal(0, 0.05, 20) + 0.1 * y, rng.uniform(0.1, 0.7, 20), rng.uniform(0.4, 1.1, 20)
    x = np.stack([np.ones(20), d, r, size, d * d, r * r, d * r, size * d, size * r], 1)
    assert ((x @ _logistic(x, y, 1e-6) > 0) == (y == 1)).all()


# ---------------------------------------------------------------- words


def test_words_on_bytes():
    texts = ["", " a  b\tc\n", "é ü x", "one", "\x0b\x0c\r"]
    data = [t.encode() for t in texts]
    joined, at = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    starts, ends, of = common.words_in(joined, at)
    words = [joined[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert [words[of[i] : of[i + 1]] for i in range(5)] == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    h = common.WordHash(1).words(joined, starts, ends)
    assert len(set(h.tolist())) == len(set(words))
