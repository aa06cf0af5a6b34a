"""The numbered operators against brute force on small tables with awkward rows."""

import hashlib
import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.llm import bpe, common, exact_dedup, html_text, license_scan, minhash, packing, registry, substring, topk, toxicity, url_filter
from threadlake.llm.components import components

DOCS = "doc_id long, text string, keep_id string, kept int"  # the last two clash with names of results


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def words_of(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Near and exact copies, shared passages, nulls, blanks, ties and a long text."""
    rng = random.Random(7)
    rows, base, passage = [], words_of(rng, 120, 4000), words_of(rng, 60, 4000)
    for i in range(40):
        w = base.split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    for i in range(12):
        rows.append(f"{words_of(rng, 30, 4000)} {passage}\n{words_of(rng, rng.randrange(5), 4000)}")
    rows += [base, base.replace(" ", "\n"), base.upper(), None, None, "", "  ", "one", "ONE", "one two", "a b c d", words_of(rng, 5000, 10**6), passage, passage + " " + passage]
    rng.shuffle(rows)
    return list(enumerate(rows, 3))


def test_exact_dedup(spark, awkward):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in awkward:
        groups.setdefault(norm(t), []).append(i)
    want = {i: (min(groups[norm(t)]), len(groups[norm(t)]), min(groups[norm(t)]) == i, hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in awkward}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs(spark, awkward)).collect()}
    assert got == want


def test_exact_dedup_null_and_repeated_ids(spark):
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, [(None, "a"), (2, "a"), (2, "a"), (None, "b")])).collect())
    assert got == [("2", "2", 3, True), ("2", "2", 3, True), ("None", "2", 3, False), ("None", "None", 1, True)]


def test_exact_dedup_with_many_frequent_digests(spark):
    """Digests of every rank over the sketch's error are winners, not only the first few."""
    rows = docs(spark, [(k * 320 + i, f"frequent {i}") for i in range(320) for k in range(30)] + [(20_000 + i, f"rare {i // 2}") for i in range(500)])
    winners = exact_dedup.heavy_digests(rows.select("doc_id", F.sha2("text", 256).alias("text_sha256")), 1024)
    assert winners.where("group_size = 30 and keep_id < 320").count() == 320 and winners.count() <= 1024
    got = exact_dedup.exact_dedup(rows, counters=64).groupBy("group_size").agg(F.count("*"), F.count_if("kept")).orderBy("group_size").collect()
    assert [tuple(r) for r in got] == [(2, 500, 250), (30, 9600, 320)]


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(spark, awkward, n):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, awkward), shingle=n).collect()}
    assert got == brute_components(awkward, n, 80)


def test_near_duplicates_that_only_the_prefix_filter_links(spark):
    """Copies of a base whose edits put many under the threshold of the first of their bucket."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(200), rng.randrange(2, 12)):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows), shingle=4).collect()}
    assert got == want and 1 < len({v[1] for v in want.values()}) < 60


def test_near_duplicates_of_a_large_family_under_the_threshold(spark):
    """10,000 texts with one core, a little too different for links, and some that are linked: no pair is listed for the others."""
    core = " ".join(f"c{i}" for i in range(88))
    rows = [(i, core + " " + " ".join(f"t{i}_{k}" for k in range(15))) for i in range(10_000)]
    rows += [(10_000 + i, rows[i * 7][1].rsplit(" ", 4)[0] + f" z{i}") for i in range(20)]
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows), shingle=4).collect()}
    want = {i: (i, True) for i in range(10_000)} | {10_000 + i: (i * 7, False) for i in range(20)}
    assert got == want


def test_near_duplicates_of_ids_with_several_texts(spark):
    rng = random.Random(18)
    a, b, c = (words_of(rng, 80, 4000) for _ in range(3))
    rows = [(1, a), (5, b), (5, c), (7, b + " more"), (8, c + " more"), (None, a), (None, None), (5, c)]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == sorted([("1", "1", True), ("5", "5", True), ("5", "5", True), ("5", "5", True), ("7", "5", False), ("8", "5", False), ("None", "None", True), ("None", "None", True)])


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 50)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def brute_cut(rows, n):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - n + 1):
            first.setdefault(tuple(split[i][k : k + n]), i)
    out = {}
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("n", [50, 10])
def test_remove_repeats(spark, awkward, n):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs(spark, awkward), n).collect()}
    assert got == brute_cut(awkward, n)


def test_remove_repeats_in_several_passes(spark, awkward, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WORDS", 40)
    monkeypatch.setattr(substring, "BLOCK_WORDS", 200)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs(spark, awkward), 20).collect()}
    assert got == brute_cut(awkward, 20)


def test_remove_repeats_of_ids_with_several_texts(spark):
    """Rows of one id don't count against each other, whatever their texts."""
    rng = random.Random(12)
    t = words_of(rng, 60, 4000)
    rows = [(1, t + " extra one"), (1, t + " other two three"), (2, t), (3, "x " + t.rsplit(" ", 5)[0] + " y"), (3, "z " + t)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(docs(spark, rows)).collect())
    assert got == [(1, 62, 0), (1, 63, 0), (2, 60, 60), (3, 57, 55), (3, 61, 60)]


@pytest.mark.parametrize("parts", [4, 1 << 10])
def test_remove_repeats_where_a_gram_has_many_contexts(spark, monkeypatch, parts):
    """A phrase shorter than a window in many documents: windows that their home lacks meet in later rounds."""
    monkeypatch.setattr(substring, "PART_ANCHORS", parts)
    rng = random.Random(13)
    phrase, tails = words_of(rng, 30, 4000), [words_of(rng, 80, 4000) for _ in range(9)]
    rows = [(i, f"{words_of(rng, 20, 4000)} {phrase} {tails[rng.randrange(9)]} {words_of(rng, 9, 4000)}") for i in range(60)]
    rows += [(60 + i, " ".join(" ".join(rng.sample(tails, 3)).split()[rng.randrange(60) :])) for i in range(20)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs(spark, rows)).collect()}
    assert got == brute_cut(rows, 50)


def test_remove_repeats_of_very_long_texts(spark):
    """A million words, and a word repeated 300,000 times; the shards stay small."""
    rng = np.random.default_rng(14)
    long = [f"w{x}" for x in rng.integers(0, 10**6, 1_000_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["a", *long[500_000:500_200], "b"])), (3, "same " * 300_000), (4, "same " * 70 + "end"), (5, " ".join(long[:100_000] + ["c"] + long[100_000:200_000]))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs(spark, rows)).collect()}
    assert got == {1: (1_000_000, 0), 2: (202, 200), 3: (300_000, 0), 4: (71, 70), 5: (200_001, 200_000)}


def test_automata_decide(spark, awkward, monkeypatch):
    """Anchors only route: without the matching statistics the result is another one."""
    want = brute_cut(awkward, 20)
    for answer in (lambda self, codes: [0] * len(codes), lambda self, codes: list(range(1, len(codes) + 1))):
        monkeypatch.setattr(substring, "SuffixAutomaton", type("Other", (), {"__init__": lambda self, sequences: None, "matching": answer}))
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs(spark, awkward), 20).collect()}
        assert got != want


def test_without_broadcasts(spark, awkward, monkeypatch):
    """Beyond the size bound of broadcasts the same comes from shuffles."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, awkward)).collect()} == brute_components(awkward, 5, 80)


def test_remove_repeats_keeps_rows_without_id(spark):
    text = " ".join(map(str, range(60)))
    got = sorted((str(r.doc_id), r.n_removed) for r in substring.remove_repeats(docs(spark, [(None, text), (1, text), (1, text), (2, text)])).collect())
    assert got == [("1", 0), ("1", 0), ("2", 60), ("None", 0)]


def test_byte_bpe(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  world's\n\n  end ", "", None, "中文 test\x1c\x85\u00a0😀\x00", "a" * 5000, "<unk> <s> \u2581 Ġ", "été déjà 123,456"]
    for r in bpe.bpe_round_trip(docs(spark, enumerate(texts)), path, public_tokenizers.PATTERN).collect():
        text = texts[r.doc_id] or ""
        assert (r.token_ids, bytes(r.decoded)) == (own.encode_ordinary(text), text.encode())


def test_byte_bpe_of_awkward_rows(spark):
    """No rows, rows without an id and rows that repeat one come back as they are."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    code = lambda rows: sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in bpe.bpe_round_trip(docs(spark, rows), path, public_tokenizers.PATTERN).collect())
    assert code([]) == []
    assert code([(None, "a b"), (1, "c"), (1, "c"), (1, "d"), (None, None)]) == [("1", "c"), ("1", "c"), ("1", "d"), ("None", ""), ("None", "a b")]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("spread", [1.0, 1e5])
def test_top_k(spark, spread):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x * spread)) for x in rng.normal(size=8)]) for i in range(350)]
    rows += [(400, rows[3][1]), (401, rows[3][1]), (500, None), (501, [1.0] * 7 + [None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, []), (None, rows[5][1]), (600, [0.5]), (300, rows[300][1]), (700, [0.0] * 8)]
    fine = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in fine:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in fine if c != q and len(w) == len(v))[:10]
            want |= {(q, k, c, -s) for k, (s, c) in enumerate(best, 1)}
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()}
    assert got == want


@pytest.mark.parametrize("huge", [1e9, 1e38])
def test_top_k_raises_on_scores_over_64_bits(spark, huge):
    rows = [(i, [huge, float(i)]) for i in range(5)]
    with pytest.raises(Exception, match="needs more than 6[34] bits"):
        topk.top_k(vectors(spark, rows), F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("kind", ["even", "skewed", "sparse", "small"])
def test_impact_index(kind):
    """Against brute force; on skewed vectors queries stop by proof, and the bounds leave few rows to rescore."""
    rng = np.random.default_rng(16)
    rows = rng.normal(size=(2000, 32)) * 200
    if kind == "skewed":
        rows = rows * np.exp(-np.arange(32) / 3)
    if kind == "sparse":
        rows = rows * (rng.random(rows.shape) < 0.1)
    rows = np.floor(rows if kind != "small" else rows[:6] / 100).astype(np.int64)
    index = topk.ImpactIndex(np.arange(len(rows)) * 3, rows)
    for query_id, ids, scores in index.search(np.arange(40) * 3, rows[np.arange(40) % len(rows)], 10):
        exact = rows @ rows[query_id // 3 % len(rows)]
        order = [i for i in np.lexsort((np.arange(len(rows)), -exact)) if i * 3 != query_id][:10]
        assert ids.tolist() == [i * 3 for i in order] and scores.tolist() == exact[order].tolist()
    if kind in ("skewed", "sparse"):
        assert index.stops["proof"] >= 30, index.stops


def test_top_k_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    ask = lambda: sorted(map(tuple, topk.top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect()))
    once = ask()
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 256)
    assert ask() == once and len(once) == 300


def test_html_text():
    page = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class='sidebar'>Side</div><article><header><h1>Head &amp; more</h1><p>By me</p></header><p>One<br>two  <b>thr</b>ee<p>Be.<script>x</script><form>name</form></article><section id=comments><p>Nice!</p></section><footer>F</footer>"
    assert html_text.main_text(page) == "Head & more\n\nOne two three\n\nBe."
    plain = "<div class=menu><a>x</a></div><div><h1>Title</h1><p>" + "word " * 60 + "</p><p>Short.</p></div><div class=comments><p>" + "hm " * 60 + "</p></div><!-- x --><div class=footer>y</div>"
    assert html_text.main_text(plain) == "Title\n\n" + ("word " * 60).strip() + "\n\nShort."
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<!-- open", "just text", "<a href='x")] == ["", "", "", "", "just text", ""]


def test_html_text_drops_nothing_else():
    for kind in ("class='post category-social'", "class='tag-search'", "id=comments class='category-ads has-comments'"):
        page = f"<body><div class='cookie-banner'>Ok?</div><article {kind}><p>One.</p><section id='related-work'><p>Two.</p></section><div class='comments'>Hm</div></article><p>Out</p></body>"
        assert html_text.main_text(page) == "One.\n\nTwo."
    assert html_text.main_text("<div role=main class='search'><p>One.</p></div><div>Out</div>") == "One."
    long = ("word " * 60).strip()
    page = f"<ul class='site-nav'><li><a href=/>Home</a></ul><div><p>{long}</p><div class=ad><p>Buy</p><p>this</p><p>now</p></div><p>Short end.</p><p><a href=x>A link</a></p></div><div class='site-footer'>F</div>"
    assert html_text.main_text(page) == f"{long}\n\nShort end.\n\nA link"


def test_html_windows_are_brute_force():
    """A stretch between windows of nothing is kept if three lines in a row reach the level."""
    rng = random.Random(17)
    for _ in range(300):
        sizes = [rng.choice([0, 0, 0, rng.randrange(1, 200)]) for _ in range(rng.randrange(40))]
        total = lambda i: sum(sizes[j] for j in range(i - 2, i + 1) if 0 <= j < len(sizes))
        level = max(1, min(86, max(map(total, range(len(sizes) + 2)), default=0) / 2))
        want = []
        for j in (j for j, n in enumerate(sizes) if n):
            first, last = j, j
            while first and total(first - 1):
                first -= 1
            while total(last + 1):
                last += 1
            want += [j] * any(total(i) >= level for i in range(first, last + 1))
        assert html_text.between_surge_and_dive(sizes) == want


def test_html_dives_in_an_article():
    """Blocks of links inside an article are part of it, however many; a linked heading is a heading; links alone stay."""
    link = "<p><a href=x>Link</a></p>"
    page = f"<body><div>Out</div><article><h1><a href=/>Title</a></h1><p>One.</p>{link * 2}<p>Two.</p>{link * 3}<p>Three.</p>{link}</article></body>"
    assert html_text.main_text(page) == "Title\n\nOne.\n\nLink\n\nLink\n\nTwo.\n\nLink\n\nLink\n\nLink\n\nThree.\n\nLink"
    assert html_text.main_text(f"<article>{link * 4}</article>") == "\n\n".join(["Link"] * 4)


def test_html_of_several_megabytes():
    long = "word " * 200_000
    page = "<nav>" + "<ul><li><a href=/>Menu</a>" * 20_000 + "</nav>" + "<div>" * 50_000 + f"<p>{long}</p>" * 3 + "</div>" * 50_000 + "<div class=footer>" + "<p>f</p>" * 20_000
    assert html_text.main_text(page) == "\n\n".join([long.strip()] * 3)
    assert html_text.main_text("<article>" + "<p>x" * 200_000) == "\n\n".join(["x"] * 200_000)
    assert html_text.main_text("<a '" * 200_000) == "" and len(html_text.main_text("<p>" + "< " * 500_000)) == 999_999


def test_extract_text(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>é</article>", "clash", 9), (1, None, None, "c", 9), (None, "v", "", "c", 9)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(str, html_text.extract_text(rows).collect())) == sorted(["Row(page_id=1, url='u', text='é', n_chars=1)", "Row(page_id=1, url=None, text='', n_chars=0)", "Row(page_id=None, url='v', text='', n_chars=0)"])


def test_url_rules_and_templates(spark):
    urls = ["http://www.EXAMPLE.com/en/1", "https://a.example.com/en/2?x#y", "http://b.com/de/", "http://c.example.net/fr/9", "http://notnet/es/", None, "no scheme", "http://host.only", "http://x.org/en/7/", "x://net/es/q://z"]
    urls += [f"http://a.example.com/en/{i}" for i in range(200)] + [f"http://new.example.org/en/{i}" for i in range(3)] + [f"http://new.example.org/de/{i}" for i in range(3)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert len(got) == len(urls)
    assert [got[i].rule for i in range(10)] == ["www.example.com/en/", "example.com/en/", "com/", "net/fr/", None, None, None, None, None, "net/es/"]
    assert (got[0].host, got[0].path, got[7].path, got[5].host) == ("www.example.com", "/en/1", "", "")
    assert {(got[i].verdict, got[i].basis) for i in range(210, 216)} == {("allow", "unlabelled")}
    assert got[210].template == "/en/{n}"


def in_duckdb(pages, rules):
    """OP5_SQL with other rules over (page_id, url)."""
    import duckdb
    import pandas as pd

    was = url_filter.RULES
    try:
        url_filter.RULES = rules
        sql = url_filter._sql()
    finally:
        url_filter.RULES = was
    c = duckdb.connect()
    c.register("pages", pd.DataFrame(pages, columns=["page_id", "url"]))
    return {(r[0], *r[4:]) for r in c.sql(sql).fetchall()}


def test_urls_of_unlabelled_hosts_stay(spark):
    """However many pages of the same template are blocked on other hosts."""
    urls = [f"http://a.example.com/en/{i}" for i in range(1000)] + [f"http://new.org/en/{i}" for i in range(5)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert {got[i].verdict for i in range(1000)} == {"block"} and {(got[i].verdict, got[i].basis) for i in range(1000, 1005)} == {("allow", "unlabelled")}


def test_url_branches_merge(spark):
    """Alike and labelled siblings share their evidence; unlabelled ones, other shares and other children don't."""
    urls = [f"http://a.com/{s}/ads/{i}" for s in ("x", "y", "z") for i in range(40)] + [f"http://a.com/{s}/ads/view/{i}" for s in ("x", "y") for i in range(60)] + [f"http://a.com/z/ads/view/{i}" for i in range(60)]
    urls += [f"http://a.com/{s}/{k}/{i}" for s in ("new", "odd") for k in ("ads", "view") for i in range(30)] + [f"http://a.com/odd/else/{w}/{i}" for w in "abcde" for i in range(30)] + [f"http://a.com/fine/{i}" for i in range(50)]
    rules = (("a.com", "/x/", "block"), ("a.com", "/y/", "block"), ("a.com", "/z/ads/view/", "block"), ("a.com", "/odd/else/", "block"), ("a.com", "/fine/", "allow"))
    pages = list(enumerate(urls))
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), rules=rules).collect()}
    assert {(i, r.verdict, r.template, r.basis) for i, r in got.items()} == in_duckdb(pages, rules)
    of = lambda start: {(r.verdict, r.basis) for i, r in got.items() if urls[i].startswith("http://a.com" + start)}
    assert of("/x/") == of("/z/ads/view/") == {("block", "rule")}
    assert of("/z/ads/0") | of("/z/ads/1") == {("block", "merged")}
    assert of("/new/") == {("allow", "unlabelled")} and of("/odd/ads/") == {("allow", "unlabelled")}


def test_long_urls(spark):
    urls = ["http://a.com/" + "-".join("x" * 100_000), "http://a.com/" + "-x" * 100_000, "http://a.net/" + "a/" * 20_000, "http://" + "h" * 100_000, "x" * 100_000]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string"), rules=()).collect()}
    assert got[0].template == "/{s}" and got[1].template == "/" + "-x" * 100_000 and got[2].template == "/" + "a/" * 20_000 and got[4].host == ""


def test_url_wildcards(spark):
    urls = [f"http://w.com/tag/{a}{b}/x" for a in "abcdefgh" for b in "klmn"]
    rows = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=()).collect()
    assert {r.template for r in rows} == {"/tag/*/x"} and {r.verdict for r in rows} == {"allow"}


def test_url_verdicts_do_not_depend_on_repetition(spark):
    """The same verdicts when every row stands there a hundred times; evidence of three quarters of the words blocks the others."""
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmn"]
    rules = tuple(("w.com", f"/tag/{w}/", "block") for w in words[:24])
    urls = [f"http://w.com/tag/{w}/x" for w in words] + [f"http://w.com/{s}/{i}" for s in "abcdefghi" for i in range(20)]
    once = {(r.page_id, r.verdict, r.template) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    many = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").crossJoin(spark.range(100)).select("page_id", "url")
    assert {(r.page_id, r.verdict, r.template) for r in url_filter.judge_urls(many, rules=rules).distinct().collect()} == once
    assert {x[1:] for x in once if 24 <= x[0] < 32} == {("block", "/tag/*/x")} and {x[2] for x in once if x[0] >= 32} == {f"/{s}/{{n}}" for s in "abcdefghi"}


def test_deep_urls_take_no_round_a_level(spark):
    """Twelve paths of 2,000 segments that part late, and eight that are beginnings of each other; wildcards below wildcards."""
    import time

    urls = ["http://deep.com/" + "a/" * 1990 + "/".join(f"{w}{k}" for k in "pqrstuvwxy") for w in "abcdefghijkl"] + ["http://trap.com" + "/n" * k for k in range(1, 40)]
    urls += [f"http://two.com/{a}/in/{b}/end" for a in ["x" + c for c in "abcdefghi"] for b in "abcdefghi"]
    began = time.time()
    got = {r.page_id: r.template for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=()).collect()}
    assert {got[i] for i in range(12)} == {"/" + "a/" * 1990 + "/".join("*" * 10)}
    assert [got[12 + k] for k in range(39)] == ["/n" * k for k in range(1, 40)] and {got[i] for i in range(51, len(urls))} == {"/*/in/*/end"}
    assert time.time() - began < 120


def test_url_trees_have_whole_paths(spark):
    pages = lambda kind, n: [f"http://a.com/shop/en/items/{kind}/{x}{y}/z" for x in "abcdefgh" for y in "klmn"][:n]
    urls = pages("spam", 32) + pages("good", 32) + ["http://a.com/shop/en/items/spam/new/z", "http://a.com/shop/en/items/good/new/z"] + ["http://b.com/" + "d/" * 40 + "e"]
    rules = tuple(("a.com", f"/shop/en/items/{k}/{x}", v) for k, v in (("spam", "block"), ("good", "allow")) for x in "abcdefg")
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    assert len(got) == len(urls)
    assert got[64].template == "/shop/en/items/spam/*/z" and got[65].template == "/shop/en/items/good/*/z" and got[66].template == "/" + "d/" * 40 + "e"
    assert {got[i].verdict for i in [*range(32), 64]} == {"block"} and {got[i].verdict for i in [*range(32, 64), 65]} == {"allow"}
    assert {(i, r.verdict, r.template, r.basis) for i, r in got.items() if i != 66} == {x for x in in_duckdb(list(enumerate(urls)), rules) if x[0] != 66}


def judged_by_hand(templates):
    """What _judged says of (host, template, n, labelled, blocked), by comparing branches at every place of every path."""
    main, alike, errors, weight, purity = url_filter.MAIN, url_filter.ALIKE, url_filter.ERRORS, url_filter.WEIGHT, url_filter.PURITY
    tree = {}
    for host, template, *counts in templates:
        seg = template.split("/")[1:]
        for i, s in enumerate(seg):
            tree.setdefault((host, *seg[:i]), {}).setdefault(s, {})["/".join(seg[i + 1 :]) if i + 1 < len(seg) else None] = (template, counts)
    total = lambda ways, k: sum(c[k] for _, c in ways.values())
    best = {}
    for (host, *above), branches in tree.items():
        kinds = {}
        for s, ways in branches.items():
            if total(ways, 1):
                key = frozenset(w for w, (_, c) in ways.items() if c[0] >= main * total(ways, 0)) or frozenset([None])
                kinds.setdefault(key, []).append(ways)
        for kin in kinds.values():
            if len(kin) == 1:
                continue
            n, l, b = (sum(total(ways, k) for ways in kin) for k in range(3))
            shares = {w: sum(ways[w][1][0] for ways in kin if w in ways) / n for w in set().union(*kin)}
            close = []
            for ways in kin:
                away = sum(abs((ways[w][1][0] / total(ways, 0) if w in ways else 0) - x) for w, x in shares.items()) / 2
                gap = total(ways, 2) - total(ways, 1) * b / l
                if round(away, 9) <= alike and round(gap * gap - errors**2 * total(ways, 1) * (b / l) * (1 - b / l), 9) <= 0:
                    close.append(ways)
            for w in set().union(*close):
                same = [ways[w] for ways in close if w in ways]
                found = (sum(c[1] for _, c in same), len(above), sum(c[2] for _, c in same))
                for template, _ in same:
                    best[host, template] = max(best.get((host, template), found), found)
    smooth = lambda rows, prior: (sum(r[4] for r in rows) + weight * prior) / (sum(r[3] for r in rows) + weight)
    out = set()
    for host, template, _, labelled, blocked in templates:
        up = lambda t: t.split("/")[:-1]
        prior = smooth([r for r in templates if r[0] == host and up(r[1]) == up(template)], smooth([r for r in templates if r[0] == host], smooth(templates, 0.5)))
        seen, _, bad = best.get((host, template), (labelled, 0, blocked))
        out.add((host, template, seen > 0 and round((bad + weight * prior) / (seen + weight), 9) > purity, "merged" if seen > labelled else "own" if seen else "unlabelled"))
    return out


def test_url_branches_merge_at_every_place(spark):
    """Siblings in the middle of a path share their evidence, as at its ends, and what begins with them counts at any length."""
    pages = [f"http://a.com/shop/{s}/ads/{i}" for s in "xyz" for i in range(40)] + [f"http://a.com/shop/{s}/ads/view/{i}" for s in "xyz" for i in range(60)]
    rules = (("a.com", "/shop/x/", "block"), ("a.com", "/shop/y/", "block"), ("a.com", "/shop/z/ads/view/", "block"))
    got = {r.page_id: (r.verdict, r.basis) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), rules=rules).collect()}
    assert {got[i] for i in range(80, 120)} == {("block", "merged")} and {got[i] for i in range(len(pages)) if not 80 <= i < 120} == {("block", "rule")}
    rng = random.Random(2)
    paths = {(f"h{rng.randrange(3)}.com", "/" + "/".join(rng.choice("ab") for _ in range(rng.randrange(1, 8)))) for _ in range(1500)}
    rows = []
    for host, template in sorted(paths):
        n = rng.choice((5, 5, 6, 40))
        labelled = 0 if host == "h2.com" else rng.choice((0, n // 2, n))
        rows.append((host, template, float(n), float(labelled), float(labelled // (1 if host == "h0.com" else 2))))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "tid long, host string, template string, n double, labelled double, blocked double")
    by_hand = judged_by_hand(rows)
    assert {tuple(r) for r in url_filter._judged(df).collect()} == by_hand
    assert {(r, basis) for _, _, r, basis in by_hand} == {(True, "merged"), (False, "merged"), (True, "own"), (False, "own"), (False, "unlabelled")}


def test_long_labelled_urls(spark):
    """A labelled path of 20,000 segments, and siblings 3,000 segments down."""
    import time

    deep = "/d" * 3000
    urls = ["http://a.com/spam" + "/e" * 20_000] + [f"http://a.com{deep}/{s}/{k}/x{i}x/end" for s in "pq" for k in ("ads", "view") for i in range(9)]
    rules = (("a.com", "/spam/", "block"), ("a.com", f"{deep}/p/", "block"), ("a.com", f"{deep}/q/ads/", "block"))
    began = time.time()
    got = {r.page_id: (r.verdict, r.basis) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    assert {got[i] for i in range(28)} == {("block", "rule")} and {got[i] for i in range(28, 37)} == {("block", "merged")}
    assert time.time() - began < 120


def test_license_scan(spark):
    rows = [(1, "some words before it\nLicensed under the Apache License, Version 2.0.\nand more words after it"), (2, "RELEASED under the mit license"), (3, None), (4, ""), (5, "word"), (6, "the apache web server"), (7, "Licensed under CC BY-NC 4.0."), (7, "x " * 3000)]
    found = sorted((r.doc_id, r.line_no, r.license) for r in license_scan.scan_licenses(docs(spark, rows)).collect())
    assert found == [(1, 1, "Apache-2.0"), (2, 0, "MIT"), (7, 0, "CC-BY-NC-4.0")]


def test_license_scan_finds_wrapped_notices(spark):
    rng = random.Random(4)
    prose = lambda n: "\n".join(" ".join(f"q{rng.randrange(900)}" for _ in range(11)) for _ in range(n))
    wrap = lambda t, n, glue="\n": glue.join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    mit, gpl, apache = license_scan.TEMPLATES["MIT"][2], license_scan.TEMPLATES["GPL-3.0"][1], license_scan.TEMPLATES["Apache-2.0"][1]
    rows = [(1, f"{prose(40)}\n{wrap(mit, 9)}\n{prose(40)}"), (2, f"{prose(3)}\n\n# {wrap(gpl, 8, chr(10) + '# ')}\n{prose(5)}\n{wrap(apache, 7)}"), (None, wrap(gpl, 8) + "\n" + prose(30)), (3, prose(60)), (4, f"{prose(9)}\n{wrap(gpl, 6)}\n{prose(9)}\n{wrap(gpl, 9)}")]
    every = [(r.doc_id, r.line_no, r.license, r.template_no, r.dice) for r in license_scan.scan_licenses(docs(spark, rows)).collect()]
    assert all(r[4] >= 0.8 for r in every) and 3 not in {r[0] for r in every} and (2, 4, "GPL-2.0", 1) in {r[:4] for r in every}
    found = {r for r in every if r[4] == 1}  # other versions of a licence come near
    n = len(wrap(gpl, 6).split("\n"))
    assert found == {(1, 40, "MIT", 2, 1.0), (2, 4, "GPL-3.0", 1, 1.0), (2, 9 + len(wrap(gpl, 8).split("\n")), "Apache-2.0", 1, 1.0), (2, 9 + len(wrap(gpl, 8).split("\n")), "Apache-2.0", 0, 1.0), (None, 0, "GPL-3.0", 1, 1.0), (4, 9, "GPL-3.0", 1, 1.0), (4, 18 + n, "GPL-3.0", 1, 1.0)}


def test_license_scan_finds_whole_texts(spark):
    """Complete texts with their titles and copyright lines, inside a longer document; the SQL finds the same."""
    import duckdb
    import pandas as pd

    rng = random.Random(5)
    prose = lambda n: "\n".join(" ".join(f"q{rng.randrange(900)}" for _ in range(11)) for _ in range(n))
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    mit, bsd, isc = license_scan.TEMPLATES["MIT"][3], license_scan.TEMPLATES["BSD-3-Clause"][2], license_scan.TEMPLATES["ISC"][1]
    rows = [(1, f"{prose(9)}\n\nMIT License\n\nCopyright (c) 2020 Somebody\n\n{wrap(mit, 12)}\n{prose(9)}"), (2, f"Copyright 2021\n{wrap(bsd, 10)}\n{prose(30)}\n{wrap(isc, 9)}"), (3, wrap(mit, 3)), (3, prose(5)), (4, None), (5, "in the of the and the to the\n" * 400)]
    got = sorted((r.doc_id, r.line_no, r.license, r.template_no, r.shared, r.unit_bigrams) for r in license_scan.scan_licenses(docs(spark, rows)).collect())
    best = {(r[0], r[2], r[3]): r for r in got}
    assert best[1, "MIT", 3][1] == 14 and best[2, "BSD-3-Clause", 2][1] == 1 and (2, "ISC", 1) in best and best[3, "MIT", 3][1] == -1
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(tuple(r[:6]) for r in c.sql(license_scan.OP10_SQL).fetchall()) == got


def test_license_scan_of_very_long_units(spark):
    """One line of 300,000 words, and 400 lines that are made of licence words."""
    line = license_scan.TEMPLATES["MIT"][1]
    rows = [(1, "in the of the and to " * 50_000), (2, ("the software is provided\n" + "and the license of\n") * 200 + line), (None, line + " " + "x" * 1_000_000)]
    assert [(r.doc_id, r.license, r.line_no) for r in license_scan.scan_licenses(docs(spark, rows)).collect() if r.dice == 1] == [(2, "MIT", 400)]


def test_license_scan_is_dice(spark):
    rng = random.Random(8)
    pool = [w for ts in license_scan.TEMPLATES.values() for t in ts for w in re.findall(r"[a-z0-9]+", t.lower())][:60]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(3)) + " " + t.rsplit(" ", rng.randrange(1, 4))[0]) for i, t in enumerate(t for ts in license_scan.TEMPLATES.values() for t in ts)]
    want = set()
    for i, text in rows:
        a = set(license_scan._bigrams(text))
        for name, k, b in license_scan._table(license_scan.TEMPLATES):
            if 2 * len(a & set(b)) / (len(a) + len(b)) >= 0.8:
                want.add((i, name, k, len(a & set(b))))
    assert {(r.doc_id, r.license, r.template_no, r.shared) for r in license_scan.scan_licenses(docs(spark, rows)).collect()} == want and want


def test_boundaries_are_optimal():
    rng = random.Random(9)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        cost = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))
        k = rng.randrange(1, 4)
        best = min(cost([*e, lengths[-1]]) for r in range(k) for e in itertools.combinations(lengths[:-1], r))
        ends = packing.boundaries(np.array(lengths), np.array(counts), k)
        assert cost(ends) == best and len(ends) <= k and ends[-1] == lengths[-1]


@pytest.mark.parametrize("ties", [False, True])
def test_boundaries_are_optimal_over_long_histograms(ties):
    """Against the plain dynamic programme, boundaries included, for lengths up to 30,000."""
    rng = np.random.default_rng(10)
    lengths = np.arange(1500) * 20 + 5 if ties else np.sort(rng.choice(30_000, 1500, replace=False))
    counts = np.ones(1500, dtype=int) if ties else rng.integers(1, 50, 1500) ** 3
    many, tokens = (np.concatenate(([0], np.cumsum(x))) for x in (counts, counts * lengths))
    best, back = np.concatenate(([0], np.full(1500, 10**15))), []
    for _ in range(6):
        costs = [best[:j] + lengths[j - 1] * (many[j] - many[:j]) - (tokens[j] - tokens[:j]) for j in range(1, 1501)]
        back.append([0, *(int(np.argmin(c)) for c in costs)])
        best = np.array([10**15, *(c.min() for c in costs)])
    want, j = [], 1500
    for came in reversed(back):
        want.append(int(lengths[j - 1]))
        j = came[j]
    got = packing.boundaries(lengths, counts, 6)
    assert got == want[::-1]


def test_packing(spark, awkward):
    rows = packing.pack(docs(spark, awkward), buckets=4, budget=500).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in awkward)
    text, batches = dict(awkward), {}
    for r in rows:
        assert r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or "")) and r.padding == r.bucket_tokens - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), members in batches.items():
        slots = max(1, 500 // max(1, members[0].bucket_tokens))
        assert sorted(m.slot for m in members) == list(range(len(members))) and len(members) <= slots
        assert len(members) == slots or (bucket, batch + 1) not in batches


def test_packing_of_equal_rows(spark, monkeypatch):
    """Null and repeated ids take a place each, also where many are equal."""
    monkeypatch.setattr(packing, "EQUAL", 8)
    rows = [(None, "a b")] * 50 + [(7, "a b")] * 30 + [(7, "a b c")] * 3 + [(i, None) for i in range(5)] + [(None, None)]
    got = packing.pack(docs(spark, rows), buckets=2, budget=12).collect()
    assert sorted(map(str, [(r.doc_id, r.n_tokens) for r in got])) == sorted(map(str, [(i, len((t or "").split())) for i, t in rows]))
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(rows)
    for bucket in {r.bucket for r in got}:
        mine = [r for r in got if r.bucket == bucket]
        slots = max(1, 12 // max(1, mine[0].bucket_tokens))
        assert sorted(r.batch * slots + r.slot for r in mine) == list(range(len(mine)))


def test_article_keeps_its_lists_of_links(monkeypatch):
    """Surges and dives decide in a declared article too, and nothing inside it goes."""
    seen, own = [], html_text.between_surge_and_dive
    monkeypatch.setattr(html_text, "between_surge_and_dive", lambda *a: seen.append(a[0]) or own(*a))
    links = "".join(f"<li><a href='/{i}'>Reference {i}</a></li>" for i in range(4))
    page = f"<body><nav><a href='/'>Home</a></nav><div><a>Up</a></div><article><h1>T</h1><p>Intro.</p><ul>{links}</ul><p>End.</p></article><footer>Imprint</footer><p>Outside of it.</p></body>"
    assert html_text.main_text(page).split("\n\n") == ["T", "Intro.", *(f"Reference {i}" for i in range(4)), "End."]
    assert seen == [[0, 0, 1, 6, 11, 11, 11, 11, 4, 0, 0]]


def labelled(spark, n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad, junk = rng.random() < 0.3, rng.random() < 0.3
        w = [f"word{rng.randrange(300)}" for _ in range(40)]
        if bad:
            w[3:5] = [rng.choice(["nasty", "vile"]) + rng.choice(["", "ing", "ly"]), "rotten"]
        if junk:
            w = [x + "!!" for x in w] + ["clickbait", "offer"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(spark, 900)
    given = spark.createDataFrame([x for x in labels if x[0] < 500] + [(None, 1, 1), (3, None, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, [*rows, (None, "rotten nasty"), (-1, None), (-2, "")]), given).collect()}
    fresh = [x for x in labels if x[0] >= 500]
    assert sum(got[i].rejected == bool(t) for i, _, t in fresh) >= 0.98 * len(fresh)
    assert sum((got[i].p_low_quality > 0.5) == (q == 0) for i, q, _ in fresh) >= 0.98 * len(fresh)
    assert got[None].rejected and not got[-1].rejected and got[-1].p_toxic == got[-2].p_toxic


def test_fit_is_the_optimum():
    """The weights against the optimality conditions of the penalised loss, worked out on the dense matrix."""
    rng = np.random.default_rng(15)
    x = rng.random((400, 25)) < 0.2
    y = rng.random(400) < 1 / (1 + np.exp(-(3 * x[:, 0] - 3 * x[:, 1] + 2 * x[:, 2] - 0.5)))
    before = rng.random((400, 1))
    rows, words = np.nonzero(x)
    model = toxicity.fit_linear(rows, words, 400, 25, before, y)
    of_true, of_all = x[y].sum(0), x.sum(0)
    ratio = np.log((of_true + 0.5) / (y.sum() + 1)) - np.log((of_all - of_true + 0.5) / (400 - y.sum() + 1))
    dense, w = np.column_stack([x * ratio, before]), np.append(np.divide(model.words, ratio), model.earlier)
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (400 - y.sum()))
    p = 1 / (1 + np.exp(-(dense @ w + model.intercept)))
    slope = dense.T @ (weight * (p - y)) + toxicity.L2 * w
    assert abs((weight * (p - y)).sum() + toxicity.L2 * model.intercept) < 1e-4
    assert np.all(np.abs(slope[w == 0]) <= toxicity.L1 + 1e-4) and np.allclose(slope[w != 0], -toxicity.L1 * np.sign(w[w != 0]), atol=1e-4)
    assert 0 < (w != 0).sum() < 26


def test_toxicity_sample_is_bounded_where_ids_repeat(spark):
    rows, labels = labelled(spark, 60)
    given = spark.createDataFrame([x for x in labels for _ in range(3)], "doc_id long, quality int, toxic int").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    once = toxicity.score_toxicity(docs(spark, rows), given).collect()
    thrice = toxicity.score_toxicity(docs(spark, rows * 3), given).collect()
    assert len(thrice) == 3 * len(once) and {tuple(r) for r in thrice} == {tuple(r) for r in once}


def test_chain_uses_earlier_categories(spark):
    """A later model weighs the earlier probability, and is fitted on out-of-fold ones."""
    y = np.arange(200) % 3 == 0
    model = toxicity.fit_linear(np.zeros(0, int), np.zeros(0, int), 200, 0, np.where(y, 0.9, 0.2)[:, None], y)
    assert model.earlier[0] > 1 and model.predict(np.zeros(2), np.array([[0.9], [0.2]])).round().tolist() == [1, 0]
    rows, labels = labelled(spark, 300, 2)
    given = spark.createDataFrame([(i, 1 - q, t) for i, q, t in labels], "doc_id long, first int, second int")
    chain = toxicity.fit_chain(docs(spark, rows).select("doc_id", "text"), given, ("first", "second"))
    assert [len(m.earlier) for m in chain.models] == [0, 1]


@pytest.mark.parametrize("labels", [[], [(1, 0, 0)], [(1, 1, 1), (2, 1, 1)]])
def test_toxicity_without_two_classes(spark, labels):
    given = spark.createDataFrame(labels, "doc_id long, low_quality int, toxic int")
    got = toxicity.score_toxicity(docs(spark, [(1, "a b"), (2, "c")]), given).collect()
    assert {r.rejected for r in got} == {bool(labels and labels[0][2])}


def test_empty_tables(spark):
    none, pages = docs(spark, []), spark.createDataFrame([], "page_id long, url string, html string")
    results = [exact_dedup.exact_dedup(none), minhash.near_duplicates(none), substring.remove_repeats(none), packing.pack(none), license_scan.scan_licenses(none), html_text.extract_text(pages), url_filter.judge_urls(pages), topk.top_k(vectors(spark, []), F.lit(True))]
    results.append(toxicity.score_toxicity(none, spark.createDataFrame([], "doc_id long, low_quality int, toxic int")))
    assert [r.count() for r in results] == [0] * len(results)


def test_native_operators_run_no_python(spark, awkward):
    small, pages = docs(spark, awkward), spark.createDataFrame([(1, "http://a.com/x", "")], "page_id long, url string, html string")
    for df in (exact_dedup.exact_dedup(small), license_scan.scan_licenses(small), url_filter.judge_urls(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    theirs = c.sql(registry.SQL[name])
    df = registry.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    assert sorted(theirs.columns) == order
    place = [list(theirs.columns).index(n) for n in order]
    assert sorted(str(tuple(r[n] for n in order)) for r in df.collect()) == sorted(str(tuple(r[k] for k in place)) for r in theirs.fetchall())
