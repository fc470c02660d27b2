"""Jaccard join, line dedup, components and HTML extraction against brute force."""

import random
import re
import time
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import graph, html_extract, jaccard_join, line_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets(text, w):
    x = WORD.findall((text or "").encode().lower())
    return {tuple(x[i : i + w]) for i in range(max(1, len(x) - w + 1))} if x else set()


def brute_components(rows, w, num, den):
    own = [(i, sets(t, w)) for i, t in rows]
    up = list(range(len(own)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = {}
    for k, (i, _) in enumerate(own):
        if i in ids:
            up[root(k)] = root(ids[i])
        ids.setdefault(i, k)
    for (a, (_, x)), (b, (_, y)) in combinations(enumerate(own), 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(own):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in enumerate(own))


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(60))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(200)]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one two"), (4, "ONE  two"), (5, "one two three four five")]
    for i in range(6, n):
        kind = rng.randrange(6)
        if kind < 3:
            x = list(base)
            for _ in range(rng.randrange(0, 12)):
                x[rng.randrange(len(x))] = word()
            rows.append((i, " ".join(x)))
        elif kind == 3:
            rows.append((i, passage + " " + " ".join(word() for _ in range(rng.randrange(5, 40)))))
        elif kind == 4:
            rows.append((i, " ".join(word() for _ in range(rng.randrange(1, 80)))))
        else:
            rows.append((i, rows[rng.randrange(6, i)][1] if i > 6 else "x"))
    return rows


@pytest.mark.parametrize(("seed", "words", "t", "ratio"), [(1, 4, "0.85", (85, 100)), (2, 5, "0.8", (8, 10))])
def test_jaccard_components(spark, seed, words, t, ratio):
    rows = corpus(seed, 160)
    d = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, n string").repartition(5)
    got = jaccard_join.near_duplicates(d, words, t).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, words, *ratio)


@pytest.mark.parametrize(("seed", "rounds", "hot"), [(5, 0, 1), (6, 0, 6), (7, 1, 1), (8, 2, 16)])
def test_jaccard_hot_groups(spark, monkeypatch, seed, rounds, hot):
    """Variants of one text around the threshold, texts around one passage, and both at once."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "SPARE", hot // 2)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    base, passage = [word() for _ in range(70)], [word() for _ in range(40)]
    rows = []
    for i in range(150):
        x = list(base)
        for _ in range(rng.randrange(1, 6)):
            k = rng.randrange(len(x))
            x[k : k + rng.randrange(2)] = [word()] * rng.randrange(2)
        rows.append((i, " ".join((passage if i % 3 == 0 else []) + x if i % 5 else passage + [word() for _ in range(rng.randrange(5, 40))])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_duplicates(d, 4, "0.85").collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 4, 85, 100)


def test_jaccard_edges(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e F")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(d).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert sorted((r["doc_id"] for r in jaccard_join.one_of_each(d).collect()), key=str) == [1, None]
    empty = spark.createDataFrame([], d.schema)
    assert jaccard_join.near_duplicates(empty).collect() == [] and jaccard_join.one_of_each(empty).collect() == []


def test_texts_of_one_id_are_told_apart(spark):
    """Different texts of one id link by themselves, and only rows whose own text is a copy go."""
    rng = random.Random(11)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(80)]
    near = lambda x: " ".join([*x[:-1], "changed"])
    bases = [text() for _ in range(12)]
    rows = [(7, " ".join(x)) for x in bases] + [(100 + i, near(x)) for i, x in enumerate(bases)]
    rows += [(7, near(bases[0])), (7, " ".join(bases[1])), (7, " ".join(bases[2]).upper()), (7, ""), (200, " ".join(text())), (3, " ".join([*bases[3], "more"])), (300, " ".join(bases[3]))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(d).collect()}
    assert got == {(7, 7), (7, 3), (3, 3), (300, 3), (103, 3), (200, 200)} | {(100 + i, 7) for i in range(12) if i != 3}
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in jaccard_join.one_of_each(d).collect()]
    fixed = {(7, " ".join(x)) for x in [*bases[1:3], *bases[4:]]} | {(7, ""), rows[-3], rows[-2]}
    assert len(kept) == len(set(kept)) == len(fixed) + 1
    assert set(kept) - fixed <= {rows[0], (7, near(bases[0]))}


def test_components_of_a_long_path(spark):
    rng = random.Random(4)
    ids = list(range(100, 164))
    rng.shuffle(ids)
    edges = list(zip(ids, ids[1:], strict=False)) + [(1, 2), (2, 3), (9, 9)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in ids} | {1: 1, 2: 1, 3: 1}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abé", max_size=9), st.text("abé", max_size=9), st.integers(0, 4))
def test_banded_distance(a, b, k):
    assert line_dedup.edit_within(a, b, k) == (levenshtein(a, b) <= k)


@settings(max_examples=150, deadline=None)
@given(st.text("ab", min_size=6, max_size=20), st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["", "a", "b", "x"]), st.booleans()), max_size=2))
def test_segment_keys_are_complete(a, edits):
    b = a
    for at, c, insert in edits:
        b = b[:at] + c + b[at if insert else at + 1 :]
    if len(b) < 6 or levenshtein(a, b) > 2:
        return
    short, long = sorted((a, b), key=len)
    row, key, probe = line_dedup.keys_of([short, long], 2, 6)
    assert set(key[(row == 0) & ~probe].tolist()) & set(key[(row == 1) & probe].tolist())


def brute_lines(rows, least, k):
    lines = [((i is not None, i), n, x, j) for j, (i, t) in enumerate(rows) for n, x in enumerate((t or "").split("\n")) if t is not None]
    lines = [x for x in lines if len(x[2]) >= least]
    lines.sort(key=lambda x: (x[0][0], x[0][1] or 0, x[1]))
    gone, first = set(), {}
    for who, n, x, j in lines:
        first.setdefault(x, (who, n))
    order = list(first)
    near = {y for a, y in combinations(order, 2) if abs(len(a) - len(y)) <= k and levenshtein(a, y) <= k}
    for who, n, x, j in lines:
        if x in near or first[x] != (who, n):
            gone.add((j, n))
    return gone


@pytest.mark.parametrize("hot", [16, 2])
def test_line_dedup(spark, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(9)
    base = ["".join(rng.choice("abcde fgh") for _ in range(rng.randrange(20, 60))) for _ in range(12)]

    def variant():
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 2, 3, 5])):
            at = rng.randrange(len(x))
            x[at : at + rng.randrange(2)] = rng.choice(["", "q", "z", "é"])
        return "".join(x)

    rows = [(i, "\n".join(variant() for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "short\n\nshort"), (None, base[0])]
    d = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, line string").repartition(3)
    want = brute_lines(rows, 24, 2)
    assert len(want) > 50
    by = {}
    for j, n in want:
        by.setdefault(rows[j][0], []).append(n)
    got = {r["doc_id"]: r for r in line_dedup.report(d).collect()}
    assert {k: r["removed"] for k, r in got.items() if r["removed"]} == {k: sorted(v) for k, v in by.items()}
    assert got[100]["n_lines"] == 0 and got[102]["n_lines"] == 3
    clean = {r["doc_id"]: r["text"] for r in line_dedup.deduped(d).collect()}
    for j, (i, t) in enumerate(rows):
        left = [x for n, x in enumerate(t.split("\n")) if (j, n) not in want] if t is not None else None
        if t is None or not any((j, n) in want for n in range(99)):
            assert clean[i] == t
        elif "".join(left).strip():
            assert clean[i] == "\n".join(left)
        else:
            assert i not in clean
    empty = spark.createDataFrame([], d.schema)
    assert line_dedup.report(empty).collect() == [] and line_dedup.deduped(empty).collect() == []


def test_short_lines_lose_their_equal_copies(spark, tmp_path):
    import corpus_pipeline
    from keystrata.llm import queries

    rows = [(1, "All rights reserved.\n \n\nItem 1"), (2, "Item 2\nAll rights reserved.\n \n你好世界"), (3, "own\n你好世界\nAll rights reserved.\nAll rights reserved."), (4, "Item 1")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["removed"], r["earlier"]) for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: ([], []), 2: ([1], [1]), 3: ([1, 2, 3], [2, 1, 1]), 4: ([0], [1])}
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, d, "").collect()}
    assert clean == {1: rows[0][1], 2: "Item 2\n \n你好世界", 3: "own"}


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy</div><article><h1>T &amp; x</h1><p><b>One  two<br><p>Three&nbsp;&lt;b&gt; four</p>
<div id="comments"><p>nice post</p></div><aside>side</aside><p>{0}</p></article><div class="cookie-notice">ok</div><form><p>mail</p></form><footer>(c)</footer>"""


def test_html_blocks(spark):
    assert html_extract.blocks_of(PAGE.format("End")) == [("T & x", True), ("One two", True), ("Three <b> four", True), ("End", True)]
    assert html_extract.blocks_of("") == [] and html_extract.blocks_of("plain  text <") == [("plain text <", False)]
    assert html_extract.blocks_of("<p>a<p>b<div>c<td>d") == [("a", False), ("b", False), ("c", False), ("d", False)]
    assert html_extract.blocks_of('<a title="x > y">t</a><p class=\'"\'>u') == [("t", False), ("u", False)]


def test_suffix_array_removes_what_pages_repeat(spark):
    chrome = "all rights are reserved by the owner of this site and nobody else"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{chrome}</div><div>page number {i} has words of its own {i * 7}</div></body>") for i in range(12)]
    rows += [(20, "http://h.example/a", PAGE.format(chrome)), (21, "http://h.example/b", PAGE.format(chrome)), (22, None, None), (23, "http://o.example/", f"<p>{chrome}</p>"), (23, "http://o.example/", f"<p>{chrome}</p>")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extract(d, partitions=2).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["text"] == f"page number {i} has words of its own {i * 7}" and by[i]["n_repeated"] >= 13 for i in range(12))
    assert by[20]["text"] == f"T & x\n\nOne two\n\nThree <b> four\n\n{chrome}" and by[20]["n_chars"] == len(by[20]["text"])
    assert by[22]["text"] == "" and by[23]["text"] == chrome
    assert html_extract.extract(spark.createDataFrame([], d.schema)).collect() == []


@pytest.mark.parametrize(("pages", "chars"), [(2, 4 << 20), (256, 400), (256, 4 << 20)])
def test_repeats_are_found_over_all_pages_of_a_host(spark, monkeypatch, pages, chars):
    """However pages fall into groups, the result is that of the whole host in one piece."""
    monkeypatch.setattr(html_extract, "GROUP_PAGES", pages)
    monkeypatch.setattr(html_extract, "GROUP_CHARS", chars)
    rng = random.Random(3)
    lines = [" ".join(f"{rng.choice('aBc')}{rng.randrange(50)}" for _ in range(rng.randrange(6, 14))) for _ in range(30)]
    rows = [(i, f"http://h{i % 2}.example/{i}", "".join(f"<{(t := rng.choice(['div', 'article']))}>{x}</{t}>" for x in [*rng.sample(lines, 2), f"own words {i} of this page only and no other {i}"])) for i in range(40)]
    rows += [(None, "http://h0.example/", rows[0][2]), rows[4], (40, "http://h0.example/x", "<p>one"), (41, "http://h1.example/y", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    want = []
    for h in ("h0", "h1"):
        own = [r for r in rows if f"//{h}." in r[1]]
        texts = html_extract.main_texts([html_extract.blocks_of(r[2] or "") for r in own], [r[0] for r in own])
        want += [(r[0], r[1], t, len(t), c) for r, (t, c) in zip(own, texts, strict=True)]
    got = [tuple(r) for r in html_extract.extract(d, partitions=3).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeats_do_not_depend_on_partitions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    one, many = (sorted(map(tuple, html_extract.extract(pages.repartition(n)).collect())) for n in (1, 7))
    assert one == many and len(one) == pages.count()
    assert sum(r[4] for r in one) > 0  # the repeats, not the marks alone, take furniture away


def test_repeats_remove_marked_and_unmarked_furniture_alike(spark):
    menu = "home news weather sport culture science travel money style"
    rows = [(i, f"http://h.example/{i}", f"<{tag}>{menu}</{tag}><article><p>text {i}</p><{tag} class='legal'>clause {i} of the contract stays</{tag}></article>") for i, tag in enumerate(["nav", "div", "section", "div"])]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["n_repeated"] == 9 for i in got)
    assert got[1]["text"] == "text 1\n\nclause 1 of the contract stays" and got[0]["text"] == "text 0"


def test_articles_lose_no_text():
    article = '<article><p>a</p><div class="legal">b</div><p><math><mi>c</mi></math> <label>d</label></p><div class="notice">e</div><p class="menu">f</p><map>g</map></article>'
    assert html_extract.blocks_of(article) == [(x, True) for x in ("a", "b", "c d", "e", "f", "g")]
    assert html_extract.blocks_of('<p title=it\'s>don\'t</p><p title="never closed>kept</p>') == [("don't", False), ("kept", False)]
    assert html_extract.blocks_of("<p>&#" + "9" * 6000 + "; &#00000000065; &#x0000000041;") == [("\ufffd A A", False)]


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000, "<a ='" * 200_000 + ">", "<b>" * 170_000 + "</i>" * 120_000, "<b>" * 100_000 + "<p></p>" * 100_000, "<!" * 500_000, "<![CDATA[" * 100_000, "<script" * 140_000, "</" * 500_000, "&#" * 500_000, "<a x=\">\" " * 100_000, "<" * 1_000_000])
def test_broken_markup_takes_linear_time(page):
    began = time.process_time()
    html_extract.all_blocks(page)
    assert time.process_time() - began < 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=4))
def test_repeated_runs(pages):
    import numpy as np

    tokens = np.array([x for p in pages for x in p], np.int64)
    page = np.array([i for i, p in enumerate(pages) for _ in p], np.int64)
    got = html_extract.covered(html_extract.repeated(tokens, page, 3), len(tokens), 3)
    want, where = [], {}
    for i, p in enumerate(pages):
        for j in range(len(p) - 2):
            where.setdefault(tuple(p[j : j + 3]), set()).add(i)
    for p in pages:
        mark = [False] * len(p)
        for j in range(len(p) - 2):
            if len(where[tuple(p[j : j + 3])]) > 1:
                mark[j : j + 3] = [True] * 3
        want += mark
    if len(tokens) >= 6:
        assert got.tolist() == want
