"""Long and odd inputs, clashing names, and what the operators promise beyond the small fixtures."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixloom.llm import exact_topk, html_text, license_scan, line_dedup, mixing, ngram_join, packing, quality_rules, secret_scan, url_filters

LIMIT = 90


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts of a megabyte: one of words, one of a single line, and the same line with one character changed."""
    rng = random.Random(4)
    words = " ".join(f"w{rng.randrange(10**6)}" for _ in range(130_000))
    line = "".join(rng.choice("abcdefghij") for _ in range(1_000_000))
    rows = [(1, words, "a"), (2, line, "a"), (3, line[:500_000] + "#" + line[500_001:], "b"), (4, words + " more", "b"), (5, "short text of a few words", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


@pytest.mark.parametrize(
    "name,run",
    [
        ("license", lambda d: license_scan.scan(d).filter("licenses.n_words > 100000").count() == 2),
        ("lines", lambda d: {(r["row"]["key"], r["kind"]) for r in line_dedup.dropped(d).collect()} == {(3, "near")}),
        ("ngrams", lambda d: {r["id"]: r["component_id"] for r in ngram_join.join(d).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5}),
        ("mixing", lambda d: mixing.mix(d, F.array("source")).agg(F.sum("mix.size")).first()[0] == 260_009),
        ("packing", lambda d: packing.pack(packing.pieces(d)).agg(F.max("length")).first()[0] == 4096),
        ("secrets", lambda d: secret_scan.scan(d).count() == 5),
        ("quality", lambda d: quality_rules.filter_documents(d).count() == 2),
        ("url", lambda d: url_filters.judge(d, url_filters.HOST_RULES, "text").count() == 5),
        ("html", lambda d: html_text.extract(d, "text", "shown").filter("length(shown) >= 1000000").count() == 4),
    ],
)
def test_texts_of_a_megabyte(long_docs, name, run):
    began = time.time()
    assert run(long_docs)
    assert time.time() - began < LIMIT


def test_columns_with_inner_names_stay(spark):
    text = "Released under the MIT License\n" + " ".join(f"w{i}" for i in range(40))
    inner = "_l_words string, _l_hits long, _d_row string, row string, _d_gone long, keeper string, _n_row long, _m_size string, _m_pattern long, _u_key string, deal long"
    rows = [(i, text, "a", "https://x.org/es/", "x", 1, "y", "row", 2, "mine", 3, "s", 4, "k", 5) for i in (1, 2)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, url string, {inner}")
    for made in (
        license_scan.scan(df).drop("licenses"),
        line_dedup.dedup(df),
        ngram_join.one_of_each(df),
        mixing.mix(df, F.array("source")).drop("mix"),
        url_filters.judge(df, url_filters.HOST_RULES).drop("judged"),
        secret_scan.scan(df).drop("secrets"),
        quality_rules.filter_documents(df),
    ):
        assert made.columns == df.columns
        assert {tuple(r)[4:] for r in made.collect()} == {rows[0][4:]}


def test_html_keeps_visible_texts():
    render = html_text.render
    assert render("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a | b\n  | c"
    assert render("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>") == "wide  | z\na | b | c"
    assert render("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b></div>") == "yes"
    assert render("<svg><title>no</title><text>drawn</text></svg> <math><mi>x</mi></math>") == "drawn x"
    assert render('<p style="display:none" style="color:red">no</p>yes') == "yes"


@pytest.mark.parametrize(
    "page",
    ["<div>" * 30_000 + "x" + "</p>" * 30_000, "<table>" + "<tr><td>a<td>b" * 2000 + "<tr><td>" + "w" * 100_000 + "</table>", "<table>" + "<tr>" + "<td colspan=1000 rowspan=60000>a" * 300 + "<tr><td>b" * 300 + "</table>", "<p><table><tr><td>" + "<span>" * 30_000 + "<div>y</div>" * 30_000],
)
def test_html_of_odd_pages_stays_small_and_quick(page):
    began = time.time()
    assert len(html_text.render(page)) < 10 * len(page)
    assert time.time() - began < 20


@pytest.mark.parametrize("seed", range(30))
def test_html_words_of_random_trees(seed):
    """Trees with known words: all that are not in an undisplayed part come out, in order."""
    rng, want = random.Random(seed), []

    def tree(depth, seen):
        out = []
        for _ in range(rng.randrange(1, 5)):
            if depth == 0 or rng.random() < 0.4:
                word = f"w{len(want)}q{rng.randrange(1000)}"
                if seen:
                    want.append(word)
                out.append(f" {word} ")
                continue
            tag = rng.choice(["div", "p", "b", "span", "section", "ul", "table", "script", "hidden"])
            if tag == "p" or tag in ("b", "span"):  # only texts, so that no end tag is implied inside
                out.append(f"<{tag}>{tree(0, seen)}</{tag}>")
            elif tag == "ul":
                out.append("<ul>" + "".join(f"<li>{tree(depth - 1, seen)}" for _ in range(rng.randrange(1, 4))) + "</ul>")
            elif tag == "table":
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{tree(0, seen)}" for _ in range(rng.randrange(1, 4))) for _ in range(2)) + "</table>")
            elif tag == "script":
                out.append("<script>var no = '<b>';</script>")
            elif tag == "hidden":
                out.append(f"<div style='display: none'>{tree(depth - 1, False)}</div>")
            else:
                out.append(f"<{tag}>{tree(depth - 1, seen)}</{tag}>")
        return "".join(out)

    page = tree(4, True)
    got = [w.strip() for w in html_text.render(page).replace("|", " ").split() if w not in ("-", "*")]
    assert got == want


def test_url_rules_as_a_table(spark, monkeypatch):
    rules = [url_filters.host_path_rule("block" if k % 2 else "allow", f"h{k % 50}.example", f"/p{k}/") for k in range(300)] + url_filters.KEYWORD_RULES + url_filters.PATTERN_RULES
    urls = [f"https://www.h{k % 60}.example/p{k % 310}/x?casino" for k in range(400)] + ["https://a.b/online-poker/", "https://a.b/ad/big/banner.gif", "https://a.b/adbanner", None, "x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    short = Counter(url_filters.judge(df, rules).collect())
    monkeypatch.setattr(url_filters, "LITERAL_RULES", 10)
    assert Counter(url_filters.judge(df, rules).collect()) == short
    got = {r["page_id"]: r["judged"]["rule"] for r in url_filters.judge(df, rules).collect()}
    assert [got[k] for k in (400, 401, 402)] == ["~online-poker", "~ad-banner", None]


def test_tokenizers_that_keep_white_space_encode_whole_texts():
    path = packing.tokenizer_path("byte_bpe_50k.json")
    assert packing.goes_by_words(packing.tokenizer_path()) and not packing.goes_by_words(path)
    texts = ["two words\n  and more", "", " a"]
    assert packing.encode(texts, path) == packing.encode(texts, path, by_words=False)


def test_documents_are_dealt_whole(spark):
    df = spark.createDataFrame([(i % 7, "word " * 9000) for i in range(12)], "doc_id long, text string")
    packed = packing.pack(packing.pieces(df), group_tokens=20_000).collect()
    groups = Counter((r["doc_id"], r["sequence_id"] >> 24) for r in packed)
    assert all(n % 3 == 0 for n in groups.values()) and len({g for _, g in groups}) > 1


def test_mixing_of_many_sources(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 30), f"host{rng.randrange(12_000):05d}" if i % 50 else None) for i in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))], sum(sizes.values()))))
    taken = Counter()
    for r in mixing.mix(df, F.array("source")).select("source", "mix.*").collect():
        assert r["target"] == goal[r["source"]] and r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)


def cheapest(capacity, members, quota, most):
    """Most words, and their least cost, by paths of one word each (Bellman-Ford)."""
    n, m = len(capacity), len(quota)
    arcs = [("s", p, capacity[p], 2**k) for p in range(n) for k in range(most)] + [(p, n + q, 10**6, 0) for p in range(n) for q in members[p]] + [(n + q, "t", quota[q], 0) for q in range(m)]
    arcs = [list(a) for a in arcs] + [[b, a, 0, -c] for a, b, _, c in arcs]
    half, cost, words = len(arcs) // 2, 0, 0
    while True:
        dist, via = {"s": 0}, {}
        for _ in range(n + m + 2):
            for i, (a, b, cap, c) in enumerate(arcs):
                if cap and a in dist and dist[a] + c < dist.get(b, 10**9):
                    dist[b], via[b] = dist[a] + c, i
        if "t" not in dist:
            return words, cost
        at = "t"
        while at != "s":
            arcs[via[at]][2] -= 1
            arcs[(via[at] + half) % (2 * half)][2] += 1
            at = arcs[via[at]][0]
        words, cost = words + 1, cost + dist["t"]


@pytest.mark.parametrize("seed", range(20))
def test_flow_is_cheapest(seed):
    rng = random.Random(seed)
    capacity, quota = [rng.randrange(1, 5) for _ in range(4)], [rng.randrange(0, 9) for _ in range(3)]
    members = [sorted(rng.sample(range(3), rng.randrange(1, 4))) for _ in capacity]
    flow = mixing.min_cost_flow(capacity, members, quota, 3)
    cost = sum(sum(2**k * min(c, max(0, f - k * c)) for k in range(3)) for f, c in zip(flow, capacity))
    assert (sum(flow), cost) == cheapest(capacity, members, quota, 3)


def test_p_values_of_random_tokens_are_uniform():
    rng = random.Random(11)
    for symbols in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        for n in (20, 40, 150):
            p = np.sort([secret_scan.p_value("".join(rng.choice(symbols) for _ in range(n)))[1] for _ in range(1500)])
            assert np.abs(p - (np.arange(1500) + 0.5) / 1500).max() < 0.07  # Kolmogorov-Smirnov of two samples, p about 0.001


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_false_discoveries_are_controlled(spark, share):
    rng = random.Random(int(10 * share))
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    names = ["get", "user", "Name", "Of", "the", "Server", "Index", "value", "Http", "list"]
    tokens = [("".join(rng.choice(symbols) for _ in range(40)), True) if rng.random() < share else (("".join(rng.choice(names) for _ in range(12)) + "x7")[:40], False) for _ in range(1200)]
    df = spark.createDataFrame([(i, f"see {t} here", r) for i, (t, r) in enumerate(tokens)], "doc_id long, text string, random boolean")
    found = [r["random"] for r in secret_scan.scan(df).filter("size(secrets.spans) > 0").collect()]
    true = sum(r for _, r in tokens)
    assert sum(found) > 0.8 * true and found.count(False) <= 0.1 * len(found) + 3


def test_method_spans_by_brute_force(spark):
    rng = random.Random(12)
    token = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    rows = [(i, f'a {token(30)} secret="{token(25)}" {"word" * 6} b {token(44)} {"ab" * 15}') for i in range(150)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cands = [c for _, t in rows if t for c in secret_scan.candidates(t)]
    counted = df.sparkSession.createDataFrame([(*c[2:], 1) for c in cands], "enc int, len_class int, bin int, n long")
    least = secret_scan.thresholds(counted, 0.05)
    got = {r["doc_id"]: [tuple(s) for s in r["secrets"]["spans"]] for r in secret_scan.scan(df).collect()}
    for i, t in rows:
        base = secret_scan.base_spans(t or "")
        more = [(a, 3, b) for a, b, e, n, p in secret_scan.candidates(t or "") if p >= least.get((e, n), 10**9) and not any(x < b and a < y for x, _, y in base)]
        assert got[i] == sorted(base + more)
    assert sum(len(v) for v in got.values()) > 400


def test_lines_near_a_dropped_line_go_too(spark):
    a = "the first of a chain of lines, each near the last"
    rows = [(1, a), (2, a + "x"), (3, a + "xx"), (4, a + "xxx")]
    got = {(r["row"]["key"], r["kept"]["row"]["key"]) for r in line_dedup.dropped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 1), (3, 2), (4, 3)}


def test_topk_of_one_repeated_id(spark):
    df = spark.createDataFrame([(50, [1, 2])] * 3000 + [(k, [k, 1]) for k in range(1, 9)], "id long, w array<long>")
    got = exact_topk.search(df.filter("id = 50"), df, query_block=16).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 8, 10), (2, 7, 9), (3, 6, 8), (4, 5, 7), (5, 4, 6)]
