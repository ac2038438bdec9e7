"""Each operator against brute force, an exact round trip or held-out accuracy."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import time
import urllib.parse
import zlib
from collections import Counter
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablekin.llm import common, embedding_dedup, html_extraction, jaccard_join, packing, quality_rules, secret_scan, shingles, source_mixing, token_output, tokens, toxicity
from tablekin.llm.common import Forest, components, local_forest, shared_folder
from tablekin.llm.common import stored as shared

SF = "/root/testdata/sf0.001"


def brute_components(nodes, pairs):
    parent = {n: n for n in nodes}
    for x, r in local_forest(pairs):
        parent[x] = r
    return parent


# 1: HTML


def test_layout():
    html = """<head><title>T</title><style>.ad,#x{display:none}</style></head><body><h1>Head</h1><div>one <b>two</b>
      three</div><p hidden>no</p><p class="ad big">no</p><ul><li>a<li>b<ol start=3><li>c</ol></ul><table><tr><th>k<th>value
      <tr><td>long key<td>1</table><pre>x  y
 z</pre><script>no()</script>a<br>b"""
    title, text = html_extraction.extract(html)
    assert title == "T"
    assert text == "Head\n\none two three\n\n- a\n- b\n  3. c\n\nk        | value\nlong key | 1\n\nx  y\n z\n\na\nb"


@pytest.mark.parametrize(
    ("css", "seen"),
    [
        ("@media print{body{display:none} .a{display:none}}", "one two"),
        ("@media (max-width:600px){div{display:none}}", "one two"),
        ("@media screen and (min-width: 600px){.a{display:none}}", "two"),
        ("@media not print{.a{display:none}} @import 'x';", "two"),
        ("div{display:none} .a.b{display:block}", "one"),
        ("@supports (display:grid){.a{color:red;display:none}}", "two"),
        (".a{display:none} div{display:block}", "two"),
        (".a{display:none!important} #i{display:block}", "two"),
        (".a{display:none} .x .b{display:flex}", "one two"),
        (".a:hover{display:none} @font-face{x:y} .c{visibility:hidden}", "one"),
    ],
)
def test_style_sheets_as_on_screen(css, seen):
    html = f'<head><style>{css}</style></head><div class="a b" id=i>one</div><div class=c>two</div>'
    assert " ".join(html_extraction.extract(html)[1].split()) == seen


@pytest.mark.parametrize("sheet", ["<style media=print>div{display:none}</style>", "<noscript><style>div{display:none}</style></noscript>", "<template><style>div{display:none}</style></template>"])
def test_style_sheets_that_do_not_count(sheet):
    assert html_extraction.extract(sheet + "<div>one</div>")[1] == "one"


@pytest.mark.parametrize(
    ("html", "seen"),
    [
        ("<p>so <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>tex</annotation></math> holds", "so E=m holds"),
        ("a<svg><title>no</title><defs><text>no</text></defs><g> stray <text>one <tspan>two</tspan></text><text>three</text></g></svg>b", "a one two three b"),
        ("<textarea>first\nsecond</textarea>", "first\nsecond"),
        ("<select><option>one<option selected>two<option>three</select> x", "two x"),
        ("<select><option disabled>one<option>two</select><datalist><option>no</datalist>", "two"),
        ("<select multiple><option>one<option>two</select>", "one\ntwo"),
        ("go <input type=submit value=Send><input type=hidden value=no><input type=password value=no><input type=checkbox value=no> <input value=typed>", "go Send typed"),
        ("<head><title>t</title><li>one", "- one"),
        ("<head><meta x><tr><td>cell", "cell"),
        ("<head><dt>term<dd>what", "term\n  what"),
    ],
)
def test_what_browsers_show(html, seen):
    assert html_extraction.extract(html)[1] == seen


@pytest.mark.parametrize(
    ("html", "seen"),
    [
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c<td>d<tr><td colspan=2>wide cell<td>e</table>", "A | b\n  | c     | d\nwide cell | e"),
        ("<table><tr><th>k<th>v<tr><td><p>one<p>two<td><ul><li>x<li>y</ul><tr><td>z<td>1</table>", "k   | v\none | - x\n    | - y\ntwo\nz   | 1"),
        (f"<table><tr><td>{'w' * 90}<td>1<tr><td>a<td>2</table>", f"{'w' * 90} | 1\na{' ' * 89} | 2"),
        ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b></div>", "yes"),
        ("<style>.v{visibility:visible} .h{visibility:hidden}</style><ul class=h><li>no<li class=v>yes</ul>", "- yes"),
        ("a<select><option>one<select><option>two", "a one two"),
        ("<p>a < b &#0000000065; &#99999999999999; <!--> c <!-- no --!> d <? no > e </ no> f", "a < b A \ufffd c d e f"),
        ("x<title>no</title><noscript><b>no</b></noscript><script>'</p>'</script>y", "xy"),
        ("<p title='>'>a<P CLASS=\"x>y\">b", "a\n\nb"),
        ("<svg><text><![CDATA[a < b]]></text></svg><![CDATA[no]]>c", "a < b c"),
    ],
)
def test_layout_of_soup(html, seen):
    assert html_extraction.extract(html)[1] == seen


HOSTILE = {
    "tags": "<a " * 20_000, "deep": "<b><i>" * 5_000 + "</b></p>" * 5_000, "tables": "<table><tr><td>a<td>" * 3_000, "lists": "<ul><li>x" * 6_000,
    "cells": "<table><tr>" + "<td rowspan=60000 colspan=9>a" * 1_000 + "<tr><td>x" * 5_000, "lines": "<table><tr>" + "<td>" * 5_000 + "x<br>" * 5_000,
    "select": "<select><option>a" * 3_000, "number": "&#" + "9" * 60_000, "zeros": "&#" + "0" * 60_000 + "65;", "comments": "<!--" * 15_000, "rules": "<style>" + ".a.b{display:none}" * 3_000 + "</style>" + "<p class=a>x" * 3_000,
    "braces": "<style>" + "{" * 60_000, "media": "<style media='(" + " " * 60_000 + "'>",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_in_proportion(name):
    began = time.process_time()
    html_extraction.extract(HOSTILE[name])
    assert time.process_time() - began < 2  # quadratic work would take minutes


class Plain(HTMLParser):
    """All text of a page that no hidden element holds, by the standard library's parser, without layout."""

    def __init__(self, hidden):
        super().__init__()
        self.hidden, self.open, self.text = hidden, [], []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        off = tag in html_extraction.HIDDEN or "hidden" in own or "display:none" in (own.get("style") or "").replace(" ", "") or bool(self.hidden & set((own.get("class") or "").split()))
        if tag not in html_extraction.VOID:
            self.open.append((tag, off))

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(off for _, off in self.open):
            self.text.append(data)


def test_all_visible_text_of_the_pages(spark):
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        plain = Plain(set(re.findall(r"\.([\w-]+)\s*\{[^}]*display:\s*none", row.html)))
        plain.feed(row.html)
        marks = r"^[ ]*(?:- |[0-9]+\. )|\||^---$"
        words = lambda t: Counter(re.sub(marks, " ", t, flags=re.MULTILINE).split())
        got, want = words(html_extraction.extract(row.html)[1]), words(" ".join(plain.text))
        glued = lambda c: Counter("".join(sorted("".join(c.elements()))))
        assert glued(got) == glued(want)


@given(st.text(alphabet="<>/=\"' abpdivtrul&;!-", max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_soup(html):
    html_extraction.extract(html)


# 2: token files


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=200))
@settings(deadline=None)
def test_code_round_trip(numbers):
    control, data = token_output.packed(np.array(numbers, np.uint32))
    assert token_output.unpacked(control, data, len(numbers)).tolist() == numbers
    assert len(control) == -(-len(numbers) // 4)
    assert len(data) == sum(max(1, -(-n.bit_length() // 8)) for n in numbers)


@given(st.lists(st.text(alphabet="aAbBzßéÉµÅÿ İıΣσς.,!'st<|endoftx>\n\t\x0b\x85\xa0\x01é😀9७ﬁ½", max_size=40), max_size=5))
@settings(max_examples=150, deadline=None)
def test_words_give_the_ids_of_whole_texts(texts):
    ids = tokens.loaded(tokens.default_path())
    whole = [ids.encoder.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in ids(texts)] == whole


def test_token_files(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = shared_folder(spark)
    token_output.write(docs, folder)
    got = sorted(token_output.token_ids(spark, folder).collect())
    want = sorted(docs.select("doc_id", "text").collect())
    encoder = tokens.loaded(tokens.default_path()).encoder
    start = 0
    for row, doc in zip(got, want, strict=True):
        ids = encoder.encode(doc.text, add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.ids) == (doc.doc_id, start, ids)
        start += len(ids)
    vocab = [r.n for r in spark.read.parquet(f"{folder}/vocab").orderBy("rank").collect()]
    assert vocab == sorted(vocab, reverse=True)


# 3: vectors


@pytest.mark.parametrize(("seed", "pivots"), [(1, 16), (2, 4)])
def test_range_join(spark, seed, pivots, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PIVOTS", (pivots,))
    monkeypatch.setattr(embedding_dedup, "LEAST_CHUNK", 16)
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 6))
    x = np.concatenate([base[rng.integers(0, 40, 260)] + rng.normal(scale=0.12, size=(260, 6)), base[[0] * 60] + 0, rng.normal(size=(60, 6))])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(frame).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    parent = brute_components(range(len(x)), zip(*(v.tolist() for v in np.nonzero(hit)), strict=True))
    assert got == {k: (int(hit[k].sum()), parent[k]) for k in range(len(x))}


def test_boundary_replication_misses_nothing():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = x[:30]
    home, guest = embedding_dedup.homes_and_guests(x, pivots, 0.9)
    i, j = np.nonzero(x @ x.T >= 0.9)
    for a, b in zip(i, j, strict=True):
        if home[a] < home[b]:
            assert guest[b, home[a]]


def test_pivots_follow_the_data():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(300, 16))
    chosen = {}
    for name, x in (("scattered", rng.normal(size=(1500, 64))), ("clustered", centres[rng.integers(0, 300, 1500)] + rng.normal(scale=0.05, size=(1500, 16)))):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        chosen[name] = min((4, 64, 256), key=lambda k: embedding_dedup.work(x[500:], x[:k], 1e6, 512, 65536, 0.9))
    assert chosen["scattered"] == 4 < chosen["clustered"]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60), st.integers(1, 7))
@settings(deadline=None)
def test_forest_of_links(pairs, batch):
    ids = np.random.default_rng(1).permutation(1000)[:31]
    forest = Forest(ids)
    for k in range(0, len(pairs), batch):
        i, j = np.array(pairs[k : k + batch]).T
        forest.link(i, j)
    want = brute_components(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in pairs])
    assert dict(zip(*forest.pairs(), strict=True)) == {k: r for k, r in want.items() if r != k}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    assert got == brute_components(nodes, pairs)


# 4: packing


def check_plan(plan, counts, capacity):
    used = {}
    for length, rules in plan.rules.items():
        at = 0
        for first, count, sequence, offset in rules:
            assert first == at
            at += count
            for k in range(count):
                used.setdefault(sequence + k, []).append((offset, length))
        assert at == counts[length]
    assert sorted(used) == list(range(plan.sequences))
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
@settings(max_examples=300, deadline=None)
def test_every_plan_is_gapless(lengths):
    counts = dict(Counter(lengths))
    check_plan(packing.solve(counts, 20), counts, 20)


def fewest(lengths, capacity):
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[k] <= capacity and bins[j] not in bins[:j]:
                place(k + 1, [*bins[:j], bins[j] + lengths[k], *bins[j + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_reduction_costs_nothing():
    rng = random.Random(4)
    for _ in range(150):
        lengths = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        plan = packing.Plan(20)
        rest = packing.reduced(plan, dict(Counter(lengths)))
        left = sorted((x for x, n in rest.items() for _ in range(n)), reverse=True)
        assert plan.sequences + (fewest(left, 20) if left else 0) == fewest(lengths, 20)


# 5: Jaccard join


def test_jaccard_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for size in (40, 5, 3, 1, 1, 1):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
    texts += texts[:3]
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    links = Counter(x for p in pairs for x in p)
    parent = brute_components(range(len(texts)), pairs)
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == {k: (links[k], parent[k]) for k in range(len(texts))}


def test_jaccard_join_broadcasts_counted_sides_only(spark, monkeypatch):
    """Under Spark's own threshold of 10 MB, which all tables here are below."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    plans = []

    def seen(df, keep=False, write=common.stored):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, keep)

    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    for module in (common, jaccard_join):
        monkeypatch.setattr(module, "stored", seen)
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(30)] + ["a b c d e f"] * 2
    out = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect() if r.kept) == [0, 30]
    left = jaccard_join.without_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [0, 30]
    plans += [x._jdf.queryExecution().sparkPlan().toString() for x in (out, left)]
    assert sum("SortMergeJoin" in p for p in plans) > 10
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]


@given(st.lists(st.integers(1, 200), min_size=shingles.TREES, max_size=shingles.TREES), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_prefixes_are_shortened_until_the_recall(base, seed):
    rng = random.Random(seed)
    crowds = {}
    for t, n in enumerate(base):
        if rng.random() < 0.7:
            deeper = rng.randint(1, n)
            crowds[t] = {4: n, 5: deeper, 6: rng.randint(1, deeper)}
    ends = shingles.shortened(crowds)
    depth = [ends.get(t, shingles.LEAST) for t in range(shingles.TREES)]
    missed = lambda ds: np.prod([1 - shingles.SIMILARITY**d for d in ds])
    assert missed(depth) <= 1 - shingles.RECALL
    if ends and max(d for d in ends.values()) < 6:  # no step more than needed: the last one made the difference
        assert any(missed([d + (k == t) for k, d in enumerate(depth)]) > 1 - shingles.RECALL for t in ends)


def test_signatures_agree_as_the_sets_do():
    rng = np.random.default_rng(4)
    agree, below = 0, 0
    for _ in range(40):
        x = rng.integers(0, 2**63, 500).astype(np.uint64)
        y = np.concatenate([x[:400], rng.integers(0, 2**63, 50).astype(np.uint64)])  # 400 of 550 in common
        p, q = (shingles.prefixes(shingles.signature(s)) for s in (x, y))
        agree += (p[0] == q[0]).sum()
        below += ((p[0] == q[0]) & (p[1] == q[1])).sum()
    n = 40 * shingles.TREES
    assert abs(agree / n - (400 / 550) ** 4) < 0.06 and abs(below / n - (400 / 550) ** 6) < 0.06


@given(st.lists(st.sets(st.integers(0, 60), min_size=1), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_intersections(sets):
    got = jaccard_join.linked([np.array(sorted(s), np.uint64) for s in sets], Fraction(4, 5))
    for a, b in itertools.product(range(len(sets)), repeat=2):
        assert got[a, b] == (a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


# 6: mixing


def test_mixing_meets_the_weights(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "'t' as text", "if(id % 3 = 0, 'big', concat('s', id % 50)) as source")
    got = {r.source: r["count"] for r in source_mixing.source_mixing(docs, {"big": 1.0, "s1": 2.0, "s2": 1.0}).groupBy("source").count().collect()}
    total = docs.where("source in ('big', 's1', 's2')").count()
    assert set(got) == {"big", "s1", "s2"}
    for k, w in (("big", 0.25), ("s1", 0.5), ("s2", 0.25)):
        assert abs(got[k] - w * total) < 5 * (w * total * 30) ** 0.5


def test_poisson_function(spark):
    row = spark.range(1).select(*(source_mixing.cdf(F.lit(r)).alias(str(k)) for k, r in enumerate((0.3, 4.0, 800.0)))).first()
    for got, rate in zip(row, (0.3, 4.0, 800.0), strict=True):
        k = np.arange(len(got))
        log = -rate + k * np.log(rate) - np.array([np.sum(np.log(np.arange(1, n + 1))) for n in k])
        assert np.allclose(got, np.cumsum(np.exp(log)), atol=1e-9) and got[-1] > 1 - 1e-9


def test_the_query_mixes_whole_documents(spark, monkeypatch):
    written = []
    monkeypatch.setattr(source_mixing, "stored", lambda df: written.append(shared(df)) or written[0])
    rows = source_mixing.op6_source_mixing(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    copies = {r.doc_id: r.n_copies for r in rows}
    want = Counter({tuple(docs[k]): n for k, n in copies.items()})
    assert Counter(tuple(r) for r in written[0].select("doc.doc_id", "doc.text", "doc.lang", "doc.source", "doc.n_chars").collect()) == want
    assert all(r.n_text == len(docs[r.doc_id].text) for r in rows)


def test_no_column_name_clashes_with_mixing(spark):
    names = ["copy", "place", "rate", "cdf", "u", "n_copies", "source_key", "doc", "_salt", "weight", "n_docs", "_copy", "_rate"]
    docs = spark.range(300).selectExpr("id as doc_id", "'t' as text", "concat('s', id % 3) as source", *(f"'own {n}' as {n}" for n in names))
    got = source_mixing.source_mixing(docs)
    assert got.columns == docs.columns
    assert all(r[n] == f"own {n}" for r in got.collect() for n in names)


def test_the_mixed_order_is_global_and_needs_no_second_pass(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'t' as text", "concat('s', id % 3) as source")
    rows = source_mixing.shuffled(source_mixing.mixed(docs), 5)
    assert rows.rdd.getNumPartitions() == 5
    places = [r.place for r in rows.collect()]
    assert places == sorted(places) and len(places) > 1500
    assert "rangepartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


# 7: secrets

KEY = "password = hunter2hunter2"


@pytest.mark.parametrize(
    ("wrapped", "span"),
    [
        (urllib.parse.quote(KEY, safe=""), None),
        ("".join(f"\\u{ord(c):04x}" for c in KEY), None),
        ("".join(f"&#{ord(c)};" for c in KEY), None),
        (base64.b64encode(KEY.encode()).decode(), None),
        (base64.b64encode(gzip.compress(KEY.encode())).decode(), None),
        (base64.b64encode(zlib.compress(base64.b64encode(("zz " + KEY).encode()))).decode(), None),
        (urllib.parse.quote(base64.b64encode(urllib.parse.quote(KEY, safe="").encode()).decode(), safe=""), None),
    ],
)
def test_nested_layers(wrapped, span):
    text = "héllo 😀 " + wrapped + " bye"
    base, spans = secret_scan.secrets(text)
    found = [(a, b) for k, a, b in spans if k == "assign"]
    assert found and not base
    at = text.index(wrapped)
    assert all(at <= a < b <= at + len(wrapped) for a, b in found)
    assert "hunter2" not in secret_scan.secrets(text)[1]


@pytest.mark.parametrize("size", [100, 9 << 20])
@pytest.mark.parametrize("inner", [urllib.parse.quote(KEY, safe=""), base64.b64encode(gzip.compress(KEY.encode())).decode()])
def test_size_of_a_stream_decides_nothing(size, inner):
    stream = base64.b64encode(gzip.compress(b"caf\xe9 " + b"z " * (size // 2) + inner.encode() + b" z" * 50)).decode()
    assert ("assign", 2, 2 + len(stream.rstrip("="))) in [(k, a, min(b, 2 + len(stream.rstrip("=")))) for k, a, b in secret_scan.secrets("a " + stream)[1]]


@pytest.mark.parametrize(
    "wrapped",
    [
        base64.b64encode(gzip.compress(gzip.compress(KEY.encode()))).decode(),
        base64.b64encode(gzip.compress(zlib.compress(gzip.compress(KEY.encode())))).decode(),
        base64.b64encode(gzip.compress(b"first") + gzip.compress(KEY.encode())).decode(),
        urllib.parse.quote(gzip.compress(KEY.encode()), safe=""),
        urllib.parse.quote(zlib.compress(KEY.encode()), safe=""),
        "".join(f"\\x{b:02x}" for b in gzip.compress(KEY.encode())),
    ],
)
def test_compressed_below_compressed_or_escaped(wrapped):
    text = "héllo " + wrapped + " bye"
    found = [(a, b) for k, a, b in secret_scan.secrets(text)[1] if k == "assign"]
    assert found and all(6 <= a < b <= 6 + len(wrapped) for a, b in found)


BODY = ("x y " * 40 + KEY + " z" * 60).encode()
LINES = random.Random(2).randbytes(150).hex(" ").encode() + b" " + KEY.encode()


@pytest.mark.parametrize(
    "wrapped",
    [
        *(base64.encodebytes(b"z " * k + KEY.encode() + b" z" * 60).decode().strip() for k in (15, 18, 21, 24)),
        base64.encodebytes(gzip.compress(LINES)).decode().strip(),
        base64.encodebytes(BODY).decode().strip().replace("\n", "\r\n"),
        *("y/-_"[:k] + "key"[: 4 - k] + "/" + base64.b64encode(BODY).decode() for k in (1, 2, 3)),
        "blob-" + base64.b64encode(gzip.compress(LINES)).decode(),
        "key_" + base64.b64encode(KEY.encode()).decode().rstrip("=") + "/abc",
        base64.b64encode(BODY + b"zz").decode().rstrip("=") + "AAAAA",
    ],
)
def test_base64_lines_and_alignments(wrapped):
    text = "héllo " + wrapped + " bye"
    found = [(a, b) for k, a, b in secret_scan.secrets(text)[1] if k == "assign"]
    assert found and all(6 <= a < b <= 6 + len(wrapped) for a, b in found)


@pytest.mark.parametrize(
    "wrapped",
    [
        urllib.parse.quote_plus(KEY), "a=1&b=" + urllib.parse.quote_plus(KEY + " ok"), "%ff%fe" + urllib.parse.quote(KEY, safe=""), base64.b64encode(("é " + KEY).encode("latin-1")).decode(),
        *(base64.b64encode(KEY.encode(c)).decode() for c in ("utf-16", "utf-16-le", "utf-16-be")), base64.b64encode(gzip.compress(KEY.encode("utf-16"))).decode(),
        "password%" + "25" * 3000 + "3Dhunter2hunter2", "password&" + "amp;" * 3000 + "#61;hunter2hunter2", "password\\" + "u005c" * 3000 + "u003dhunter2hunter2",
    ],
)
def test_forms_charsets_and_depth(wrapped):
    began = time.process_time()
    found = [(a, b) for k, a, b in secret_scan.secrets("hi " + wrapped + " bye")[1] if k == "assign"]
    assert found and all(3 <= a < b <= 3 + len(wrapped) for a, b in found)
    assert time.process_time() - began < 2


def test_the_query_against_the_contract(spark):
    rows = {r.doc_id: r for r in secret_scan.op7_secret_scan(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    kinds = {
        "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""", 12),
        "access": (r"(?P<value>AKIA[A-Z0-9]+)", 18),
        "hex": (r"(?P<value>[0-9a-f]+)", 16),
    }
    for doc in docs:
        found = [(m.start(), n, kind, m.end()) for n, (kind, (pattern, least)) in enumerate(kinds.items()) for m in re.finditer(pattern, doc.text or "") if len(m["value"]) >= least]
        row = rows[doc.doc_id]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(f[2] == k for f in found) for k in kinds)
        told = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
        assert row.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(row.spans.split(","))


def test_base_patterns():
    text = "ApiKey: 'abcdefghijkl' token=short AKIA" + "A" * 14 + " " + "AKIA" + "B" * 13 + " " + "0123456789abcdef" + " " + "f" * 15
    base, spans = secret_scan.secrets(text)
    assert base == spans
    assert [(k, text[a:b]) for k, a, b in base] == [("assign", "ApiKey: 'abcdefghijkl"), ("access", "AKIA" + "A" * 14), ("hex", "0123456789abcdef")]


def test_cycles_end():
    text = "%2525252541" * 50 + base64.b64encode(b"A" * 300).decode()
    secret_scan.secrets(text)


def test_url_span_is_exact():
    text = "x%20token%3Dabcdefghijkl%20y"
    assert secret_scan.secrets(text)[1] == [("assign", text.index("token"), text.index("%20y"))]


# 9: rules


@given(st.lists(st.sampled_from("abc"), max_size=40))
@settings(deadline=None)
def test_repeated_words(words):
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    assert quality_rules.measure(" ".join(words))[4] == len(covered)


def test_failing_hosts_take_all(spark):
    good, bad = " ".join(f"w{k}" for k in range(20)), "too short"
    docs = [(k, bad if k % 10 else good, "spam" if k < 100 else f"h{k % 4}") for k in range(100)] + [(k, bad if k % 20 == 0 else good, f"h{k % 4}") for k in range(100, 500)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert not any(got[k].kept for k in range(100))
    assert all(got[k].kept == (k % 20 > 0) for k in range(100, 500))
    assert {got[k].host for k in range(100)} == {"failed"} and got[0].shrunk_rate > 0.5


def test_hosts_in_doubt_are_held_to_all_rules(spark):
    good = " ".join(f"w{k}" for k in range(20))
    odd = good + " ####"  # breaks a further rule only
    docs = [(k, odd if k % 4 == 0 else good, f"doubt{k % 2}") for k in range(200)] + [(k, odd if k % 50 == 0 else good, f"h{k % 8}") for k in range(200, 1000)] + [(2000, odd, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame).collect()}
    rates = {s: sum(t == odd for _, t, x in docs if x == s) / sum(x == s for _, _, x in docs) for s in {x for _, _, x in docs if x}}
    mean = sum(rates.values()) / len(rates)
    for k, text, source in docs:
        strict = source is not None and rates[source] > mean
        assert got[k].host == (None if source is None else "strict" if strict else "passed")
        assert got[k].kept == (not strict or text != odd) and not got[k].base_failed
        if source is not None:  # shrunk: between the host's own rate and the mean of all
            assert min(rates[source], mean) - 1e-6 <= got[k].shrunk_rate <= max(rates[source], mean) + 1e-6


# 10: toxicity


def test_gapped_insults():
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    plain = lambda: [rng.choice(words) for _ in range(30)]
    insults = ["wretchbag", "gutterfink"]
    texts, labels = [], []
    for k in range(400):
        text = plain()
        if k % 4 == 0:
            text.insert(7, insults[k // 4 % 2])
        texts.append(" ".join(text))
        labels.append(int(k % 4 == 0))
    score = toxicity.train(texts, labels).scores
    assert (score([" ".join(plain()) for _ in range(200)]) >= 0.5).sum() <= 2
    forms = ("wretchbag", "Wretchbag!", "w.r.e.t.c.h.b.a.g", "w r  e t c h \t b a g", "wretchbbag", "wretqchbag", "wrxetchqbag", "wretch bag", "gutter-fink", "gutterfink's", "gutqteryfink")
    for form in forms:
        assert score([" ".join([*plain(), form, *plain()])])[0] >= 0.5, form


def kernel_by_hand(x, y):
    """Sum over all subsequences of two strings of codes, from the definition."""
    def held(s):
        out = Counter()
        for first in range(toxicity.WIDTH):
            for gaps in itertools.product(range(toxicity.GAP + 1), repeat=toxicity.ORDER - 1):
                at = list(itertools.accumulate([first, *(1 + g for g in gaps)]))
                if sum(gaps) <= toxicity.GAP and at[-1] < len(s):
                    out[tuple(s[k] for k in at)] += toxicity.DECAY ** sum(gaps)
        return out

    a, b = held(x), held(y)
    return sum(n * b[u] for u, n in a.items()) / sum(n * n for n in b.values()) ** 0.5


def test_kernel_and_folded_weights():
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("".join(rng.choice(list("abcd"), rng.integers(2, 9))) for _ in range(n))
    codes, starts, text = toxicity.sentences([words(6) + ". " + words(5), words(9)])
    assert text.tolist() == [0] * 11 + [1] * 9
    rows = toxicity.stretches(codes, starts)
    strings = [tuple(r[r > 0].tolist()) for r in rows]
    marks = toxicity.Landmarks(rows[:4])
    w = rng.normal(size=marks.whiten.shape[1] + 1)
    got = marks.features(rows)
    for k in range(0, 20, 5):
        want = np.array([kernel_by_hand(strings[k], strings[j]) for j in range(4)]) @ marks.whiten
        assert np.allclose(got[k, :-1], want, atol=1e-4)
    assert np.allclose(toxicity.margins(codes, starts, marks.folded(w)), got[:, :-1] @ w[:-1], atol=1e-3)


def test_sentences_are_apart():
    show = lambda t: "".join("|" if c == 0 else " " if c == 1 else chr(95 + c) for c in toxicity.sentences([t])[0])
    apart = "|" * (toxicity.APART - 1)  # and a blank before each sentence
    for text, want in (("Ab, c!  D.e\nf", ["ab c", "de", "f"]), ("x i  d\t i o\tt yy", ["xidiot yy"]), ("...", []), ("", [])):
        assert [" ".join(p.split()) for p in show(text).split(apart) if p.strip("| ")] == want
    two = toxicity.sentences(["ab cd. ef", "", "gh"])
    assert two[2].tolist() == [0, 0, 0, 2]
