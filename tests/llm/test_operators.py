"""The corpus operators against brute force, and on the cases their docstrings define."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cairnlake.llm import decontaminate, embedding_dedup, html_text, jaccard, license_scan, line_dedup, packing, substring_dedup, toxicity, url_filter
from cairnlake.llm.induced import suffix_array

DOCS = "doc_id long, text string"
random.seed(5)
VOCABULARY = ["".join(random.choices("abcdefghij", k=random.randint(2, 6))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choices(VOCABULARY, k=n))


def corpus() -> list[tuple]:
    """Copies, near copies of many degrees, shared passages, short, empty and null texts, a hot group."""
    r = random.Random(9)
    rows: list[tuple] = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "x" * 900), (7, "é" * 300)]
    passage = prose(90, 1000)
    for base in range(12):
        words = prose(r.choice([8, 60, 200, 700]), base).split()
        for copy in range(r.choice([1, 2, 5])):
            new = words[:]
            for _ in range(r.choice([0, 0, 1, 3, 8])):
                new[r.randrange(len(new))] = r.choice(VOCABULARY)
            text = " ".join(new)
            rows.append((len(rows) + 10, text.upper() if copy == 2 else text))
    for k in range(30):
        rows.append((len(rows) + 10, prose(r.randint(0, 60), 2000 + k) + "\n" + passage + "\n" + prose(r.randint(0, 60), 3000 + k)))
    rows += [(len(rows) + 10 + k, prose(150, 7)) for k in range(6)]
    return rows


def brute_jaccard(rows, size, num, den):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    least = {d: d for d in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                least[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("size,num", [(3, 90), (5, 80), (2, 50)])
def test_jaccard(spark, size, num):
    rows = corpus()
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3), size, num, 100).collect()}
    assert got == brute_jaccard(rows, size, num, 100)


@pytest.mark.parametrize("block", [4, 1024])
def test_jaccard_open_lists(spark, monkeypatch, block):
    """Groups of near copies on both sides of the threshold, led by a short text, in one block and in many."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r, rows = random.Random(4), []
    for base in range(3):
        words = prose(120, 400 + base).split()
        rows.append((len(rows), " ".join(words[:100])))
        for _ in range(25):
            new = words[:]
            for _ in range(r.choice([1, 2, 4, 6])):
                new[r.randrange(len(new))] = r.choice(VOCABULARY)
            rows.append((len(rows), " ".join(new)))
    got = {x[0]: (x[1], x[2]) for x in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3), 3, 90, 100).collect()}
    want = brute_jaccard(rows, 3, 90, 100)
    assert got == want and 3 < len({c for _, c in want.values()}) < len(rows)


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).collect() == []
    assert [tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame([(None, "a b c"), (4, "a b c")], DOCS)).orderBy("doc_id").collect()] == [(None, 1, 4), (4, 1, 4)]


def test_jaccard_without_ids(spark):
    a, b, c = prose(200, 80).split(), prose(200, 81).split(), prose(200, 82).split()
    edited = lambda w, *at: " ".join("changed" if i in at else x for i, x in enumerate(w))
    # 1 and 2 are linked by a row without an id only
    rows = [(1, edited(a, 10, 50)), (None, edited(a, 10)), (2, edited(a, 10, 90)), (None, edited(b)), (None, edited(b)), (None, edited(b, 9)), (3, edited(c, 1)), (None, edited(c))]
    got = sorted((tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3), 5, 94, 100).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (2, 1), (None, None), (None, None), (None, None), (3, 3), (None, 3)], key=str)


def brute_substrings(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot,hashes", [(None, 10), (1, 1_000_000), (1, 0)])
def test_substrings(spark, monkeypatch, hot, hashes):
    monkeypatch.setattr(substring_dedup, "BROADCAST_HASHES", hashes)
    rows = corpus()
    docs = spark.createDataFrame([(*x, 7, b"old") for x in rows], "doc_id long, text string, cid long, spans binary").repartition(3)
    got = substring_dedup.substring_dedup(docs, hot=hot).collect()
    assert sorted((r["doc_id"], r["n_bytes"], sum(b - a for a, b in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got) == brute_substrings(rows, 400)
    assert all(sum(b - a for a, b in r["spans"]) + len(r["kept"]) == r["n_bytes"] for r in got)


def test_substrings_of_very_long_texts(spark):
    """A passage within texts of a megabyte, a null id, a text that repeats itself."""
    passage = prose(150, 41)
    rows = [(1, prose(200_000, 42) + passage), (None, passage + prose(100_000, 43)), (3, prose(100_000, 44)), (4, "ab" * 50_000)]
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    (a, b), n = got[1][0], len(passage)
    assert len(got[1]) == len(got[None]) == 1 and 0 <= len(rows[0][1]) - n - a <= 3 and b == len(rows[0][1]) and got[3] == [] and got[4] == [(0, 100_000)]


def test_substrings_of_passages_about_as_long_as_the_bound(spark):
    """Passages of over 50 words in documents that share nothing else: bytes decide, not words."""
    passages = [prose(100, 50)[:399], prose(100, 51)[:400], prose(52, 52), prose(120, 53)]
    assert all(len(p.split()) > 50 for p in passages) and [len(p) >= 400 for p in passages] == [False, True, False, True]
    rows = [(10 * k + copy, f"{prose(150, 60 + 10 * k + copy)}{copy}{p}{copy + 5}{prose(150, 160 + 10 * k + copy)}") for k, p in enumerate(passages) for copy in range(3)]
    rows += [(100 + k, prose(300, 300 + k)) for k in range(12)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = lambda length: {r["doc_id"]: [b - a for a, b in r["spans"]] for r in substring_dedup.substring_dedup(docs, length).collect()}
    whole = {d: [len(passages[d // 10])] if d < 40 else [] for d, _ in rows}
    assert found(400) == {d: n if n and n[0] >= 400 else [] for d, n in whole.items()}
    assert found(200) == whole


def test_substrings_empty(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_suffix_array_with_disk():
    r = np.random.default_rng(0)
    for _ in range(150):
        text = r.integers(0, int(r.integers(1, 4)), int(r.integers(1, 60)))
        want = sorted(range(len(text)), key=lambda i: text.tolist()[i:])  # noqa: B023
        assert suffix_array(text, 400, int(r.integers(2, 40))).tolist() == want


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 16))
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(base)]
    for k in range(120):
        rows.append((1000 + k, [float(x) for x in base[k % 40] + r.normal(size=16) * r.choice([0.02, 0.2, 0.33])]))
    rows += [(2000 + k, rows[3][1]) for k in range(50)] + [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [None] * 16), (3005, [1.0, 2.0]), (3006, [2.0, 4.0]), (3007, [float("inf")] * 16)]
    rows += [(3100, [1e-200, 2e-200, 3e-200]), (3101, [1e200, 2e200, 3e200]), (None, [2e-300, 4e-300, 6e-300]), (None, [5.0, 1.0, 0.0, 0.0]), (None, [5.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    rows_of = [(r["vec_id"], (r["n_links"], r["component_id"], r["kept"])) for r in embedding_dedup.near_duplicates(df.selectExpr("*", "0 as id", "'x' as list", "1 as weight"), margin=100.0, lists=12).collect()]
    got = dict(rows_of)
    assert got[3100] == (2, 3100, True) and got[3101] == (2, 3100, False) and sorted((v for k, v in rows_of if k is None), key=str) == [(1, None, True), (1, None, True), (2, 3100, False)]
    ids = [i for i, v in rows if i is not None and i < 3000]
    x = np.array([v for i, v in rows if i is not None and i < 3000])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    want = {i: (int(near[k].sum()), ids[label[k]], ids[label[k]] == i) for k, i in enumerate(ids)}
    assert {i: got[i] for i in ids} == want
    assert got[3005] == (1, 3005, True) and got[3006] == (1, 3005, False)
    assert all(got[i] == (0, i, True) for i in (3000, 3001, 3002, 3003, 3004, 3007))
    fast = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, lists=12).collect()}
    assert sum(fast[i] for i in ids) >= 0.9 * near.sum()
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_urls(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    rows = [(1, None), (2, "no scheme/en/"), (3, "http://Example.COM/en/x?y#z"), (4, "https://a.www.example.com/en/"), (5, "http://example.com"), (6, "http://notexample.com/en/"), (7, "x://y.net/es/?a"), (8, "x://y.net?/es/"), (9, "http://net/es/"), (10, "http://example.com/eng"), (11, "a://b://c.com/"), (3, "http://Example.COM/en/x?y#z")]
    got = sorted(tuple(r) for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string").selectExpr("page_id", "url", "'old' as rule"), rules).select("page_id", "host", "path", "rule", "verdict").fillna("-", ["rule"]).collect())
    assert got == sorted([
        (1, "", "", "-", "allow"), (2, "", "", "-", "allow"), (3, "example.com", "/en/x", "example.com/en/", "block"), (3, "example.com", "/en/x", "example.com/en/", "block"), (4, "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        (5, "example.com", "", "-", "allow"), (6, "notexample.com", "/en/", "com/", "allow"), (7, "y.net", "/es/", "net/es/", "block"), (8, "y.net", "", "-", "allow"), (9, "net", "/es/", "net/es/", "block"), (10, "example.com", "/eng", "com/", "allow"), (11, "b:", "//c.com/", "-", "allow"),
    ])
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string"), rules).collect() == []


def test_cascade_is_exact(spark):
    listed, universe = [(f"k{i}",) for i in range(0, 3000, 3)], [(f"k{i}",) for i in range(3000)]
    make = lambda rows: spark.createDataFrame(rows, "key string")
    cascade = url_filter.Cascade(make(listed), make(universe))
    from pyspark.sql import functions as F

    assert sorted(make(universe).where(cascade.contains(F.col("key"))).collect()) == sorted(listed) and len(cascade.levels) > 1


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies on this site</div>
    <article><header><h1>Head &amp;amp; line</h1></header><p>First&nbsp;<b>bo</b>ld <!-- no --> text.<p>Second &lt;p&gt;<br>line<script>var a="</p>";</script></p><ul><li>one<li>two</ul><aside>Side</aside><form>Form<input></form>
    <div class="ad">Buy</div></article><div id="comments"><p>Reader words</p></div><footer>&copy; F</footer></body></html>"""
    assert html_text.main_text(page) == "Head &amp; line First bold text. Second <p> line one two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    long = "A sentence that is long enough to make the text surge here. " * 3
    plain = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><h1>Title</h1><p>{long}</p><p>{long}</p><div class=sidebar>{long}</div><div><a href=z>More</a></div></body>"
    assert html_text.main_text(plain) == " ".join(("Title " + long + long).split())
    assert html_text.main_text("<p>just words") == "just words"


def test_html_article_is_a_hint():
    long = "A sentence that is long enough to make the text surge here. " * 3
    links = "".join(f"<li><a href=x>Other story {k}</a></li>" for k in range(5))
    teaser = f"<body><div><h1>Title</h1><p>{long}</p><p>{long}</p></div><ul>{links}</ul><article><h3><a href=y>Elsewhere</a></h3><p>In short.</p></article></body>"
    assert html_text.main_text(teaser) == " ".join(("Title " + long + long).split())
    listed = f"<body><article><h1>Title</h1><p>By one</p><p>{long}</p><div><ul>{links}</ul></div><p>{long}</p><p>See <a href=z>there</a>.</p><p><a href=z>Source</a></p><p>The end.</p><div>{links}</div><p>Box</p><ul>{links}</ul></article></body>"
    assert html_text.main_text(listed) == " ".join(f"Title By one {long} {long} See there. Source The end.".split())
    assert html_text.main_text(f"<article><h1><a href=x>Title</a></h1><p>Short.</p><ul>{links}</ul><p>{long}</p></article>") == " ".join(f"Title Short. {long}".split())


def test_html_names_are_hints():
    long = "A sentence that is long enough to make the text surge here. " * 3
    story = f"<h1>Title</h1><p>{long}</p><p>{long}</p>"
    want = " ".join(f"Title {long} {long}".split())
    for page in (
        f'<div class="overflow-hidden">{story}</div>',
        f'<div class="content has-sidebar"><article>{story}</article></div>',
        f'<div id="page" class="site no-sidebar">{story}</div>',
        f'<article><div class="legal">{story}</div></article>',
        f"<div data-hidden>{story}</div>",
        f'<div class="sidebar-wrap">{story}</div>',
        f'<div><h1>Title</h1><p>{long}</p><div class="market share"><p>{long}</p></div></div>',
        f'<article>{story}</article><div class="sidebar">{story * 4}</div><div class=site-footer>Foot</div><div class="cookie_notice">{long}</div><div hidden>{long}</div><p class="share">Tell friends</p><div id="my-advertising">{long}</div>',
        f"<article>{story.replace('Title', '<a title=it&#39;s href=x>Title</a>').replace('&#39;', chr(39))}</article>",
        f"<div><a href=x>Home</a></div><div>{story}</div>",
    ):
        assert html_text.main_text(f"<body>{page}</body>") == want, page
    assert html_text.main_text(f"<body><div><p>{long}</p><p><a href=x>Linked line</a></p><p>{long}</p></div>") == " ".join(f"{long} Linked line {long}".split())
    assert html_text.main_text(f"<article><p>{long} <math><mi>x</mi></math> and <object>fallback</object></p><p>The <span class=share>share</span> rose.</p></article>") == " ".join(f"{long} x and fallback The share rose.".split())
    deep = "<div>" * 3000 + story + "</div>" * 3000
    assert html_text.main_text(deep) == want
    assert len(html_text.main_text(f"<article><h1>Title</h1>{f'<p>{long}</p>' * 3000}</article>")) > 500_000


def test_html_distribution():
    """The stretches against their definition, line by line."""
    r = random.Random(8)
    for _ in range(300):
        own = [r.choice([0, 0, 10, 30, 90, 300]) for _ in range(r.randint(1, 25))]
        lines = [(f"{k}" + "x" * n, len(str(k)), True) for k, n in enumerate(own)]
        block = [sum(own[i : i + 3]) for i in range(len(own))]
        # a line is within text if no dive (three lines or the page's end without text) begins at or before it since the last line that isn't in one
        groups: list[list[int]] = []
        for i, b in enumerate(block):
            if b and (i == 0 or not block[i - 1]):
                groups.append([])
            if b:
                groups[-1].append(i)
        groups = [[i for i in g if i >= next(k for k in g if own[k])] if g[0] else g for g in groups]
        surge = [any(block[i] > 80 for i in range(*(g[0], g[-1] + 1))) or any(block[i] > 80 for i in range(max(0, g[0] - 2), g[0]) if all(own[k] == 0 for k in range(i, g[0]))) for g in groups]
        want = [i for k, g in enumerate(groups) if surge[k] or not any(surge) or k == 0 for i in g]
        assert html_text.main_lines(lines) == [lines[i][0] for i in want]


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "<p>a", "v"), (2, "<p>a", "v")], "page_id long, html string, text string")
    assert [tuple(r) for r in html_text.extract(df).select("page_id", "text", "n_chars").orderBy("page_id").collect()] == [(1, "", 0), (2, "a", 1), (2, "a", 1)]


def test_licenses(spark):
    rows = [(1, None), (2, ""), (3, "words\nReleased under the MIT license\nmore"), (4, "Licensed under CC BY-NC 4.0."), (5, "a permission slip to license nothing at all"), (6, license_scan.TEMPLATES["MIT"].replace("Software", "Program", 1)), (7, "intro\n\n" + license_scan.TEMPLATES["ISC"].replace(", and/or", ",\nand/or") + "\n\nend")]
    got = {r["doc_id"]: (r["license"], r["n_units"]) for r in license_scan.license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (None, 0), 2: (None, 0), 3: ("MIT-notice", 2), 4: ("CC-BY-NC-4.0", 1), 5: (None, 0), 6: ("MIT", 1), 7: ("ISC", 3)}


MIT_FILE = """MIT License

Copyright (c) 2031 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_license_files(spark):
    from pathlib import Path

    bsd2 = """Copyright 2031 Some One\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    files = {"MIT": MIT_FILE, "MIT ": " ".join(MIT_FILE.split()), "BSD-2-Clause": " ".join(bsd2.split())}
    at = Path("/usr/share/common-licenses")
    files |= {name: (at / own).read_text() for own, name in [("BSD", "BSD-3-Clause"), ("GPL-1", "GPL-1.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.3", "GFDL-1.3"), ("MPL-2.0", "MPL-2.0")] if (at / own).exists()}
    rows = list(enumerate(files.values())) + [(100, prose(300, 8)), (101, "Terms and conditions\n\nintro\n\n" + MIT_FILE.split("\n\n")[4])]
    got = {r["doc_id"]: r["license"] for r in license_scan.license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert {n: got[k] for k, n in enumerate(files) if not (got[k] or "").startswith(n.strip())} == {}
    assert got[100] is None and got[101] == "MIT-paragraph-3"


def test_lines(spark):
    rows = [(i, f"menu\nbody {i}\n\n" + ("menu" if i % 2 else ""), "h") for i in range(10)] + [(20, None, "h"), (21, "", None), (22, "menu\nx", "other"), (22, "menu\nx", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(df).collect()}
    assert got[0] == ("body 0\n\n", 4, 1) and got[1] == ("body 1\n", 4, 2) and got[20] == (None, 0, 0) and got[21] == ("", 1, 0) and got[22] == ("", 2, 2)
    small = spark.createDataFrame([(k, f"menu\nbody {k}", 1.0, "h") for k in range(4)] + [(9, "alone\nsecond", 1.0, "i")], "doc_id long, text string, n_lines double, source string")
    assert {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.line_dedup(small).collect()} == {**{k: (f"body {k}", 1) for k in range(4)}, 9: ("alone\nsecond", 0)}
    long = spark.createDataFrame([(k, "menu\n" + "words " * 200_000 + str(k), "h") for k in range(3)], "doc_id long, text string, source string")
    assert {r["n_dropped"] for r in line_dedup.line_dedup(long).collect()} == {1}
    assert line_dedup.line_dedup(df.limit(0)).collect() == []


def test_lines_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"menu\nbody {i}", "h") for i in range(10)], "doc_id long, text string, source string")
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert sorted(r["text"] for r in line_dedup.line_dedup(df).collect()) == sorted(f"body {i}" for i in range(10))


def brute_contaminated(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            a = shingles(words(x))
            for start in range(len(w)):
                b = shingles(w[start : start + len(words(x))])
                both = sum((a & b).values())
                if both and both / (sum(a.values()) + sum(b.values()) - both) >= 0.8 - 1e-12:
                    out[d, i] = max(out.get((d, i), 0), both / (sum(a.values()) + sum(b.values()) - both))
    return out


def test_contamination(spark):
    items = [(1, prose(40, 50)), (2, prose(75, 51)), (3, "tiny item"), (4, None), (5, ""), (6, prose(14, 52)), (7, "ab " * 30)]
    edited = prose(75, 51).split()
    edited[30] = "changed"
    far = prose(40, 50).split()
    far[10] = far[25] = "changed"
    rows = [(0, None), (1, ""), (2, prose(30, 60) + " " + items[0][1].upper() + ", " + prose(30, 61)), (3, " ".join(edited)), (4, prose(20, 62) + " ".join(far)), (5, "a Tiny, item!"), (6, items[5][1]), (7, prose(300, 63)), (8, "ab " * 29), (9, " ".join(items[0][1].split()[1:39])), (2, prose(30, 60) + " " + items[0][1].upper() + ", " + prose(30, 61))]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_contaminated(rows, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and (3, 2) in got and (4, 1) not in got
    assert decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert decontaminate.contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_contamination_of_swapped_parts(spark):
    items = [(1, prose(50, 70)), (2, prose(120, 71)), (3, prose(64, 72))]
    swap = lambda t, at: " ".join(t.split()[at:] + t.split()[:at])
    rows = [(1, prose(100, 73) + " " + swap(items[0][1], 25) + " " + prose(100, 74)), (2, prose(9, 75) + " " + swap(items[1][1], 30) + " " + prose(70, 76)), (3, swap(items[2][1], 40)), (4, prose(8, 77) + " " + swap(swap(items[1][1], 40), 77))]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_contaminated(rows, items)
    assert set(want) >= {(1, 1), (2, 2), (3, 3)} and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_contamination_recall(spark):
    """Edited and shuffled passages about the threshold: fingerprints find nine of ten, the exact mode all."""
    r, items, rows = random.Random(6), [], []
    for k in range(40):
        words = prose(r.choice([25, 40, 64, 90]), 7000 + k).split()
        items.append((None if k == 39 else k, " ".join(words)))
        for copy in range(3):
            new = words[:]
            for _ in range(r.choice([0, 1, 1, 2])):
                new[r.randrange(len(new))] = "changed"
            if copy == 2:
                cut = r.randrange(len(new))
                new = new[cut:] + new[:cut]
            rows.append((None if k == 38 and copy == 0 else len(rows), prose(r.randint(0, 40), 8000 + len(rows)) + " " + " ".join(new) + " " + prose(r.randint(0, 40), 9000 + len(rows))))
    docs, marks = spark.createDataFrame([(*x, "old", 1) for x in rows], "doc_id long, text string, item_id string, n int"), spark.createDataFrame([(*x, "h", 0) for x in items + items[:3]], "item_id long, text string, doc_id string, row int")
    want = brute_contaminated(rows, items)
    got = {exact: {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, marks, exact=exact).collect()} for exact in (False, True)}
    assert got[True] == set(want) and got[False] <= set(want) and len(got[False]) >= 0.9 * len(want) > 50


def test_contamination_of_very_long_texts(spark, monkeypatch):
    """A text of 150,000 words; counters of 32 bits give the same fingerprints."""
    items = [(1, prose(60, 31)), (2, "ab " * 70)]
    rows = [(1, prose(100_000, 32) + " " + items[0][1] + " " + prose(50_000, 33)), (2, "ab " * 300), (3, prose(500, 3))]
    found = lambda: {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found() == {(1, 1), (2, 2)}
    monkeypatch.setattr(decontaminate, "MOST_SHORT", 10)
    assert found() == {(1, 1), (2, 2)}


def test_toxicity_counterfactuals(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = r.choices(VOCABULARY, k=30)
        if toxic:
            words[5] = r.choice(["vilething", "awfulthing"])
        if r.random() < (0.8 if toxic else 0.1):
            words[9] = "muslim"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    fair, naive = toxicity.fit(docs, marks, neutral=0, counterfactual=20.0), toxicity.fit(docs, marks, neutral=0, counterfactual=0.0)
    probe = spark.createDataFrame([(0, "a muslim went home"), (1, "a christian went home"), (2, "such a vilething here"), (3, None), (4, "")], DOCS)
    scores = lambda m: [x["toxicity"] for x in toxicity.score(probe, m).orderBy("doc_id").collect()]
    f, n = scores(fair), scores(naive)
    assert abs(f[0] - f[1]) < abs(n[0] - n[1]) and f[0] < 0.3 and f[2] > f[0] and f[3] == f[4] and all(0 <= x <= 1 for x in f)
    assert toxicity.fit(docs, marks.limit(0)).bias == 0.0
    shipped = toxicity.fit(docs, marks)
    g = scores(shipped)
    assert shipped.swapped > 300 and abs(g[0] - g[1]) < abs(n[0] - n[1]) and g[0] < 0.3 and g[2] > 0.5


@pytest.mark.parametrize("texts", [["one"] * 8, [None, "", "a", "b"] * 2, ["x " * 200_000 + "y"] * 8])
def test_toxicity_of_few_texts(spark, texts):
    """Ties, nulls, one-word and very long texts; labels of unknown and null ids; a document with both labels; clashing columns."""
    docs = spark.createDataFrame([(i, t, "old", 0.0) for i, t in enumerate(texts)] + [(None, "n", "old", 0.0), (0, texts[0], "old", 0.0)], "doc_id long, text string, toxic string, toxicity double")
    marks = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(1, 0), (None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, marks))
    assert got.columns == ["doc_id", "text", "toxic", "toxicity"] and got.count() == 10 and got.where("toxicity between 0 and 1").count() == 10
    one = toxicity.score(docs, toxicity.fit(docs, marks.where("toxic = 1"))).select("toxicity").distinct().collect()
    assert len(one) == 1 and one[0][0] > 0.5


def test_toxicity_swaps_on_held_out_texts(spark):
    """With the shipped weight, swapping terms in held-out sentences changes scores less than without it."""
    import os

    at = "/root/testdata/sf0.01"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    fair, naive = (toxicity.fit(docs, toxicity.learnable(labels), counterfactual=c) for c in (toxicity.COUNTERFACTUAL, 0.0))
    held = [r["text"] for r in docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").collect()]
    swap = toxicity.Swap(fair.terms)
    import pyarrow as pa

    pairs = [(t, swap(t)) for t in held if swap(t)]
    gap = lambda m: np.abs(m.score(pa.array([a for a, _ in pairs])) - m.score(pa.array([b for _, b in pairs]))).mean()
    assert fair.swapped > 0 and len(pairs) > 10 and gap(fair) < gap(naive)


def test_toxicity_held_out(spark):
    import os

    at = "/root/testdata/sf0.01"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = toxicity.fit(docs, toxicity.learnable(labels))
    got = toxicity.score(docs, model).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").select("toxicity", "toxic").collect()
    assert sum((r["toxicity"] >= 0.3) == bool(r["toxic"]) for r in got) >= 0.9 * len(got)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = [None, "", "a", "Hello, world... it's a,b.c 12.5 ''s don't. _a._ x", "ΣΑΣ İstanbul. é.  a\x1cb  Σ. é. É", "<|endoftext|>. x<|startoftext|>,", "I'LL, we'Re. 's.s", "١٢٣, ². ª. ǅ.", *[prose(n, n) for n in (10, 300, 900, 1500, 4000, 900, 77)]] * 3
    rows = list(enumerate(texts))
    pieces = packing.pack(spark.createDataFrame(rows, DOCS).repartition(2), path).collect()
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    places: dict = {}
    parts: dict = {}
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]])
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        parts.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for spans, whole in [(v, None) for v in places.values()] + [(v, len(ids[d])) for d, v in parts.items()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == whole if whole else at == 4096 or at & (at - 1) == 0 and at < 4096
    assert set(parts) == set(ids) and packing.pack(spark.createDataFrame([], DOCS), path).collect() == []


def test_word_ids_of_odd_spellings():
    """Any mixture of letters, marks, digits and white space has the tokenizer's own ids, through a cleared cache too."""
    r, ids_of = random.Random(3), packing.WordIds(packing.tokenizer_path())
    letters = "aAzZ.,!'`$<|>endoftext  \n\t  \u0130\u03a3\u03c3\u03c2H\u0331\u1e96\u00e9\u00c9e\u0301\u00df\u1e9e日本слСЛ12³½_-\"\0\u200b😀\u0149\u01c5sSL\x1c\x85"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(5000)] + ["", " ", "<|ENDOFTEXT|>", "foo<|endoftext|>..", "H\u0331 J\u030c"]
    want = [g.ids for g in ids_of.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in ids_of(texts)] == want
        ids_of.known.clear()


def test_sum_of_squares_choice():
    packer, r = packing.Packer(16), random.Random(1)
    for _ in range(300):
        size = r.randint(1, 15)
        n = packer.counts.copy()

        def cost(level, n=n, size=size):
            m = n.copy()
            m[level] -= level > 0
            if level + size < 16:
                m[level + size] += 1
            return int((m[1:16] ** 2).sum())

        options = [h for h in range(17 - size) if h == 0 or n[h] > 0]
        assert cost(packer.level_for(size)) == min(map(cost, options))
        packer.add(0, b"\0\0\0\0" * size)
