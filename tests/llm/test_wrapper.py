"""Main text extraction: trees, matching, templates and slots, and the query against a plain reading."""

import html
import random
import re
from functools import lru_cache

import duckdb
import pytest

from patchlake.llm import dom, page_queries, wrapper

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def texts(spark, rows, **columns):
    pages = spark.createDataFrame(rows, SCHEMA)
    for name, value in columns.items():
        pages = pages.selectExpr("*", f"'{value}' AS {name}")
    return {r.page_id: r.text for r in wrapper.extract(pages).collect()}


def blocks(text, **options):
    return [b.text for b in dom.parse(text, **options)[1]]


def words(rng, n):
    return " ".join(rng.choice("amber birch cedar delta ember fjord grove heath inlet jetty knoll".split()) + str(rng.randint(0, 999)) for _ in range(n))


# ---- parsing --------------------------------------------------------------------


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a <b>b<i>c</i></b>\n\t d&amp;e&eacute;&#233;&lt;p&gt;", ["a bc d&eéé<p>"]),
        ("<p><b>one<br>two<br><p>three</p>four", ["one two", "three", "four"]),
        ("<script>var t='</p><p>x';</script><style>p{}</style><p>y</p><!-- <p>z</p> --><noscript>n</noscript>", ["y"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul><dl><dt>e<dd>f<dt>g</dl>", ["a", "b", "c", "d", "e", "f", "g"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("5 < 6 <<p>x</ p><a href='>'>y</a><a title=it's>z</a>", ["5 < 6 <", "xyz"]),
        ("a<div hidden>b</div><div style='Display : none'>c</div><p aria-hidden=true>d</p>e", ["a", "e"]),
        ("a<p>b <span class='ad'>buy</span> c</p>", ["a", "b c"]),
        ("a<script>never ends <p>b", ["a"]),
        ("a<!-- never ends <p>b", ["a"]),
        ("a&nbsp; b&amp", ["a b&"]),
        ("<div class='no-sidebar'>a</div><div class='post-header'>b</div><div class=cookieNotice>c</div><div id=comments-2>d</div><div class=header>e</div>", ["a", "b"]),
        ("<header>a</header><article><header><h1>b</h1></header>c<footer>d</footer></article>", ["b", "c"]),
        ("", []),
    ],
)
def test_blocks(source, want):
    assert blocks(source) == want


def test_odd_markup_ends():
    """Deep, wide and broken markup is read in linear time and loses no text."""
    deep = "".join(f"<div>{i} " for i in range(5000))
    assert " ".join(blocks(deep)).split() == [str(i) for i in range(5000)]
    wide = "".join(f"<div class='q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}'>{i}</div>" for i in range(5000))
    root, found = dom.parse(wide)
    assert [b.text for b in found] == [str(i) for i in range(5000)] and len(dom.nodes_of(root)) <= dom.MAX_NODES
    for piece in ("<a ", "<a b='", "<!-", "</", "<p x=\"", "&#", "<", "<div><p></div>", "</p>"):
        dom.parse(piece * 50_000)
    assert blocks("<div class=ad><article>a</article>") == [] and blocks("<div class=ad><article>a</article>", by_class=False) == ["a"]


# ---- trees ---------------------------------------------------------------------------


def random_tree(rng, depth=0):
    below = [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3))] if depth < 3 else []
    return dom.Node(rng.choice("ab") if depth else "r", below)


def brute_matching(a, b):
    """The most matched pairs, by trying every way to skip a child."""
    if a.label != b.label:
        return 0

    @lru_cache(None)
    def go(i, j):
        if i == len(a.children) or j == len(b.children):
            return 0
        pair = brute_matching(a.children[i], b.children[j])
        return max(go(i + 1, j), go(i, j + 1), go(i + 1, j + 1) + pair if pair else 0)

    return 1 + go(0, 0)


def test_matching():
    rng = random.Random(1)
    for _ in range(150):
        a, b = (dom.read(dom.write(random_tree(rng))) for _ in range(2))
        n, _ = dom.matching(a, b)
        at = dom.aligned(a, b)
        assert n == brute_matching(a, b) == len(at) == len(set(at.values()))
        labels = [x.label for x in dom.nodes_of(a)], [x.label for x in dom.nodes_of(b)]
        assert all(labels[1][k] == labels[0][v] for k, v in at.items())
        assert sorted(at) == [k for k, _ in sorted(at.items(), key=lambda x: x[1])]  # order is kept
        whole = dom.read(dom.write(a))
        dom.merge(whole, b)
        assert len(dom.nodes_of(whole)) == len(labels[0]) + len(labels[1]) - n
        assert dom.matching(whole, b)[0] == len(labels[1])
        dom.prune(whole, 3)
        assert len(dom.nodes_of(whole)) <= 3


def test_skeleton_folds_repeats():
    root, found = dom.parse("<ul><li>a</li><li>b</li></ul><ul><li>c</ul><p>d</p><ul><li>e</ul>")
    assert dom.skeleton(root) == "root(ul(li),p,ul(li))"
    assert [b.node.place for b in found] == [2, 2, 2, 3, 5]
    assert dom.write(dom.read("root(ul(li),p)")) == "root:1(ul:1(li:1),p:1)"


# ---- templates --------------------------------------------------------------------------


def site(rng, n, host="site.test"):
    """Pages without article elements, a fixed text in the content and varying text around it."""
    rows, want = [], {}
    for i in range(n):
        body = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 5))]
        title = words(rng, 5)
        paragraphs = "".join(f"<p>{p}</p>" for p in body)
        page = f"""<html><body><div class="top"><p>Welcome to the site of many words</p></div>
          <div class="links"><ul>{"".join(f'<li><a href="/{k}">{words(rng, 2)}</a></li>' for k in range(rng.randint(2, 6)))}</ul></div>
          <div class="story"><h1>{title}</h1><div class="body">{paragraphs}<p>Subscribe now for more of this</p></div></div>
          <div class="box"><p>Popular</p><p>{words(rng, 3)}</p></div><div class="cookie-bar">We use cookies {i}</div>
          <section id="comments"><p>reader {words(rng, 90)}</p></section></body></html>"""
        rows.append((1000 + i, f"https://{host}/{i}", page))
        want[1000 + i] = "\n".join([title, *body])
    return rows, want


@pytest.mark.parametrize("fan", [64, 2])
def test_template_and_slots(spark, monkeypatch, fan):
    monkeypatch.setattr(wrapper, "FAN", fan)
    rows, want = site(random.Random(4), 25)
    assert texts(spark, rows, host="h", node="n", text="t", n="1", blocks="b") == want


def test_copies_stay_content(spark):
    """Many copies of a page, exact ones and some with another advert, aren't a template; nor is a lone page."""
    rows, want = site(random.Random(5), 12)
    copy = rows[0][2]
    rows += [(i, f"https://site.test/c{i}", copy.replace("Popular", f"Popular {i % 3}")) for i in range(60)]
    want |= {i: want[1000] for i in range(60)}
    lone = "<div class=menu>m</div><p>Only page of its host.</p><p>Second paragraph.</p>"
    rows += [(500, "https://lone.test/", lone), (501, None, lone), (502, "no host", lone), (503, "https://null.test/", None), (504, "https://empty.test/", "")]
    want |= dict.fromkeys((500, 501, 502), "Only page of its host.\nSecond paragraph.") | {503: "", 504: ""}
    assert texts(spark, rows) == want


def test_lines_that_many_articles_share_stay(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(60):
        body = [words(rng, 30), "All rights reserved under a licence." if i % 3 == 0 else words(rng, 4)]
        rows.append((i, f"https://a.test/{i}", f"<nav>x</nav><main><h1>t{i}</h1><p>{body[0]}<p>{body[1]}<p>Share this page</main><footer>f</footer>"))
        want[i] = "\n".join([f"t{i}", *body])
    assert texts(spark, rows) == want


def test_odd_tables(spark):
    assert texts(spark, []) == {}
    long = "<article>" + "<p>" + "word " * 300_000 + "</article>"
    rows = [(1, "http://a/1", long), (1, "http://a/1", long), (None, "http://a/2", "<p>x")]
    out = wrapper.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page_id or 0, r.url, r.n_chars) for r in out) == [(0, "http://a/2", 1), (1, "http://a/1", 1_499_999), (1, "http://a/1", 1_499_999)]


def plain(page):
    """The pages of the table hold one article of headings, paragraphs and bold text."""
    inner = re.search("<article>(.*)</article>", page, re.S)[1]
    parts = re.split("</?(?:p|h1)>", inner)
    cleaned = (" ".join(html.unescape(re.sub("</?b>", "", part).replace("<br>", " ")).split()) for part in parts)
    return "\n".join(x for x in cleaned if x)


def test_query(spark):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF_DIR}/pages.parquet'").fetchall()
    got = sorted(map(tuple, page_queries.op11_wrapper_text(spark, SF_DIR).collect()))
    assert got == sorted((i, url, plain(page), len(plain(page))) for i, url, page in pages)
