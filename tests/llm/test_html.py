"""Main text and site templates, against known pages and a twin that works on the trees themselves."""

import math
import random
import time
from collections import defaultdict

from peakloom.llm import html


def text_of(page):
    p = html.Page(page or "")
    return "\n".join(t for t, keep in zip(p.texts, p.unframed(), strict=True) if keep)


def test_blocks():
    page = '<body><nav>x</nav><article><h1>T &amp; x</h1><p><b>a b<br><p>c\n d&nbsp;e</p><div class="ad">buy</div><ul><li>1<li>2</ul><aside>z</aside><div id="comments"><article>hey</article></div><script>"</p>"</script>tail</article><footer>f'
    assert text_of(page) == "T & x\na b\nc d e\n1\n2\ntail"
    assert text_of('<div><p>one</p><p>two <i>it</i> & <a href="x>y">l</a>') == "one\ntwo it & l"
    assert [text_of(x) for x in ("", None, "plain", "<", "a < b", "a <!-- b", "a<!-- <p>b</p>", "a <script>b")] == ["", "", "plain", "<", "a < b", "a", "a", "a"]


def test_class_words_that_name_parts_of_an_article_stay():
    inside = "".join(f'<p class="{w}">{w}</p>' for w in ("legal", "related", "side", "header", "form", "share", "search"))
    assert text_of(f"<article>{inside}</article>") == "legal\nrelated\nside\nheader\nform\nshare\nsearch"
    assert text_of(f"<body>{inside}<p>x</p>") == "x"


def test_deep_and_broken_pages_take_linear_time():
    began = time.time()
    assert text_of("<div>" * 100_000 + "x" + "</div>" * 100_000) == "x"
    assert time.time() - began < 2
    for page in ("<div><span>a</b>" * 20_000, "<a" * 100_000, "<td></td>" * 20_000 + "<div>" * 20_000 + "<td>x</td>" * 500, "</p>" * 50_000):
        began = time.time()
        text_of(page)
        assert time.time() - began < 3


def extracted(spark, rows):
    schema = "page_id long, url string, html string, host string, key int, text string, ranges int"
    return {r.page_id: r for r in html.extract(spark.createDataFrame([(*r, "h", 1, "t", 2) for r in rows], schema)).collect()}


def test_templates_go_and_quoted_lines_stay(spark):
    frame = lambda i: f"<div><p>Our site</p></div><div><p>story {i}</p></div><p>often quoted</p>"
    marked = lambda i: f"<article><p>{'often quoted' if i % 2 else 'alone ' + str(i)}</p><p>text {i}</p></article>"
    rows = [(i, f"http://a.example/{i}", frame(i)) for i in range(12)] + [(100 + i, f"http://b.example/{i}", marked(i)) for i in range(12)]
    rows += [(200 + i, "http://c.example/x", frame(0)) for i in range(20)] + [(300, None, None), (301, "", "")]
    rows += [(400 + i, f"http://d.example/{i}", frame(i)) for i in range(3)] + [(500 + i, f"http://e.example/{i}", frame(i)) for i in range(2)]
    got = extracted(spark, rows)
    assert got[3].text == "story 3" and got[3].n_template == 2 and got[3].n_marked == 0  # no tag or class tells
    assert got[103].text == "often quoted\ntext 3"  # on half of the articles only
    assert got[205].text == "Our site\nstory 0\noften quoted"  # copies of one page are no template
    assert got[300].text == got[301].text == ""
    assert got[401].text == "story 1"  # a host of three pages
    assert got[501].text == "Our site\nstory 1\noften quoted"  # two don't tell


def test_a_paragraph_on_most_articles_is_template(spark):
    rows = [(i, f"http://a.example/{i}", f"<article><p>All rights reserved</p><p>text {i}</p></article>") for i in range(10)]
    assert extracted(spark, rows)[4].text == "text 4"


def test_section_templates_of_a_large_host(spark):
    page = lambda i: f"<div><p>menu</p></div>{'<div><p>section</p></div>' if i % 8 == 0 else ''}<p>body {i}</p>"
    got = extracted(spark, [(i, f"http://big.example/{i}", page(i)) for i in range(400)])
    assert {r.text for r in got.values()} == {f"body {i}" for i in range(400)}


def test_empty_tables_and_repeated_rows(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    rows = [(None, "http://a.example/1", "<p>x</p>")] * 3 + [(7, "http://a.example/1", "<p>y</p>")] * 2
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("7", "y")] * 2 + [("None", "x")] * 3


def test_against_a_twin_on_trees(spark):
    rng = random.Random(3)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return ("p", rng.choice(["menu", "about us", "terms", f"w{rng.randint(0, 30)}"]))
        return ("div", *(tree(depth - 1) for _ in range(rng.randint(1, 3))))

    shared = [tree(2) for _ in range(4)]
    pages = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else tree(2) for _ in range(rng.randint(1, 4))]
        pages.append((i, rng.choice("ab"), parts))
    pages += [(100 + i, h, p) for i, h, p in pages[:10]]  # copies

    def spell(t):
        return f"<{t[0]}>{t[1]}</{t[0]}>" if t[0] == "p" else "<div>" + "".join(map(spell, t[1:])) + "</div>"

    def below(t):
        yield t
        if t[0] == "div":
            for c in t[1:]:
                yield from below(c)

    def lines(t, gone):
        if t in gone:
            return []
        return [t[1]] if t[0] == "p" else [x for c in t[1:] for x in lines(c, gone)]

    seen, contents = defaultdict(set), defaultdict(set)
    for _, host, parts in pages:
        content = tuple(x for t in parts for x in lines(t, ()))
        contents[host].add(content)
        for t in parts:
            for s in below(t):
                seen[host, s].add(content)
    need = {h: max(html.LEAST_PAGES, math.ceil(math.sqrt(len(c)))) for h, c in contents.items()}
    got = extracted(spark, [(i, f"http://{h}.example/{i}", "<body>" + "".join(map(spell, p))) for i, h, p in pages])
    for i, host, parts in pages:
        gone = {s for (h, s), c in seen.items() if h == host and len(c) >= need[host]}
        assert got[i].text == "\n".join(x for t in parts for x in lines(t, gone))
    assert sum(r.n_template for r in got.values()) > 20
