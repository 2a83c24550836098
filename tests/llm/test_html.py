"""Main text of broken, hostile and hand-marked pages."""

import time

from corpusloom.llm import site_style


def main(page):
    marked, found, _ = site_style.blocks(page)
    return [text for _, kind, text in found if kind == (site_style.ARTICLE if marked else site_style.BODY)]


def test_nothing_eats_what_follows():
    for inner in ("<svg class='i'/>", "<svg>", "<svg><path d='x'>", "<noscript>", "<template>", "<!-->", "<!--->", "<!-- c --!>", "<!-- c -->", "<svg><title/></svg>", "<a x='", "<svg/><svg>t</svg>"):
        assert main(f"<article><p>One</p>{inner}<p>Two</p></article>") == ["One", "Two"], inner
    assert main("<article><p>One<template>Two</article><template>x</template>") == ["OneTwo"]
    assert main("<article>1 < 2 & x <3</article>") == ["1 < 2 & x <3"] and main("<article>x<y") == ["x<y"]
    assert main("<article><p title='a>b'>t</p><img alt=\"x>\">u</article>") == ["t", "u"]
    assert main("<article>a<svg><foreignObject><div>label</div></foreignObject></svg>b<noscript>n</noscript></article>") == ["ab"]


def test_work_is_linear():
    for page in ("<a " * 350_000, '<a x="' * 170_000, "<div>" * 200_000, '<a x=">" ' * 100_000, "<ul>" + "<div>" * 60_000 + "<li></li>" * 60_000, "<div class=ad>" * 70_000 + "t", "<" * 1_000_000, "<!--" * 250_000,
                 "</script " * 120_000 + ">", "<b>" * 250_000 + "</i>" * 90_000, "<article>" * 100_000 + "x", "<a x='>" * 120_000, "<svg>" * 200_000, "<p>t" * 90_000 + f"<div class={chr(120) * 300_000}>", "&" * 1_000_000):
        start = time.process_time()
        site_style.blocks(page)
        half = time.process_time()
        site_style.blocks(page[:len(page) // 8])
        whole, part = half - start, time.process_time() - half
        assert whole < 10 and whole < 30 * part + 1, page[:20]


def test_depth_bounds_paths():
    _, found, shown = site_style.blocks("<div class='" + "long " * 50 + "'>" + "<div>" * 5000 + "<p>deep</p>")
    assert [t for *_, t in found] == ["deep"] and max(map(len, shown)) <= (site_style.MAX_LABEL + 2) * site_style.MAX_DEPTH


#: Pages with the blocks that a reader marked as their article.
MARKED = [
    ("<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav>a b</nav><article><h1>Head</h1><p>One.</p><p>Two.</p></article><footer>f</footer></body></html>", ["Head", "One.", "Two."]),
    ("<body><div id=nav><a href=x>Home</a></div><main><h2>H</h2>Text<br>more<div class='share'>Share</div></main></body>", ["H", "Text more"]),
    ("<article><header><h1>Title</h1></header><p>Body <em>with</em> <a href=#>link</a>.<form><input><label>Mail</label></form><footer>by</footer></article>", ["Title", "Body with link."]),
    ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></article>", ["a", "b", "1", "2", "3"]),
    ("<article><p>A&amp;B &lt;tag&gt; &eacute;&#233;&#xe9; &nbsp;x</p></article>", ["A&B <tag> ééé x"]),
    ("<article><p>One<script>if (a<b) { '</p>' }</script> two<style>p{}</style></article>", ["One two"]),
    ("<article><p>One</p></article><section class='comments'><article>c1</article><article>c2</article></section>", ["One"]),
    ("<article><p>One</p><div class='comments'><article>c1</article></div></article>", ["One"]),
    ("<article><p>One</p><aside>ad</aside><div class='ad'>Buy</div><p>Two</p></article>", ["One", "Two"]),
    ("<div role=main><p>One</p><div role=navigation>n</div></div><div>out</div>", ["One"]),
    ("<div itemprop='articleBody'><p>One</p></div><p>out</p>", ["One"]),
    ("<body><p>No article</p><nav>n</nav><footer>f</footer></body>", ["No article"]),
    ("<article><p>One<p>Two<div>Three</div>Four</article>", ["One", "Two", "Three", "Four"]),
    ("<article><pre>a\n  b</pre><blockquote>q<p>r</p></blockquote></article>", ["a b", "q", "r"]),
    ("<article><div hidden>h</div><div aria-hidden='true'>x</div><p>One</p></article>", ["One"]),
    ("<article><dl><dt>t<dd>d<dt>u</dl><details><summary>s</summary>more</details></article>", ["t", "d", "u", "s", "more"]),
    ("<article><P>Up</P><B>bold</B>er <select><option>o</select></ARTICLE>", ["Up", "bolder"]),
    ("<div class='cookie-banner'>We use</div><article class='post sidebar'>One</article>", ["One"]),
    ("<article><p>un<b>closed</p><p>next</b></p></article>", ["unclosed", "next"]),
    ("<article><h1>A</h1><!-- <p>gone</p> --><p>B</p><![CDATA[c]]></article>", ["A", "B", "c"]),
    ("", []),
]


def test_marked_pages():
    for page, want in MARKED:
        assert main(page) == want, page


def test_the_tree_decides_where_no_article_is_marked(spark):
    """Menus and notes that carry no tell-tale tag or name go by the tree alone; what differs from page to page stays."""
    page = "<body><div class='c1'><div class='x'><p>Start</p><p>Prices {a}</p></div><div class='y'><h1>Head {n}</h1><p>Text of page {n}</p></div><div class='z'><p>All about us</p></div></div></body>"
    rows = [(n, "http://h/", page.format(n=n, a=n % 2)) for n in range(20)] + [(100, "http://alone/", page.format(n=0, a=0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in site_style.main_text(df).collect()}
    assert all(got[n] == [f"Head {n}", f"Text of page {n}"] for n in range(20))
    assert got[100] == ["Start", "Prices 0", "Head 0", "Text of page 0", "All about us"]  # one page tells nothing
