import math
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import html

PLAIN = "One sentence of the story with enough words to count as prose, then some more."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, []),
        ("", []),
        ("<html><body></body></html>", []),
        ("plain text only", ["plain text only"]),
        ("<p>a &lt;b&gt; &amp;amp; &eacute;&#233;&#x41; &nbsp; c", ["a <b> &amp; ééA c"]),
        ("<body><p>a<script>x='</p>'</script>b</p><style>p{}</style><!-- <p>no</p> --><p>c<br>d <b>e</b>f", ["ab", "c d ef"]),
        ("<article><h1>T</h1><p><b>one<br><p>two</p></article><footer>no", ["T", "one", "two"]),
        ("<div class='has-sidebar'><article><p>yes<div class='ad'>buy</div><p>also</article></div><div id=comments>no no no no</div>", ["yes", "also"]),
        ("<nav><a href=/>Home</a></nav><main><p>in main</p><form>f<input></form><aside>s</aside></main><p>out", ["in main"]),
        ("<article><p>cut off in the mid", ["cut off in the mid"]),
        ("<article><p>cut <a href='x", ["cut"]),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", ["a", "b", "c", "d"]),
        ("<article><p>a</article></div></p><div hidden>no</div><div style='display: none'>no</div>", ["a"]),
    ],
)
def test_pages(page, want):
    assert html.main_text(page) == want


def test_core_without_article_element():
    menu = "".join(f"<li><a href='/{k}'>Menu entry {k}</a></li>" for k in range(30))
    page = (
        f"<body><div class='top'><ul>{menu}</ul></div><div class='page'><div class='text'><h2>Headline</h2>"
        + "".join(f"<p>{PLAIN} {k} <a href='#'>link</a></p>" for k in range(6))
        + f"</div><div class='links'><ul>{menu}</ul></div></div><div>Short notice.</div></body>"
    )
    assert html.main_text(page) == ["Headline", *(f"{PLAIN} {k} link" for k in range(6))]


def test_text_in_two_parts_under_a_heading():
    part = "".join(f"<p>{PLAIN} {k}</p>" for k in range(4))
    page = f"<body><div><h1>Head</h1><div>{part}</div><div>{part}</div></div><div><a href=x>a</a> | <a href=y>b</a></div></body>"
    assert html.main_text(page) == ["Head", *(f"{PLAIN} {k}" for k in range(4)), *(f"{PLAIN} {k}" for k in range(4))]


def test_deep_and_long_pages():
    deep = "<div>" * 30_000 + PLAIN + "</div>" * 30_000
    assert html.main_text(deep) == [PLAIN]
    long = "<article>" + "".join(f"<p>word {k}</p>" for k in range(50_000)) + "</article>"
    assert len(html.main_text(long)) == 50_000


def test_given_pages_against_their_markup(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html.extract(pages).collect():
        inner = r.html[r.html.index("<article>") + 9 :].split("</article>")[0]
        parts = re.split(r"</?p>|</?h1>|<br>", re.sub("</?b>", "", inner))
        want = [" ".join(html.entities.unescape(x).split()) for x in parts]
        assert r.text == " ".join(x for x in want if x)


def test_random_markup_never_fails():
    rng = random.Random(8)
    bits = ["<p>", "</p>", "<div class='x'>", "</div>", "<a href=q>", "</a>", "text ", "&amp;", "<", ">", "<!--", "-->", "<b", "'", '"', "<article>", "</article>", "<td>", "</body>", "<body>", "<script>", "</script>", "<li>", "<br/>", "<img src=x/>", "<![CDATA[", "]]>"]
    for _ in range(3000):
        page = "".join(rng.choices(bits, k=rng.randrange(40)))
        assert all(b == " ".join(b.split()) and b for b in html.main_text(page))


def test_columns_and_rows(spark):
    df = spark.createDataFrame(
        [(1, "u", "<p>a b</p>", "old"), (None, None, None, None), (1, "u", "<p>a b</p>", "old")], "page_id long, url string, html string, text string"
    )
    out = html.extract(df)
    assert out.columns == ["page_id", "url", "html", "blocks", "text"]
    assert sorted(str(r.text) for r in out.collect()) == ["", "a b", "a b"]
    assert html.extract(df.where(F.lit(False))).collect() == []


LONG = "".join(f"<p>Paragraph {k} tells the whole story of the long article, with many plain words in a row and no link at all.</p>" for k in range(8))


def test_teaser_beside_the_text_is_not_the_article():
    page = f"<body><div class=content>{LONG}<article class=card>Read this teaser next</article></div></body>"
    got = " ".join(html.main_text(page))
    assert all(f"Paragraph {k} " in got for k in range(8))


def test_marked_frames_of_the_whole_text():
    for start, end in (("<div class=elementor-widget-text-editor>", "</div>"), ("<form action=x>", "</form>"), ('<div id="related"><form>', "</form></div>")):
        got = " ".join(html.main_text(f"<body><div class=menu>Home News</div>{start}{LONG}{end}</body>"))
        assert all(f"Paragraph {k} " in got for k in range(8)) and "Home" not in got, start
    for tag in ("div", "form"):
        hidden = f'<body><{tag} class=widget style="display: none">{LONG}</{tag}><p>Seen text of the page.</p></body>'
        assert html.main_text(hidden) == ["Seen text of the page."]


def test_tails_of_pages():
    got = " ".join(html.main_text(f"<body><div><p>First <a title=don't href=x>link</a> of it.</p><svg width='5'/>{LONG}</div></body>"))
    assert "First link of it." in got and all(f"Paragraph {k} " in got for k in range(8))


PROSE = "Some long prose about the matter, which goes on and on. " * 20


def test_names_of_link_lists_do_not_hide_prose():
    page = (
        f"<body><article><p>{PROSE}</p><section id='related-work'><p>Work of others is related to it.</p></section>"
        "<p class='share-price'>The share price rose to 5.</p><div class='share-links'>Share: <a>Facebook</a> <a>Twitter</a></div>"
        "<div class='related-posts'><a>Another story.</a> <a>One more story.</a></div><div class='cookie-notice'>We use cookies.</div></article></body>"
    )
    assert html.main_text(page) == [PROSE.strip(), "Work of others is related to it.", "The share price rose to 5."]


def test_articles_side_by_side_are_parts_of_one():
    page = f"<body><main><article><p>{PROSE}</p></article><article><p>{PROSE}</p><p>{PROSE}</p></article></main></body>"
    assert html.main_text(page) == [PROSE.strip()] * 3
    page = f"<body><div><article><p>{PROSE}</p><p>{PROSE}</p></article><article><a href=x>Teaser</a> <a href=y>Teaser</a></article></div></body>"
    assert html.main_text(page) == [PROSE.strip()] * 2


def test_cut_attributes_and_stray_end_tags_take_linear_time():
    import time

    start = time.perf_counter()
    for page in (
        '<p>x</p><img src="data:image/png;base64,' + "A" * 1_000_000,
        "<p>x</p><img " + "A" * 1_000_000 + ">",
        "<div>" * 16_000 + "x" + "</span></p></li></section>" * 16_000,
        "<article>" * 16_000 + "x",
    ):
        assert html.main_text(page) == ["x"]
    assert time.perf_counter() - start < 10


def plain_density(node, body):
    """Density of a node, counted anew from its whole subtree."""

    def count(x, in_link):
        if isinstance(x, str):
            n = len("".join(x.split()))
            return n, 0, n if in_link else 0, 0
        parts = [count(c, in_link or x.tag == "a") for c in x.children if isinstance(c, str) or not c.hidden]
        inner = [c for c in x.children if not isinstance(c, str) and not c.hidden]
        chars, tags, links, link_tags = (sum(p[i] for p in parts) for i in range(4))
        return chars, tags + len(inner), links, link_tags + sum(c.tag == "a" for c in inner)

    c, t, lc, lt = count(node, False)
    if not c:
        return 0.0
    bc, _, blc, _ = count(body, False)
    base = math.log(c / max(c - lc, 1) * lc + blc / max(bc, 1) * c + math.e)
    return max(0.0, c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / base)


def test_densities_and_core_by_counting_every_subtree():
    rng = random.Random(5)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return "word " * rng.randrange(1, 40)
        tag = rng.choice(["div", "p", "ul", "a", "section", "b"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(1, 5))) + f"</{tag}>"

    for _ in range(40):
        root = html.parse(f"<body>{''.join(tree(5) for _ in range(4))}</body>")
        body = next(c for c in root.children if not isinstance(c, str))
        nodes = html.weigh(body)
        for x in nodes:
            assert math.isclose(x.density, plain_density(x, body), abs_tol=1e-9)
            own = sum(len("".join(c.split())) for c in x.children if isinstance(c, str))
            kids = [c for c in x.children if not isinstance(c, str) and not c.hidden]
            assert math.isclose(x.density_sum, own + sum(plain_density(c, body) for c in kids), abs_tol=1e-9)
