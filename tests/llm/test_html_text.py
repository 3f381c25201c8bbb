import html
import re

import pytest

from reviewgate.llm import html_text as H
from reviewgate.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="content-7"><h1>Title &amp; more</h1>
<script>var a = "<p>no</p>";</script><p>First  <b>bold</b>
line<br>second</p><p>Open paragraph<ul><li>One<li>Two</ul><div class="ad-slot">Buy</div>
<blockquote>Said &eacute;&#233;&nbsp;x</blockquote><form><p>Sign up</p></form>
<table><tr><td>c1<td>c2</table></div>
<div class="sidebar"><p>Side text that is quite long, longer than others, to see that it goes</p></div>
<section id="comments"><p>Reader says</p></section></div><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more\nFirst bold line second\nOpen paragraph\nOne\nTwo\nSaid éé x\nc1\nc2"


def extracted(pages, rows, clashing=False):
    frame = pages(rows, clashing)
    found = H.extract(frame, H.host_paths(frame)).collect()
    assert len(found) == len(rows)
    return found


def test_main_text(pages):
    found = extracted(pages, [(1, "http://a/1", PAGE)], clashing=True)
    assert found[0].text == TEXT


def test_hosts_agree_on_a_path(pages):
    """A page whose own best container is another one follows its host."""
    def page(menu, body):
        return f"<body><div class=links><p>{menu}</p></div><div class=c{len(body)}><p>{body}</p></div>"

    rows = [(i, "http://h/x", page("m", "the body text " * 9)) for i in range(5)]
    rows.append((9, "http://h/y", page("a long list of things " * 9, "short text " * 11 + "abcde")))
    rows.append((10, "http://other/y", page("a long list of things " * 9, "short")))
    found = {r.page_id: r.text for r in extracted(pages, rows)}
    assert found[1] == ("the body text " * 9).strip()
    assert found[9].startswith("short text")
    assert found[10].startswith("a long list")



def test_nested_layouts_keep_title_lead_and_sections(pages):
    """Parts of the article one or two elements outside its longest container."""
    lead, body = "the lead " * 10, "the body text " * 70
    text = f"<h1>Title</h1><p>{lead}</p>"
    layouts = [
        f"<div class=post>{text}<div class=text><p>{body}</p></div></div>",
        f"<article>{text}<div><div class=text><p>{body}</p></div></div></article>",
        f"<div class=x>{text}<div class=y><div class=z><p>{body}</p></div></div></div>",
        f"<div class=x>{text}<div class=text><p>{body}</p></div></div>",
        f"<div class=x><div class=a><h1>Title</h1></div><div class=b><p>{lead}</p></div>"
        f"<div class=c><p>{body}</p></div></div>",
    ]
    links = "<div class=all><p><a href=/a>Some other page</a></p></div>"
    rows = [
        (10 * i + k, f"http://h{i}/{k}", f"<html><body>{links}{x}{links}</body></html>")
        for i, x in enumerate(layouts)
        for k in range(3)
    ]
    want = f"Title\n{lead.strip()}\n{body.strip()}"
    for r in extracted(pages, rows):
        assert r.text == want, r.page_id


def test_links_beside_the_article_stay_out(pages):
    body = "the body text " * 30
    page = (
        "<body><div class=page><div class=post><h1>Title</h1>"
        f"<p><a href=/x>Some link</a></p><div class=text><p>{body}</p><p><a href=/y>Source</a></p>"
        "</div></div><div class=more><p><a href=/a>Some other page of this site</a></p></div></div>"
    )
    assert extracted(pages, [(1, "http://h/1", page)])[0].text == (
        f"Title\n{body.strip()}\nSource"
    )


def test_a_teaser_at_the_path_of_the_host_is_not_all(pages):
    body = "the body text " * 30
    usual = f"<body><div class=text><p>{body}</p></div>"
    other = f"<body><div class=text><p>A teaser</p></div><div class=long><p>{body}</p></div>"
    rows = [(i, "http://h/x", usual) for i in range(5)] + [(9, "http://h/y", other)]
    found = {r.page_id: r.text for r in extracted(pages, rows)}
    assert found[1] == body.strip()
    assert found[9] == f"A teaser\n{body.strip()}"


def test_paths_are_generalised():
    blocks = H.read_blocks('<div class="post-12 b a"><p>x</p></div>')
    assert blocks == [(">div.a.b.post-#", "x", 0)]


def test_cases(pages):
    rows = [
        (1, None, None),
        (2, "http://a/", ""),
        (3, "http://a/", "plain < text & more"),
        (3, "http://a/", "plain < text & more"),
        (None, "x", "<p>un<b>closed <i>tags</p>tail <scr"),
        (4, "http://b/", "<div class=menu><p>only a menu</p></div>"),
        (5, "http://c/", "<article>" + "<p>word</p>" * 20_000 + "</article>"),
        (6, "http://d/", "<!-- a --><script>only()</script><!-- open"),
        (7, "http://e/", "<a href='x>y'>q</a> <p title=\"a>b\">r</p>"),
    ]
    found = {r.page_id: r.text for r in extracted(pages, rows, clashing=True)}
    assert found[1] == found[2] == found[6] == ""
    assert found[3] == "plain < text & more"
    assert found[None] == "unclosed tags\ntail"
    # Boilerplate alone is no article.
    assert found[4] == ""
    assert found[5].count("\n") == 19_999
    assert found[7] == "q\nr"


STORY = [f"Sentence number {i} of the story tells what happened there next." for i in range(5)]
NOTE = "<div class={}><p>Two words</p></div>"


@pytest.mark.parametrize(
    "name",
    [
        "post category-social", "entry tag-search", "news-alert", "form", "story related-politics",
        "content-header-image", "post reply-allowed", "post promo", "hentry category-comments",
        "article sponsored-by-reader", "entry topic-advertising has-sidebar",
    ],
)
def test_a_name_does_not_drop_the_article(pages, name):
    story = "".join(f"<p>{x}</p>" for x in STORY)
    rows = [
        (i, f"http://h{i}/", f'<body>{NOTE.format("box")}<div class="{name}">{story}</div></body>')
        for i in range(2)
    ]
    for r in extracted(pages, rows):
        assert r.text.endswith("\n".join(STORY)), name
    alone = f'<body><div class="{name}">{story}</div>{NOTE.format("sidebar")}</body>'
    assert extracted(pages, [(1, "http://x/", alone)])[0].text == "\n".join(STORY)


@pytest.mark.parametrize(
    "other",
    [
        '<article class="comment"><p>{}</p></article>',
        '<section class="user-reviews"><p>{}</p></section>',
        '<ol class="discussion"><li>{}</li></ol>',
        '<div class="responses"><p>{}</p></div>',
        '<div aria-label="Advertisement"><p>{}</p></div>',
        "<div hidden><p>{}</p></div>",
        '<div class="x" hidden=""><p>{}</p></div>',
        '<div class="comment-list"><p>{}</p></div>',
        '<div id="cookie-notice"><p>{}</p></div>',
        '<div class="related-links"><p>{}</p></div>',
        '<div class="widget promo-box"><p>{}</p></div>',
        '<div class="news-alert"><p>{}</p></div>',
    ],
)
def test_boilerplate_inside_the_article_goes(pages, other):
    long = "A reader or a sponsor has something to say about this. " * 3
    inside = other.format(long)
    page = f"<body><article>{''.join(f'<p>{x}</p>' for x in STORY)}{inside}{inside}</article></body>"
    assert extracted(pages, [(1, "http://h/", page)])[0].text == "\n".join(STORY)


@pytest.mark.parametrize(
    "page",
    [
        "<div class=cookie-notice><p>We use cookies</p></div><div class=comments><p>nice post</p></div>",
        "<div class=sidebar><p>" + "about this site " * 40 + "</p></div>",
        "<div id=comments>" + "<p>I think otherwise, and here is why.</p>" * 30 + "</div>",
        "<nav><p>a</p></nav><footer><p>b</p></footer><div class=form><p>Your name</p></div>",
    ],
)
def test_boilerplate_alone_is_empty(pages, page):
    assert extracted(pages, [(1, "http://h/", f"<body>{page}</body>")])[0].text == ""


def test_values_that_only_mention_hiding(pages):
    page = '<body><p title="a hidden word" class="not-hidden">Shown.</p></body>'
    assert extracted(pages, [(1, "http://h/", page)])[0].text == "Shown."


def test_many_open_tags_take_linear_time():
    assert H.read_blocks("<p>" * 50_000 + "x")[-1][1] == "x"
    assert H.read_blocks('<p a="' * 20_000 + "x") is not None
    assert H.read_blocks("<" * 200_000) is not None


def test_whole_table_against_the_article(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op10_html_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r.page_id]
        article = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
        parts = re.split(r"</?(?:p|h1|h2|ul|li|div)>", article)
        plain = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts)
        assert r.text == "\n".join(x for x in plain if x)
        assert r.n_chars == len(r.text)


def test_empty_table(pages):
    frame = pages([])
    assert H.extract(frame, H.host_paths(frame)).count() == 0
