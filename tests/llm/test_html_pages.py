"""Hand-made pages of common layouts: each block of the article is kept, nothing else is."""

import random
import time

import pytest

from stratalens.llm.op4_html import blocks_of, default_tree, main_text, word_count

WORDS = "harbour lantern meadow copper violet engine ladder winter orchard signal marble canyon ribbon thunder island velvet compass garden bridge saddle".split()


def p(n, start=0):
    """A sentence of n words."""
    return " ".join(WORDS[(start * 7 + i * 3) % len(WORDS)] for i in range(n)).capitalize() + "."


A, B, C, D = p(40), p(55, 1), p(30, 2), p(70, 3)
T = "The long road home"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li><li><a href="/c">Contact us</a></li></ul></nav>'
FOOT = '<footer><p>Copyright 2024 Some Company. All rights reserved.</p><a href="/p">Privacy</a></footer>'
COMMENTS = f'<div id="comments"><h3>3 comments</h3><div class="comment-12"><p>{p(60, 4)}</p></div><div class="comment-body"><p>{p(45, 5)}</p></div></div>'
PLAIN = [T, A, B, C]
BODY = f"<h1>{T}</h1><p>{A}</p><p>{B}</p><p>{C}</p>"

PAGES = {
    "wordpress post": (f'{NAV}<article class="post-12 post type-post hentry category-news tag-python">{BODY}</article>{FOOT}', PLAIN),
    "classes of a wrapper": (f'{NAV}<div class="entry tag-news">{BODY}</div>{FOOT}', PLAIN),
    "share enabled": (f'{NAV}<div class="post-content share-enabled">{BODY}</div>{FOOT}', PLAIN),
    "legal section": (f'<main><section class="legal">{BODY}</section></main>{FOOT}', PLAIN),
    "apostrophe without quotes": (f"<body>{NAV}<article><p title=it's>{A}</p><p>{B}</p></article>{FOOT}", [A, B]),
    "unquoted attributes": (f"<div class=site-nav><a href=/x>Home</a> <a href=/y?a=1&b=2>Shop</a></div><div id=content class=wide data-x=a/b><h1>{T}</h1><p>{A}</p><p class=x>{B}</p></div><div id=footer>Imprint and contact</div>", [T, A, B]),
    "greater sign in quotes": (f'<article data-q="a > b" title=\'x>y\'><p>{A}</p></article>{FOOT}', [A]),
    "hidden in a value": (f'<article data-title="The hidden truth"><p>{A}</p></article>', [A]),
    "overflow hidden": (f'<article style="overflow: hidden !important"><p>{A}</p></article>', [A]),
    "really hidden": (f'<article><p>{A}</p><p hidden>{B}</p><div style="display:none">{C}</div><p>{D}</p></article>', [A, D]),
    "hidden span": (f'<article><p>{A} <span style="display:none">secret <span>deep</span> words</span>end</p></article>', [f"{A} end"]),
    "math in an article": (f"<article><p>{A} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>", [f"{A} x=1"]),
    "blog with sidebar": (f'<header><h2>Site</h2></header>{NAV}<div class="content-area"><div class="post">{BODY}</div></div><aside class="sidebar"><h4>About</h4><p>{p(35, 6)}</p></aside>{FOOT}', PLAIN),
    "blog with comments": (f'<article class="post">{BODY}</article>{COMMENTS}', PLAIN),
    "comments inside the article": (f'<article class="post comments-open">{BODY}<section class="comments-area"><ol class="comment-list"><li><p>{p(80, 6)}</p></li><li><p>{p(90, 7)}</p></li></ol></section></article>', PLAIN),
    "comments as articles": (f'<main>{BODY}<article class="comment"><p>{p(90, 8)}</p></article><article class="comment"><p>{p(99, 9)}</p></article></main>', PLAIN),
    "much more comments than text": (f'<article><p>{A}</p></article><div class="comments">' + "".join(f"<div><p>{p(80, k)}</p></div>" for k in range(9)) + "</div>", [A]),
    "cookie notice first": (f'<div class="cookie-banner"><p>{p(35, 6)}</p><button>Accept</button></div><div class="content">{BODY}</div>', PLAIN),
    "cookie notice with another name": (f'<div id="cookieConsentWrapper"><p>{p(35, 6)}</p></div><main>{BODY}</main>', PLAIN),
    "news with related stories": (f'<div class="article-body">{BODY}</div><div class="related-articles"><h3>Read more</h3><ul><li><a href="/1">{p(8)}</a></li><li><a href="/2">{p(9)}</a></li></ul></div>', PLAIN),
    "advert between paragraphs": (f'<article><p>{A}</p><div class="ad-slot">Advertisement</div><div id="ads-300x250"><p>{p(30, 8)}</p></div><p>{B}</p></article>', [A, B]),
    "newsletter box": (f'<article><p>{A}</p><div class="newsletter-signup"><p>{p(26, 7)}</p><form><input name=e><button>Go</button></form></div><p>{B}</p></article>', [A, B]),
    "social links": (f'<article><p>{A}</p><ul class="social-links"><li><a href="/f">Face</a></li><li><a href="/t">Twit</a></li></ul><p>{B}</p></article>', [A, B]),
    "breadcrumbs": (f'<div class="breadcrumbs"><a href="/">Home</a> / <a href="/n">News</a> / This</div><article>{BODY}</article>', PLAIN),
    "documentation": (f'<div class="toc"><a href="#a">One</a><a href="#b">Two</a></div><div class="markdown-body"><h1>{T}</h1><p>{A}</p><pre>x = 1\ny = 2</pre><h2>Usage</h2><p>{B}</p></div>', [T, A, "x = 1 y = 2", "Usage", B]),
    "forum": (f'<div class="topbar"><a href="/l">Log in</a></div><div class="topic"><h1>{T}</h1><div class="post"><div class="post-text"><p>{A}</p><p>{B}</p></div></div></div>', [T, A, B]),
    "list in an article": (f"<article><p>{A}</p><ul><li>First point</li><li>Second point here</li></ul><p>{B}</p></article>", [A, "First point", "Second point here", B]),
    "table in an article": (f"<article><p>{A}</p><table><tr><th>Name</th><th>Size</th></tr><tr><td>Oak</td><td>Large</td></tr></table><p>{B}</p></article>", [A, "Name", "Size", "Oak", "Large", B]),
    "layout by tables": (f'<table><tr><td><a href="/1">One</a><br><a href="/2">Two</a></td><td><p>{A}</p><p>{B}</p></td></tr></table>', [A, B]),
    "unclosed paragraphs": (f"<article><h1>{T}</h1><p>{A}<p>{B}<p>{C}</article>{FOOT}", PLAIN),
    "unclosed items": (f"<article><p>{A}</p><ul><li>First point<li>Second point</ul><p>{B}</p></article>", [A, "First point", "Second point", B]),
    "tags in capitals": (f"<BODY><DIV CLASS='Menu'><A HREF='/'>Home</A></DIV><DIV ID='Content'><P>{A}</P><P>{B}</P></DIV></BODY>", [A, B]),
    "character references": (f"<article><p>{A} caf&eacute; &amp; &#8220;tea&#x201D; &lt;b&gt;</p></article>", [f"{A} café & “tea” <b>"]),
    "comment and script in between": (f'<article><p>{A}</p><!-- <p>no</p> --><script>var a = "<p>no</p>";</script><style>p{{}}</style><p>{B}</p></article>', [A, B]),
    "line breaks": (f"<article><p>{A}<br>next<br/>last</p></article>", [f"{A} next last"]),
    "white space": (f"<article><p>\n  {A}\n\t{B}  </p></article>", [f"{A} {B}"]),
    "no helpful markup": (f"<div><div><a href=/1>Home</a> <a href=/2>Shop</a></div><div><p>{A}</p><p>{B}</p><p>{D}</p></div><div>Imprint</div></div>", [A, B, D]),
    "page inside a form": (f'<form id="aspnetForm"><div class="menu"><a href="/">Home</a></div><div class="content">{BODY}</div></form>', PLAIN),
    "page inside a form, unnamed": (f"<form><p>{A}</p><p>{B}</p><p>{D}</p></form>", [A, B, D]),
    "contact form": (f'<main><p>{A}</p><form><label>Your name</label><input><textarea>x</textarea></form></main>', [A]),
    "wrapper named by a layout": (f'<div class="sidebar-right"><div class="col-main">{BODY}</div><div class="sidebar"><p>{p(30, 9)}</p></div></div>', PLAIN),
    "menu is open": (f'<div class="menu-open"><ul class="main-menu"><li><a href="/">Home</a></li></ul><div class="story">{BODY}</div></div>', PLAIN),
    "search results": (f'<div class="search-results"><div class="entry"><h2>{T}</h2><p>{A}</p></div></div>', [T, A]),
    "header of the article": (f"<header><h1>Site name</h1></header><article><header><h1>{T}</h1><p>By somebody</p></header><p>{A}</p></article>", [T, "By somebody", A]),
    "entry header outside": (f'<div class="post"><div class="entry-header"><h1>{T}</h1></div><div class="entry-content"><p>{A}</p><p>{B}</p></div></div>', [T, A, B]),
    "heading that is a link": (f'<article><h2><a href="/x">{T}</a></h2><p>{A}</p></article>', [T, A]),
    "figure caption": (f"<article><p>{A}</p><figure><img src=x><figcaption>A boat at sea</figcaption></figure><p>{B}</p></article>", [A, "A boat at sea", B]),
    "quotation": (f"<article><p>{A}</p><blockquote>{C}</blockquote><p>{B}</p></article>", [A, C, B]),
    "camel case names": (f'<div class="topNavBar"><a href="/">Home</a></div><div class="articleBody"><p>{A}</p></div><div class="footerLinks"><p>{p(28, 9)}</p></div>', [A]),
    "roles": (f'<div role="banner"><p>Site</p></div><div role="main"><p>{A}</p></div><div role="complementary"><p>{p(30, 5)}</p></div><div role="contentinfo">Imprint</div>', [A]),
    "promo in the article": (f'<article><p>{A}</p><div class="promo"><p>{p(28, 5)}</p></div><p>{B}</p></article>', [A, B]),
    "pager": (f'<article><p>{A}</p></article><div class="pagination"><a href="/2">2</a> <a href="/3">3</a></div>', [A]),
    "japanese": ('<div><p>' + "春の海は静かに光る。" * 33 + "</p><p>" + "山の道を歩いた。" * 22 + "</p><p>終わり</p></div>", ["春の海は静かに光る。" * 33, "山の道を歩いた。" * 22, "終わり"]),
    "chinese with a menu": ('<div class="menu"><a href="/">首页</a><a href="/n">新闻</a></div><div><h1>城市的早晨</h1><p>' + "街上的人慢慢多了起来，" * 12 + "</p><p>" + "面包店打开了门。" * 15 + '</p></div><div class="footer">版权所有 ' + "保留一切权利" * 6 + "</div>", ["城市的早晨", "街上的人慢慢多了起来，" * 12, "面包店打开了门。" * 15]),
    "thai": ("<article><p>" + "ภาษาไทยไม่มีช่องว่าง" * 12 + "</p></article>", ["ภาษาไทยไม่มีช่องว่าง" * 12]),
    "ad hoc": (f'<article><p>{A}</p><div class="ad-hoc-committee"><p>Three members.</p><p>{B}</p></div></article>', [A, "Three members.", B]),
    "reply from": (f'<article><p>{A}</p><section class="reply-from-minister"><p>It was short.</p></section></article>', [A, "It was short."]),
    "foot notes": (f'<article><p>{A}</p><ol class="foot-notes"><li>First note</li><li>Second note</li></ol></article>', [A, "First note", "Second note"]),
    "references": (f'<article><p>{A}</p><h2>References</h2><ul><li><a href="/1">First source</a></li><li><a href="/2">Second source</a></li></ul><p><a href="/3">{C}</a></p><p>{B}</p></article>', [A, "References", "First source", "Second source", C, B]),
    "recipe outside an article": (f"<div><h1>{T}</h1><p>{A}</p><ul><li>2 eggs</li><li>100 g flour</li></ul><p>{B}</p></div>{FOOT}", [T, A, "2 eggs", "100 g flour", B]),
    "short page": (f"{NAV}<h1>Opening hours</h1><p>Monday to Friday.</p><p>Nine to five.</p>{FOOT}", ["Opening hours", "Monday to Friday.", "Nine to five."]),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page(name):
    page, want = PAGES[name]
    assert main_text(page, default_tree()).split("\n\n") == want


def test_pathological_pages_end():
    tree = default_tree()
    for page in ("<" * 200_000, "<p " + "a" * 200_000, "<p " + "a=" * 100_000, '<p a="' + "x" * 200_000, "<div>" * 20_000 + "x", "<!--" * 50_000, "&" * 100_000):
        main_text(page, tree)


def test_deep_pages_take_linear_time():
    """Closing tags without an opening one are known at once, however deep a page is."""
    tree = default_tree()
    for page in ("<div>" * 100_000 + "</p>" * 100_000 + "x", "<section>" * 50_000 + "<p>a</p>" * 50_000 + "</section>" * 60_000, "<ul><li>" * 50_000 + "</ol>" * 50_000, "<span class=a>" * 50_000 + "</b>" * 50_000):
        start = time.perf_counter()
        main_text(page, tree)
        assert time.perf_counter() - start < 30


def test_words_of_any_script():
    assert [word_count(x) for x in ("", "two words", "日本語です。", "mixed 日本 text", "é à")] == [0, 2, 3, 3, 2]


def flat(tree, row):
    """Every path of a tree from its root, read as conditions: the one that holds gives the label."""
    if isinstance(tree, int):
        return [tree]
    f, cut, low, high = tree
    return flat(low, row) * (row[f] <= cut) + flat(high, row) * (row[f] > cut)


def test_blocks_against_brute_force():
    """On pages of well-formed elements, blocks are the runs of text between block tags, each with what its own tags say."""
    rng = random.Random(8)
    tree = default_tree()
    for _ in range(200):
        want = []
        body = ""
        for i in range(rng.randint(1, 12)):
            name, linked, n = rng.choice(["p", "h2", "blockquote", "pre"]), rng.random() < 0.3, rng.choice([1, 2, 5, 14, 40, 90])
            text = p(n, i)
            body += f"<{name}>" + (f"<a href=x>{text}</a>" if linked else text) + f"</{name}>"
            want.append((text, n, float(linked), name == "h2"))
        for page, boiler, content in ((f"<article>{body}</article>", 0, 1), (f"<nav>{body}</nav>", 2, 0), (f"<div>{body}</div>", 0, 0)):
            got = blocks_of(page)
            assert [(b.text, b.words, b.density, b.heading) for b in got] == want and {(b.boiler, int(b.content)) for b in got} == {(boiler, content)}
            around = [(0, 0.0), *((w, d) for _, w, d, _ in want), (0, 0.0)]
            sure = [flat(tree, (w, d, *around[i], *around[i + 2], boiler, content, int(h))) for i, (_, w, d, h) in enumerate(want)]
            assert all(len(x) == 1 for x in sure)
            kept = main_text(page, tree).split("\n\n")
            assert all(t in kept for (t, *_), x in zip(want, sure) if x == [1])
            if boiler:
                assert kept == [""]
