"""Pages written by hand in the manner of common sites, with the texts a reader would keep."""

import pytest

from tabsignal.llm import html_text

A = "The river rose again on Monday night, and by morning the lower fields were under a metre of brown water."
B = "Farmers moved their cattle to the old railway embankment, which is the only high ground for several miles."
C = "“We have done this before,” said one of them, pointing at the marks that earlier floods had left on the barn."
D = "The council has promised to dredge the channel, but it made the same promise eleven years ago and nothing came of it."
E = "Rain is forecast until Thursday; the agency expects the level to fall slowly after that."
F = "What follows is a short account of how the embankment was built and who paid for it at the time."
PARAS = [A, B, C, D, E, F]

BLOG = f"""<!doctype html><html lang=en><head><meta charset=utf-8><title>Flood | Valley Notes</title><link rel=stylesheet href=/s.css></head>
<body class="single post-template"><div id="page" class="hfeed site">
<header id="masthead" class="site-header"><p class="site-title"><a href="/">Valley Notes</a></p><nav class="main-navigation"><ul><li><a href=/>Home</a><li><a href=/about>About</a><li><a href=/contact>Contact</a></ul></nav></header>
<div id="content" class="site-content"><main id="main" class="site-main"><article id="post-41" class="post-41 post type-post hentry">
<header class="entry-header"><h1 class="entry-title">The river comes up</h1></header>
<div class="entry-content"><p>{A}</p><p>{B}</p><blockquote><p>{C}</p></blockquote><h2>What the council says</h2><p>{D}</p><p>{E}</p></div>
<footer class="entry-footer"><span class="cat-links">Posted in <a href=/c/news>News</a></span> <span class="tags-links">Tagged <a href=/t/river>river</a>, <a href=/t/flood>flood</a></span></footer></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Great post, thanks for writing it all down.</p></li><li class="comment"><p>My uncle lost two sheep that night.</p></li></ol></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></section></aside>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by a press &copy; 2024 Valley Notes</div></footer></div></body></html>"""

NEWS = f"""<html><head><title>x</title><script type="application/ld+json">{{"a":"<p>no</p>"}}</script></head><body>
<div class="cookie-banner" role="dialog"><p>We use cookies to improve your experience. By continuing you agree.</p><button>Accept</button></div>
<div class="top-bar"><a href=/login>Sign in</a> <a href=/sub>Subscribe</a></div>
<div class="menu"><ul><li><a href=/uk>UK</a></li><li><a href=/world>World</a></li><li><a href=/sport>Sport</a></li></ul></div>
<div class="story-body"><h1>Fields under water</h1><p>{A}<p>{B}<p>{C}<div class="ad-slot advert"><p>Advertisement: buy one, get one free this week only.</p></div><p>{D}</p></div>
<div class="related"><h3>More on this story</h3><ul><li><a href=/a>Storm names explained</a></li><li><a href=/b>How to read a gauge</a></li></ul></div>
<div class="footer"><ul><li><a href=/terms>Terms</a></li><li><a href=/privacy>Privacy</a></li></ul><p>Copyright &copy; 2024 The Valley Paper. All rights reserved.</p></div></body></html>"""

FORM = f"""<html><body><form method="post" action="./page.aspx" id="aspnetForm"><input type=hidden name=__VIEWSTATE value="zz">
<div id="nav"><ul><li><a href=/a>Home</a></li><li><a href=/b>Products</a></li></ul></div>
<div id="ContentPlaceHolder" class="content"><h1>The embankment</h1><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p><p>{E}</p><p>{F}</p></div>
<div id="footer">&copy; Valley District Council</div></form></body></html>"""

QUOTES = f"""<html><body><article><h1>Quotes</h1><p title=it's>{A}</p><p data-x="a>b" class='x y'>{B}</p><p title=don't/>{C}</p><p>{D}</p></article></body></html>"""

ARTICLE_FOOTER = f"""<html><body><article><h1>The river</h1><p>{A}</p><p>{B}</p><p>{C}</p><footer><p>Written by our staff. Share this with a friend.</p></footer></article></body></html>"""

INLINE = f"""<html><body><main><h1>Formulas</h1><p>The depth <math><mi>d</mi><mo>=</mo><mn>1</mn><annotation encoding="tex">d=1</annotation></math> is given in metres. {A}</p>
<p><custom-term>{B}</custom-term> <font color=red>{C}</font></p><p>R&amp<b>;</b>D &lt;p&gt; {D}</p></main></body></html>"""


@pytest.mark.parametrize(
    "source, want",
    [
        (BLOG, ["The river comes up", A, B, C, "What the council says", D, E]),
        (NEWS, ["Fields under water", A, B, C, D]),
        (FORM, ["The embankment", *PARAS]),
        (QUOTES, ["Quotes", A, B, C, D]),
        (ARTICLE_FOOTER, ["The river", A, B, C]),
        (INLINE, ["Formulas", f"The depth d=1 is given in metres. {A}", f"{B} {C}", f"R&;D <p> {D}"]),
    ],
    ids=["blog", "news", "page-wide form", "quotes", "article footer", "inline"],
)
def test_pages_by_hand(source, want):
    assert html_text.main_texts([source], html_text.trained())[0].split("\n") == want


def test_deep_nesting_loses_nothing():
    deep = "<div>" * 3000 + f"<article><h1>Deep</h1><p>{A}</p><p>{B}</p><p>{C}</p></article>"
    assert html_text.main_texts([f"<html><body>{deep}</body></html>"], html_text.trained())[0].split("\n") == ["Deep", A, B, C]


@pytest.mark.parametrize(
    "source, texts",
    [
        ("<p title=it's>a</p><p>b's</p>", ["a", "b's"]),
        ("<p title='x>y' z=\"<p>\">a", ["a"]),
        ("<p title=\"never closed>a<p>b", []),
        ("<p a = b c='d'e>x</p>", ["x"]),
        ("<b><p>x</b>y</p>z", ["xy", "z"]),
        ("<a href=/x>one<div>two</a>three</div>", ["one", "twothree"]),
        ("<table><tr><td>a</div>b<td>c</table>", ["ab", "c"]),
        ("<unknown-x><div>a</div></unknown-x>b", ["a", "b"]),
        ("a &amp b&am<i>p;</i> &lt;i&gt;", ["a & b&amp; <i>"]),
        ("<textarea><p>x</textarea >y<TITLE>z</title\n>w", ["yw"]),
        ("x</ p>y<!doctype z>w</>v", ["xywv"]),
        ("<p>a<br/>b</br>c<wbr>d", ["a b cd"]),
    ],
)
def test_markup_as_browsers_read_it(source, texts):
    assert html_text.parse(source)[1] == texts
