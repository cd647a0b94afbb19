"""Pages written by hand, apart from the generator that the trees learn from, and pages that are hard to parse."""

import time

import pytest
from mapstone.llm import html_text

TEXTS = [f"Paragraph {i} tells about the long river and the small town, with people who live there since many years." for i in range(4)]
P = "".join(f"<p>{t}</p>" for t in TEXTS)
REST = "\n".join(TEXTS)


def page(body):
    return f"<html><head><title>not this</title></head><body>{body}</body></html>"


CASES = {
    "a title in a block of its own": (
        "<header class='site-header'><a href=/>Site</a></header><div class='content'><article class='post'><div class=entry-header><h1>The title</h1></div>" + P + "</article></div><footer>Impressum Datenschutz</footer>",
        "The title\n" + REST,
    ),
    "prose of links": (
        "<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Links</h1>" + "<p>See <a href=/a>the first long link text</a> and <a href=/b>another long link here</a> or <a href=/c>a third one</a>.</p>" * 4 + "</article>",
        "Links" + "\nSee the first long link text and another long link here or a third one." * 4,
    ),
    "comments in a plain list": (
        "<article><h1>T</h1>" + P + "</article><h3>Comments</h3><ul><li><b>Anna</b> I like it very much.</li><li><b>Bob</b> Me too, thanks.</li></ul>",
        "T\n" + REST,
    ),
    "comments inside the main block": (
        "<main><h1>T</h1>" + P + "<div><h2>2 Kommentare</h2><ul><li><strong>Anna</strong> <p>Sehr schön.</p></li><li><strong>Bob</strong><p>Danke dafür!</p></li></ul></div></main>",
        "T\n" + REST,
    ),
    "a footer in another language": ("<main><h1>Titel</h1>" + P + "</main><div><a href=/i>Impressum</a> <a href=/d>Datenschutz</a></div>", "Titel\n" + REST),
    "formulas and parts for readers without scripts": (
        "<article><h1>T</h1><p>The value <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is given.</p>" + P + "<noscript><p>This part of the story is shown without scripts, and it is long enough.</p></noscript></article>",
        "T\nThe value x=2 is given.\n" + REST + "\nThis part of the story is shown without scripts, and it is long enough.",
    ),
    "a notice for readers without scripts": ("<noscript>Please enable JavaScript in your browser.</noscript><article><h1>T</h1>" + P + "</article>", "T\n" + REST),
    "an apostrophe in a bare attribute": ("<article><h1>T</h1><p title=it's>first text of the article here</p><p>second, it's the text</p>" + P + "</article>", "T\nfirst text of the article here\nsecond, it's the text\n" + REST),
    "a greater-than sign in quotes": ("<article><h1>T</h1><p title=\"a > b\" class='x'>first text of the article here</p>" + P + "</article>", "T\nfirst text of the article here\n" + REST),
    "a cookie banner and a subscription": (
        '<div id="cookie-consent"><p>We use cookies to improve your experience, accept them all.</p><button>Accept</button></div><div class="post-body"><h1>T</h1>' + P + '</div><div class="newsletter-signup"><p>Subscribe to our newsletter, it is free.</p></div>',
        "T\n" + REST,
    ),
}

NAV, FOOT = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>", "<footer><p>Copyright 2024 All rights reserved.</p></footer>"
ARTICLE, WHOLE = f"<article><h1>The title</h1>{P}</article>", "The title\n" + REST
CASES |= {
    "a box called site": (f"<div class=site>{NAV}{ARTICLE}{FOOT}</div>", WHOLE),
    "a page called page and site": (f"<div id=page class=site><main><h1>The title</h1>{P}</main></div>", WHOLE),
    "a common blog's template": (
        '<div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">My Blog</a></p><nav id="site-navigation" class="main-navigation"><ul><li><a href=/>Home</a></li><li><a href=/c>Contact</a></li></ul></nav></header>'
        '<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-1" class="post-1 post type-post hentry"><header class="entry-header"><h1 class="entry-title">The title</h1></header><div class="entry-content">' + P + "</div></article></main></div>"
        '<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent Posts</h2><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></section></aside></div><footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by WordPress</div></footer></div>',
        WHOLE,
    ),
    **{f"an article called {x}": (f"{NAV}<div class={x}><h1>The title</h1>{P}</div>{FOOT}", WHOLE) for x in ("top-story", "public-notice", "c", "hero", "bar")},
    "boxes in boxes": (f"<div class=container><div class=row><div class=col>{ARTICLE}</div></div></div>", WHOLE),
    "names of two letters": (f"<div id=wrap class=de>{NAV}<div class='li go in'>{ARTICLE}</div>{FOOT}</div>", WHOLE),
    "a cookie window": (f'<div class="cc-window cc-banner" role=dialog><span>This website uses cookies to ensure you get the best experience.</span><a href=/p>Learn more</a><a>Got it!</a></div>{ARTICLE}', WHOLE),
    "cards of other stories": (ARTICLE + "<div class=cards><h3>More from us</h3><div class=card><h4>Another story here</h4><p>A short teaser of it.</p></div><div class=card><h4>Second story there</h4><p>A teaser of that one.</p></div></div>", WHOLE),
    "a quoted paragraph that sounds like a button": (f"<article><h1>The title</h1>{P}<blockquote><p>Share what you know</p></blockquote></article>", WHOLE + "\nShare what you know"),
    "terms that sound like notices": (
        f"<article><h1>The title</h1>{P}<dl><dt>Cookie</dt><dd>A small piece of data that a site keeps in the browser.</dd><dt>Newsletter</dt><dd>A letter that is sent to many readers at once.</dd></dl></article>",
        WHOLE + "\nCookie\nA small piece of data that a site keeps in the browser.\nNewsletter\nA letter that is sent to many readers at once.",
    ),
    "comments as lines of a list": (ARTICLE + "<h3>Comments</h3><ul><li>Anna: great article!</li><li>Bob: I liked it a lot, thanks.</li></ul>", WHOLE),
    "a notice alone": (f"<div class='cookie-banner'><p>We use cookies to improve your experience on our site. Accept all of them.</p></div>{NAV}", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(name):
    body, want = CASES[name]
    assert html_text.extract([page(body)], html_text.trained()) == [want]


@pytest.mark.parametrize(
    "bad",
    [
        "<b><p>x" * 14_000, "<div>" * 10_000 + "</b></x>" * 10_000, "<div>" * 50_000 + "x" + "</p>" * 10_000, "<li><ul>" + "<div><li>a</li>" * 9_000, "<svg>" * 20_000, "<a b=\"c' d='" * 9_000,
        "<" * 100_000, "<table>" + "<tr><td>x" * 11_000, "<i>" * 30_000 + "<p>x</p>" * 1_000, "<span>" * 8_000 + "<div>y</div>" * 8_000, "<!--" * 20_000, "<a " * 30_000,
    ],
)
def test_the_work_grows_with_the_page_only(bad):
    html_text.trained()
    began = time.process_time()
    html_text.extract([bad], html_text.trained())
    once = time.process_time() - began
    assert once < 1.5
    began = time.process_time()
    html_text.extract([bad * 3], html_text.trained())
    assert time.process_time() - began < 9 * max(once, 0.05)


def test_trees_are_the_same_from_the_shared_folder(spark):
    fresh = html_text.trained()
    html_text._MODEL = None
    left = html_text.trained(spark)
    html_text._MODEL = None
    again = html_text.trained(spark)  # read, not trained
    for got in (left, again):
        assert got.odds == fresh.odds and got.bias == fresh.bias and (got.cut == fresh.cut).all() and (got.value == fresh.value).all() and (got.feature == fresh.feature).all()
