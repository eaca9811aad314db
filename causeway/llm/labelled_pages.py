"""Labelled pages for the model of html_text: a few written ones, and any number drawn from a grammar of page layouts.

data-keep marks elements whose own text is content. `drawn` composes a page of labelled pieces (site headers, menus,
adverts, notices, sidebars, comments, footers; wrappers, headlines, paragraphs, lists, tables, quotes) under names that
sites give them, with the layout words (`no-sidebar`, `has-comments`, `left-side`) that tell nothing about an element.
"""

from __future__ import annotations

import random

#: Pages labelled by hand.
WRITTEN = (
    """<html><head><title>A title</title><style>p{}</style><script>x()</script></head><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav><div class="ad">Buy this now.</div><article data-keep><h1 data-keep>A title</h1><p data-keep>First long paragraph of the story, with a comma and a stop. It goes on for some time.</p><p data-keep><b data-keep>Bold words here.</b> and more text, as it should be.</p><p data-keep>Short.</p></article><footer>&copy; site. All rights.</footer></body></html>""",
    """<body><header class="site-header"><h2>Site name</h2><a href=a>About</a></header><div id="menu"><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div><main data-keep><section data-keep><h2 data-keep>Heading of a part</h2><p data-keep>Text of the part, which says something. And another sentence follows here.</p><ul data-keep><li data-keep>An item of the text, as a sentence.</li><li data-keep>Another item.</li></ul><blockquote data-keep><p data-keep>What somebody said, word for word.</p></blockquote></section></main><aside class="sidebar"><h3>Related</h3><p>You may also like this story about a thing.</p></aside><div class="comments"><h3>Comments</h3><p>I disagree with all of it, said a reader. It is wrong.</p></div><footer><p>Contact us at the office. Terms apply.</p></footer></body>""",
    """<body><div class="cookie-notice"><p>We use cookies on this site. Accept them, please.</p></div><div id="nav"><ul><li><a href=x>World</a></li></ul></div><div id="content" data-keep><h1 data-keep>Headline</h1><div class="story-body" data-keep><p data-keep>The story starts with this sentence, and goes on. It has <a href=x data-keep>a link</a> inside.</p><div class="ad"><p>Advert text, cheap offers. Click here today.</p></div><p data-keep>It ends here.</p><table data-keep><tbody data-keep><tr data-keep><td data-keep>Cell one</td><td data-keep>12</td></tr></tbody></table></div></div><div class="newsletter"><form><label>Mail</label><input><button>Send</button></form></div></body>""",
    """<body><div class="wrapper" data-keep><div class="top-banner">Subscribe now and save.</div><div class="post" data-keep><h2 data-keep>Post title</h2><div data-keep>Text without a paragraph tag, long enough to be content of the page, with commas, stops. And so on.</div><pre data-keep>code = 1</pre><div class="share"><a href=a>Share</a><a href=b>Post</a></div></div><div class="respond"><h3>Leave a reply</h3><p>Your mail will not be shown, of course. Fields are needed.</p></div></div><div class="footer"><span>Copyright</span></div></body>""",
    """<html><body><p data-keep>A plain page with a paragraph, no more than that.</p><p data-keep>And a second <em data-keep>one</em> here.</p></body></html>""",
    """<html><body><h1 data-keep>Only a heading</h1><div data-keep><span data-keep>Words in a span, part of the text.</span></div><section class="related-posts"><h2>More stories</h2><div>Another headline from elsewhere, with words. Read it.</div></section></body></html>""",
    """<html><body><article data-keep><h2 data-keep>Steps</h2><ul data-keep><li data-keep>One</li><li data-keep>Two</li><li data-keep>Three of them</li><li data-keep>Four</li></ul><p data-keep>Then this.</p><ol data-keep><li data-keep>First</li><li data-keep>Second</li><li data-keep>Third</li></ol><dl data-keep><dt data-keep>Term</dt><dd data-keep>Meaning</dd></dl><div data-keep><em data-keep>End</em></div></article></body></html>""",
)

_WORDS = (
    "river market council report village engine weather station paper winter school garden harbour music letter bridge "
    "morning evening number product service account member article change budget history nature window people country"
).split()
#: Names of pieces on pages; "" is no name.
HEADERS = ("site-header", "masthead", "header", "page-head top", "top-header", "banner", "")
MENUS = ("menu", "nav", "navbar", "main-menu", "breadcrumbs", "nav-wrapper", "site-navigation", "toolbar")
ADVERTS = ("ad", "ads", "advert", "sponsored", "promo", "banner", "ad-slot", "advertisement", "sponsor-box")
NOTICES = ("cookie-notice", "consent", "notice", "alert", "popup", "newsletter", "subscribe", "modal overlay", "signup-box")
SIDEBARS = ("sidebar", "widget-area", "related", "recommended", "related-posts", "sidebar-wrapper", "widgets", "more promo")
COMMENTS = ("comments", "comment-list", "reader-comments", "discussion", "respond", "replies", "comments-area", "post-comments")
SHARES = ("share", "social", "tags", "pager", "pagination", "post-tags", "share-buttons", "entry-share")
FOOTERS = ("footer", "site-footer", "page-footer", "copyright", "legal", "footer-container", "")
WRAPS = ("content", "main", "article", "post", "entry", "story", "story-body", "content has-comments", "left-side", "col-left",
         "page no-sidebar", "entry-content", "articleBody", "main-content", "wrapper", "container", "layout-sidebar-right",
         "row", "", "", "post with-related", "text", "page-content")
BODIES = ("", "", "", "page no-sidebar", "single single-post", "has-sidebar", "home blog", "layout-sidebar comments-open", "with-banner article")
#: Names that mention boilerplate and stand on articles all the same, and names that say nothing to an outsider.
MISLEADING = ("post category-social", "post tag-comments", "hentry category-legal", "article js-share", "post sharing-enabled",
              "article related-article", "content content-with-sidebar", "sidebar-right content", "sponsored-post", "widget-content",
              "content sidebar-none", "promo-story", "newsletter-article", "comment-page", "discussion-post", "notice-text", "menu-page")
TITLES = ("entry-header", "post-header", "article-header", "page-header", "story-head", "")


def drawn(seed: int, hard: bool = False) -> str:
    """One labelled page; a hard one may have misleading or meaningless names, long lists, or no headline of the first order."""
    rng = random.Random(seed)
    pick = rng.choice

    def words(low: int, high: int, marks: bool = True) -> str:
        out = [pick(_WORDS) for _ in range(rng.randint(low, high))]
        if marks:
            out = [w + (pick(",.") if rng.random() < 0.12 else "") for w in out]
        return " ".join(out).capitalize() + ("." if marks else "")

    def named(tag: str, name: str, inner: str, keep: bool = False) -> str:
        attr = f' {pick(("class", "class", "id"))}="{name}"' if name else ""
        return f"<{tag}{attr}{' data-keep' if keep else ''}>{inner}</{tag}>"

    def many(most: int) -> int:
        """Up to most, or sometimes several times as many."""
        return rng.randint(1, most * 5 if hard and rng.random() < 0.12 else most)

    def odd(names: tuple[str, ...], rate: float = 0.05) -> str:
        """One of names, or sometimes a made-up one that tells nothing."""
        return "-".join(rng.sample(_WORDS, rng.randint(1, 2))) if hard and rng.random() < rate else pick(names)

    def wrap() -> str:
        return pick(MISLEADING) if hard and rng.random() < 0.12 else odd(WRAPS)

    def links(low: int, high: int) -> str:
        tag = pick(("li", "li", "span", ""))
        each = [f'<a href="/{pick(_WORDS)}">{words(1, 5, False)}</a>' for _ in range(rng.randint(low, high))]
        inner = " ".join(f"<{tag}>{a}</{tag}>" if tag else a for a in each)
        return f"<ul>{inner}</ul>" if tag == "li" else inner

    def lines(low: int, high: int) -> str:
        return "".join(f"<{t}>{words(3, 30)}</{t}>" for t in (pick(("p", "p", "div", "span")) for _ in range(rng.randint(low, high))))

    def menu() -> str:
        return pick((f"<nav>{links(3, 9)}</nav>", named(pick(("div", "ul", "nav")), odd(MENUS), links(3, 9))))

    def advert() -> str:
        tag = pick(("div", "div", "aside", "section", "p"))  # a paragraph holds no blocks
        return named(tag, pick(ADVERTS), words(2, 14) if tag == "p" else pick((words(2, 14), lines(1, 2), links(1, 2))))

    def sidebar() -> str:
        inner = f"<h3>{words(1, 3, False)}</h3>" + pick((links(3, 8), lines(1, 4), lines(1, 2) + links(2, 5)))
        tag = pick(("aside", "div", "section"))
        return named(tag, "" if tag == "aside" and rng.random() < 0.5 else odd(SIDEBARS), inner)

    def comments() -> str:
        one = lambda: pick((
            named("div", pick(("comment", "comment", "reply")), f"<h4>{words(1, 2, False)}</h4><p>{words(5, 60)}</p>"), f"<li><p>{words(4, 50)}</p></li>",
            f"<p>{words(6, 60)}</p>", named("article", "comment-body", f"<p>{words(4, 40)}</p>")))
        inner = f"<h3>{words(1, 3, False)}</h3>" + "".join(one() for _ in range(many(12)))
        return named(pick(("div", "section", "ol")), pick(COMMENTS), inner)

    def block() -> str:
        kind = rng.random()
        k = " data-keep"
        if kind < 0.5:
            return f"<p{k}>{words(3, 80)}</p>"
        if kind < 0.6:
            return f"<p{k}>{words(3, 30)} <a href=x{k}>{words(1, 3, False)}</a> {words(3, 30)} <em{k}>{words(1, 2, False)}</em></p>"
        if kind < 0.66:
            return f"<p{k}><b{k}>{words(2, 12)}</b><br>{words(5, 30)}</p>"
        if kind < 0.72:
            return f"<h2{k}>{words(1, 7, False)}</h2>"
        if kind < 0.8:
            tag = pick(("ul", "ol"))
            return f"<{tag}{k}>" + "".join(f"<li{k}>{words(1, 15)}</li>" for _ in range(rng.randint(2, 8))) + f"</{tag}>"
        if kind < 0.84:
            return f"<blockquote{k}><p{k}>{words(5, 40)}</p></blockquote>"
        if kind < 0.87:
            return f"<pre{k}>{words(3, 20, False)}</pre>"
        if kind < 0.9:
            row = lambda: f"<tr{k}>" + "".join(f"<td{k}>{words(1, 3, False)}</td>" for _ in range(3)) + "</tr>"
            return f"<table{k}>{row()}{row()}</table>"
        if kind < 0.93:
            return f"<figure{k}><figcaption{k}>{words(3, 15)}</figcaption></figure>"
        if kind < 0.97:
            return named("div", odd(("",), 0.3) if hard else "", words(8, 60), True)
        return f"<section{k}><h3{k}>{words(1, 5, False)}</h3><p{k}>{words(5, 50)}</p></section>"

    top = "h2" if hard and rng.random() < 0.07 else "h1"
    inner = f"<{top} data-keep>{words(2, 9, False)}</{top}>"
    if rng.random() < 0.35:
        title = pick(TITLES)
        inner = named(pick(("header", "header", "div")) if title else "header", title, inner, True)
    for _ in range(many(14)):
        inner += block()
        if rng.random() < 0.07:
            inner += advert()
    if rng.random() < 0.25:
        inner += named("div", odd(SHARES), links(2, 5))
    wrapped = rng.random() < 0.8
    if wrapped:
        inner = named(pick(("article", "article", "main", "div", "section")), wrap(), inner, True)
    after = ""
    if rng.random() < 0.3:
        after += comments()
    if rng.random() < 0.35:
        after += sidebar()
    if hard and wrapped and top == "h1" and rng.random() < 0.25:  # a block under a name that tells nothing: its place does
        after += named(pick(("div", "section")), odd(("",), 0.8), lines(1, 4))
    for _ in range(rng.randint(0, 2)):
        inner = named(pick(("div", "div", "main", "section")), wrap(), inner + after, True)
        after = ""
    inner += after
    before = ""
    if rng.random() < 0.5:
        name = pick(HEADERS)
        before += named("header" if not name else pick(("header", "div")), name, f"<h2>{words(1, 3, False)}</h2>" + pick((links(1, 4), lines(1, 1))))
    if rng.random() < 0.8:
        before += menu()
    if rng.random() < 0.3:
        before += named(pick(("div", "section")), odd(NOTICES), lines(1, 2) + pick(("", "<button>Go</button>")))
    if rng.random() < 0.3:
        before += advert()
    if rng.random() < 0.2:
        before += sidebar()
    end = ""
    if rng.random() < 0.8:
        name = pick(FOOTERS)
        end = named("footer" if not name else pick(("footer", "div")), name, pick((f"&copy; {words(2, 12)}", lines(1, 2) + links(2, 4))))
    body = pick(BODIES)
    return f'<html><body{f" class={chr(34)}{body}{chr(34)}" if body else ""}>{before}{inner}{end}</body></html>'


def training(n: int = 400) -> tuple[str, ...]:
    """The pages that the model is counted on, half of the drawn ones hard; held-out ones have seeds of n and more."""
    return (*WRITTEN, *(drawn(k, hard) for k in range(n) for hard in (False, True)))
