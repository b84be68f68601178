"""Main text of pages whose article is known."""

from __future__ import annotations

import random

from measurekit.llm.html_text import extract_main_text, main_text
from measurekit.llm.shared import tune

STORY = ["Title &amp; more", "First   paragraph of a story, with\n enough text to be <b>main</b> text indeed, and then some more.", "Second paragraph of a story, again with plenty of text<br>in it, up to the last line.", "Short.",
         "Third paragraph &mdash; and the last one of all &#8230; it ends here, after some more words."]
TEXT = ["Title & more", "First paragraph of a story, with enough text to be main text indeed, and then some more.", "Second paragraph of a story, again with plenty of text in it, up to the last line.", "Short.",
        "Third paragraph — and the last one of all … it ends here, after some more words."]
BODY = f"<h1>{STORY[0]}</h1>" + "".join(f"<p>{p}</p>" for p in STORY[1:])
AROUND = ('<header><h2>Site</h2><p>A tagline that explains the site to all its many readers in a good number of words.</p></header><nav><ul><li><a href="/x">Home</a></li></ul></nav>'
          '<div id="cookie-notice"><p>We use cookies. Accept all of them now, please, or else leave this page again.</p></div>',
          '<aside><p>Sidebar text that is as long as the paragraphs of the story, but it is no part of it.</p></aside><form><p>Your name</p><input type=text></form>'
          '<section id="comments"><p>Great post, I liked it very much and will come again tomorrow for more of it.</p></section><footer>&copy; us</footer>')


def page(body: str) -> str:
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>x";</script></head><body class="sidebar-left">{AROUND[0]}{body}{AROUND[1]}</body></html>'


def test_marked_article():
    assert main_text(page(f"<article>{BODY}</article>")) == "\n\n".join(TEXT)
    assert main_text(page(f'<main><div class="entry-header"><h1>{STORY[0]}</h1></div>{BODY[BODY.index("<p>"):]}</main>')) == "\n\n".join(TEXT)


def test_unmarked_article_by_its_surge():
    assert main_text(page(f'<div class="text">{BODY}</div>')) == "\n\n".join(TEXT)
    links = "".join(f'<p><a href="/{k}">A link to another page of this site, number {k}</a></p>' for k in range(8))
    assert main_text(f"<body>{links}<div>{BODY}</div>{links}</body>") == "\n\n".join(TEXT)


def test_adverts_and_comments_inside_the_article():
    body = BODY.replace("<p>Short.", '<div class="ad">Buy now and pay later, it is all yours for ever.</div><p>Short.') + '<div class="comments"><p>First!</p></div>'
    assert main_text(page(f"<article>{body}</article>")) == "\n\n".join(TEXT)


def test_comments_that_are_articles_are_no_article():
    comments = "".join(f'<article class="comment"><p>Comment number {k} of a reader who liked the story very much and says so at length.</p></article>' for k in range(5))
    assert main_text(page(f"<article>{BODY}</article>{comments}")) == "\n\n".join(TEXT)
    assert main_text(page(f'<div class="text">{BODY}</div>{comments}')) == "\n\n".join(TEXT)


def test_names_that_only_hold_a_word_of_an_aside():
    for name in ("site has-sidebar", "content no-sidebar", "page-with-header", "layout-sidebar-right", "sidebar-left", "sidebar", "content--sidebar"):
        for by in ("class", "id"):
            for tag in ("article", "main"):
                assert main_text(page(f'<div {by}="{name}"><div><{tag}>{BODY}</{tag}></div></div>')) == "\n\n".join(TEXT)
    for name in ("site has-sidebar", "content no-sidebar", "page-with-header", "layout-sidebar-right"):
        assert main_text(page(f'<div class="{name}">{BODY}</div>')) == "\n\n".join(TEXT)
    assert main_text(page(f'<form id="aspnetForm"><main>{BODY}</main></form>')) == "\n\n".join(TEXT)
    for slug in ("related-work", "social-impact", "share-prices", "header-1", "comments", "notice"):
        body = BODY.replace("<h1>", f'<h1 id="{slug}">').replace("<p>Short.", f'<section id="{slug}"><p>Short.') + "</section>"
        assert main_text(page(f"<article>{body}</article>")) == "\n\n".join(TEXT)


def test_names_of_asides():
    text = "<p>Text that is as long as the paragraphs of the story, but it is no part of it at all.</p>"
    for name in ("ad", "ad-slot ad-300x250", "site-footer", "cookie-notice", "comments-area", "related-posts", "newsletter_signup", "sidebar sidebar-left", "widget-3", "x share-buttons", "ad--large", "main-nav"):
        for by in ("class", "id"):
            aside = f'<div {by}="{name}">{text}</div>'
            assert main_text(page(f"<article>{BODY}{aside}</article>{aside}")) == "\n\n".join(TEXT)
            assert main_text(page(f'<div class="text">{BODY}</div>{aside}')) == "\n\n".join(TEXT)
    teasers = f'<div class="related-posts"><article>{text}</article><article>{text}</article></div>'
    assert main_text(page(f"<article>{BODY}</article>{teasers}")) == main_text(page(f'<div class="text">{BODY}</div>{teasers}')) == "\n\n".join(TEXT)


def test_broken_markup():
    assert main_text("<p>a<p>b<li>c") == "a\n\nb\n\nc"
    assert main_text("x < y and <b>z") == "x < y and z"
    assert main_text('<div><!-- <p>no</p> --><script>if(a<b)"</p>"</script>yes</di') == "yes"
    assert main_text("<article><p>open &am") == "open &am"
    assert main_text('<p title="a > b\'">quoted</p><p title="never closed>lost') .startswith("quoted")
    assert main_text("<script>all script") == "" and main_text("<!-- all comment") == ""


def test_long_pages_are_whole():
    many = "".join(f"<p>Paragraph number {k} of a very long page.</p>" for k in range(20_000))
    assert main_text(f"<article>{many}</article>").count("\n\n") == 19_999
    assert len(main_text("<p>" + "word " * 300_000)) == 5 * 300_000 - 1
    assert main_text("<div " * 50_000) == "" and main_text("<b>" * 50_000 + "x") == "x"


def test_rows(spark):
    pages = tune(spark).createDataFrame([(1, "u", page(f"<article>{BODY}</article>"), "mine"), (2, None, None, None), (2, None, "", None), (1, "u", page(f"<article>{BODY}</article>"), "mine")], "page_id long, url string, html string, text string")
    out = extract_main_text(pages)
    assert out.columns == [*pages.columns, "text_", "n_chars"]
    rows = out.collect()
    assert sorted((r.page_id, r["text_"], r.n_chars, r.text) for r in rows if r.page_id == 1) == [(1, "\n\n".join(TEXT), len("\n\n".join(TEXT)), "mine")] * 2
    assert [(r["text_"], r.n_chars) for r in rows if r.page_id == 2] == [("", 0)] * 2
    assert extract_main_text(pages.limit(0)).count() == 0


def test_anchors_and_links_that_are_never_closed():
    for start in ('<a name="top">', '<a id="x"/>', '<a name="top"></a>', '<p><a href="/home">Home</p>', '<div><a href="/">Up</div>'):
        for body in (f'<div class="text">{BODY}</div>', f"<article>{BODY}</article>"):
            assert main_text(f"<body>{start}{body}</body>").endswith("\n\n".join(TEXT))
    linked = "".join(f'<li><a href="/{k}"><div>A linked card with a title of some length, number {k}</div></a></li>' for k in range(6))
    assert main_text(f"<body><ul>{linked}</ul><div>{BODY}</div></body>") == "\n\n".join(TEXT)


def test_feedback_is_no_main_text():
    said = "<p>" + "A reader says what they think of it all, and at some length. " * 5 + "</p>"
    assert main_text(f'<body><div class="text">{BODY}</div><div class="user-feedback">{said}</div></body>') == "\n\n".join(TEXT)


def test_pages_built_from_known_articles():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(1, 10)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    for _ in range(250):
        paragraphs = [sentence(r.randrange(15, 60)) for _ in range(r.randrange(2, 9))]
        shown = []
        for p in paragraphs:
            words = p.split(" ")
            at = r.randrange(len(words))
            words[at] = r.choice(["<b>{}</b>", "<em class='x'>{}</em>", '<a href="/y">{}</a>', '<a name="z">{}</a>', "{}<!-- no -->", "{}"]).format(words[at])
            shown.append(r.choice(["<p>{}</p>", "<p>\n{}\n</p>", "<div><p>{}</p></div>", "<blockquote>{}</blockquote>", "<p>{}"]).format(r.choice([" ", "\n", "  "]).join(words)))
        menu = "<nav><ul>" + "".join(f'<li><a href="/{k}">{word()}</a></li>' for k in range(r.randrange(1, 8))) + "</ul></nav>"
        links = "<ul>" + "".join(f'<li><a href="/{k}">{sentence(4)}</a></li>' for k in range(r.randrange(1, 12))) + "</ul>"
        ends = [r.choice(["", menu]), r.choice(["", f'<div class="sidebar"><p>{sentence(40)}</p></div>', f'<div id="cookie-banner">{sentence(30)}</div>']), r.choice(["", links])]
        after = [r.choice(["", links]), r.choice(["", f'<section class="comments"><p>{sentence(50)}</p></section>']), r.choice(["", f"<footer><p>{sentence(20)}</p></footer>"])]
        for wrap in ("<article>{}</article>", '<div class="text">{}</div>', '<main id="main"><div class="content">{}</div></main>'):
            body = "".join(ends) + wrap.format("".join(shown)) + "".join(after)
            assert main_text(f"<html><head><title>{word()}</title></head><body>{body}</body></html>") == "\n\n".join(paragraphs)
