"""Labelled training pages, laid out by rule.

A page is drawn from a small grammar of site layouts; every element whose text belongs to the article is
marked ``data-main``.  Words are drawn at random, so the model can only learn from structure.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba co di fe gu la mo ne pi ro sa tu ve wi xo za".split()


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))


def _sentences(r: random.Random, low: int, high: int) -> str:
    return " ".join(_words(r, 4, 18).capitalize() + "." for _ in range(r.randint(low, high)))


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{k}">{_words(r, 1, 3)}</a></li>' for k in range(n))


def _inline(r: random.Random, text: str) -> str:
    """Some words of a content paragraph in links and emphasis, which belong to the article."""
    words = text.split(" ")
    for _ in range(r.randint(0, 2)):
        k = r.randrange(len(words))
        tag = r.choice(['a href="/x"', "b", "em", "i", "strong", "code", "span"])
        words[k] = f"<{tag} data-main>{words[k]}</{tag.split()[0]}>"
    return " ".join(words)


def _body_part(r: random.Random) -> str:
    kind = r.random()
    if kind < 0.07:
        tag = r.choice(["div", "section"])
        inner = "".join(f"<p data-main>{_sentences(r, 1, 4)}</p>" for _ in range(r.randint(1, 3)))
        head = f"<h3 data-main>{_words(r, 1, 5)}</h3>" if r.random() < 0.6 else ""
        return f"<{tag}>{head}{inner}</{tag}>"
    if kind < 0.62:
        text = _inline(r, _sentences(r, 1, 7)) if r.random() < 0.75 else _words(r, 1, 3) + "." * r.randint(0, 1)
        return f"<p data-main>{text}</p>" if r.random() < 0.8 else f"<p data-main><b data-main>{text}<br>"
    if kind < 0.74:
        h = r.choice(["h2", "h3", "h4"])
        return f"<{h} data-main>{_words(r, 1, 7)}</{h}>"
    if kind < 0.84:
        lst = r.choice(["ul", "ol"])
        return f"<{lst}>" + "".join(f"<li data-main>{_sentences(r, 1, 2)}</li>" for _ in range(r.randint(2, 6))) + f"</{lst}>"
    if kind < 0.90:
        return f"<blockquote data-main><p data-main>{_sentences(r, 1, 3)}</p></blockquote>"
    if kind < 0.94:
        cells = "".join("<tr>" + "".join(f"<td data-main>{_words(r, 1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4)))
        return f"<table>{cells}</table>"
    if kind < 0.97:
        return f'<figure><img src="i"><figcaption data-main>{_words(r, 3, 12)}</figcaption></figure>'
    return f"<pre data-main>{_words(r, 5, 20)}</pre>"


def _noise(r: random.Random) -> str:
    n = r.randint(2, 8)
    kinds = [
        lambda: f'<div class="{r.choice(["notice", "alert", "cookie", "newsletter", "subscribe", "promo", "sponsor", "related", "share", "popup", "widget", "signup"])}">{_words(r, 2, 14)}</div>',
        lambda: f'<div class="{r.choice(["sidebar", "side", "about-author", "widget"])}"><h3>{_words(r, 1, 3)}</h3><p>{_sentences(r, 1, 5)}</p></div>',
        lambda: f'<div class="{r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"])}">{_sentences(r, 1, 2)}</div>',
        lambda: f'<aside class="{r.choice(["sidebar", "widget", "side", "col-right", ""])}"><h3>{_words(r, 1, 3)}</h3><ul>{_links(r, n)}</ul></aside>',
        lambda: f"<aside><p>{_sentences(r, 1, 3)}</p></aside>",
        lambda: f'<div class="{r.choice(["sidebar", "side-bar", "related", "recommended", "more-stories", "widget"])}"><h4>{_words(r, 1, 4)}</h4><ul>{_links(r, n)}</ul></div>',
        lambda: f'<div class="{r.choice(["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal"])}"><p>{_sentences(r, 1, 3)}</p><button>{_words(r, 1, 2)}</button></div>',
        lambda: f'<form class="{r.choice(["search", "newsletter", "subscribe", "login", ""])}"><label>{_words(r, 1, 4)}</label><input name="q"><select><option>{_words(r, 1, 2)}</option><option>{_words(r, 1, 2)}</option></select><button>{_words(r, 1, 2)}</button></form>',
        lambda: f'<div class="{r.choice(["share", "social", "share-buttons", "tags", "breadcrumb", "breadcrumbs", "pagination", "toolbar"])}">' + " ".join(f'<a href="/{k}">{_words(r, 1, 2)}</a>' for k in range(n)) + "</div>",
    ]
    return r.choice(kinds)()


def _comments(r: random.Random) -> str:
    one = r.choice(["div", "li", "div", "li", "div", "article"])
    name = r.choice(["comment", "reply", "comment-body", ""])
    items = "".join(f'<{one} class="{name}"><p>{_words(r, 1, 2)}</p><p>{_sentences(r, 1, 4)}</p></{one}>' for _ in range(r.randint(1, 5)))
    box = r.choice(['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'section id="discussion"', 'div class="responses"'])
    h = r.choice(["h2", "h3", "h4"])
    return f"<{box}><{h}>{_words(r, 1, 3)}</{h}>{items}</{box.split()[0]}>"


def labelled_page(seed: int) -> str:
    r = random.Random(seed)
    nav = f'<ul>{_links(r, r.randint(3, 9))}</ul>'
    menu = r.choice([f"<nav>{nav}</nav>", f'<div class="{r.choice(["menu", "nav", "navbar", "navigation"])}">{nav}</div>',
                     "<nav>" + " ".join(f'<a href="/{k}">{_words(r, 1, 2)}</a>' for k in range(5)) + "</nav>", f'<div id="menu">{nav}</div>', f"<nav><p>{_words(r, 2, 8)}</p></nav>"])
    top = r.choice(["", "", f"<header><a href='/'>{_words(r, 1, 3)}</a>{menu}</header>", f'<div id="header" class="masthead"><h1>{_words(r, 1, 3)}</h1><p>{_sentences(r, 1, 2)}</p></div>',
                    f"<header><h1>{_words(r, 1, 4)}</h1><p>{_words(r, 3, 9)}</p></header>", f"<header><p>{_sentences(r, 1, 3)}</p></header>"])
    foot_text = f"&copy; {_words(r, 1, 3)} &middot; {_sentences(r, 1, 3)}"
    foot = r.choice([f"<footer>{foot_text}</footer>", f"<footer><p>{foot_text}</p><ul>{_links(r, 4)}</ul></footer>",
                     f'<div class="footer" id="footer"><p>{foot_text}</p></div>', ""])
    title = f"<h1 data-main>{_words(r, 2, 9)}</h1>" if r.random() < 0.85 else ""
    if title and r.random() < 0.25:
        byline = f'<p class="{r.choice(["byline", "meta", "author", "date", "posted"])}">{_words(r, 1, 5)}</p>' if r.random() < 0.7 else ""
        title = f"<header>{title}{byline}</header>"
    plain = r.random() < 0.12                       # paragraphs are divs
    parts = [title] + [f"<div data-main>{_sentences(r, 1, 5)}</div>" if plain else _body_part(r) for _ in range(r.choice([0, 1, 1, 2, 3, 4, 5, 7, 9, 14]))]
    if not title and len(parts) == 1:
        parts.append(f"<p data-main>{_sentences(r, 1, 3)}</p>")
    inside = [_noise(r)] if r.random() < 0.35 else []
    for x in inside:
        parts.insert(r.randint(1, len(parts)), x)
    if r.random() < 0.2:
        parts.append(_comments(r))
    wrap = r.choice([("<article>", "</article>")] * 4 + [("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="content">', "</div>"),
                    ('<div id="content"><div class="post">', "</div></div>"), ('<div class="article-body">', "</div>"), ('<div class="entry-content">', "</div>"),
                    ('<section class="story">', "</section>"), ('<div id="main" role="main">', "</div>"), ('<article class="post"><div class="text">', "</div></article>")])
    article = wrap[0] + "".join(parts) + wrap[1]
    if r.random() < 0.2:                            # comments beside the article in one container
        article = f"<main>{article}{_comments(r)}</main>" if not wrap[0].startswith("<main") else article
    around = [_noise(r) for _ in range(r.randint(0, 3))]
    k = r.randint(0, len(around))
    rest = [*around[:k], article, *([_comments(r)] if r.random() < 0.25 else []), *around[k:]]
    inner = "".join(rest)
    if r.random() < 0.25:
        inner = f'<div class="{r.choice(["wrapper", "container", "page", "layout"])}">{inner}</div>'
    head = f"<head><title>{_words(r, 2, 8)}</title><style>p{{margin:0}}</style><script>var a=1;</script></head>"
    return f'<!DOCTYPE html><html lang="xx">{head}<body>{"" if "nav" in top else menu}{top}{inner}{foot}</body></html>'
