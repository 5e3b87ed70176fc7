"""A small HTML reader: the leaf blocks of a page with their ancestors, and labelled sample pages."""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")
#: Elements whose text is never shown, those that end a block, and those without content.
RAW = frozenset(("script", "style", "template", "iframe", "title", "textarea"))
BLOCK = frozenset(
    ("html", "head", "body", "article", "aside", "section", "nav", "header", "footer", "main", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table",
     "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "form", "fieldset", "legend", "label", "button", "select", "option", "blockquote", "pre", "figure", "figcaption", "address",
     "details", "summary", "hr", "dialog", "menu", "center", "noscript", "input", "meta", "link", "base")
)
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Elements that a start tag of the same group closes, up to the boundary elements.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
BOUNDARY = frozenset(("ul", "ol", "dl", "table", "select", "article", "section", "div", "body", "html", "blockquote", "td", "th", "form", "aside", "nav", "main", "header", "footer"))
ENDS_P = BLOCK - frozenset(("html", "head", "body", "label", "button", "select", "option", "input", "meta", "link", "base"))


@dataclass(slots=True)
class Block:
    text: str
    #: (element, name tokens) from the outermost ancestor to the block's own element.
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int
    label: str


def tokens(attributes: str) -> tuple[tuple[str, ...], str]:
    names, label = [], ""
    for m in ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "data-label":
            label = value
        else:
            names += TOKEN.findall(value)
    return tuple(dict.fromkeys(names)), label


def blocks(page: str) -> list[Block]:
    """The page's non-empty leaf blocks in order; white space runs are one blank."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    labels: list[str] = []  # of each element of the stack; one with a label is a mark of a sample page and no ancestor
    out: list[Block] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(e for e, mark in zip(stack, labels, strict=True) if not mark), min(linked, len(text)), next((x for x in reversed(labels) if x), "")))
            parts.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    def pop(k: int) -> None:
        del stack[k:], labels[k:]

    at = 0
    while (m := TAG.search(page, at)) is not None:
        take(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        pop(k)
                        break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "a":
            links += 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            flush()
            links = 0
            shut = CLOSES.get(name, ("p",) if name in ENDS_P else ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    pop(k)
                elif stack[k][0] in BOUNDARY:
                    break
            if name not in VOID:
                names, label = tokens(m[3] or "") if m[3] else ((), "")
                stack.append((name, names))
                labels.append(label)
    take(page[at:])
    flush()
    return out


def sample_page(rng: random.Random) -> str:
    """An invented page whose content elements carry ``data-label=1``; layouts and names vary."""
    pick = rng.choice

    def words(low: int, high: int) -> str:
        style = rng.random()
        made = ["".join(pick("aeioubcdlmnrstéäñ") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
        if style < 0.08:
            made = [w + pick(("###", "%%%", "$$$", "&amp;&amp;")) for w in made]
        elif style < 0.14:
            made = [w + pick((" |", ",", "!!")) for w in made]
        elif style < 0.18:
            made = [w.upper() for w in made]
        text = " ".join(made)
        return text[:1].upper() + text[1:] + pick((".", ".", ".", "", "?", "!"))

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/{rng.randint(0, 999)}">{words(low, high)}</a>'

    def named(element: str, *names: str) -> str:
        attribute = pick(("class", "class", "id"))
        return f'<{element} {attribute}="{pick(names)}">' if names else f"<{element}>"

    def wrap(element: str, inner: str, *names: str) -> str:
        return f"{named(element, *names) if rng.random() < 0.7 or element == 'div' else f'<{element}>'}{inner}</{element}>"

    def menu() -> str:
        inner = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9)))
        return pick((lambda: wrap("nav", f"<ul>{inner}</ul>", "nav", "navbar", "menu"), lambda: wrap("div", f"<ul>{inner}</ul>", "menu", "nav", "navigation", "main-menu", "breadcrumb", "topbar"), lambda: f'<ul class="menu">{inner}</ul>', lambda: wrap("div", " ".join(link() for _ in range(4)), "nav", "menu", "links")))()

    def header() -> str:
        return pick((lambda: wrap("header", f"<div>{words(1, 4)}</div>" + menu(), "header", "masthead", "site-header"), lambda: wrap("div", f"<p>{words(1, 6)}</p>", "header", "masthead", "banner", "logo"), lambda: f"<header><h1>{words(1, 3)}</h1><p>{words(3, 9)}</p></header>"))()

    def advert() -> str:
        return pick((lambda: wrap("div", words(3, 18), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot"), lambda: wrap("aside", f"<p>{words(4, 15)}</p>", "ad", "sponsored", "promo"), lambda: wrap("div", f"<p>{words(3, 15)} {link()}</p>", "ad", "advert", "banner-ad", "promotion")))()

    def notice() -> str:
        if rng.random() < 0.12:
            return f"<noscript>{words(4, 20)}</noscript>"
        return wrap("div", f"<p>{words(6, 30)}</p>" + pick(("", f"<button>{words(1, 2)}</button>", link(1, 2))), "cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "disclaimer", "subscribe-notice", "banner", "modal", "message")

    def form() -> str:
        fields = "".join(f"<label>{words(1, 4)}</label><input type=text>" for _ in range(rng.randint(1, 3)))
        start, end = pick((("<form>", "</form>"), ('<form class="search">', "</form>"), ('<form id="newsletter">', "</form>"), ('<div class="newsletter"><form>', "</form></div>")))
        return start + (f"<p>{words(4, 14)}</p>" if rng.random() < 0.5 else "") + fields + f"<select><option>{words(1, 1)}<option>{words(1, 2)}</select><button>{words(1, 2)}</button>{end}"

    def sidebar() -> str:
        inner = f"<h3>{words(1, 4)}</h3>" + pick((lambda: "<ul>" + "".join(f"<li>{link(2, 7)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", lambda: f"<p>{words(5, 40)}</p>", lambda: f"<div>{words(4, 20)}</div>"))()
        return pick((lambda: wrap("aside", inner, "sidebar", "related", "widget"), lambda: wrap("div", inner, "sidebar", "related", "widget", "recent-posts", "trending", "side", "rail", "recommended"), lambda: wrap("section", inner, "related", "sidebar", "more")))()

    def comments() -> str:
        one = lambda: pick((lambda: wrap("div", f"<p>{words(3, 60)}</p>", "comment", "comment-body", "reply"), lambda: f'<li class="comment"><b>{words(1, 2)}</b><p>{words(4, 50)}</p></li>', lambda: f"<p>{words(4, 50)}</p>", lambda: f"<article class=comment><p>{words(4, 50)}</p></article>"))()
        inner = (f"<h2>{words(1, 3)}</h2>" if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 6))) + (form() if rng.random() < 0.3 else "")
        return pick((lambda: named("section", "comments", "discussion", "responses") + inner + "</section>", lambda: wrap("div", inner, "comments", "comment-list", "commentlist", "disqus", "reader-comments", "discussion"), lambda: f'<ol class="commentlist">{inner}</ol>'))()

    def share() -> str:
        return wrap("div", " ".join(link(1, 2) for _ in range(3)), "share", "social", "tags", "byline-links", "pagination", "pager")

    def footer() -> str:
        inner = pick((f"&copy; {words(1, 3)} &middot; {words(3, 12)}", f"<p>&copy; 2020 {words(2, 8)}</p>", f"<p>{words(4, 20)}</p>" + menu(), " | ".join(link() for _ in range(4))))
        return pick((lambda: f"<footer>{inner}</footer>", lambda: wrap("footer", inner, "footer", "site-footer"), lambda: wrap("div", inner, "footer", "copyright", "legal", "colophon", "bottom")))()

    def body_part() -> str:
        kind = rng.random()
        if kind < 0.72:
            text = words(1, 5) if rng.random() < 0.15 else words(8, 110)
            if rng.random() < 0.15:
                text += " " + link(1, 5) + " " + words(2, 20)
            if rng.random() < 0.1:
                return f"<p><b>{text}<br><p>{words(1, 60)}</p>"
            return f"<p>{text}" + pick(("</p>", "</p>", "</p>", ""))
        if kind < 0.8:
            return f"<h{(h := pick((2, 2, 3)))}>{words(1, 9)}</h{h}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{words(5, 40)}</p></blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{words(1, 4)}<td>{words(1, 8)}</tr>" for _ in range(3)) + "</table>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{words(2, 15)}</figcaption></figure>"
        return f"<div>{words(10, 70)}</div>" if rng.random() < 0.6 else f"<pre>{words(4, 20)}</pre>"

    inner = (f"<h1>{words(1, 14)}</h1>" if rng.random() < 0.85 else "") + "".join(
        body_part() + (f'<div data-label="0">{x()}</div>' if (x := pick((advert, sidebar, share, form, notice))) and rng.random() < 0.18 else "") for _ in range(1 if rng.random() < 0.1 else rng.randint(1, 14))
    )
    if rng.random() < 0.12:
        inner += f'<div data-label="0">{comments()}</div>'
    open_, close = pick((("<article>", "</article>"), ("<article>", "</article>"), ('<article class="post">', "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ('<div class="article-body">', "</div>"), ('<div class="post"><div class="entry-content">', "</div></div>"), ("<section>", "</section>"), ("<div>", "</div>"), ("", ""), ("", ""), ("", "")))
    article = f'<div data-label="1">{open_}{inner}{close}</div>'
    before = [f() for f in (header, menu, advert, notice, form, share) if rng.random() < 0.4]
    after = [f() for f in (sidebar, comments, advert, share, form, notice, menu) if rng.random() < 0.35] + ([footer()] if rng.random() < 0.85 else [])
    if rng.random() < 0.08:  # a bare page
        before, after = [], []
    rng.shuffle(before)
    if rng.random() < 0.3:
        before.append(sidebar())
    # the reader leaves the marks out of every block's ancestors, so that they are no clue
    return f"<html><head><title>{words(2, 8)}</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"
