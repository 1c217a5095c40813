"""Labelled pages for training: random layouts in which every text block is known to be content or not.

The words are random, so that a model can learn from structure only. Content carries the attribute ``data-y="1"``, anything
set inside content that isn't part of it ``data-y="0"``; parsers hand the attribute to the trainer and never to features.
"""

from __future__ import annotations

import random

# Names that page authors give to parts of a page.
CONTENT_NAMES = ("content", "post", "entry", "article-body", "story", "post-content", "text", "page", "main-content", "entry-content")
BOILERPLATE_NAMES = {
    "nav": ("nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "pagination"),
    "header": ("header", "masthead", "site-header", "top-bar", "branding"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal"),
    "aside": ("sidebar", "aside", "widget", "related", "recommended", "side"),
    "notice": ("notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "popup"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner"),
    "form": ("newsletter", "subscribe", "search", "login", "signup", "contact-form"),
    "comments": ("comments", "comment-list", "respond", "discussion", "replies"),
    "share": ("share", "social", "toolbar"),
}


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = "plain"

    def word(self) -> str:
        return "".join(self.r.choice(("ka", "lo", "mi", "ren", "ta", "su", "vel", "or", "in", "da")) for _ in range(self.r.randint(1, 3)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, low: int = 1, high: int = 6) -> str:
        if self.style == "odd":  # text that doesn't read like prose: fragments, symbols, capitals, one word again and again
            text = self.words(1, 40) if self.r.random() < 0.5 else " ".join([self.word()] * self.r.randint(1, 40))
            return self.r.choice((text, text.upper() + "!!", text.replace(" ", "### "), text.replace(" ", ", ") + ",", text.replace(" ", " | ")))
        return " ".join(f"{self.words(3, 18).capitalize()}." for _ in range(self.r.randint(low, high)))

    def links(self) -> str:
        items = "".join(f'<li><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(2, 9)))
        return f"<ul>{items}</ul>"

    def plain_links(self) -> str:
        return '<div data-y="0">' + " ".join(f'<a href="/w">{self.words(1, 3)}</a>' for _ in range(self.r.randint(2, 12))) + "</div>"

    def named(self, kind: str, body: str) -> str:
        r = self.r
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6 else r.choice(("div", "div", "section"))
        name = r.choice(BOILERPLATE_NAMES[kind])
        attribute = "" if tag == kind and r.random() < 0.6 else f' {r.choice(("class", "id"))}="{name}"'
        return f'<{tag}{attribute} data-y="0">{body}</{tag}>'

    def boilerplate(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            body = self.links()
        elif kind == "comments":
            body = f"<h3>{self.words(1, 2)}</h3>" + "".join(f"<div class='comment'><p>{self.word()}</p><p>{self.prose(1, 3)}</p></div>" if r.random() < 0.5 else f"<p>{self.prose(1, 4)}</p>" for _ in range(r.randint(1, 6)))
        elif kind == "form":
            body = f"<label>{self.words(1, 3)}</label><input name=q><p>{self.words(2, 8)}</p><button>{self.word()}</button>"
        elif kind == "footer":
            body = r.choice((f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 3)}", f"<p>&copy; {self.words(2, 6)}</p>{self.links()}", f"<p>{self.prose(1, 2)}</p>"))
        elif kind == "header":
            body = r.choice((f"<a href='/'>{self.word()}</a><p>{self.words(2, 6)}</p>", f"<h2>{self.words(1, 3)}</h2>", f"<p>{self.prose(1, 1)}</p>{self.links()}"))
        elif kind == "aside":
            body = r.choice((f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<h3>{self.words(1, 3)}</h3><p>{self.prose(1, 2)}</p>", f"<p>{self.prose(1, 4)}</p>"))
        elif kind == "share":
            body = "".join(f"<a href='#'>{self.word()}</a> " for _ in range(r.randint(2, 5)))
        else:
            body = r.choice((self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>", f"<p>{self.words(2, 9)}</p><a href='#'>{self.word()}</a>"))
        return self.named(kind, body)

    def block(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.62:
            text = self.prose(1, 6) if r.random() < 0.8 else self.words(1, 4)
            start = r.choice(("<p>", "<p>", "<p>", "<p><b>", "<p class='lead'>"))
            return f"{start}{text}{r.choice(('</p>', '</p>', '</p>', '<br>', ''))}"
        if x < 0.7:
            return f"<h{(n := r.randint(2, 4))}>{self.words(1, 7)}</h{n}>"
        if x < 0.77:
            return f"<p>{self.prose(0, 2)} <a href='/y'>{self.words(1, 4)}</a> {self.prose(1, 2)}</p>"
        if x < 0.84:
            return "<ul>" + "".join(f"<li>{self.prose(1, 1) if r.random() < 0.7 else self.words(1, 5)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if x < 0.88:
            return f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>"
        if x < 0.92:
            return f"<pre>{self.words(3, 15)}</pre>"
        if x < 0.94:
            return f"<p>{self.words(2, 6)}</p>{self.links()}" if r.random() < 0.5 else self.links()
        if x < 0.95:
            tag, name = r.choice((("section", "references"), ("div", "footnotes"), ("section", "sources"), ("div", "notes"), ("section", "")))
            items = "".join(f"<li><a href='/z'>{self.words(2, 8)}</a>{r.choice(('', ' ' + self.words(1, 6) + '.'))}</li>" for _ in range(r.randint(1, 9)))
            return f"<{tag}{f' class={chr(34)}{name}{chr(34)}' if name else ''}><h2>{self.words(1, 2)}</h2><ol>{items}</ol></{tag}>"
        if x < 0.97:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<figure><img src=a.png><figcaption>{self.words(2, 9)}</figcaption></figure>"

    def page(self) -> str:
        r, kinds = self.r, tuple(BOILERPLATE_NAMES)
        self.style = r.choice(("plain", "odd"))
        blocks = [f"<h1>{self.words(1, 8)}</h1>"] * (r.random() < 0.85) + [self.block() for _ in range(r.choice((1, 2, 4, 8, 14, 40)))]
        for _ in range(r.choice((0, 0, 1, 2))):
            blocks.insert(r.randint(0, len(blocks)), self.boilerplate(r.choice(("ad", "share", "form", "aside", "notice", "comments"))))
        self.style = r.choice(("plain", "odd"))
        before = [self.boilerplate(k) for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.5]
        after = [self.boilerplate(k) for k in ("comments", "aside", "share", "ad", "nav", "footer") if r.random() < 0.4]
        before += [self.plain_links()] * (r.random() < 0.15)
        after += [self.plain_links()] * (r.random() < 0.15)
        r.shuffle(before)
        x, head = r.random(), f"<head><title>{self.words(1, 6)}</title></head>"
        if x < 0.03:
            return f'<html data-y="1">{self.prose(1, 6)}</html>'
        if x < 0.15:  # content right in the body
            return f'<!DOCTYPE html><html>{head if x < 0.1 else ""}<body data-y="1">{"".join(before)}{"".join(blocks)}{"".join(after)}</body></html>'
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        named = r.random() < (0.6 if tag in ("div", "section") else 0.2)
        attribute = f' {r.choice(("class", "id"))}="{r.choice(CONTENT_NAMES)}"' if named else ""
        main = f'<{tag}{attribute} data-y="1">{"".join(blocks)}</{tag}>'
        if r.random() < 0.3:
            main = f"<div class='{r.choice(('wrapper', 'container', 'row', 'layout'))}'>{main}{self.boilerplate(r.choice(kinds)) if r.random() < 0.6 else ''}</div>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{main}{''.join(after)}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    made = Pages(seed)
    return [made.page() for _ in range(n)]
