"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of words and tags. A word's score is learned from labelled pages (html, main text): a logistic
regression on the open elements around it (their names, and the words of their class, id and role) gives main text
positive and the rest negative scores, between BEST and WORST; a tag's penalty grows with the share of its kind that lies
outside main texts though the words around it score above 0, and is WORST elsewhere. One linear scan finds the contiguous region of greatest score. Its text comes out block by block;
blocks of negative score inside it, such as an advert between two paragraphs, are left out.

Map-only; nothing but a page is held at a time. Defined results: a null, empty or text-less page gives an empty text;
broken or unclosed markup is read as far as it goes; where no word scores above 0 (an element of the margin that never
ends), all words count alike; of regions with equal scores the first is taken; repeated rows, null ids and very long
pages are read like any other; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html as refs
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|iframe|svg|math|object|canvas|textarea|select)\b[^>]*>.*?</\2\s*>"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*.?true|display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SPACED = frozenset(["br"])
#: Controls end where one of these begins.
CONTROLS = frozenset("select option optgroup textarea button label".split())
BLOCKS = frozenset("address article aside blockquote div dl figure footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
BEST, WORST = 1.0, -0.25


def element_words(name: str, attributes: str) -> list[str]:
    """The element's features: its name (but for inline ones that aren't links, and what a page always has), and the words of its class, id and role."""
    out = [f"<{name}"] if name == "a" or name not in INLINE and name not in ("html", "body") else []
    if attributes:
        for m in NAMED.finditer(attributes):
            out += [w.lower() for w in PART.findall(m[1] or m[2] or m[3] or "")]
        if HIDDEN.search(attributes):
            out.append("<hidden")
    return out


class Weights:
    """Scores by feature of the open elements, and penalties by tag name."""

    def __init__(self) -> None:
        self.tags: dict[str, float] = {}
        self.words: dict[str, float] = {}
        self.other, self.bias = -0.5, BEST

    def score(self, features: frozenset[str]) -> float:
        """Of a word."""
        return max(WORST, min(BEST, self.bias + sum(self.words.get(f, 0.0) for f in features)))

    def fit(self, pages: list[tuple[str, str]], rounds: int = 1200, rate: float = 0.1, decay: float = 1e-5, scale: float = 2.0) -> Weights:
        kinds: Counter[tuple[frozenset[str], bool]] = Counter()
        read = []
        for page, main in pages:
            tokens = walk(page)
            flags = [placed(" ".join(refs.unescape(t).split()), main) if t else None for t, _, _ in tokens]
            read.append((tokens, [i for i, f in enumerate(flags) if f]))
            for (text, features, _), good in zip(tokens, flags, strict=True):
                if good is not None:
                    kinds[features, good] += len(text.split())
        names = sorted({f for features, _ in kinds for f in features})
        at = {f: i for i, f in enumerate(names)}
        x = np.zeros((len(kinds), len(names) + 1))
        for i, (features, _) in enumerate(kinds):
            x[i, [at[f] for f in features]] = 1
        x[:, -1] = 1
        y = np.array([good for _, good in kinds], float)
        # Each kind of place counts by the root of its words, each side as much as the other.
        n = np.sqrt(np.array(list(kinds.values()), float))
        for side in (0, 1):
            n[y == side] /= max(n[y == side].sum(), 1e-9)
        w, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
        for step in range(1, rounds + 1):
            g = x.T @ (n * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.words, self.bias = {f: float(w[i]) for f, i in at.items()}, float(w[-1])
        # Tags among words that score as main text does.
        kept, seen = Counter(), Counter()
        for tokens, known in read:
            for i, (_, features, name) in enumerate(tokens):
                if name and known and self.score(features) > 0:
                    seen[name] += 1
                    kept[name] += known[0] - 1 <= i <= known[-1] + 1
        self.tags = {t: -(0.02 + scale * (1 - kept[t] / n) ** 2) for t, n in seen.items()}
        return self


def placed(text: str, main: str) -> bool | None:
    """Whether a text is of the main text; None where it is too short to tell."""
    if not text or (text in main and len(text.split()) < 4 and text not in main.split("\n\n")):
        return None
    return text in main


def walk(page: str) -> list[tuple[str | None, frozenset[str], str | None]]:
    """(text, features of the open elements, tag name) in page order."""
    stack: list[tuple[str, frozenset[str]]] = []
    out, at, none = [], 0, frozenset()

    def features() -> frozenset[str]:
        return stack[-1][1] if stack else none

    for m in TOKEN.finditer(page):
        if m.start() > at:
            out.append((page[at : m.start()], features(), None))
        at = m.end()
        close, name, attributes = (m[3], m[4], m[5]) if m[4] else (m[6], m[7], m[8])
        if not name:
            continue
        name = name.lower()
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            else:
                if name not in ("p", "br"):
                    continue
        elif name not in VOID:
            while stack and (name in BLOCKS and stack[-1][0] in CONTROLS or name == stack[-1][0] and name in ("p", "li", "tr", "td", "th", "dt", "dd", "option")):
                stack.pop()
            stack.append((name, features() | frozenset(element_words(name, attributes))))
        out.append((None, features(), name))
    if at < len(page):
        out.append((page[at:], features(), None))
    return out


def extract(page: str, weights: Weights) -> str:
    """The best region's text; where no word scores above 0, that of all words but the title's."""
    tokens = walk(page)
    known = {f: weights.score(f) for f in {f for _, f, _ in tokens}}
    return region(tokens, weights, known) or region([t for t in tokens if "<head" not in t[1] and "<title" not in t[1]], weights, {})


def region(tokens: list, weights: Weights, known: dict[frozenset[str], float]) -> str:
    best, here, start, span = 0.0, 0.0, 0, (0, 0)
    for i, (text, features, name) in enumerate(tokens):
        if text:
            here += len(text.split()) * known.get(features, BEST)
        else:
            here += weights.tags.get(name, weights.other) if known.get(features, BEST) > 0 else WORST
        if here <= 0:
            here, start = 0.0, i + 1
        elif here > best:
            best, span = here, (start, i + 1)
    blocks, block, total = [], [], 0.0
    for text, features, name in [*tokens[span[0] : span[1]], (None, frozenset(), "p")]:
        if text:
            block.append(text)
            total += len(text.split()) * known.get(features, BEST)
        elif name in SPACED:
            block.append(" ")
        elif name not in INLINE:
            if total > 0:
                blocks.append("".join(block))
            block, total = [], 0.0
    cleaned = (" ".join(refs.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in cleaned if b)


def example_pages(count: int = 240, seed: int = 3) -> list[tuple[str, str]]:
    """Labelled pages: layouts drawn at random from common page parts, around main texts of invented words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    prose = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + "."
    pick = rng.choice
    links = lambda n: "".join(f'<li><a href="/{word()}">{word().title()}</a></li>' for _ in range(n))

    def aside(kind: str) -> str:
        names = {
            "menu": ["menu", "nav", "navbar", "site-nav", "main-navigation", "breadcrumb", "breadcrumbs", "topbar", "pagination", "toc"],
            "head": ["header", "site-header", "masthead", "page-header", "branding", "logo"],
            "foot": ["footer", "site-footer", "colophon", "copyright", "legal", "bottom-links"],
            "side": ["sidebar", "widget", "aside", "related", "related-posts", "recommended", "trending", "popular", "tags", "author-bio"],
            "note": ["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "banner", "popup", "modal", "overlay", "disclaimer"],
            "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "adsense"],
            "form": ["form", "newsletter", "subscribe", "signup", "login", "search", "contact-form", "share", "social", "sharing"],
            "comments": ["comments", "comment", "comment-list", "replies", "respond", "discussion", "disqus", "responses", "reviews"],
        }[kind]
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind)
        named = rng.random() < 0.75 or not tag
        tag = tag if tag and rng.random() < 0.5 else pick(["div", "section"])
        if kind == "form" and rng.random() < 0.4:
            tag = "form"
        mark = f' {pick(["class", "id"])}="{pick(names)}{pick(["", "", " box", " inner", " container"])}"' if named or tag in ("div", "section") else ""
        body = {
            "menu": lambda: f"<ul>{links(rng.randint(3, 9))}</ul>",
            "head": lambda: f"<div><a href='/'>{prose(1, 3)}</a></div><p>{prose(3, 9)}</p>",
            "foot": lambda: f"<p>&copy; {prose(3, 14)}</p><a href='/{word()}'>{word()}</a>",
            "side": lambda: f"<h3>{prose(1, 3)}</h3><ul>{links(rng.randint(2, 6))}</ul><p>{prose(4, 25)}</p>",
            "note": lambda: f"<p>{prose(6, 30)}</p><button>{word()}</button>",
            "ad": lambda: f"<p>{prose(4, 25)}</p><a href='#'>{prose(1, 3)}</a>",
            "form": lambda: f"<label>{word()}</label><input name=q><p>{prose(2, 12)}</p><button>{word()}</button>",
            "comments": lambda: "".join(f"<div class='{pick(['comment', 'reply', 'item'])}'><b>{word()}</b><p>{prose(5, 60)}</p></div>" for _ in range(rng.randint(1, 6))),
        }[kind]()
        return f"<{tag}{mark}>{body}</{tag}>"

    pages = []
    for _ in range(count):
        blocks, inner = [], []
        for k in range(rng.randint(2, 14)):
            text, kind = prose(*pick([(1, 3), (8, 30), (30, 120)])), pick(["p"] * 8 + ["h2", "h3", "h4", "ul", "quote", "cut", "link", "figure"])
            if k == 0:
                kind = pick(["h1", "h1", "p"])
            if kind == "ul":
                items = [prose(2, 12) for _ in range(rng.randint(2, 5))]
                blocks += items
                inner.append(f"<ul{pick(['', '', ' class=list', ' class=links-list'])}>" + "".join(pick([f"<li>{x}</li>", f"<li><a href='/x'>{x}</a></li>"]) for x in items) + "</ul>")
                continue
            blocks.append(text)
            half = text.split(" ", 1)
            inner.append({"h3": f"<h3>{text}</h3>", "h4": f"<h4>{text}</h4>", "link": f"<p>{half[0]} <a href='/y'>{half[-1]}</a></p>" if len(half) > 1 else f"<p>{text}</p>", "figure": f"<figure><img src=x><figcaption>{text}</figcaption></figure>", "p": f"<p>{text}</p>", "h1": f"<h1>{text}</h1>", "h2": f"<h2>{text}</h2>", "quote": f"<blockquote><p>{text}</p></blockquote>", "cut": f"<p>{half[0]} <b>{half[1]}</b><br>" if len(half) > 1 else f"<p>{text}<br>"}[kind])
            if rng.random() < 0.1:
                inner.append(aside(pick(["ad", "side", "form"])))
        holder = pick(["article", "article", "main", "div class='content'", "div class='post entry-content'", "div id='main'", "section class='story container'", "div class='inner box item'", "div class='page-content'", "div class='posts page'", "article class='post author'", "div id='content' class='site-main'", "div class='article-body text'"])
        article = f"<{holder}>{''.join(inner)}</{holder.split()[0]}>"
        before = [aside(k) for k in ("head", "menu", "note", "ad", "form", "side") if rng.random() < 0.5]
        after = [aside(k) for k in ("comments", "side", "form", "menu", "ad", "foot", "note") if rng.random() < 0.55]
        head = f"<head><title>{prose(2, 8)}</title><style>p{{}}</style></head>"
        pages.append((f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{article}{''.join(after)}</body></html>", "\n\n".join(blocks)))
    return pages


def main_text(pages: DataFrame, labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(Weights().fit(labelled if labelled is not None else example_pages()))

    def pull(raws: list[bytes]) -> dict:
        texts = [extract(r.decode("utf-8", "replace"), shared.value) for r in raws]
        return {"text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)}

    return map_texts(pages, ["page_id", "url"], "html", pull, "text string, n_chars long")
