"""HTML extraction (4): a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Elements that begin and end blocks, that have no end tag, and whose content is not page text.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style title noscript template iframe svg object".split())
#: An open element of these is ended by the start of another of its set.
ENDS_ITSELF = {t: s for s in (("p",), ("li",), ("dd", "dt"), ("option",), ("td", "th"), ("tr",)) for t in s}
ENDS_P = BLOCK_TAGS - {"html", "body", "head", "button", "label", "option", "select", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "legend", "textarea"}
LANDMARKS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "table", "ul", "body")
MARKUP = re.compile(r"""<!--(?:(?s:.*?)-->|(?s:.*)\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
NAME_PARTS = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Leaf:
    """A run of text between block boundaries: its elements from the outermost in, and how much of it is linked."""

    text: str
    path: tuple[tuple[str, str], ...]
    linked: int


@functools.cache
def closing(tag: str) -> re.Pattern:
    """Where a hidden element of this tag ends, in ASCII letters of any case."""
    return re.compile(f"</{tag}", re.ASCII | re.IGNORECASE)


def leaves(page: str | None) -> list[Leaf]:
    """The leaf blocks of a page in its order, white space made single, references decoded; blank ones are left out."""
    out: list[Leaf] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = 0
    anchors = 0
    page = page or ""
    at = 0

    def close():
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Leaf(text, tuple(e for e in stack if e[0] in BLOCK_TAGS), linked))
            parts.clear()
        linked = 0

    while m := MARKUP.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if anchors:
                linked += m.start() - at
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if any(e[0] == tag for e in stack):
                if tag in BLOCK_TAGS:
                    close()
                    while stack.pop()[0] != tag:
                        pass
                else:  # an inline element ends without those it crosses
                    k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)
                    del stack[k]
            continue
        if tag in HIDDEN:
            if not m[3].endswith("/") or tag in ("script", "style", "title"):
                shut = closing(tag).search(page, at)
                end = page.find(">", shut.start()) + 1 if shut else len(page)
                at = end if end > 0 else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK_TAGS:
            close()
            if tag in ENDS_P and any(e[0] == "p" for e in stack):
                while stack.pop()[0] != "p":
                    pass
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ENDS_ITSELF.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select", "div", "section", "article"):
                    break
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "a":
            anchors += 1
        names = " ".join(a or b or c for a, b, c in NAMED.findall(m[3])).lower() if tag in BLOCK_TAGS and "=" in m[3] else ""
        stack.append((tag, names))
    parts.append(page[at:])
    close()
    return out


@functools.lru_cache(maxsize=20_000)
def path_features(path: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    tags = [t for t, _ in path]
    out = {f"in:{t}" for t in tags} | {f"at:{tags[-1]}" if tags else "at:"}
    inner = next((t for t in reversed(tags) if t in LANDMARKS), "none")
    out.add(f"land:{inner}")
    if "header" in tags:
        out.add("header-of-article" if "article" in tags and tags.index("article") < tags.index("header") else "header-of-page")
    for _, names in path:
        out |= {f"name:{n}" for n in NAME_PARTS.findall(names)}
    return tuple(sorted(out))


def features(block: Leaf) -> list[str]:
    """Ancestor tags and names, the nearest landmark, and the text's length, links and ending."""
    n = len(block.text)
    density = min(1.0, block.linked / n)
    out = [*path_features(block.path), f"size:{min(8, int(math.log2(n)))}", f"links:{0 if density < 0.05 else 1 if density < 0.5 else 2}"]
    out.append("stop" if block.text[-1] in ".!?:\"'»”…" else "open")
    if "©" in block.text:
        out.append("rights")
    return out


@dataclass
class Chain:
    """A two-label chain: label 1 is main text."""

    number: dict[str, int]
    weight: np.ndarray  # features x labels
    step: np.ndarray  # from label x to label
    first: np.ndarray

    def emissions(self, blocks: list[Leaf]) -> np.ndarray:
        out = np.zeros((len(blocks), 2))
        for k, b in enumerate(blocks):
            out[k] = self.weight[[self.number[f] for f in features(b) if f in self.number]].sum(axis=0)
        return out

    def decode(self, blocks: list[Leaf]) -> list[bool]:
        """The likeliest labels of the whole chain (Viterbi); at a tie main text."""
        if not blocks:
            return []
        gain = (self.weight[:, 1] - self.weight[:, 0]).tolist() if not hasattr(self, "_gain") else self._gain
        self._gain = gain
        number = self.number
        s00, s01, s10, s11 = self.step.ravel().tolist()
        back: list[tuple[int, int]] = []
        no, yes = self.first.tolist()
        for k, b in enumerate(blocks):
            e = sum([gain[number[f]] for f in features(b) if f in number])
            if k:
                to0, to1 = (no + s00, yes + s10), (no + s01, yes + s11)
                back.append((to0[1] > to0[0], to1[1] >= to1[0]))
                no, yes = max(to0), max(to1)
            yes += e
        label = yes >= no
        labels = [bool(label)]
        for b in reversed(back):
            label = b[1] if label else b[0]
            labels.append(bool(label))
        return labels[::-1]


def fit(pages: Iterable[tuple[list[Leaf], list[int]]], rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Chain:
    """Maximum penalised likelihood by gradient steps with moments; forward and backward sums run over all pages at once."""
    pages = [(b, y) for b, y in pages if b]
    rows = [[features(x) for x in b] for b, _ in pages]
    seen: dict[str, int] = {}
    for r in rows:
        for fs in r:
            for f in fs:
                seen[f] = seen.get(f, 0) + 1
    number = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= 5))}
    size, length = len(pages), max(len(b) for b, _ in pages)
    y = np.zeros((size, length), int)
    live = np.zeros((size, length), bool)
    where, what = [], []
    for p, r in enumerate(rows):
        live[p, : len(r)] = True
        y[p, : len(r)] = pages[p][1]
        for t, fs in enumerate(r):
            ids = [number[f] for f in fs if f in number]
            what += ids
            where += [p * length + t] * len(ids)
    where, what = np.array(where), np.array(what)
    total = live.sum()
    shape = [(len(number), 2), (2, 2), (2,)]
    theta = np.zeros(sum(math.prod(s) for s in shape))
    cuts = np.cumsum([math.prod(s) for s in shape])[:-1]
    one = np.zeros((size, length, 2))
    np.put_along_axis(one, y[..., None], 1.0, axis=2)
    one *= live[..., None]
    pair = live[:, 1:]
    empirical = np.zeros((2, 2))
    np.add.at(empirical, (y[:, :-1][pair], y[:, 1:][pair]), 1.0)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, s, f = (part.reshape(sh) for part, sh in zip(np.split(theta, cuts), shape))
        emit = np.stack([np.bincount(where, w[what, c], size * length) for c in (0, 1)], axis=1).reshape(size, length, 2)
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = f + emit[:, 0]
        for t in range(1, length):
            alpha[:, t] = np.logaddexp(alpha[:, t - 1, :1] + s[0], alpha[:, t - 1, 1:] + s[1]) + emit[:, t]
            alpha[:, t] = np.where(live[:, t, None], alpha[:, t], alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            ahead = emit[:, t + 1] + beta[:, t + 1]
            b = np.logaddexp(s[:, 0] + ahead[:, :1], s[:, 1] + ahead[:, 1:])
            beta[:, t] = np.where(live[:, t + 1, None], b, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        gamma = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
        joint = alpha[:, :-1, :, None] + s + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expected = np.where(pair[..., None, None], np.exp(np.minimum(joint, 0)), 0).sum(axis=(0, 1))
        gap = (one - gamma).reshape(-1, 2)
        gw = np.stack([np.bincount(what, gap[where, c], len(number)) for c in (0, 1)], axis=1)
        grad = np.concatenate((gw.ravel(), (empirical - expected).ravel(), (one - gamma)[:, 0].sum(axis=0))) / total - ridge * theta / len(theta) ** 0.5
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        theta = theta + rate * (moment / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    w, s, f = (part.reshape(sh) for part, sh in zip(np.split(theta, cuts), shape))
    return Chain(number, w, s, f)


# Labelled pages: invented pages whose blocks' labels are known by construction.

SYLLABLES = "an be cor da el fi gra hu in jo ka lor ma ne or pa qui ra so ten ul ve wi xa yo zu th er on re".split()
#: Names that pages give to their parts.
MAIN_NAMES = "content article post entry main story text body page-content post-body entry-content article-body markdown".split()
PART_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toolbar tabs pagination pager toc topnav".split(),
    "head": "header masthead topbar site-header logo branding banner-top".split(),
    "foot": "footer site-footer copyright bottom legal colophon".split(),
    "side": "sidebar aside widget rail related recommended trending popular tags archive side right-column".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner ad-slot adbox partner".split(),
    "notice": "cookie consent cookie-notice gdpr alert notice popup modal paywall overlay disclaimer announcement".split(),
    "form": "form search subscribe newsletter signup login contact".split(),
    "comment": "comments comment reply responses discussion comment-list comment-body disqus user-comment".split(),
    "share": "share social social-share sharing follow byline-links like-buttons".split(),
}


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """An invented page and the labels of its leaf blocks in order (1: main text)."""
    labels: list[int] = []

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))

    def sentence() -> str:
        return words(rng.randint(1, 14)).capitalize() + rng.choice(("", *"...?!"))

    def link(n: int = 2) -> str:
        return f'<a href="/{words(1)}">{words(rng.randint(1, n))}</a>'

    def leaf(text: str, label: int) -> str:
        labels.append(label)
        return text

    def prose() -> str:
        kind = rng.random()
        if kind < 0.2:
            return words(rng.randint(1, 3)) + rng.choice((".", ""))
        if kind < 0.3:
            return " | ".join(words(1) for _ in range(rng.randint(3, 30)))
        if kind < 0.4:
            return " ".join(words(1) + rng.choice(("***", "###", "$$$", " 17", " 4.5%", " x@y.org", " https://a.b/c")) for _ in range(rng.randint(2, 30)))
        if kind < 0.5:
            return f"{sentence()} {link(4)} {sentence()}"
        if kind < 0.55:
            return rng.choice(("Released under the MIT License.", "Copyright 2020 " + words(2), "Licensed under CC BY 4.0.", "Subscribe to " + words(3), "&copy; " + words(3), "Comments on " + words(4) + ".", "Cookies are " + words(4)))
        return " ".join(sentence() for _ in range(rng.randint(1, 9)))

    def paragraph(label: int) -> str:
        text = leaf(prose(), label)
        kind = rng.random()
        if kind < 0.1:
            return f"<p><b>{text}<br>"
        if kind < 0.2:
            return f"<p>{text}"
        if kind < 0.25:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.3:
            return f"<pre>{text}</pre>"
        if kind < 0.35:
            return f"<div>{text}</div>"
        return f"<p>{text}</p>"

    def items(label: int, n: int, links: bool) -> str:
        tag = rng.choice(("ul", "ol"))
        return f"<{tag}>" + "".join(f"<li>{leaf(link() if links else sentence(), label)}</li>" for _ in range(n)) + f"</{tag}>"

    def rows(label: int) -> str:
        return "<table>" + "".join("<tr>" + "".join(f"<td>{leaf(words(rng.randint(1, 4)), label)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"

    def part(kind: str, tag: str, inner) -> str:
        name = f' {rng.choice(("class", "class", "id"))}="{rng.choice(PART_NAMES[kind])}"' if tag in ("div", "section", "ul", "p", "article", "li") or rng.random() < 0.5 else ""
        return f"<{tag}{name}>" + "".join(f() for f in inner) + f"</{tag}>"

    def text(label: int = 0, tags=("p", "span", "div", "h3", "h4", "")) -> str:
        tag = rng.choice(tags)
        body = leaf(rng.choice((sentence, prose, lambda: words(3)))(), label)
        return f"<{tag}>{body}</{tag}>" if tag and tag != "span" else f"<div>{body}</div>"

    def bare(label: int = 0) -> str:
        return leaf(rng.choice((sentence(), prose(), "&copy; " + words(2) + " &middot; " + sentence())), label)

    nav = lambda: part("nav", rng.choice(("nav", "nav", "div", "ul")), [lambda: items(0, rng.randint(2, 8), True)])
    ad = lambda: part("ad", rng.choice(("div", "div", "aside", "section")), [rng.choice((bare, text))])
    notice = lambda: part("notice", rng.choice(("div", "section", "aside")), [rng.choice((bare, text)), *([lambda: f"<button>{leaf(words(1), 0)}</button>"] * rng.randint(0, 1))])
    form = lambda: part("form", rng.choice(("form", "form", "div")), [text, lambda: f"<label>{leaf(words(2), 0)}</label><input name=q>", lambda: f"<button>{leaf(words(1), 0)}</button>"])
    share = lambda: part("share", rng.choice(("div", "ul")), [lambda: items(0, 3, True)])
    side = lambda: part("side", rng.choice(("aside", "aside", "div", "section")), [text, *([lambda: items(0, rng.randint(2, 6), True)] * rng.randint(0, 1)), *([text] * rng.randint(0, 2))])
    head = lambda: part("head", rng.choice(("header", "header", "div")), [text, *([nav] * rng.randint(0, 1))])
    foot = lambda: part("foot", rng.choice(("footer", "footer", "div")), [rng.choice((bare, text)), *([lambda: items(0, 3, True)] * rng.randint(0, 1))])
    one_comment = lambda: part("comment", rng.choice(("div", "article", "li")), [lambda: text(0), lambda: paragraph(0)])
    comments = lambda: part("comment", rng.choice(("section", "div")), [lambda: f"<h3>{leaf(words(2), 0)}</h3>", *([one_comment] * rng.randint(1, 4))])

    def heading(level: str) -> str:
        return f"<{level}>{leaf(sentence(), 1)}</{level}>"

    def article() -> str:
        tag = rng.choice(("article", "article", "article", "main", "div", "section"))
        name = f' class="{rng.choice(MAIN_NAMES)}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
        inner = [lambda: (f"<header>{heading('h1')}</header>" if rng.random() < 0.2 else heading("h1"))] if rng.random() < 0.85 else []
        for _ in range(rng.randint(0, 14)):
            r = rng.random()
            if r < 0.72:
                inner.append(lambda: paragraph(1))
            elif r < 0.8:
                inner.append(lambda: heading(rng.choice(("h2", "h3"))))
            elif r < 0.86:
                inner.append(lambda: items(1, rng.randint(1, 5), False))
            elif r < 0.89:
                inner.append(lambda: rows(1))
            elif r < 0.91:
                inner.append(lambda: f"<figure><img src=x><figcaption>{leaf(sentence(), 1)}</figcaption></figure>")
            else:
                inner.append(rng.choice((ad, share, form, side, notice)))
        if rng.random() < 0.12:
            inner.append(comments)
        body = f"<{tag}{name}>" + "".join(f() for f in inner) + f"</{tag}>"
        return f"<main>{body}</main>" if tag != "main" and rng.random() < 0.2 else body

    before = [f for f in (notice, head, nav, ad, side, form) if rng.random() < 0.45]
    after = [f for f in (share, comments, side, ad, form, notice, foot) if rng.random() < 0.45]
    rng.shuffle(before)
    page = [f() for f in before] + [article()] + [f() for f in after]
    body = "".join(page)
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(("wrapper", "container", "site", "page", "row"))}">{body}</div>'
    top = "<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style><script>var t='</p>';</script></head>"
    return f"{top}<body>{body}</body></html>", labels


@functools.lru_cache(maxsize=2)
def trained(pages: int = 900, seed: int = 4) -> Chain:
    """The chain learned from invented pages; the number of pages bounds what training takes."""
    rng = random.Random(seed)
    made = [labelled_page(rng) for _ in range(pages)]
    return fit([(leaves(p), y) for p, y in made])


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaves(page)
    return "\n".join(b.text for b, keep in zip(blocks, chain.decode(blocks)) if keep)


def extract(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars (code points).

    text joins the blocks decoded as main text by line feeds. Null and blank
    pages have empty text; pages are read whole; repeated rows and null ids stay
    as they are; other columns are not read; an empty table gives no rows.
    """
    small_batches(pages.sparkSession, 256)
    chain = chain or trained()
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(p, chain) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, f"page_id {types[id_col]}, url {types[url_col]}, text string, n_chars long")
