"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks: runs of text between block-level tags, each
with its open elements. Features of a block are its ancestors' tags, names
(class, id, role) and the look of its text; the chain's transitions let
neighbours support each other. The field is trained by gradient ascent on its
log-likelihood over labelled pages and decoded by Viterbi.

The corpus has no labels, so ``labelled_pages`` writes pages of many layouts
whose blocks are known by construction; any list of pages and labels can take
their place.
"""

from __future__ import annotations

import html
import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import held, slices

BUCKETS = 1 << 13
#: Elements by their role in a document.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title textarea noscript iframe noframes noembed xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
#: An opening tag ends an open sibling of these kinds, looked for up to the nearest of the containers.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass(eq=False, slots=True)
class Element:
    """An open element; ``fresh`` are the names that none of its ancestors brings, as features."""

    parent: Element | None
    tag: str
    fresh: tuple[str, ...]
    score: np.ndarray | None = None


@dataclass
class Block:
    """A leaf block: its text with white space as single spaces, its innermost open element, and its letters within links."""

    text: str
    inside: Element | None
    linked: int


class _Page:
    """The open elements, shared by the blocks as a linked path, so that a page of any depth takes memory in its length."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[tuple[Element, tuple[str, ...]]] = []
        self.open: dict[str, list[int]] = defaultdict(list)  # depths of open elements by tag
        self.names: Counter[str] = Counter()
        self.held: list[str] = []
        self.linked = 0

    def text(self, raw: str) -> None:
        """A run between two tags; references are decoded here, as none reaches over a tag."""
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            self.held.append(raw)
            if self.open["a"]:
                self.linked += len(raw)

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.blocks.append(Block(text, self.stack[-1][0] if self.stack else None, self.linked))
            self.held.clear()
            self.linked = 0

    def push(self, tag: str, tokens: tuple[str, ...]) -> None:
        names = _path_names(tag, tokens)
        fresh = tuple([n for n in names if not self.names[n]])
        self.names.update(names)
        self.open[tag].append(len(self.stack))
        self.stack.append((Element(self.stack[-1][0] if self.stack else None, tag, fresh), names))

    def close(self, kinds: set[str], up_to: set[str] = frozenset()) -> None:
        """End the innermost open element of ``kinds``, unless one of ``up_to`` lies within."""
        depth = lambda tags: max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)
        at = depth(kinds)
        if at < 0 or depth(up_to) > at:
            return
        while len(self.stack) > at:
            element, names = self.stack.pop()
            self.open[element.tag].pop()
            self.names.subtract(names)


@lru_cache(1 << 14)
def _path_names(tag: str, tokens: tuple[str, ...]) -> tuple[str, ...]:
    """What an open element tells of all that lies in it: its tag, and its names whole and cut short."""
    names = [] if tag in ("html", "body") else [f"in {tag}"]
    names += [f"named {t}" for t in tokens]
    names += [f"named {t[:4]}-" for t in tokens if len(t) > 4]
    return tuple(sorted(set(names)))


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a whole page; unclosed, misnested and cut-off markup is tolerated."""
    page = page or ""
    out, at, n = _Page(), 0, len(page)
    for m in iter(_Scanner(page)):
        out.text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        inline = name in INLINE
        if not inline:
            out.flush()
        elif name == "br":
            out.text(" ")
        if m["end"] or m["end2"]:
            out.close({name}, set() if name not in ("p", "li") else {"article", "section", "div", "body"})
            continue
        if name in ENDS_PARAGRAPH:
            out.close({"p"}, {"article", "aside", "blockquote", "body", "button", "div", "form", "li", "main", "nav", "section", "td", "th"})
        if name in SIBLINGS:
            out.close(*SIBLINGS[name])
        if name in VOID or page[m.end() - 2 : m.end()] == "/>" and not inline and name not in ENDS_PARAGRAPH:
            continue
        names = tuple(t.lower() for v in _NAMES.findall(m["attributes"] or "") for t in _TOKEN.findall("".join(v)))
        if name not in RAW:
            out.push(name, names)
    out.text(page[at:n])
    out.flush()
    return out.blocks


class _Scanner:
    """Tags in order; what lies inside raw-text elements is skipped with their tags."""

    def __init__(self, page: str):
        self.page = page

    def __iter__(self) -> Iterator[re.Match]:
        at = 0
        while m := _TAG.search(self.page, at):
            name = (m["name"] or m["name2"] or "").lower()
            at = m.end()
            if name in RAW and not (m["end"] or m["end2"]):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(self.page, at)
                yield _Skipped(m, end.end())
                at = end.end()
            else:
                yield m


class _Skipped:
    """A raw-text element as one match."""

    def __init__(self, m: re.Match, end: int):
        self.m, self.at = m, end

    def __getitem__(self, key):
        return self.m[key]

    def start(self) -> int:
        return self.m.start()

    def end(self) -> int:
        return self.at


def _hashed(names: Sequence[str]) -> list[int]:
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


def ancestor_features(inside: Element | None) -> list[int]:
    """The innermost tag, and tags and name tokens of all open elements."""
    names, at = [f"own {inside.tag}" if inside else "bare"], inside
    while at:
        names += at.fresh
        at = at.parent
    return _hashed(names)


def text_features(block: Block) -> list[int]:
    """Length, links, punctuation and signs of a block's text."""
    n = len(block.text)
    words = block.text.count(" ") + 1
    size = next(i for i, most in enumerate((2, 5, 10, 20, 50, 1 << 60)) if words <= most)
    link = next(i for i, most in enumerate((0.0, 0.3, 0.7, 9e9)) if block.linked <= most * n)
    names = [f"size {size}", f"link {link}", f"size {size} link {link}", f"ends {block.text[-1] in '.!?…:;'}"]
    if "©" in block.text:
        names.append("copyright")
    return _hashed(names)


@dataclass
class Field:
    """Emission weights by feature and label (0: around, 1: main text), and transitions."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi: the best labels for emission scores (blocks, 2)."""
        (s00, s01), (s10, s11) = self.step.tolist()
        back = []
        a, b = (self.first + scores[0]).tolist()
        for e0, e1 in scores[1:].tolist():
            stay0, stay1 = a + s00 >= b + s10, b + s11 >= a + s01
            back.append((0 if stay0 else 1, 1 if stay1 else 0))
            a, b = (a + s00 if stay0 else b + s10) + e0, (b + s11 if stay1 else a + s01) + e1
        labels = [int(b > a)]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = 120, rate: float = 0.4, ridge: float = 1e-3) -> Field:
    """Adaptive gradient ascent on the log-likelihood; pages run through forward and backward side by side."""
    pages = [p for p in pages if p[0]]
    n, longest = len(pages), max(len(b) for b, _ in pages)
    live, gold = np.zeros((n, longest), bool), np.zeros((n, longest), int)
    row, col = [], []
    for i, (blocks, labels) in enumerate(pages):
        for t, (block, label) in enumerate(zip(blocks, labels)):
            live[i, t], gold[i, t] = True, label
            found = ancestor_features(block.inside) + text_features(block)
            row += [i * longest + t] * len(found)
            col += found
    row, col = np.array(row), np.array(col)
    truth = np.eye(2)[gold] * live[..., None]
    pairs = truth[:, :-1, :, None] * truth[:, 1:, None, :]
    emit, step, first = np.zeros((BUCKETS, 2)), np.zeros((2, 2)), np.zeros(2)
    seen = [np.full_like(w, 1e-6) for w in (emit, step, first)]
    for _ in range(steps):
        score = np.stack([np.bincount(row, emit[col, k], n * longest) for k in (0, 1)], axis=1).reshape(n, longest, 2)
        p, joint = _marginals(score, step, first, live)
        error = (truth - p).reshape(-1, 2)
        slope = [np.stack([np.bincount(col, error[row, k], BUCKETS) for k in (0, 1)], axis=1) - ridge * n * emit, (pairs - joint).sum(axis=(0, 1)), (truth - p)[:, 0].sum(axis=0)]
        for w, g, s in zip((emit, step, first), slope, seen):
            s += g * g
            w += rate * g / np.sqrt(s)
    return Field(emit, step, first)


def _marginals(score: np.ndarray, step: np.ndarray, first: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and pair probabilities by forward-backward in log space; what isn't live gets 0."""
    n, longest, _ = score.shape
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[:, 0] = first + score[:, 0]
    for t in range(1, longest):
        move = np.logaddexp(ahead[:, t - 1, 0, None] + step[0], ahead[:, t - 1, 1, None] + step[1]) + score[:, t]
        ahead[:, t] = np.where(live[:, t, None], move, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        on = behind[:, t + 1] + score[:, t + 1]
        move = np.logaddexp(step[:, 0] + on[:, 0, None], step[:, 1] + on[:, 1, None])
        behind[:, t] = np.where(live[:, t + 1, None], move, 0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None]
    p = np.exp(ahead + behind - total[..., None]) * live[..., None]
    joint = ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - total[..., None, None]
    return p, np.exp(np.where(live[:, 1:, None, None], joint, -np.inf))


#: Names that page authors give to what surrounds an article, and to articles.
AROUND = {
    "nav": ["nav", "menu", "navbar", "topnav", "main-menu", "breadcrumbs", "navigation", "site-nav", "pagination", "tabs", "toc-menu"],
    "header": ["header", "site-header", "masthead", "page-header", "top-bar", "branding", "logo"],
    "footer": ["footer", "site-footer", "page-footer", "bottom", "copyright", "legal", "colophon"],
    "aside": ["sidebar", "side", "widget", "right-column", "related", "related-posts", "more-stories", "recommended", "trending", "tags", "tagcloud"],
    "notice": ["notice", "cookie-notice", "cookie-banner", "cookies", "consent", "gdpr", "alert", "popup", "modal", "paywall", "subscribe-notice", "message"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "sponsor", "promo", "promotion", "banner", "adbox"],
    "form": ["newsletter", "search", "login", "signup", "subscribe", "contact-form", "form", "poll"],
    "comments": ["comments", "comment-list", "comment", "replies", "discussion", "disqus", "responses", "reader-comments", "user-comments"],
    "share": ["share", "social", "sharing", "share-buttons", "follow", "social-links"],
}
ARTICLE = ["content", "post", "entry", "article", "story", "article-body", "post-content", "entry-content", "main-content", "text", "body-text", "main", "page-content", "blog-post"]
_MARKS = "\ue000\ue001"


def labelled_pages(n: int = 800, seed: int = 17) -> list[tuple[list[Block], list[int]]]:
    """Pages of varied layout with the label of each block, known because the writer marks its text."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        blocks = leaf_blocks(_write_page(rng))
        labels = [int(b.text[0] == _MARKS[1]) for b in blocks]
        for b in blocks:
            b.text = re.sub(f"[{_MARKS}]", "", b.text).strip() or "x"
        out.append((blocks, labels))
    return out


def _write_page(rng: np.random.Generator) -> str:
    one = lambda options: options[int(rng.integers(len(options)))]
    chance = lambda p: rng.random() < p

    def words(least: int, most: int, end: str = "") -> str:
        made = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(rng.integers(least, most + 1))]
        return " ".join(made).capitalize() + end

    def sentences(least: int, most: int) -> str:
        return " ".join(words(4, 18, ".") for _ in range(rng.integers(least, most + 1)))

    def marked(label: int, text: str) -> str:
        return _MARKS[label] + text

    def named(name: str | None) -> str:
        if name is None or chance(0.1):
            return f' class="{words(1, 1).lower()}"' if chance(0.3) else ""
        return f' {one(["class", "class", "id"])}="{name}"'

    def link(label: int = 0) -> str:
        return f'<a href="/{words(1, 1)}">{marked(label, words(1, 4))}</a>'

    def around(kind: str, named_always: bool = False) -> str:
        name = one(AROUND[kind])
        plain = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = plain if plain and chance(0.7) else one(["div", "div", "section"])
        label = f' class="{name}"' if named_always or tag in ("div", "section") else named(name if chance(0.5) else None)
        if kind in ("nav", "share"):
            body = "".join(f"<li>{link()}</li>" for _ in range(rng.integers(2, 8)))
            body = f"<ul>{body}</ul>" if chance(0.7) else re.sub("</?li>", " ", body)
        elif kind == "header":
            body = f"<div>{link()}</div><p>{marked(0, words(2, 8))}</p>"
            if chance(0.3):
                body = f"<h1>{link()}</h1>" + body
        elif kind == "footer":
            body = f"&copy; {marked(0, words(2, 10))} &middot; {sentences(1, 2)}" if chance(0.6) else f"<p>{marked(0, sentences(1, 2))}</p><ul><li>{link()}</li><li>{link()}</li></ul>"
            body = _MARKS[0] + body
        elif kind == "aside":
            body = f"<h3>{marked(0, words(1, 4))}</h3>" + ("<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.integers(2, 6))) + "</ul>" if chance(0.6) else f"<p>{marked(0, sentences(1, 3))}</p>")
        elif kind == "notice":
            body = f"<p>{marked(0, sentences(1, 2))}</p>" + (f"<button>{marked(0, words(1, 2))}</button>" if chance(0.5) else "")
        elif kind == "ad":
            body = marked(0, sentences(1, 3)) if chance(0.6) else f"<p>{marked(0, sentences(1, 2))}</p>{link()}"
        elif kind == "form":
            body = f"<label>{marked(0, words(1, 4))}</label><input name=q><button>{marked(0, words(1, 2))}</button>" + (f"<p>{marked(0, sentences(1, 1))}</p>" if chance(0.4) else "")
        else:
            tag_, name_ = one([("div", "comment"), ("li", "comment"), ("article", "comment"), ("div", "reply")])
            said = "".join(f'<{tag_} class="{name_}"><p class="author">{marked(0, words(1, 2))}</p><p>{marked(0, sentences(1, 4))}</p></{tag_}>' for _ in range(rng.integers(1, 5)))
            body = f"<h2>{marked(0, words(1, 3))}</h2>" + said
        return f"<{tag}{label}>{body}</{tag}>"

    def part() -> str:
        kind = rng.random()
        p = lambda: f"<p>{marked(1, sentences(1, 6))}" + ("</p>" if chance(0.85) else "")
        if kind < 0.68:
            return p()
        if kind < 0.74:
            return f"<p>{marked(1, words(1, 3, '.'))}</p>"
        if kind < 0.80:
            return f"<{(h := one(['h2', 'h3']))}>{marked(1, words(1, 7))}</{h}>"
        if kind < 0.86:
            return f"<{(u := one(['ul', 'ol']))}>" + "".join(f"<li>{marked(1, sentences(1, 1))}</li>" for _ in range(rng.integers(2, 5))) + f"</{u}>"
        if kind < 0.90:
            return f"<blockquote>{p()}</blockquote>"
        if kind < 0.93:
            return f"<pre>{marked(1, words(3, 20))}</pre>"
        if kind < 0.96:
            return "<table>" + "".join("<tr>" + f"<td>{marked(1, words(1, 4))}</td>" * 2 + "</tr>" for _ in range(2)) + "</table>"
        if kind < 0.98:
            return f"<figure><img src=x><figcaption>{marked(1, words(3, 12, '.'))}</figcaption></figure>"
        return f"<p>{marked(1, words(3, 9))} {link(1)} {words(3, 9, '.')}</p>"

    title = f"<h1>{marked(1, words(2, 10))}</h1>"
    if chance(0.3):
        title = f"<p><b>{marked(1, words(2, 10))}<br>" + title
    if chance(0.15):
        title = f"<header>{title}</header>"
    inner = [title, *(part() for _ in range(rng.integers(1, 12)))]
    for kind, p in (("ad", 0.45), ("share", 0.15), ("form", 0.15), ("notice", 0.12), ("aside", 0.15)):
        if chance(p):
            inner.insert(int(rng.integers(1, len(inner) + 1)), around(kind, True))
    if chance(0.15):
        inner.append(around("comments", True))
    tag = one(["article", "article", "main", "div", "div", "section", "body", "td"])
    article = "".join(inner)
    if tag == "td":
        article = f"<table><tr><td>{article}</td></tr></table>"
    elif tag != "body":
        article = f"<{tag}{named(one(ARTICLE)) if tag in ('div', 'section') or chance(0.4) else ''}>{article}</{tag}>"
    before = [around(k) for k, p in (("notice", 0.3), ("header", 0.5), ("nav", 0.8), ("ad", 0.5), ("form", 0.2)) if chance(p)]
    after = [around(k) for k, p in (("comments", 0.35), ("aside", 0.4), ("nav", 0.15), ("ad", 0.2), ("form", 0.2), ("notice", 0.1), ("footer", 0.85)) if chance(p)]
    return f"<html><head><title>t</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"


@cache
def trained_field(n: int = 800, seed: int = 17) -> Field:
    """The field trained on ``n`` written pages; made once a process."""
    return train(labelled_pages(n, seed))


class Extractor:
    """Decodes pages; an element's score is its parent's and that of its fresh names, which sites repeat and are remembered."""

    def __init__(self, field_: Field, limit: int = 50_000):
        self.field, self.limit, self.known = field_, limit, {}

    def _emission(self, names: tuple[str, ...]) -> np.ndarray:
        known = self.known.get(names)
        if known is None:
            if len(self.known) > self.limit:
                self.known.clear()
            known = self.known[names] = self.field.emit[_hashed(names)].sum(axis=0)
        return known

    def _path(self, inside: Element | None) -> np.ndarray:
        """Scores go from the nearest ancestor that has one down to the element."""
        path, at = [], inside
        while at is not None and at.score is None:
            path.append(at)
            at = at.parent
        score = np.zeros(2) if at is None else at.score
        for element in reversed(path):
            if element.fresh:
                score = score + self._emission(element.fresh)
            element.score = score
        return score

    def _score(self, block: Block) -> np.ndarray:
        own = self._emission((f"own {block.inside.tag}" if block.inside else "bare",))
        return self._path(block.inside) + own + self.field.emit[text_features(block)].sum(axis=0)

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        if not blocks:
            return ""
        labels = self.field.decode(np.array([self._score(b) for b in blocks]))
        return "\n\n".join(b.text for b, main in zip(blocks, labels) if main)


def extract(pages: DataFrame, field_: Field | None = None) -> DataFrame:
    """Per row: page_id, url, text and n_chars (code points) of the main text of the whole page.

    Character references are decoded, white space in a block becomes one
    space, and main blocks are joined by two line breaks. A null page and one
    without main text give an empty text. Repeated rows repeat, an empty table
    gives no rows, other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, field_ or trained_field()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, made = sent.value
        extractor = held((Extractor, name), lambda: Extractor(made))
        for batch in slices(batches):
            texts = [extractor.main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
