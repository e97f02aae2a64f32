"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into text blocks; hidden elements have no text. A block's features are its own and its
neighbours' word counts and link densities, its kind of tag, whether an ancestor marks an article, page furniture, or is
named like furniture, the share of phrases that notices use, and whether only other blocks of the page lie in an article.
The tree is grown (Gini, depth at most MAX_DEPTH) on a small table of labelled blocks, which `labelled_pages` makes by
rule from page layouts: some with telling tags or names, others on which only words, links and neighbours tell. Blocks
that the tree accepts are joined in page order."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.llm.common import table

MAX_DEPTH, MIN_LEAF = 12, 2
# Names of HTML elements and of page parts.
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe math noembed noframes noscript object script style svg template textarea title".split())
#: Elements that are kept on the stack; the end tags of others may be missing and mean nothing.
STRUCTURE = set("article aside body button details dialog div fieldset figure footer form header html label li main menu nav ol search section select table td th tr ul".split())
FURNITURE = set("aside button dialog fieldset footer form label menu nav search select".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
GOOD_NAMES = set("article articlebody content entry main post story".split())
BAD_NAMES = set("ad ads adsbygoogle adv advert advertisement advertising adverts advertorial alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies discussion disqus gdpr menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo recommended related replies reply respond responses search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe teaser toolbar".split())
#: Names of furniture that are words of articles as well: at an end of a name they count only alone, or where all of its
#: other tokens are names of furniture or of plain containers.
UNSURE = set("alert discussion header login menu notice recommended related replies reply respond responses search share sharing skip social".split())
CONTAINERS = set("area bar block body box btn button buttons card container content desktop form grid group head icons id info inner inline item items label left link links list main mobile module outer page panel posts right row section site slot stories sub text title tools top unit view wrap wrapper".split())
BAD_OUTSIDE = set("bottom copyright footer header latest legal login masthead popular promotion recent site topbar trending widget widgets".split())
#: A quote in a tag that is never closed ends with the tag.
_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z", re.S)
_NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Inline elements whose hidden text is left out.
INLINE = set("a abbr b cite code em font i mark small span strong sub sup time u".split())
#: Phrases of notices about rights, cookies and accounts, in the languages of the pages: a weak sign, by their share of words.
_CUES = re.compile(r"©|\bcopyright\b|\ball rights reserved\b|\bcookies?\b|\bprivacy policy\b|\bterms of (?:use|service)\b|\bnewsletter\b|\bsubscribe\b|\b(?:sign|log) in\b|\bconsent\b|\balle rechte vorbehalten\b|\bdatenschutz\w*|\bimpressum\b|\beinwilligung\b|\btodos los derechos reservados\b|\bpolítica de privacidad\b|\baviso legal\b|\btous droits réservés\b|\bpolitique de confidentialité\b|\bmentions légales\b")
#: Every cue holds one of these; a block without any of them needs no closer look.
_STEMS = ("©", "copyright", "rights reserved", "cookie", "privac", "terms of", "newsletter", "subscribe", "sign in", "log in", "consent", "vorbehalten", "datenschutz", "impressum", "einwilligung", "derechos reservados", "aviso legal", "droits réservés", "confidentialité", "mentions légales")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "in_article", "in_furniture", "named_bad", "heading", "item", "cues", "article_elsewhere")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_article: bool
    in_furniture: bool
    named_bad: bool
    heading: bool
    item: bool
    cues: int


def _names(attributes: str, tag: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element's class, id or role calls it an article, or furniture."""
    good = bad = False
    for found in _NAMED.findall(attributes):
        for name in "".join(found).split():
            tokens = [t.lower() for t in _TOKEN.findall(name)]
            if not tokens or {"has", "no", "with", "without"} & set(tokens):
                continue
            ends = {tokens[0], tokens[-1]}
            listed = BAD_NAMES if in_article else BAD_NAMES | BAD_OUTSIDE
            plain = all(t in listed or t in CONTAINERS or t.isdigit() for t in tokens)
            bad |= bool(ends & listed - (set() if plain else UNSURE))
            good |= bool(set(tokens) & GOOD_NAMES)
    if tag in ("html", "body", "main"):
        bad = False
    return good and not bad, bad


def cues(text: str) -> int:
    lower = text.lower()
    return len(_CUES.findall(lower)) if any(s in lower for s in _STEMS) else 0


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page, in order. Blocks without text are left out."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    open_tags = Counter[str]()
    state = (False, False, False)  # in an article, in furniture, named bad
    text: list[str] = []
    linked: list[str] = []
    tag_of, link, lower = "", False, ""
    unseen, veil = False, [""]  # whether the block is hidden; hidden inline elements: their tag, once for each that is open
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal text, linked
        if text:
            own = " ".join("".join(text).split())
            if own:
                out.append(Block(own, own.count(" ") + 1, len("".join(linked).split()), *state, tag_of in HEADINGS, tag_of in ("li", "option", "dt", "dd"), cues(own)))
            text, linked = [], []

    def add(raw: str) -> None:
        if unseen or veil[-1]:
            return
        raw = html.unescape(raw) if "&" in raw else raw
        text.append(raw)
        if link:
            linked.append(raw)

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "a":
            link = not closing
            if closing and linked:
                linked.append(" ")
        elif tag == "br":
            text.append(" ")
        if tag in BLOCKS:
            flush()
            tag_of = "" if closing else tag
            unseen = not closing and tag not in STRUCTURE and bool(_HIDDEN.search(m[3]))
            del veil[1:]
        elif tag in INLINE and (veil[-1] == tag or not closing and not veil[-1] and _HIDDEN.search(m[3])):
            if closing:
                veil.pop()
            else:
                veil.append(tag)
        if tag in STRUCTURE:
            link = False
            if closing:
                while open_tags[tag]:  # what is open inside ends as well; an end tag without a start means nothing
                    top = stack.pop()[0]
                    open_tags[top] -= 1
                    if top == tag:
                        break
            else:
                article, furniture, bad = state
                good, named = _names(m[3], tag, article)
                article |= tag in ("article", "main") or good
                furniture |= tag in FURNITURE or tag == "header" and not article
                open_tags[tag] += 1
                stack.append((tag, article, furniture, bad or named or bool(_HIDDEN.search(m[3]))))
            state = stack[-1][1:] if stack else (False, False, False)
        if tag in RAW and not closing and not m[3].endswith("/"):
            lower = lower or page.lower()
            if len(lower) != end:  # lower case has another length for a few letters
                lower = re.sub("[A-Z]", lambda x: x[0].lower(), page)
            close = lower.find(f"</{tag}", at)
            at = end if close < 0 else close
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    own = np.array([(b.words, b.linked / b.words, b.in_article, b.in_furniture, b.named_bad, b.heading, b.item, b.cues / b.words) for b in found], float).reshape(-1, 8)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own[:-1, :2]])[: len(own)], np.concatenate([own[1:, :2], edge])[: len(own)]
    elsewhere = (own[:, 2:3] == 0) & (own[:, 2] > own[:, 3] + own[:, 4]).any()
    return np.concatenate([own[:, :2], before, after, own[:, 2:], elsewhere], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH):
    """A decision tree: a label, or (feature, threshold, at most, above)."""
    if depth == 0 or len(y) < 2 * MIN_LEAF or y.min() == y.max():
        return bool(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, positive = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= MIN_LEAF) & (len(y) - n >= MIN_LEAF)
        if not ok.any():
            continue
        a, b = positive[:-1] / n, (positive[-1] - positive[:-1]) / (len(y) - n)
        gini = np.where(ok, n * a * (1 - a) + (len(y) - n) * b * (1 - b), np.inf)
        i = int(gini.argmin())
        if best is None or gini[i] < best[0] - 1e-12:
            best = gini[i], f, (v[i] + v[i + 1]) / 2
    if best is None:
        return bool(2 * y.sum() >= len(y))
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def accepts(tree, row: list[float]) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def labelled_pages() -> list[tuple[str, list[bool]]]:
    """The labelled table: pages of several layouts with the label of each block, made by rule."""
    out: list[list[tuple[str, int, bool]]] = []
    say = lambda n: " ".join(["word"] * n)
    links = lambda n: "".join(f"<li><a href='/'>{say(1 + i % 3)}</a></li>" for i in range(n))
    lengths = [[40, 1, 120, 2, 60], [3, 80], [1], [7, 30, 15, 200, 1, 1, 50], [25, 25], [90, 4, 4, 4, 70], [5, 60, 9], [150], [2, 1], [12, 33, 8, 21]]
    around = [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div>", "</div>"), ("", "")]
    for a, (open_, close) in enumerate(around):
        for i, ns in enumerate(lengths):
            if a >= 3 and max(ns) < 30:
                continue  # nothing but length tells plain text from furniture there
            parts: list[tuple[str, int, bool]] = []  # markup, blocks, label
            parts += [(f"<header>{say(2 + i)}</header>", 1, False)] if i % 2 else [(f"<div class='header'><h1>{say(2 + i)}</h1></div>", 1, False)]
            parts += [(f"<nav><ul>{links(3 + i % 4)}</ul></nav>", 3 + i % 4, False)] if i % 3 else [(f"<ul>{links(4)}</ul>", 4, False)] if a >= 3 else [(f"<ul class='menu'>{links(4)}</ul>", 4, False)]
            parts += [(f"<div class='{('ad', 'cookie-notice', 'banner')[i % 3]}'>{say((8, 45, 20)[i % 3])}</div>", 1, False)]
            parts += [(open_, 0, False)]
            parts += [(f"<h1>{say(1 + i)}</h1>", 1, True)] if a < 3 or max(ns) >= 30 and ns[0] >= 30 else []
            for j, n in enumerate(ns):
                linked = f" <a href='/'>{say(1 + n // 8)}</a>" if j % 3 == 1 else ""
                parts += [(f"<p>{say(n)}{linked}</p>", 1, True)]
                if j == 1:
                    parts += [(f"<div class='{('advert', 'related', 'share', 'newsletter')[i % 4]}'>{say((6, 30, 3, 18)[i % 4])}</div>", 1, False)]
                if j == 2 and a < 3:
                    parts += [(f"<p><a href='/'>{say(3 + 2 * i)}</a></p>", 1, True)]
                    parts += [(f"<ul><li>{say(2)}</li><li>{say(9)}</li></ul>", 2, True), (f"<form>{say(5)}</form>", 1, False), (f"<aside>{say(25)}</aside>", 1, False)]
            parts += [(close, 0, False)]
            parts += [(f"<aside>{say((30, 3)[i % 2])}</aside>", 1, False), (f"<div class='sidebar'><p>{say((4, 35)[i % 2])}</p></div>", 1, False), (f"<form>{say(3)}<button>{say(1)}</button></form>", 2, False)]
            parts += [(f"<section id='comments'><article class='comment'><p>{say((60, 12)[i % 2])}</p></article><div class='comment'>{say(5)}</div></section>", 2, False)]
            parts += [(f"<footer>{say((4, 12, 30)[i % 3])} <a href='/'>{say(2)}</a></footer>", 1, False)]
            out.append(parts)
            # The same text between long and short furniture of each kind, next to its first and last paragraphs.
            text = [p for p in parts if p[2] or p[0] in (open_, close)]
            for j, size in enumerate((1, 6, 14, 28, 55, 110)):
                for k, (left, right) in enumerate((("<nav>", "</nav>"), ("<footer>", "</footer>"), ("<aside>", "</aside>"), ("<form>", "</form>"), ("<div class='ad'>", "</div>"), ("<div id='comments'><p>", "</p></div>"), ("<header>", "</header>"))):
                    other = ("<div class='notice'>", "</div>") if (i + j + k) % 2 else ("<footer>", "</footer>")
                    out.append([(left + say(size) + right, 1, False), *text, (other[0] + say(1 + size * (1 + k) % 90) + other[1], 1, False)])
                    out.append([*text, (left + say(size) + right, 1, False)])
                    out.append([(left + say(size) + right, 1, False), *text])
                out.append([*text, (f"<ul>{links(1 + j)}</ul>", 1 + j, False)])
                # Furniture that no name gives away: around an article of any size, else short, or links.
                plain = size if a < 3 else 1 + j % 3
                out.append([(f"<div>{say(plain)}</div>", 1, False), (f"<ul>{links(5)}</ul>", 5, False), *text, (f"<p>{say(plain)}</p>", 1, False), (f"<div>{links(2)}</div>", 2, False)])
    out += _plain_pages(say) + _short_articles(say) + _notices(say) + _last_lines(say)
    return [("<body>" + "".join(p for p, _, _ in parts) + "</body>", [label for _, n, label in parts for _ in range(n)]) for parts in out]


def _short_articles(say) -> list[list[tuple[str, int, bool]]]:
    """Labelled pages with one paragraph or a few, of any length, and links behind them: what stands in an article stays;
    without one a long paragraph does, and the links go."""
    out: list[list[tuple[str, int, bool]]] = []
    link = lambda n: f"<a href='/'>{say(n)}</a>"
    lists = {
        "p": lambda j: [(f"<p>{link(2 + (3 * j + i) % 9)}</p>", 1) for i in range(1 + j % 3)],
        "ul": lambda j: [("<ul>" + "".join(f"<li>{link(1 + (i + j) % 4)}</li>" for i in range(1 + j % 5)) + "</ul>", 1 + j % 5)],
        "line": lambda j: [("<p>" + " ".join(link(1 + i % 3) for i in range(2 + j % 4)) + "</p>", 1)],
        "div": lambda j: [(f"<div>{say(1 + j % 4)} {link(2 + j % 6)}</div>", 1)],
    }
    lengths = [1, 2, 3, 5, 8, 13, 20, 29, 40, 60, 90, 150]
    for a, (open_, close) in enumerate([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post'>", "</div>"), ("", ""), ("<div>", "</div>")]):
        for j, n in enumerate(lengths):
            for k, (kind, make) in enumerate(lists.items()):
                if a >= 3 and n < 29:
                    continue
                links = [(markup, count, a < 3) for markup, count in make(j + k)]
                text = [(f"<p>{say(n)}</p>", 1, True)]
                more = [(f"<p>{say(lengths[(j + 5) % 12] if a < 3 else 35 + n // 2)}</p>", 1, True)]
                outside = [(f"<nav><ul><li>{link(1)}</li><li>{link(2)}</li></ul></nav>", 2, False)] if (j + k) % 2 else []
                below = [(f"<footer>{say(3 + j)}</footer>", 1, False)] if (j + k) % 3 else []
                for body in ([*text, *links], [*text, *more, *links], [(f"<h1>{say(1 + j % 7)}</h1>", 1, True), *text, *links]) + (([*text, *links, *more], [*links, *text]) if a < 3 else ()):
                    out.append([*outside, (open_, 0, False), *body, (close, 0, False), *below])
    return out


def _last_lines(say) -> list[list[tuple[str, int, bool]]]:
    """Labelled pages that end with a line of some words: behind a long paragraph the text's last, behind a short line that
    is furniture (a name, then an address) furniture as well."""
    out: list[list[tuple[str, int, bool]]] = []
    for j in range(60):
        n, text = 8 + j % 7, [(f"<p>{say(30 + 7 * j % 80)}</p>", 1, True) for _ in range(1 + j % 3)]
        last = (f"<{('p', 'div')[j % 2]}>{say(n)}</{('p', 'div')[j % 2]}>", 1)
        out.append([*text, (*last, True)])
        out.append([*text, (f"<p>{say(2 + j % 4)}</p>", 1, False), (*last, False)])
    return out


def _notices(say) -> list[list[tuple[str, int, bool]]]:
    """Labelled pages with notices that no name gives away, known by their phrases; in an article, and in long paragraphs
    that use one now and then, the same phrases are text."""
    out: list[list[tuple[str, int, bool]]] = []
    cues = ["cookies", "© copyright", "all rights reserved", "privacy policy", "consent", "newsletter"]

    def with_cues(n: int, share: float, j: int) -> str:
        words = ["word"] * n
        for i in range(max(1, round(n * share))):
            words[(7 * i + j) % n] = cues[(i + j) % len(cues)]
        return " ".join(words)

    for j, n in enumerate([6, 9, 12, 16, 20, 25, 30, 33, 40, 50, 60, 75] * 4):
        notice = (f"<{('p', 'div')[j % 2]}>{with_cues(n, 0.07 + 0.03 * (j % 5), j)}</{('p', 'div')[j % 2]}>", 1, False)
        text = [(f"<p>{say(40 + 3 * j)}</p>", 1, True), (f"<p>{say(25 + 9 * j % 90)}</p>", 1, True)]
        seldom = [(f"<p>{with_cues(60 + 2 * j, 0.02, j)}</p>", 1, True), (f"<p>{say(70)}</p>", 1, True)]
        inside = [(f"<p>{with_cues(n, 0.07 + 0.03 * (j % 5), j)}</p>", 1, True)]
        for around in (("<article>", "</article>"), ("<main>", "</main>")):
            out.append([(around[0], 0, False), *text, *inside, (around[1], 0, False), notice])
            out.append([notice, (around[0], 0, False), *inside, *text, (around[1], 0, False)])
        out += [[*text, notice], [notice, *text], [*seldom, notice], [*text, *seldom], [notice, *seldom, notice]]
    return out


def _plain_pages(say) -> list[list[tuple[str, int, bool]]]:
    """Labelled pages on which neither tags nor names tell text from furniture: lengths, links and neighbours do. The
    furniture is short or full of links and stands together; a short paragraph has long ones around it."""
    out: list[list[tuple[str, int, bool]]] = []
    anchor = lambda n: f"<a href='/'>{say(n)}</a>"
    for i in range(240):
        size = lambda low, high, step: low + (i * step + step // 2) % (high - low)  # noqa: B023, E731
        menus = (
            [(f"<p>{anchor(1 + j % 4)}</p>", 1, False) for j in range(size(2, 9, 5))],
            [("<p>" + " / ".join(anchor(1 + j % 3) for j in range(size(2, 10, 3))) + "</p>", 1, False)],
            [(f"<li>{anchor(2 + j % 2)}</li>", 1, False) for j in range(size(3, 8, 7))],
            [(f"<div>{say(size(1, 4, 3))} {anchor(size(2, 6, 5))}</div>", 1, False)],
        )
        parts: list[tuple[str, int, bool]] = [(f"<p>{say(size(1, 11, 7))}</p>", 1, False)] if i % 3 else [(f"<div>{anchor(size(1, 5, 3))}</div>", 1, False)]
        parts += menus[i % 4]
        parts += [(f"<p>{say(size(1, 11, 3))}</p>", 1, False)] if i % 5 < 3 else []
        parts += [(f"<h1>{say(size(2, 12, 7))}</h1>", 1, True)]
        for j in range(size(1, 7, 5)):
            n = 16 + (i * 37 + j * 53) % 150
            links = f" {anchor(1 + (i + j) % 5)} {say(3)}" if (i + j) % 3 == 0 else ""
            parts += [(f"<p>{say(n)}{links}</p>", 1, True)]
            if (i + 2 * j) % 5 == 0:  # a short one inside
                parts += [(f"<p>{say(3 + (i + j) % 12)}</p>", 1, True), (f"<p>{say(25 + n // 2)}</p>", 1, True)]
            if (i + j) % 7 == 0:
                parts += [(f"<h2>{say(2 + j)}</h2>", 1, True), (f"<p>{say(40 + n // 3)}</p>", 1, True)]
        parts += [(f"<p>{anchor(3 + (i + j) % 9)}</p>", 1, False) for j in range(size(2, 6, 3))] if i % 2 else []
        parts += menus[(i // 4) % 4] if i % 7 < 5 else []
        parts += [(f"<p>{say(size(2, 12, 5))} {anchor(size(1, 4, 3))}</p>", 1, False)] if i % 4 else [(f"<div>{say(size(2, 12, 5))}</div>", 1, False)]
        out.append(parts)
    return out


@lru_cache(maxsize=1)
def trained():
    """The tree grown on the labelled table."""
    x, y = [], []
    for page, labels in labelled_pages():
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError("labels do not match the blocks")
        x.append(features(found))
        y.append(np.array(labels, float))
    return grow(np.concatenate(x), np.concatenate(y))


def main_text(page: str | None, tree=None) -> str:
    found = blocks(page)
    if not found:
        return ""
    tree = trained() if tree is None else tree
    return "\n".join(b.text for b, row in zip(found, features(found).tolist(), strict=True) if accepts(tree, row))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points): a row for each row of pages. A null page counts as empty; a page
    without main text has empty text. Pages are read whole, however long; repeated rows give equal rows. An empty table
    gives no rows; other columns are not looked at."""

    tree = trained()  # once, on the driver: a few nested tuples

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                texts = [main_text(p, tree) for p in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(read, f"page_id {dict(own.dtypes)['page_id']}, url string, text string, n_chars long")


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
