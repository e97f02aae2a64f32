"""Held-out pages on which markup says nothing: no article, no telling element or name. Word counts and link densities of
blocks and their neighbours have to decide."""

from __future__ import annotations

import random
import time

from pollveil.llm import htmltext

VOCABULARY = "river stone market winter letter garden window village music season captain engine harbour forest people story number evening company result".split()


def say(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def plain_page(seed: int) -> tuple[str, list[bool]]:
    """A page of divs, paragraphs, tables and lists, and whether each of its blocks is main text."""
    rng = random.Random(seed)
    parts: list[tuple[str, bool]] = []
    link = lambda n: f"<a href='/{rng.randrange(999)}'>{say(rng, n)}</a>"

    def menu() -> None:
        style = rng.randrange(3)
        if style == 0:
            parts.extend((f"<li>{link(rng.randint(1, 3))}</li>", False) for _ in range(rng.randint(3, 9)))
        elif style == 1:
            parts.append(("<div>" + " | ".join(link(rng.randint(1, 2)) for _ in range(rng.randint(3, 8))) + "</div>", False))
        else:
            parts.extend((f"<td>{link(rng.randint(1, 2))}</td>", False) for _ in range(rng.randint(3, 7)))

    parts.append((f"<div>{link(2)}</div>", False))
    menu()
    if rng.random() < 0.6:
        parts.append((f"<div>{say(rng, rng.randint(2, 8))}</div>", False))
    for i in range(rng.randint(2, 9)):
        if i == 0 or rng.random() < 0.15:
            parts.append((f"<h{1 + (i > 0)}>{say(rng, rng.randint(3, 9))}</h{1 + (i > 0)}>", True))
        n = rng.randint(18, 140)
        linked = f" {link(rng.randint(1, 4))} {say(rng, 6)}" if rng.random() < 0.4 else ""
        parts.append((f"<p>{say(rng, n)}{linked}.</p>", True))
        if rng.random() < 0.15:
            parts.append((f"<p>{say(rng, rng.randint(5, 12))}.</p><p>{say(rng, rng.randint(30, 70))}.</p>", True))
    if rng.random() < 0.5:
        parts.extend((f"<li>{link(rng.randint(4, 9))}</li>", False) for _ in range(rng.randint(3, 6)))
    if rng.random() < 0.7:
        menu()
    parts.append((f"<div>&copy; {say(rng, rng.randint(2, 7))} {link(2)}</div>", False))
    labels = [label for part, label in parts for _ in range(2 if part.count("<p>") == 2 else 1)]
    return "<html><body>" + "".join(p for p, _ in parts) + "</body></html>", labels


def scores(pages: range) -> tuple[float, float]:
    hits = said = true = 0
    for seed in pages:
        page, labels = plain_page(seed)
        found = htmltext.blocks(page)
        assert len(found) == len(labels)
        got = [htmltext.accepts(htmltext.trained(), row) for row in htmltext.features(found).tolist()]
        hits += sum(a and b for a, b in zip(got, labels, strict=True))
        said, true = said + sum(got), true + sum(labels)
    return hits / max(1, said), hits / true


def test_pages_without_telling_markup():
    precision, recall = scores(range(400))
    assert 2 * precision * recall / (precision + recall) >= 0.9


def used(tree) -> set[str]:
    return set() if isinstance(tree, bool) else {htmltext.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def test_neighbours_take_part():
    assert {"words", "link_density", "words_before", "words_after", "density_before", "density_after"} <= used(htmltext.trained())


def test_end_tags_take_linear_time():
    def seconds(n: int) -> float:
        page = "<div>" * n + "</section>" * n + "<p>x</p>"
        begin = time.perf_counter()
        htmltext.blocks(page)
        return time.perf_counter() - begin

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.01)


def test_names_that_only_contain_those_of_furniture():
    long = "A paragraph of the article with a good number of words in it, as there are in any article of this kind."
    for name in ("search-engines", "header-image", "share-prices", "login-history"):
        assert htmltext.main_text(f"<article><p>One.</p><div class='{name}'><p>{long}</p></div></article>") == f"One.\n{long}", name
    for name in ("search-form", "site-header", "share-buttons", "login", "comment-12", "related-posts", "ad-slot", "cookie-law"):
        assert htmltext.main_text(f"<article><p>One {long}</p></article><div class='{name}'><p>{long}</p></div>") == f"One {long}", name
