"""What stands in an article stays, however short it is and whatever follows; notices and hidden text go."""

from __future__ import annotations

import pytest

from pollveil.llm import htmltext


def words(n):
    return " ".join(f"w{i}" for i in range(n))


LINKS = ["<p><a href='/x'>Read more on this topic here</a></p>", "<ul><li><a href='/'>one</a></li><li><a href='/'>two more</a></li></ul>", "<p><a href='/'>a</a> <a href='/'>b c</a></p>" * 3]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 29, 60, 90, 150])
@pytest.mark.parametrize("links", LINKS)
@pytest.mark.parametrize("tag", ["article", "main"])
def test_a_paragraph_before_links_stays(n, links, tag):
    for before, after in (("", ""), ("<nav><a href='/'>home</a></nav>", "<footer>end</footer>"), ("<h1>Title of it</h1>", "")):
        for page in (f"{before}<{tag}><p>{words(n)}</p>{links}</{tag}>{after}", f"{before}<{tag}><p>{words(n)}</p>{links}<p>{words(40)}</p></{tag}>{after}"):
            assert words(n) in htmltext.main_text(f"<body>{page}</body>").split("\n")


def test_a_long_paragraph_before_links_stays_without_an_article():
    for n in (30, 60, 150):
        for links in LINKS:
            assert htmltext.main_text(f"<body><p>{words(n)}</p>{links}</body>") == words(n)


TEXT = f"<p>{words(60)}</p><p>{words(40)}</p>"
PLAIN = f"{words(60)}\n{words(40)}"
RIGHTS = "<p>© 2024 Example Company. All rights reserved. No part of this site may be copied.</p>"
COOKIES = "<div>We use cookies to give you the best experience on our site. By going on you consent to our use of cookies as our privacy policy says, and you can change your settings at any time here.</div>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p data='x>text here", "text here"),
        ('<article><p class="x>one</p><p>two</p></article>', "one\ntwo"),
        ("<article><p style='display:none'>no</p><p>yes</p><h2 hidden>no</h2>tail</article>", "yes\ntail"),
        ("<article><p>a <span hidden>b <span>x</span> c</span> d <b aria-hidden='true'>e</b>f</p><p>g</p></article>", "a d f\ng"),
        ("<article><p>never <span hidden>closed</p><p>next</p></article>", "never\nnext"),
        (f"<body>{TEXT}{RIGHTS}</body>", PLAIN),
        (f"<body>{COOKIES}{TEXT}</body>", PLAIN),
        (f"<body><article>{TEXT}</article>{RIGHTS}{COOKIES}</body>", PLAIN),
        (f"<article>{TEXT}<p>Cookies are small files. Cookies need consent.</p></article>", PLAIN + "\nCookies are small files. Cookies need consent."),
        (f"<article><div class='widget-text'><p>{words(20)}</p></div><div class='promotion'><p>{words(12)}</p></div></article>", f"{words(20)}\n{words(12)}"),
        (f"<body><div class='widget'>{words(30)}</div><article>{TEXT}</article></body>", PLAIN),
    ],
)
def test_pages(page, want):
    assert htmltext.main_text(page) == want
