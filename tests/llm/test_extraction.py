"""Main texts of pages that are put together from parts whose text is known."""

from __future__ import annotations

import html
import random

import pytest

from frameline.llm.html_extract import main_text

WORDS = "the of and to in a is that it was for on with as his they at be this from house river stone letter winter garden market teacher window mountain engine picture question answer".split()


def sentence(chance: random.Random, n: int) -> str:
    return (" ".join(chance.choice(WORDS) for _ in range(n)) + ".").capitalize()


def paragraph(chance: random.Random) -> str:
    return " ".join(sentence(chance, chance.randint(9, 16)) for _ in range(chance.randint(3, 6)))


def shown(text: str, chance: random.Random) -> str:
    """The text as markup that reads as it: references, line ends for spaces, inline elements, comments."""
    words = [f"<b>{html.escape(w)}</b>" if chance.random() < 0.05 else html.escape(w) for w in text.split(" ")]
    out = "".join(w + (chance.choice([" ", " ", " ", "\n  ", " <!-- c --> "]) if k + 1 < len(words) else "") for k, w in enumerate(words))
    return out.replace("house", "hous&#101;")


def around(chance: random.Random) -> tuple[list[str], list[str]]:
    """Parts before and after an article, none of which is main text."""
    links = "".join(f'<li><a href="/{k}">{sentence(chance, 2)}</a></li>' for k in range(6))
    before = [f"<nav><ul>{links}</ul></nav>", f'<header><a href="/">Site</a><p>{sentence(chance, 5)}</p></header>', f'<div class="cookie-notice"><p>{paragraph(chance)}</p></div>', f'<form action="/s"><label>Search</label><input name=q><p>{sentence(chance, 6)}</p></form>', f"<script>var a = '<p>{paragraph(chance)}</p>';</script>"]
    after = [f"<footer><p>{paragraph(chance)}</p></footer>", f'<aside class="sidebar"><p>{paragraph(chance)}</p></aside>', f'<div id="reader-comments"><p>{paragraph(chance)}</p><p>{paragraph(chance)}</p></div>', f'<section class="cc-window"><p>{paragraph(chance)}</p></section>', f'<div class="related-posts"><ul>{links}</ul></div>', f'<div style="display:none"><p>{paragraph(chance)}</p></div>']
    return chance.sample(before, chance.randint(0, 3)), chance.sample(after, chance.randint(0, 4))


@pytest.mark.parametrize("wrap", ["{}", "<article>{}</article>", "<main>{}</main>", '<div class="content-with-sidebar">{}</div>', '<form id="aspnetForm" method="post">{}</form>'])
@pytest.mark.parametrize("head", ["<html><head><title>Title</title><style>p {}</style></head><body>", "<html><head><title>Title</title><meta charset=utf-8><body>", "<!doctype html>"])
def test_pages_of_known_parts(wrap, head):
    for seed in range(40):
        chance = random.Random(f"{wrap}{head}{seed}")
        blocks = [sentence(chance, 4).removesuffix(".")] + [paragraph(chance) for _ in range(chance.randint(2, 5))]
        body = f"<h1>{shown(blocks[0], chance)}</h1>" + "".join(f"<p>{shown(b, chance)}</p>\n" if chance.random() < 0.8 else f"<p>{shown(b, chance)}" for b in blocks[1:])
        before, after = around(chance)
        if "form" in wrap:  # all of the page is in the form, but forms are not put into forms
            page = head + wrap.replace("{}", "".join(p for p in before if "<form" not in p) + body + "".join(after)) + "</body></html>"
        else:
            page = head + "".join(before) + wrap.replace("{}", body) + "".join(after) + "</body></html>"
        assert main_text(page) == "\n".join(blocks), page


def test_headers_of_the_article_and_of_the_site():
    p = paragraph(random.Random(1))
    own = f'<body><header><h2>Site</h2></header><header class="entry-header"><h1>Headline</h1><span>by somebody</span></header><p>{p}</p><p>{p}</p></body>'
    assert main_text(own) == f"Headline\n{p}\n{p}"
    named = f'<body><div class="article-header"><h1>Headline</h1></div><p>{p}</p><div class="post-comments"><p>{p}</p></div><div class="article-share"><p>{p}</p></div></body>'
    assert main_text(named) == f"Headline\n{p}"


def test_pages_of_nothing_else():
    p = paragraph(random.Random(2))
    assert main_text(f"<body><footer><p>{p}</p></footer></body>") == p  # better than nothing
    assert main_text(f"<head><title>t</title>{p}") == p
    assert main_text("<nav><a href=x>Home</a></nav>") == "" == main_text(f"<script>{p}</script>") == main_text(None)
