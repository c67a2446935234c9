"""Tag-path ratios of web pages: against a plain version, at other thresholds, and on awkward pages."""

import re
import time

import numpy as np
import pytest

from tessella.llm.html_text import _PUNCT, main_blocks, parse, path_scores

LONG = "A sentence that says something, with a comma or two, as articles do. And another one, which goes on."
PLAIN = f"<html><body><div><a href=x>Home</a></div><div><p>{LONG}</p><p>{LONG} More, of it.</p><p>Short, too.</p></div><table><tr><td>Posted by me</td></tr></table><div><span>Contact us</span></div></body></html>"


def test_ratios_decide():
    """Without a label or an article element: a threshold of nothing takes all, a common one the text, a high one nothing."""
    every, text, none = (main_blocks([PLAIN], t)[0] for t in (0.0, 0.5, 9.0))
    assert "Home" in every and "Contact us" in every and "Posted by me" in every
    assert text == f"{LONG}\n{LONG} More, of it.\nShort, too."
    assert none == ""


def test_scores_against_plain_sums():
    pages = [PLAIN, f"<p>{LONG}</p><ul><li>one<li>two, three</ul><p>{LONG}</p>", "<b>x</b>"]
    nodes = [[(p.path[e], len(s), len(_PUNCT.findall(s))) for _, e, t in p.nodes if (s := t.strip())] for p in map(parse, pages)]
    want = []
    for page in nodes:
        mean = [{k: np.mean([x[i] for x in page if x[0] == k]) for k in {x[0] for x in page}} for i in (1, 2)]
        ratio = [[m[x[0]] for x in page] for m in mean]
        weight = {-2: 0.15, -1: 0.6, 0: 1, 1: 0.6, 2: 0.15}
        near = lambda r, i: [(w, r[i + d]) for d, w in weight.items() if 0 <= i + d < len(r)]
        smooth = [[sum(w * x for w, x in near(r, i)) / sum(w for w, _ in near(r, i)) for i in range(len(r))] for r in ratio]
        fused = [((ratio[0][i] * smooth[0][i]) ** 0.5 * (0.2 + (ratio[1][i] * smooth[1][i]) ** 0.5)) ** 0.5 for i in range(len(page))]
        want += [np.mean([f for f, y in zip(fused, page) if y[0] == x[0]]) for x in page]
    flat = [(k, *x) for k, page in enumerate(nodes) for x in page]
    got = path_scores(*(np.array([x[i] for x in flat], dtype=float if i > 1 else int) for i in range(4)))
    assert got == pytest.approx(want)


AWKWARD = {
    "nested": "<div>" * 100_000 + LONG, "nested with labels": "<div class=ad>" * 100_000 + LONG, "unclosed": "<a " * 100_000, "spans below a list": "<div><p>" + "<span>" * 50_000 + "<ul></ul></x>" * 20_000 + LONG,
    "quotes": "<a \"" * 50_000 + "<b '" * 50_000, "ends": "<p>" + "<b>" * 50_000 + "</i></ul>" * 50_000 + LONG, "half a comment": "<!-" * 100_000,
}


@pytest.mark.parametrize("page", AWKWARD.values(), ids=AWKWARD)
def test_time_follows_length(page):
    began = time.time()
    text = main_blocks([page])[0]
    assert time.time() - began < 20
    assert not text or LONG in text


def test_evidence(spark):
    """A footer longer than the article, a form around all, a header within the article, references, blank pages."""
    body = f"<h1>Title</h1><p>{LONG}</p>"
    assert main_blocks([f"<nav><a>x</a></nav><article><h1>Oh.</h1><p>Oh.</article><footer>&copy; us. {LONG}</footer>"]) == ["Oh.\nOh."]
    assert main_blocks([f"<form><div>{body}</div></form>"]) == [f"Title\n{LONG}"]
    assert main_blocks([f"<article><header>By me, today. All rights, and so on.</header>{body}</article>"]) == [f"Title\n{LONG}"]
    assert main_blocks(["<nav><a>Home</a></nav><footer>&copy; me.</footer>", "", " \n", f"<div>{LONG} &amp; &#x41;\n\t b</div>"]) == ["", "", "", f"{LONG} & A b"]
    assert re.fullmatch(r"(Word, word\.\n?)+", main_blocks(["<main>" + "<p>Word, word.</p>" * 3 + "</main>"])[0])
