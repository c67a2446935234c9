"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't shown as text.
UNSEEN = frozenset("audio button canvas datalist head iframe input math noscript object option script select style svg template textarea title video".split())
#: Elements that seldom hold main text: evidence against what is in them, as the words of LABELS are.
AGAINST = frozenset("aside dialog footer form header label menu nav search".split())
#: Words of class and id names that are evidence against an element.
LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright discussion disqus footer gdpr header "
    "links login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion recommended related replies reply "
    "respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget".split()
)
_NEGATED = frozenset("has no with without".split())
#: Evidence doesn't count against these elements themselves.
_FRAME = frozenset("html body main article".split())
#: Start tags that end an open element of the second kind, unless one of the third kind stands between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"})}
_ENDS |= {"tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|xmp)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^<>]*)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<[a-zA-Z/][^<>]*\Z"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
#: The prior of a path: what evidence against an element leaves of its score, and what an article or main element makes of it.
SUSPECT, FRAMED = 0.02, 2.0
#: Scores below this are no main text on any page: about that of six letters without punctuation.
FLOOR = 1.0
#: Share of the chosen text that the container of the main text holds, and elements that can be one.
HELD = 0.9
_CONTAINERS = frozenset("article main section div td body html".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PUNCT = re.compile(r"[.,;:!?…。，！？；：]")


def _told(rest: str) -> tuple[bool, bool]:
    """Whether a tag's attributes hide its element, and whether its class, id or role has a label's name."""
    hidden = labelled = False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            for name in value.lower().split():
                parts = re.split(r"[-_]+", name)
                labelled |= parts[0] not in _NEGATED and not LABELS.isdisjoint(parts)
        else:
            hidden |= key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and bool(_UNSEEN.search(value))
    return hidden, labelled


@dataclass
class Page:
    """Text nodes (block, element, text) in page order, character references still in the text; per element its parent (before it), tag, whether
    there is evidence against it, its path's number and prior. Element 0 is the page."""

    nodes: list[tuple[int, int, str]]
    parent: list[int]
    tag: list[str]
    against: list[bool]
    path: list[int] = field(default_factory=list)
    prior: list[float] = field(default_factory=list)

    def total(self, of_nodes: Iterable[tuple[int, float]]) -> list[float]:
        """Of every element the sum of what nodes in it have."""
        out = [0.0] * len(self.parent)
        for e, n in of_nodes:
            out[e] += n
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


def parse(text: str) -> Page:
    """Cut a page into text nodes; every step looks at the ends of a few lists of open elements only, so the time follows the page's length."""
    page = Page([], [0], [""], [False])
    stack: list[int] = [0]
    unseen = [False]
    places: dict[str, list[int]] = {}
    block = 0

    def shut(at: int) -> None:
        while len(stack) > at:
            places[page.tag[stack.pop()]].pop()
            unseen.pop()

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: Iterable[str], barrier: Iterable[str] = ()) -> None:
        if (at := last(tags)) > last(barrier):
            shut(at)

    for m in _TOKEN.finditer(text):
        if (found := m["text"]) is not None:
            if not unseen[-1]:
                page.nodes.append((block, stack[-1], found))
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, rest = tag.lower(), m["rest"] or m["rest2"] or ""
        if tag in BLOCKS:
            block += 1
        elif tag == "br" and not unseen[-1]:
            page.nodes.append((block, stack[-1], " "))
        if m["end"] or m["end2"]:
            close((tag,))
            continue
        if tag in BLOCKS:
            close(("p",), [t for t in ("table", "button", "article", "section", "div", "body") if t != tag] if tag != "p" else ("table", "button"))
        if tag in _ENDS:
            close(*_ENDS[tag])
        if tag in VOID:
            continue
        hidden, labelled = _told(rest) if rest else (False, False)
        places.setdefault(tag, []).append(len(stack))
        page.parent.append(stack[-1])
        page.tag.append(tag)
        page.against.append((labelled or tag in AGAINST) and (tag not in _FRAME or labelled and tag in ("article", "main")))
        stack.append(len(page.parent) - 1)
        unseen.append(unseen[-1] or tag in UNSEEN or hidden and tag not in _FRAME)
    _weigh(page)
    return page


def _weigh(page: Page) -> None:
    """Paths and priors. Evidence against an element counts for nothing if it holds most of the text of article and main elements, or, for labels and
    forms, most of the page's text unless article and main elements without evidence against them hold over a fifth as much; on article
    and main elements it only takes their own advantage."""
    n = len(page.parent)
    frame = [t in ("article", "main") and not a for t, a in zip(page.tag, page.against)]
    framed, doubted = frame[:], [a and t not in _FRAME for t, a in zip(page.tag, page.against)]
    for e in range(1, n):
        framed[e] |= framed[page.parent[e]]
        doubted[e] |= doubted[page.parent[e]]
    size = [(e, float(len(text.strip()))) for _, e, text in page.nodes]
    held = page.total(size)
    all_framed = sum(s for e, s in size if framed[e])
    outside = sum(s for e, s in size if framed[e] and not doubted[e])
    inner = [0.0] * n
    for e in range(n - 1, 0, -1):
        inner[page.parent[e]] += held[e] if frame[e] else inner[e]
    page.path, page.prior = [0] * n, [1.0] * n
    numbers: dict[tuple[int, str, bool], int] = {}
    for e in range(1, n):
        up = page.parent[e]
        most = (page.tag[e] not in AGAINST or page.tag[e] == "form") and 2 * held[e] > held[0] and 5 * outside <= held[e]
        suspect = page.against[e] and page.tag[e] not in _FRAME and 2 * inner[e] <= all_framed and not most
        page.path[e] = numbers.setdefault((page.path[up], page.tag[e], suspect), len(numbers) + 1)
        page.prior[e] = max(page.prior[up] * (SUSPECT if suspect else FRAMED if frame[e] and not framed[up] else 1.0), SUSPECT**3)


def path_scores(page: np.ndarray, path: np.ndarray, length: np.ndarray, punct: np.ndarray) -> np.ndarray:
    """Score of each text node's tag path, for the nodes of many pages in page order.

    Per page and path: text length and punctuation per node; both smoothed over neighbouring nodes of the page, fused as a
    geometric mean, and averaged over the path's nodes."""
    _, key = np.unique(np.stack([page, path]), axis=1, return_inverse=True)
    key = key.ravel()
    nodes = np.bincount(key)
    ratios = [np.bincount(key, x)[key] / nodes[key] for x in (length, punct)]
    smooth = []
    for values in ratios:
        total, weight = values.copy(), np.ones(len(values))
        for d, w in ((1, 0.6), (2, 0.15)):
            same = page[d:] == page[:-d]
            total[d:] += w * same * values[:-d]
            total[:-d] += w * same * values[d:]
            weight[d:] += w * same
            weight[:-d] += w * same
        smooth.append(total / weight)
    fused = np.sqrt(np.sqrt(ratios[0] * smooth[0]) * (0.2 + np.sqrt(ratios[1] * smooth[1])))
    return np.bincount(key, fused)[key] / nodes[key]


def main_blocks(texts: list[str], threshold: float = 0.5) -> list[str]:
    """The main text of each page: blocks joined by newlines.

    Nodes are chosen by the score of their path, the fused ratios times the path's prior, if it is at least `threshold` times the page's
    text-weighted mean. With them go the nodes without evidence against them that share their container (`_taken`), as headings do."""
    pages = [parse(t) for t in texts]
    flat = [(k, block, e, html.unescape(text)) for k, p in enumerate(pages) for block, e, text in p.nodes]
    real = [(i, k, e, len(s), len(_PUNCT.findall(s))) for i, (k, _, e, text) in enumerate(flat) if (s := text.strip())]
    if not real:
        return [""] * len(texts)
    page, length, punct = (np.array([x[j] for x in real]) for j in (1, 3, 4))
    path, prior = np.array([pages[k].path[e] for _, k, e, *_ in real]), np.array([pages[k].prior[e] for _, k, e, *_ in real])
    score = path_scores(page, path, length.astype(float), punct.astype(float)) * prior
    mass = np.bincount(page, length, minlength=len(pages))
    bar = threshold * np.bincount(page, length * score, minlength=len(pages)) / np.maximum(mass, 1)
    chosen: list[dict[int, int]] = [{} for _ in pages]
    for j in np.flatnonzero((score >= bar[page]) & (score >= FLOOR)):
        chosen[page[j]][real[j][0]] = int(length[j])
    nodes: list[list[tuple[int, int, int, str]]] = [[] for _ in pages]
    for i, (k, block, e, text) in enumerate(flat):
        nodes[k].append((i, block, e, text))
    out = []
    for k, p in enumerate(pages):
        blocks: dict[int, list[str]] = {}
        for block, text in _taken(p, nodes[k], chosen[k]):
            blocks.setdefault(block, []).append(text)
        out.append("\n".join(s for b in sorted(blocks) if (s := " ".join("".join(blocks[b]).split()))))
    return out


def _taken(page: Page, nodes: list[tuple[int, int, int, str]], chosen: dict[int, int]) -> Iterator[tuple[int, str]]:
    """(block, text) of the chosen nodes and of those in their container: the article, main or smallest sectioning element that holds HELD of the chosen
    text. Where that is the whole body, only what stands between chosen nodes goes along, and headings before them."""
    if not chosen:
        return
    total = page.total((e, chosen[i]) for i, _, e, _ in nodes if i in chosen)
    top = 0
    for e in range(1, len(total)):
        if page.parent[e] == top and total[e] >= HELD * total[0]:
            top = e
    while top and page.tag[top] not in _CONTAINERS:
        top = page.parent[top]
    up = top
    while up and not (page.tag[up] in ("article", "main") and page.prior[up] > SUSPECT):
        up = page.parent[up]
    top = up or top
    inside = [False] * len(page.parent)
    heading = inside[:]
    for e in range(len(inside)):
        inside[e] = e == top or e > 0 and inside[page.parent[e]]
        heading[e] = page.tag[e] in _HEADINGS or e > 0 and heading[page.parent[e]]
    kept = [i in chosen or inside[e] and page.prior[e] > 2 * SUSPECT for i, _, e, _ in nodes]
    if page.tag[top] in ("", "html", "body"):
        at = [j for j, (i, *_) in enumerate(nodes) if i in chosen]
        first, last = at[0], at[-1]
        while first and (heading[nodes[first - 1][2]] or not nodes[first - 1][3].strip()):
            first -= 1
        kept = [x and first <= j <= last for j, x in enumerate(kept)]
    blocks = {block for (_, block, _, _), x in zip(nodes, kept) if x}
    for (_, block, e, text), x in zip(nodes, kept):
        # White space between the parts of a block belongs to it.
        if x or block in blocks and not text.strip():
            yield block, text


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), threshold: float = 0.5) -> DataFrame:
    """Per row of `pages`: the columns of `keep`, text and n_chars (code points).

    Pages are cut into text nodes in tasks, a batch of rows at a time; ratios, smoothing and thresholds are array operations over
    the batch. Nothing is shuffled.

    Cases: null and empty pages give an empty text, and so do pages without text outside menus and the like; pages cut off in the
    middle are read as far as they go; repeated rows give repeated results; other columns are ignored; a column of `keep` named as a
    result is an error; an empty table gives an empty result.
    """
    if {"text", "n_chars"} & set(keep):
        raise ValueError("columns to keep have the names of results")
    kept = [pages.schema[c] for c in keep]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts: list[str] = []
            for at in range(0, len(batch), 256):
                texts += main_blocks([x or "" for x in batch["__html"].iloc[at : at + 256]], threshold)
            yield batch[list(keep)].assign(text=texts, n_chars=[len(x) for x in texts])

    return pages.select(*keep, F.col(html_col).alias("__html")).mapInPandas(run, schema)
