"""Inline styles in the markup of scripts, for one text, called inside tasks."""

from __future__ import annotations

import hashlib

from .syntax import Tokens


def printed(t: Tokens, first: int, stop: int) -> str:
    """The tokens from `first` to `stop` with single spaces between, without comments and the comma before a closing bracket: however it was laid out."""
    kept = [t.text[i] for i in range(first, stop) if not (t.is_(i, ",") and i + 1 < stop and t.is_(i + 1, ")", "]", "}"))]
    return " ".join(kept)


def _attributes(t: Tokens, i: int) -> list[tuple[str, int, int]]:
    """(name, first, stop) of the attributes of the element that begins at token i; a spread one has no name."""
    out, outer = [], t.parent[i]
    i += 1
    while i < len(t) and t.kind[i] in ("word", "punct") and t.is_(i + 1, ".", "-", ":"):
        i += 2
    i += i < len(t) and t.kind[i] == "word"
    depth = 0
    while t.is_(i, "<") or depth:
        depth += t.is_(i, "<") - t.is_(i, ">")
        i += 1
        if i >= len(t):
            return out
    while i < len(t) and t.parent[i] == outer and not t.is_(i, ">", "/"):
        first = i
        if t.is_(i, "{"):
            i = t.after(i)
            out.append(("", first, i))
            continue
        while t.is_(i + 1, "-", ":"):
            i += 2
        i += 1
        if t.is_(i, "="):
            i = t.after(i + 1)
        out.append(("".join(t.text[k] for k in range(first, i) if k < i).split("=")[0], first, i))
    return out


def _style_properties(t: Tokens, opened: int) -> list[tuple[int, int]]:
    """(first, stop) of the properties named style of the object written out in a spread, `{...{ style: x }}`."""
    inner = opened + 2
    if not (t.is_(opened + 1, "...") and t.is_(inner, "{") and t.after(inner) == t.pair[opened]):
        return []
    out, i, end = [], inner + 1, min(t.pair[inner], len(t))
    while i < end:
        first = i
        while i < end and not t.is_(i, ","):
            i = t.after(i)
        if t.text[first].strip("\"'") == "style" and t.kind[first] in ("word", "string") and (first + 1 == i or t.is_(first + 1, ":", "(")):
            out.append((first, i))
        i += 1
    return out


def inline_styles(source: str | None) -> list[tuple[int, str]]:
    """(line, SHA-256 of the printed node) of every style attribute, and every style property of an object spread into an element."""
    t = Tokens(source, markup=True)
    found = []
    for element in t.elements:
        for name, first, stop in _attributes(t, element):
            if name == "style":
                found.append((first, stop))
            elif not name:
                found += _style_properties(t, first)
    return [(t.line(t.start[a]), hashlib.sha256(printed(t, a, b).encode()).hexdigest()) for a, b in sorted(found)]
