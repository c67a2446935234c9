"""What a Rust source says of its scopes, read from its tokens: items, modules, uses, and chains of names; helpers for one text, called inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .syntax import COMMENT_EDGE, RUST_WORDS, Tokens

#: Words that are no names, and types that belong to no scope, fixed by the language.
KEYWORDS = frozenset(
    "as async await break const continue dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return static struct trait true type unsafe use where while yield "
    "bool char f32 f64 i8 i16 i32 i64 i128 isize str u8 u16 u32 u64 u128 usize".split()
)
ITEMS = frozenset("const enum fn mod static struct trait type union".split())

#: What tells where an item ends: comments, strings and words are passed over, brackets nest.
_ITEM_EDGE = re.compile(r"//[^\n]*|(?P<comment>/\*)|" + RUST_WORDS + r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<stop>;)", re.DOTALL)
#: Characters from which on a source is read in pieces; a piece of this size takes some 20 MB while it is read.
PIECE = 100_000


def item_pieces(source: str | None, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of at least `size` characters, cut on line ends behind outermost items: what `scope_facts` finds in the pieces is what it finds in the whole."""
    source = (source or "").replace("\r\n", "\n").replace("\r", "\n")
    begun, at, open_ = 0, 0, []
    while len(source) - begun > size and (found := _ITEM_EDGE.search(source, at)):
        at = found.end()
        if found["comment"]:
            depth = 1
            while depth and (edge := COMMENT_EDGE.search(source, at)):
                depth, at = depth + (1 if edge[0] == "/*" else -1), edge.end()
            if depth:
                break
        elif found["open"]:
            open_.append({"(": ")", "[": "]", "{": "}"}[found["open"]])
        elif found["close"] or found["stop"]:
            if found["close"] in open_:
                del open_[len(open_) - 1 - open_[::-1].index(found["close"]) :]
            if not open_ and at - begun >= size and source.startswith("\n", at) and found[0] in "};":
                yield source[begun : at + 1]
                begun = at = at + 1
    yield source[begun:]


def _path_token(t: Tokens, i: int) -> bool:
    return t.kind[i] == "word" and t.text[i][0] != "'" and t.text[i] not in KEYWORDS


def use_leaves(t: Tokens, first: int, stop: int, prefix: tuple[str, ...] = ()) -> list[dict]:
    """The leaves of a use tree: segments, the name that each binds (null: none), whether it takes everything."""
    out, segments, alias, bound, plain = [], list(prefix), None, False, True

    def end() -> None:
        if plain and len(segments) > len(prefix):
            path = segments[:-1] if segments[-1] == "self" and len(segments) > 1 else segments
            out.append({"segments": path, "name": alias if bound else path[-1], "wildcard": False})

    i = first
    while i < stop:
        if t.is_(i, ","):
            end()
            segments, alias, bound, plain = list(prefix), None, False, True
        elif t.is_(i, "{"):
            out += use_leaves(t, i + 1, min(t.pair[i], len(t)), tuple(segments))
            plain = False
        elif t.is_(i, "*"):
            out.append({"segments": list(segments), "name": None, "wildcard": True})
            plain = False
        elif t.is_(i, "as") and i + 1 < stop:
            alias, bound = (None if t.text[i + 1] == "_" else t.text[i + 1]), True
            i += 1
        elif t.is_(i, "::"):
            segments += ["::"] if not segments else []
        elif t.kind[i] == "word":
            segments.append(t.text[i])
        i = t.after(i)
    end()
    return out


def _statement_end(t: Tokens, i: int, stop: int) -> int:
    while i < stop and not t.is_(i, ";"):
        i = t.after(i)
    return min(i, stop)


def _public(t: Tokens, i: int) -> bool:
    """Whether `pub` at token i reaches beyond the scope itself."""
    return not (t.is_(i + 1, "(") and t.is_(i + 2, "self") and t.is_(i + 3, ")"))


def scope_facts(source: str | None, bodies: bool = True) -> list[dict]:
    """One entry for the file and one for each module written out in it: scope (its names, outermost first), items (name, public, declared),
    modules (name, inline), uses (leaves), paths (chains of two names or more outside `use`, in macros as elsewhere).

    Without `bodies`, what is in brackets is passed over unless it is a module's: items and modules are the same, uses and paths only those outside."""
    t = Tokens(source, rust=True)
    out, pending = [], [((), 0, len(t))]
    while pending:
        scope, first, stop = pending.pop(0)
        facts = {"scope": list(scope), "items": [], "modules": [], "uses": [], "paths": []}
        out.append(facts)
        depth, public, i = t.parent[first] if first < stop else -1, False, first
        chain: list[str] = []
        joined = False

        def flush() -> None:
            nonlocal chain, joined
            if len(chain) > 1 and not joined:
                facts["paths"].append(chain)
            chain, joined = [], False

        while i < stop:
            outer = t.parent[i] == depth
            if t.kind[i] == "punct":
                # Most tokens are signs: none of them begins an item, a use or a name.
                if t.text[i] == "::":
                    chain, joined = chain or ["::"], True
                else:
                    if chain:
                        flush()
                    if outer and t.text[i] in (";", "}"):
                        public = False
                    if not bodies and t.pair[i] > i:
                        i = t.pair[i]
                        continue
                i += 1
                continue
            if t.is_(i, "pub") and outer:
                public = _public(t, i)
            if t.is_(i, "use"):
                flush()
                end = _statement_end(t, i + 1, stop if outer else min(stop, t.pair[t.parent[i]]))
                leaves = use_leaves(t, i + 1, end)
                facts["uses"] += leaves
                if outer and public:
                    facts["items"] += [{"name": x["name"], "public": True, "declared": False} for x in leaves if x["name"]]
                public, i = public and not outer, end
                continue
            named = i + 1 + t.is_(i + 1, "mut")
            if t.text[i] in ITEMS and t.kind[i] == "word" and named < stop and t.kind[named] == "word" and t.text[named] not in ("fn", "unsafe", "extern", "async") and (t.text[i] != "union" or t.is_(named + 1, "{", "<")) and not t.is_(i - 1, "*"):
                body = named + 1
                if outer:
                    facts["items"].append({"name": t.text[named], "public": public, "declared": True})
                    public = False
                if t.is_(i, "mod"):
                    written = t.is_(body, "{")
                    if outer:
                        facts["modules"].append({"name": t.text[named], "inline": written})
                    if written:
                        flush()
                        if outer:
                            pending.append(((*scope, t.text[named]), body + 1, min(t.pair[body], len(t))))
                        i = t.pair[body] + 1
                        continue
            if joined and _path_token(t, i):
                chain.append(t.text[i])
                joined = False
            else:
                flush()
                if _path_token(t, i):
                    chain = [t.text[i]]
            i += 1
        flush()
    return out
