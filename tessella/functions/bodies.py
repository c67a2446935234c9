"""Functions, calls and links between files of one script, read from its tokens; names are resolved by joins, not here."""

from __future__ import annotations

from typing import NamedTuple

from .syntax import Tokens

#: Words that are followed by a bracket without being called, fixed by the language.
CONTROL = frozenset("if for while switch catch with return typeof await function super import case in of delete void throw yield new do else instanceof".split())
#: Words whose bracket is followed by a block, fixed by the language.
BLOCKS = frozenset("if for while switch catch with".split())
#: Words before a declared name, fixed by the language.
MODIFIERS = frozenset("export default const let var public private protected static readonly async get set declare abstract override function".split())


class Function(NamedTuple):
    """A function with a body: where its declaration, itself and its body begin and where it ends (places of tokens), and the name of what it
    belongs to. A name given by a declaration around it, as in `const f = () => 1`, isn't a part of it."""

    name: str
    container: str
    head: int
    own: int
    params: int
    body: int
    stop: int
    exported: bool


class Call(NamedTuple):
    """A call: the innermost function around it (-1: none), what stands before the dot, the name, whether it makes an object, its place."""

    owner: int
    receiver: str
    name: str
    made: bool
    at: int


class Link(NamedTuple):
    """A name brought in or handed out: its local name (null: all, `*`: the module as one name), the name over there, the file's specifier."""

    form: str
    local: str | None
    name: str | None
    specifier: str | None


def _clause(t: Tokens, i: int) -> int:
    """The first token of the statement, member or argument that token i is in: the one after the last separator beside it."""
    while True:
        j = t.before(i)
        if j < 0 or j == t.parent[i] or t.is_(j, ";", ",") or (t.is_(j, "{") and t.text[i - 1] == "}" and not t.is_(i, "=>", ".", "=", ")", "as")):
            return i
        i = j


def _declared(t: Tokens, first: int, last: int) -> tuple[str, bool]:
    """The name that a clause gives to the function at `last`, if it is given one, and whether the clause exports it."""
    exported = False
    while first < last and t.kind[first] == "word" and t.text[first] in MODIFIERS:
        exported |= t.text[first] == "export"
        first += 1
    following = t.after(first)
    following += t.is_(following, "?", "!") and t.is_(following + 1, ":")
    named = first < last and t.kind[first] in ("word", "string") and t.is_(following, "=", ":")
    return (t.text[first].strip("\"'") if named else "", exported)


def _generic(t: Tokens, i: int) -> int:
    """Past type parameters that begin at token i."""
    if not t.is_(i, "<"):
        return i
    depth = 0
    while i < len(t):
        depth += t.is_(i, "<") - t.is_(i, ">")
        if depth == 0:
            return i + 1
        if t.is_(i, ";", ")", "}", "]"):
            return i
        i = t.after(i)
    return i


def _body(t: Tokens, params: int) -> int:
    """The bracket of the body after parameters, past a return type; -1 if there is none."""
    i = t.after(params)
    if t.is_(i, ":"):
        i += 1
        while i < len(t) and t.parent[i] == t.parent[params] and not t.is_(i, ";", ",", "=>", "=", ")", "}"):
            if t.is_(i, "{") and not t.is_(i - 1, ":", "|", "&", "<", ",", "=>"):
                return i
            i = t.after(i)
        return -1
    return i if t.is_(i, "{") else -1


def _named(t: Tokens, i: int) -> tuple[int, int, int, str] | None:
    """head, params, body, name of a function that token i begins: `function` with or without a name, or a method's name."""
    name = ""
    if t.is_(i, "function"):
        j = i + 1 + t.is_(i + 1, "*")
        if j < len(t) and t.kind[j] == "word":
            name, j = t.text[j], j + 1
    elif t.kind[i] in ("word", "string") and t.parent[i] >= 0 and t.text[t.parent[i]] == "{" and t.text[i] not in BLOCKS and not t.is_(i - 1, ".", "?.", "new", "function", "*") or t.is_(i - 1, "*") and t.kind[i] == "word" and not t.is_(i - 2, "function"):
        name, j = t.text[i].strip("\"'"), i + 1
    else:
        return None
    params = _generic(t, j)
    if not t.is_(params, "("):
        return None
    body = _body(t, params)
    return None if body < 0 else (i, params, body, name)


def _arrow(t: Tokens, i: int) -> tuple[int, int, int, int]:
    """head, params, body, stop of the arrow function whose arrow is token i."""
    params = t.before(i)
    if not t.is_(params, "("):
        j = params
        while j > t.parent[i] and j >= 0 and not t.is_(j, "(", ",", ";", "=", "=>"):
            j = t.before(j)
        params = j if t.is_(j, "(") and t.is_(t.after(j), ":") else params
    body = i + 1
    if t.is_(body, "{"):
        return params, params, body, t.pair[body]
    stop, outer = body, t.pair[t.parent[i]] if t.parent[i] >= 0 else len(t)
    while stop < outer and not t.is_(stop, ",", ";"):
        stop = t.after(stop)
    return params, params, body, min(stop, len(t)) - 1


def functions(t: Tokens) -> list[Function]:
    """Functions with bodies in the order of their declarations. A container is the class or named object around a member."""
    holders, found = {}, []
    for i in [i for i, x in enumerate(t.text) if x == "{" or x == "class"]:
        if t.is_(i, "class") and not t.is_(i - 1, "."):
            j = i + 1
            name = t.text[j] if j < len(t) and t.kind[j] == "word" and t.text[j] not in ("extends", "implements") else _declared(t, _clause(t, i), i)[0]
            while j < len(t) and not t.is_(j, "{", ";", "}"):
                j = t.after(j)
            if t.is_(j, "{"):
                holders[j] = name
        elif t.is_(i, "{") and t.is_(i - 1, "=", ":"):
            name = _declared(t, _clause(t, i), i)[0]
            if name:
                holders.setdefault(i, name)
    # A function begins with its word, at its arrow, or with a name before a bracket or type parameters.
    for i in [i for i, (x, y) in enumerate(zip(t.text, [*t.text[1:], ""])) if y == "(" or y == "<" or x == "=>" or x == "function"]:
        if t.kind[i] == "string" and not t.is_(i, "function") and t.parent[i] not in holders:
            continue
        if t.is_(i, "=>"):
            head, params, body, stop = _arrow(t, i)
            name, named = "", None
            first = _clause(t, head)
            name, exported = _declared(t, first, head)
            # The type of a parameter, of a declared name or of an alias has no body.
            typed = name and not t.is_(t.before(head), "=", "async", ">") and (t.parent[i] >= 0 and t.text[t.parent[i]] == "(" or t.is_(first, *MODIFIERS))
            if typed or t.is_(first, "type", "interface"):
                continue
            own = head - t.is_(t.before(head), "async")
            head = first if name else own
        elif named := _named(t, i):
            head, params, body, name = named
            stop, first = t.pair[body], _clause(t, i)
            given, exported = _declared(t, first, i)
            name = name or given
            if all(t.kind[k] == "word" and t.text[k] in MODIFIERS for k in range(first, head)):
                head = first
            own = head
        else:
            continue
        inside = t.parent[head]
        found.append(Function(name, holders.get(inside, ""), head, own, params, body, min(stop, len(t) - 1), exported and inside < 0))
    return sorted(found, key=lambda f: (f.head, -f.stop))


def calls(t: Tokens, found: list[Function]) -> list[Call]:
    """Calls in the order of their places; each belongs to the innermost function whose parameters or body hold it."""
    params = {f.params for f in found}
    starts = sorted(range(len(found)), key=lambda k: (found[k].params, -found[k].stop))
    out, around, due = [], [], 0
    for i in [i for i, x in enumerate(t.text) if x == "(" or x == "new"]:
        while due < len(starts) and found[starts[due]].params <= i:
            around.append(starts[due])
            due += 1
        while around and found[around[-1]].stop < i:
            around.pop()
        made = t.is_(i, "new")
        j = i
        if made:
            j = i + 1
            while t.is_(j + 1, ".", "?."):
                j += 2
        elif t.is_(i, "(") and i not in params:
            j = i - 1 - t.is_(i - 1, "?.")
            if t.is_(j, ">"):
                depth = 0
                while j >= 0 and (depth := depth + t.is_(j, ">") - t.is_(j, "<")) > 0:
                    j = t.before(j)
                j -= 1
        else:
            continue
        if not 0 <= j < len(t) or t.kind[j] != "word" or (t.text[j] in CONTROL and not t.is_(j - 1, ".", "?.")) or (not made and (t.is_(j - 1, "function", "new") or _after_new(t, j))):
            continue
        receiver = t.text[j - 2] if t.is_(j - 1, ".", "?.") and j >= 2 and t.kind[j - 2] == "word" else ("?" if t.is_(j - 1, ".", "?.") else "")
        out.append(Call(next((k for k in reversed(around) if found[k].stop >= i), -1), receiver, t.text[j], made, i if made else j))
    return out


def _after_new(t: Tokens, j: int) -> bool:
    while t.is_(j - 1, ".", "?.") and j >= 2:
        j -= 2
    return t.is_(j - 1, "new")


def links(t: Tokens) -> list[Link]:
    """What the file's outermost import and export statements bring in and hand out."""
    out = []
    for i in [i for i, x in enumerate(t.text) if x == "import" or x == "export"]:
        if t.parent[i] >= 0 or not t.is_(i, "import", "export") or t.is_(i + 1, "(", "."):
            continue
        stop = i + 1
        while stop < len(t) and not t.is_(stop, ";", "import", "export") and not (t.kind[stop] == "string" and (t.is_(stop - 1, "from") or stop == i + 1)):
            if t.is_(stop, "{") and not t.is_(t.after(stop), "from") and t.is_(i, "export"):
                stop = t.after(stop)
                break
            stop = t.after(stop)
        specifier = t.text[stop][1:-1] if stop < len(t) and t.kind[stop] == "string" else None
        j = i + 1 + t.is_(i + 1, "type")
        if t.is_(i, "export") and not t.is_(j, "{", "*"):
            if t.is_(j, "default"):
                k = j + 1 + t.is_(j + 1, "async")
                k += (t.is_(k, "function", "class") and 1) + (t.is_(k + 1, "*") and 1)
                out.append(Link("export", t.text[k] if k < len(t) and t.kind[k] == "word" else "", "default", None))
                continue
            while j < len(t) and (t.text[j] in MODIFIERS or t.is_(j, "class", "interface", "enum", "namespace", "type", "*")):
                j += 1
            if j < len(t) and t.kind[j] == "word":
                out.append(Link("export", t.text[j], t.text[j], None))
            continue
        form = t.text[i]
        while j < stop:
            if t.is_(j, "{"):
                k, end = j + 1, min(t.pair[j], len(t))
                while k < end:
                    k += t.is_(k, "type") and not t.is_(k + 1, ",", "as", "}")
                    name = t.text[k]
                    local = t.text[k + 2] if t.is_(k + 1, "as") else name
                    # An export's first name is local, the second is what others see.
                    out.append(Link(form, *((local, name) if form == "import" else (name, local)), specifier))
                    while k < end and not t.is_(k, ","):
                        k += 1
                    k += 1
            elif t.is_(j, "*"):
                out.append(Link(form, t.text[j + 2] if t.is_(j + 1, "as") else None, "*", specifier))
                j += 2 * t.is_(j + 1, "as")
            elif t.kind[j] == "word" and t.text[j] != "from" and form == "import":
                out.append(Link(form, t.text[j], "default", specifier))
            j = t.after(j)
    return out
