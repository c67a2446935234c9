"""Tokens of scripts and Rust sources and how brackets nest them: helpers for one text, called inside tasks."""

from __future__ import annotations

import re
from bisect import bisect_right

_COMMON = r"(?P<punct>=>|->|::|\?\.(?!\d)|\.\.\.|===|!==|==|!=|<=|&&|\|\||\?\?|\+\+|--|\*\*|[-+*%&|^]=|.)"
_SCRIPT = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*(?:.*?\*/|.*))"
    r"""|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""
    r"|(?P<number>0[xXbBoO]\w+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<word>[#@]?[\w$]+)|" + _COMMON,
    re.DOTALL,
)
RUST_WORDS = (
    r"""(?P<string>[bc]?r(?P<hashes>\#*)".*?(?:"(?P=hashes)|\Z)|[bc]?"(?:\\.|[^"\\])*"?|b?'(?:\\(?:u\{[^}]*\}|.)[^']?|[^'\\])')"""
    r"|(?P<number>\d\w*(?:\.\d\w*)?)|(?P<word>'?(?:r\#)?[^\W\d]\w*)"
)
_RUST = re.compile(
    r"(?P<skip>\s+|//[^\n]*)|(?P<comment>/\*)|"
    + RUST_WORDS + "|" + _COMMON,
    re.DOTALL,
)


def _stepping(rules: re.Pattern) -> re.Pattern:
    """The same rules with what is skipped as a part of the step to the next lexeme, and words and brackets tried first."""
    skipped, rest = re.fullmatch(r"\(\?P<skip>(.*?)\)\|((?:\(\?P<(?:string|comment)>).*)", rules.pattern, re.DOTALL).groups()
    return re.compile(rf"(?:{skipped})*+(?:(?P<end>\Z)|(?P<bracket>[(){{}}\[\]])|{rest})", re.DOTALL)


_SCRIPT_STEP, _RUST_STEP = _stepping(_SCRIPT), _stepping(_RUST)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])*/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?P<end>`|\$\{|\Z)", re.DOTALL)
#: The start of a markup element in a script: its name, and what may follow it. Type parameters begin alike but go on with a comma or `extends`.
_ELEMENT = re.compile(r"<(?:/|(?:[A-Za-z_$][\w.$:-]*)?(?=\s*(?:/?>|\{|(?!extends\b)[A-Za-z_$][\w:-]*\s*(?:=\s*[\"'{<]|[A-Za-z_${/>]))))")
_MARKUP_TEXT = re.compile(r"[^<{]*")
COMMENT_EDGE = re.compile(r"/\*|\*/")
CLOSING = {"(": ")", "[": "]", "{": "}", "${": "}"}
#: Words after which an expression begins, so that a slash there begins a pattern.
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do await yield".split())


class Tokens:
    """Parallel lists, a place for each token: kind (word, number, string, punct, text of markup), text, start, end, parent (place of the bracket around it,
    -1 outside all), pair (place of a bracket's partner: the number of tokens for one that is never closed, -1 for other tokens).

    With `markup`, elements in scripts are read as such: `elements` has the places of their first signs."""

    def __init__(self, source: str | None, rust: bool = False, markup: bool = False):
        self.source = (source or "").replace("\r\n", "\n").replace("\r", "\n")
        self.kind, self.text, self.start, self.end, self.parent, self.pair = [], [], [], [], [], []
        self._open: list[int] = []
        self.elements: list[int] = []
        # Where markup is being read: in a tag, its type parameters, a closing tag, between tags, or in the code of a bracket within (its place).
        self._modes: list[str | int] = []
        self._read(rust, markup) if markup else self._read_plain(rust)
        for i in self._open:
            self.pair[i] = len(self.kind)
        self._lines = [m.end() for m in re.finditer("\n", self.source)]

    def __len__(self) -> int:
        return len(self.kind)

    def line(self, at: int) -> int:
        """Line, from 1, of a place in the source."""
        return bisect_right(self._lines, at) + 1

    def _add(self, kind: str, start: int, end: int) -> None:
        self.kind.append(kind)
        self.text.append(self.source[start:end])
        self.start.append(start)
        self.end.append(end)
        self.parent.append(self._open[-1] if self._open else -1)
        self.pair.append(-1)

    def _template(self, start: int, at: int) -> int:
        """A template's text from `start` to its end or to the next expression in it; returns where reading goes on."""
        found = _TEMPLATE.match(self.source, at)
        stop = found.start("end")
        self._add("string", start, found.end() if found["end"] != "${" else stop)
        if found["end"] == "${":
            self._add("punct", stop, stop + 2)
            self._open.append(len(self) - 1)
        return found.end()

    def _comment(self, at: int) -> int:
        depth = 0
        for edge in COMMENT_EDGE.finditer(self.source, at):
            depth += 1 if edge[0] == "/*" else -1
            if depth == 0:
                return edge.end()
        return len(self.source)

    def _value_before(self) -> bool:
        if not self.kind:
            return False
        return self.text[-1] in (")", "]") if self.kind[-1] == "punct" else self.text[-1] not in _BEFORE_VALUE

    def _markup(self, at: int) -> int:
        """Text between tags, up to a tag or a bracket; returns where reading goes on."""
        end = _MARKUP_TEXT.match(self.source, at).end()
        if self.source[at:end].strip():
            self._add("text", at, end)
        if end < len(self.source):
            self._add("punct", end, end + 1)
            if self.source[end] == "{":
                self._open.append(len(self) - 1)
                self._modes.append(len(self) - 1)
            else:
                closing = self.source.startswith("</", end)
                self._modes.append("close" if closing else "tag")
                if not closing:
                    self.elements.append(len(self) - 1)
        return end + 1

    def _end_of_tag(self) -> None:
        """After the `>` of a tag: an opening one begins what is between, a closing one ends it, one that ends itself does neither."""
        mode = self._modes.pop()
        if mode == "tag" and not (len(self) > 1 and self.text[-2] == "/"):
            self._modes.append("between")
        elif mode == "close" and self._modes and self._modes[-1] == "between":
            self._modes.pop()

    def _read(self, rust: bool, markup: bool) -> None:
        rules, at, size = (_RUST if rust else _SCRIPT), 0, len(self.source)
        while at < size:
            if self._modes and self._modes[-1] == "between":
                at = self._markup(at)
                continue
            in_tag = bool(self._modes) and self._modes[-1] in ("tag", "close")
            found = rules.match(self.source, at)
            kind, end = found.lastgroup, found.end()
            if kind == "hashes":
                kind = "string"
            if kind == "comment":
                at = self._comment(at)
                continue
            if kind == "skip":
                at = end
                continue
            text = found[0]
            if text == "`" and not rust:
                at = self._template(at, end)
                continue
            if text == "<" and markup and not in_tag and not self._value_before() and _ELEMENT.match(self.source, at):
                self._modes.append("tag")
                self.elements.append(len(self))
            if text == "/" and not rust and not in_tag and not self._value_before() and (pattern := _PATTERN.match(self.source, at)):
                kind, end = "string", pattern.end()
            if text in (")", "]", "}"):
                self._close(at, end, text)
                if text == "}" and self.pair[-1] >= 0 and self.text[self.pair[-1]] == "${":
                    end = self._template(end, end)
            else:
                self._add(kind, at, end)
                if text in CLOSING:
                    self._open.append(len(self) - 1)
                    if in_tag and text == "{":
                        self._modes.append(len(self) - 1)
                if markup and text == "<" and self._modes and (in_tag and self.kind[-2] == "word" or self._modes[-1] == "type"):
                    self._modes.append("type")
                elif text == ">" and self._modes and self._modes[-1] == "type":
                    self._modes.pop()
                elif text == ">" and in_tag:
                    self._end_of_tag()
            at = end

    def _read_plain(self, rust: bool) -> None:
        """`_read` of a source whose markup isn't read: one loop, as scanners spend most of their time here."""
        rules, at, source = (_RUST_STEP if rust else _SCRIPT_STEP).finditer, 0, self.source
        size, open_, kinds, texts, starts, ends, parents, pairs = len(source), self._open, self.kind, self.text, self.start, self.end, self.parent, self.pair
        outer = -1
        while at < size:
            for found in rules(source, at):
                kind = found.lastgroup
                text, end = found[kind], found.end()
                if kind == "word" or kind == "string" or kind == "number":
                    pass
                elif kind == "bracket":
                    kind = "punct"
                    if text == ")" or text == "}" or text == "]":
                        self._close(end - 1, end, text)
                        outer = open_[-1] if open_ else -1
                        if text == "}" and pairs[-1] >= 0 and texts[pairs[-1]] == "${":
                            at = self._template(end, end)
                            outer = open_[-1] if open_ else -1
                            break
                        continue
                    kinds.append(kind)
                    texts.append(text)
                    starts.append(end - 1)
                    ends.append(end)
                    parents.append(outer)
                    pairs.append(-1)
                    outer = len(kinds) - 1
                    open_.append(outer)
                    continue
                elif kind == "punct":
                    if not rust:
                        if text == "`":
                            at = self._template(end - 1, end)
                            outer = open_[-1] if open_ else -1
                            break
                        if text == "/" and not self._value_before() and (pattern := _PATTERN.match(source, end - 1)):
                            at = pattern.end()
                            self._add("string", end - 1, at)
                            break
                elif kind == "hashes":
                    kind, text = "string", found["string"]
                elif kind == "comment":
                    at = self._comment(end - 2)
                    break
                else:
                    at = size
                    break
                kinds.append(kind)
                texts.append(text)
                starts.append(end - len(text))
                ends.append(end)
                parents.append(outer)
                pairs.append(-1)
            else:
                at = size

    def _close(self, start: int, end: int, text: str) -> None:
        """A closing bracket ends the innermost open one of its sort and those left open within it; one that closes nothing is a token like others."""
        fits = len(self._open) - 1
        while fits >= 0 and CLOSING[self.text[self._open[fits]]] != text:
            fits -= 1
        fits = None if fits < 0 else fits
        if fits is None:
            self._add("punct", start, end)
            return
        for i in self._open[fits + 1 :]:
            self.pair[i] = len(self)
        opened = self._open[fits]
        del self._open[fits:]
        # The bracket's code is over, with all markup that was left open in it.
        if opened in self._modes:
            del self._modes[self._modes.index(opened) :]
        self._add("punct", start, end)
        self.pair[opened], self.pair[-1] = len(self) - 1, opened

    def after(self, i: int) -> int:
        """The next token beside token i, past what a bracket at i holds."""
        return self.pair[i] + 1 if self.pair[i] > i else i + 1

    def before(self, i: int) -> int:
        """The token beside token i - 1's end: the opening bracket if one closes there."""
        j = i - 1
        return self.pair[j] if j >= 0 and 0 <= self.pair[j] < j else j

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.text) and self.text[i] in texts and self.kind[i] != "string"


def token_lines(source: str | None, rust: bool = False) -> int:
    """Lines that hold a token or a part of one: comments and blank lines don't count, the lines of a template or raw string do."""
    tokens = Tokens(source, rust)
    lines, last = 0, 0
    for start, end in zip(tokens.start, tokens.end):
        first, stop = tokens.line(start), tokens.line(end - 1)
        lines += max(0, stop - max(first, last + 1) + 1)
        last = max(last, stop)
    return lines
