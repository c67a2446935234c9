"""Tokens, their lines, and inline styles in markup."""

import hashlib

import pytest

from tessella.functions.jsx import inline_styles
from tessella.functions.syntax import Tokens, token_lines
from tessella.operators.lines import script_styles, token_line_counts


@pytest.mark.parametrize("text,rust,lines", [
    (None, False, 0), ("", False, 0), ("// a\n\n/* b\n*/\n", False, 0), ("a\r\nb\rc", False, 3), ("`one\n\ntwo ${ f(`in\nner`) // c\n} end\n`;", False, 6), ("x = a / b; y = /\\/*[/*]/.test(z) // no\n", False, 1),
    ("s = '// no'; /* a */ b\n", False, 1), ('let s = r#"one\n\n"two"\n"#; // c\n/* a /* b */\n c */ d\n', True, 5), ("fn f<'a>(c: char) { c == '\"' }\n// \"\n", True, 1), ("/* never closed\nx", False, 0), ("'open\nx", False, 2),
])
def test_lines_with_tokens(text, rust, lines):
    assert token_lines(text, rust) == lines


def test_brackets_of_all_sorts():
    t = Tokens("f(a[{ b }], `${c}`) ) ] { d")
    for i, text in enumerate(t.text):
        if t.pair[i] >= 0 and t.pair[i] < len(t):
            assert t.pair[t.pair[i]] == i
    assert t.text.count(")") == 2 and t.pair[t.text.index("{", 8)] == len(t)
    assert len(Tokens("(" * 50_000 + ")" * 50_000)) == 100_000


PAGE = """
export const Page = <T,>(x: T) => (
  <main className="a" style={{ color: 'red', /* c */
      width: x < 3 ? <b style="no" /> : 2, }}>
    don't style={{ y: 1 }} <p data-style={{ z: 1 }} {...{ style: { top: 1 }, id: 3 }} {...rest} /> // style={1}
    {list.map((item) => <li key={item} style = {item.style}>{`style={${x}}`}</li>)}
    <></> it's <Foo.Bar<string> style />
  </main>
);
const s = "<p style={{ a: 1 }}>", c = a < b && c > d; // <p style={1}>
"""


def test_styles_in_markup(spark):
    want = ["style = { { color : 'red' , width : x < 3 ? < b style = \"no\" / > : 2 } }", 'style = "no"', "style : { top : 1 }", "style = { item . style }"]
    got = inline_styles(PAGE)
    assert {h for _, h in got} >= {hashlib.sha256(x.encode()).hexdigest() for x in want} and [line for line, _ in got][:4] == [3, 4, 5, 6]
    assert len(got) == 5 and inline_styles(None) == []
    spread = inline_styles("x = <a {...{'style': 1, styles: 2, style() {}, style}} {...style} />")
    assert len(spread) == 3
    relaid = PAGE.replace("{{ color: 'red', /* c */\n      width", "{{color:'red',width").replace("2, }}", "2}}")
    assert [h for _, h in inline_styles(relaid)] == [h for _, h in got]
    texts = spark.createDataFrame([("a.tsx", PAGE), ("b.tsx", None), ("c.rs", "/* /* */ */ a")], "file string, text string")
    assert script_styles(texts).count() == 5 and {r["file"]: r["lines"] for r in token_line_counts(texts).collect()} == {"a.tsx": 9, "b.tsx": 0, "c.rs": 1}
