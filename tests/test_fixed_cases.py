"""Small fixed sources: what patterns find in them, kinds of paths, module trees, numbers of lines."""

from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as X
from tessella.operators import graph as G
from tessella.operators import metrics as M
from tessella.operators import references as R
from tessella.sources import files as S


def test_rust_and_script_patterns(spark):
    rust = spark.createDataFrame([("src/lib.rs", "pub mod a;\nmod b { }\n// mod c;\npub(crate) fn run() { }\nstruct S;\nuse crate::a::{self, x as y, z::*};\n")], "file string, text string")
    found = S.scan_rust(rust).first()
    assert [(m["name"], m["inline"]) for m in found["modules"]] == [("a", False), ("b", True)] and [(i["name"], i["visibility"]) for i in found["items"]] == [("run", "pub(crate)"), ("S", "")]
    leaves = S.use_leaves(S.scan_rust(rust).select("file", F.explode("uses").alias("use")))
    assert {(r["path"], r["name"], r["wildcard"]) for r in leaves.collect()} == {("crate::a", "a", False), ("crate::a::x", "y", False), ("crate::a::z", None, True)}
    script = spark.createDataFrame([("a.ts", 'import { x } from "./x";\nexport function f() { }\nclass C { }\nexport { C, x as y };\nconst z = require("z");\n')], "file string, text string")
    told = S.scan_scripts(script).first()
    assert (told["imports"], told["exports"], told["declared"]) == (["./x", "z"], ["f", "C", "y"], ["f", "C", "z"])


def test_kinds_of_paths(spark):
    want = {
        "src/a/index.ts": ("src/a", True, False, True, True, "source"), "src/a/b.test.ts": ("src/a", False, True, True, True, "test"), "tests/x.ts": ("tests", False, True, True, True, "test"), "main.ts": (".", False, False, True, True, "source"),
        "node_modules/q/i.js": ("node_modules/q", False, False, False, False, "source"), "src/styles/c.css": ("src/styles", False, False, True, False, "style"), "src/pages/p.tsx": ("src/pages", False, False, True, True, "page"),
        "scripts/t.mjs": ("scripts", False, False, True, True, "tool"), "src/d.d.ts": ("src", False, False, True, False, "source"),
    }
    f = F.col("file")
    rows = spark.createDataFrame([(x,) for x in want], "file string").select(f, P.module_of(f), P.is_entry_point(f), P.is_test(f), P.is_authored(f), P.is_script(f), P.code_family(f))
    assert {r[0]: tuple(r[1:]) for r in rows.collect()} == want


def test_module_tree_and_lines(spark):
    declared = spark.createDataFrame([("src/lib.rs", "net", False), ("src/lib.rs", "inner", True), ("src/net/mod.rs", "http", False), ("src/net/mod.rs", "gone", False)], "file string, name string, inline boolean")
    files = spark.createDataFrame([("src/lib.rs",), ("src/net/mod.rs",), ("src/net/http.rs",), ("src/net/http/mod.rs",)], "file string")
    assert {tuple(r) for r in R.module_tree(declared, files, files.where("file = 'src/lib.rs'")).select("scope", "file").collect()} == {("", "src/lib.rs"), ("net", "src/net/mod.rs"), ("net/http", "src/net/http.rs"), ("inner", "src/lib.rs")}
    lines = spark.createDataFrame([("a", ""), ("b", "one"), ("c", "one\ntwo\n"), ("d", "one\r\ntwo\r\n\r\nfour"), ("e", None)], "file string, text string").select("file", X.line_count(F.col("text")))
    assert {tuple(r) for r in lines.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 4), ("e", 0)}
    code = spark.createDataFrame([("a", 'const a = 1; // one\n\n/* two\n three */\nconst s = "// no";\n'), ("b", "// only\n"), ("c", None)], "file string, text string").select("file", X.meaningful_lines(F.col("text")))
    assert {tuple(r) for r in code.collect()} == {("a", 2), ("b", 0), ("c", 0)}


def test_rust_surface(spark):
    names = spark.createDataFrame([("a", "f"), ("a", "g"), ("b", "h")], "module string, name string")
    refs = spark.createDataFrame([("c", "a", "f", False), ("b", "a", "", True), ("c", "a", "f", False), ("b", "b", "h", False)], "consumer string, module string, name string, wildcard boolean")
    assert {tuple(r) for r in R.rust_surface(names, refs).collect()} == {("a", "f", 2), ("a", "g", 1), ("b", "h", 0)}


def test_colours_and_sheets(spark):
    sheets = {
        "a.css": ("a { color: RED; background: #FFF url(blue.png) }", ["#fff", "red"]), "b.css": ("b { color: transparent; border-color: currentcolor }", []),
        "c.css": ("c { color: rgb(1, 2, 3); fill: #12345 } .red-box { }", ["rgb(1, 2, 3)"]), "d.css": ('d::after { content: "red" } e { color: red }', ["red"]),
    }
    rows = spark.createDataFrame([(f, t) for f, (t, _) in sheets.items()], "file string, text string").select("file", X.css_colors(F.col("text")).alias("colors"))
    assert {r["file"]: r["colors"] for r in rows.collect()} == {f: c for f, (_, c) in sheets.items()}
    assert {(r["file"], r["score"]) for r in M.color_files(rows, ["."], 1).collect()} == {("a.css", 3), ("c.css", 3), ("d.css", 3)} and M.color_files(rows, ["."], 3).count() == 0
    files = spark.createDataFrame([(x,) for x in ("src/a.css", "src/b.ts", "node_modules/q/c.css", "dist/d.css", "styles/E.css", "styles/f.css.ts")], "file string")
    assert [r["file"] for r in P.css_files(files).collect()] == ["src/a.css", "styles/E.css"]


def test_manifests_and_crates(spark):
    manifests = spark.createDataFrame([("", '[package]\nname = "core"\n\n[lib]\npath = "src/core.rs"\n'), ("tools", "[package]\nname = 'tools'\n"), ("none", "[workspace]\nmembers = []\n")], "directory string, text string")
    files = spark.createDataFrame([(x,) for x in ("src/core.rs", "src/main.rs", "src/util.rs", "tests/one.rs", "tools/src/bin/run.rs", "tools/build.rs")], "file string")
    want = {("core", "lib", "src/core.rs"), ("core", "bin", "src/main.rs"), ("core", "test", "tests/one.rs"), ("tools", "bin", "tools/src/bin/run.rs"), ("tools", "build", "tools/build.rs")}
    assert {tuple(r) for r in S.crates(manifests, files).select("crate", "kind", "root").collect()} == want


def test_rust_paths(spark):
    heads = ["crate", "self", "super", "files", "body", "core", "nowhere"]
    paths = spark.createDataFrame([(i, "net/http", h) for i, h in enumerate(heads, 1)], "id int, scope string, head string")
    scopes = spark.createDataFrame([("net",), ("net/http",), ("net/http/body",), ("io",)], "scope string")
    aliases, libraries = spark.createDataFrame([("net/http", "files", "io")], "scope string, name string, target string"), spark.createDataFrame([("core", "core"), ("files", "files")], "name string, target string")
    want = {(1, "", "crate"), (2, "net/http", "self"), (3, "net", "super"), (4, "io", "alias"), (5, "net/http/body", "child"), (6, "core", "library")}
    assert {tuple(r) for r in R.resolve_paths(paths, scopes, aliases, libraries).collect()} == want
    hops = spark.createDataFrame([(1, ["net", "http", "Request"]), (2, ["io", "Reader"]), (3, ["std", "fmt"])], "id int, segments array<string>")
    assert {tuple(r) for r in R.path_hops(hops, scopes).collect()} == {(1, "net", 1), (1, "net/http", 2), (2, "io", 1)}


def test_separate_groups(spark):
    exports = spark.createDataFrame([("m", "parse"), ("m", "validate"), ("m", "render"), ("m", "format"), ("n", "one"), ("n", "two")], "module string, export string")
    # One of n's exports reaches the other's only behind a chain that is longer than the rounds that are kept apart.
    chain = ["two", *(f"mid{i}" for i in range(20)), "core"]
    edges = spark.createDataFrame([("parse", "scan"), ("validate", "scan"), ("render", "draw"), ("format", "draw"), ("one", "core"), *zip(chain, chain[1:])], "src string, dst string")
    groups = G.separate_groups(exports, edges)
    assert {tuple(r) for r in groups.collect()} == {("m", "parse", "parse"), ("m", "validate", "parse"), ("m", "render", "format"), ("m", "format", "format"), ("n", "one", "one"), ("n", "two", "one")}
    consumers = spark.createDataFrame([("m", "parse", "x"), ("m", "validate", "x"), ("m", "render", "y"), ("m", "format", "y"), ("n", "one", "x")], "module string, export string, consumer string")
    found = {r["module"]: (r["exports"], r["cohorts"], r["smallest"], round(r["separated_ratio"], 9), float(r["consumer_overlap"])) for r in G.cohesion(groups, consumers).collect()}
    assert found == {"m": (4, 2, 2, 0.666666667, 0.0), "n": (2, 1, 2, 0.0, 1.0)}
