"""What a call means in its own file is told by the scanner, and what it means elsewhere is sought once, whoever brings it in."""

from pyspark.sql import functions as F

from tessella.functions.paths import joined_path
from tessella.operators import calls as C
from tessella.operators import references as R

FILES = {
    "m/a.ts": "export function one() { return two(); }\nfunction two() { return 2; }\nexport class Box { constructor() {} open() { this.shut(); } shut() {} }",
    "m/b.ts": "export function one() { return 1; }",
} | {f"n/u{i:02}.ts": "import { one, Box } from '../m/a';\nimport * as all from '../m/./a.js';\nimport { one as other } from '../m/b';\nimport x from 'far';\n"
     "function one2() { one(); other(); all.one(); new Box(); new all.Box(); Box.open(); x(); y(); }" for i in range(40)}  # fmt: skip


def test_calls_are_sought_once_for_all_files(spark, monkeypatch):
    sizes, write = {}, C.staged

    def counted(df, name):
        out = write(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(C, "staged", counted)
    texts = spark.createDataFrame(list(FILES.items()), "file string, text string")
    facts = C.script_facts(texts).localCheckpoint()
    name = {r["fn"]: (r["file"], r["container"], r["name"]) for r in C.function_rows(facts).collect()}
    assert {(c["name"], c["dst"]) for c in facts.where("file = 'm/a.ts'").first()["calls"]} == {("two", "m/a.ts#1"), ("shut", next(k for k, v in name.items() if v[2] == "shut"))}
    found = C.call_sites(facts, texts.select("file", F.split_part("file", F.lit("/"), F.lit(1)).alias("module"))).collect()
    far = {("m/a.ts", "", "one"), ("m/b.ts", "", "one"), ("m/a.ts", "Box", "constructor"), ("m/a.ts", "Box", "open")}
    for i in range(40):
        assert {name[r["dst"]] for r in found if r["src"] == f"n/u{i:02}.ts#0"} == far
    # Rounds and joins of names no longer grow with the files that bring them in.
    assert sizes["name-led"] <= 4 and sizes["calls-wanted"] <= 6 and "name-starts" in sizes and sizes["name-starts"] <= 4


def test_paths_of_imports_are_told_alike(spark):
    cases = [("a/b/f.ts", x) for x in ("./c", "../c.js", "../../c", "../../../../c", ".", "..", "./../x/./y", "c", ".js", "./")] + [("f.ts", "./c"), ("f.ts", "../c"), ("/a/f.ts", "./c"), ("a//f.ts", "../c")]
    rows = R.import_stems(spark.createDataFrame(cases, "file string, specifier string")).collect()
    assert {(r["file"], r["specifier"]): r["stem"] for r in rows} == {x: joined_path(*x) for x in cases}
