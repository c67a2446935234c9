"""Source texts and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import PRUNED, is_authored, relative
from ..functions.text import toml_string


def source_texts(spark: SparkSession, root: str, endings: Sequence[str], pruned: Sequence[str] = PRUNED) -> DataFrame:
    """file, text of the authored files below a folder, one row each; Spark lists and reads them."""
    where = root if "://" in root else f"file://{root}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in endings) + "}").load(where)
    plain = root.split("://", 1)[-1] if "://" in root else root
    file = relative(F.regexp_replace("path", "^[a-z]+:(//)?", ""), plain)
    return raw.select(file.alias("file"), F.col("content").cast("string").alias("text")).where(is_authored(F.col("file"), pruned)).distinct()


def crates(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """directory, crate, kind, root: library, binary, build script, and the files of bin, tests, benches and examples.

    manifests(directory, text) of Cargo.toml files; files(file)."""
    at = lambda path: F.when(F.col("directory") == "", path).otherwise(F.concat_ws("/", "directory", path))
    name = toml_string(F.col("text"), "package", "name")
    fixed = F.array(
        F.struct(F.lit("lib").alias("kind"), at(F.coalesce(toml_string(F.col("text"), "lib", "path"), F.lit("src/lib.rs"))).alias("root")),
        F.struct(F.lit("bin").alias("kind"), at(F.lit("src/main.rs")).alias("root")),
        F.struct(F.lit("build").alias("kind"), at(F.coalesce(toml_string(F.col("text"), "package", "build"), F.lit("build.rs"))).alias("root")),
    )
    packages = manifests.withColumn("crate", name).where("crate is not null")
    known = packages.select("directory", "crate", F.explode(fixed).alias("t")).select("directory", "crate", "t.kind", "t.root").join(files.select(F.col("file").alias("root")), "root", "left_semi")
    folder = {"bin": "src/bin", "test": "tests", "bench": "benches", "example": "examples"}
    parts = files.withColumn("directory", F.regexp_extract("file", r"^(?:(.*)/)?(?:src/bin|tests|benches|examples)/(?:[^/]+|[^/]+/main)\.rs$", 1)).withColumn("kind", F.lit(None).cast("string"))
    for kind, path in folder.items():
        parts = parts.withColumn("kind", F.when(F.col("file").rlike(rf"(^|/){path}/([^/]+|[^/]+/main)\.rs$"), kind).otherwise(F.col("kind")))
    more = packages.join(parts.where("kind is not null"), "directory").select("directory", "crate", "kind", F.col("file").alias("root"))
    return known.select("directory", "crate", "kind", "root").unionByName(more)


def scan_rust(texts: DataFrame) -> DataFrame:
    """file, modules (name, inline), items (name, visibility), uses: what Rust files declare, by pattern.

    Comments and strings are blanked first. Use trees are left as they are written; `use_leaves` takes them apart."""
    code = F.regexp_replace(F.regexp_replace("text", r'(?s)/\*.*?\*/|//[^\n]*', " "), r'"(?:\\.|[^"\\])*"', '""')
    mods = F.regexp_extract_all(code, F.lit(r"(?m)^\s*((?:pub(?:\s*\([^)]*\))?\s+)?mod\s+\w+\s*[;{])"), F.lit(1))
    items = F.regexp_extract_all(code, F.lit(r"(?m)^\s*((?:pub(?:\s*\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|type|static|const|union)\s+\w+)"), F.lit(1))
    uses = F.regexp_extract_all(code, F.lit(r"(?s)\buse\s+([^;]+);"), F.lit(1))
    return texts.select(
        "file",
        F.transform(mods, lambda m: F.struct(F.regexp_extract(m, r"mod\s+(\w+)", 1).alias("name"), m.endswith("{").alias("inline"))).alias("modules"),
        F.transform(items, lambda m: F.struct(F.regexp_extract(m, r"(\w+)$", 1).alias("name"), F.regexp_extract(m, r"^(pub(?:\s*\([^)]*\))?)?", 1).alias("visibility"))).alias("items"),
        F.transform(uses, lambda u: F.trim(F.regexp_replace(u, r"\s+", " "))).alias("uses"),
    )


def use_leaves(uses: DataFrame) -> DataFrame:
    """file, path, name, wildcard: the leaves of use trees (file, use), a pair of braces at a time, as many as the tree has.

    `self` names its parent, `as` renames, `as _` brings no name, `*` is a wildcard."""
    # The innermost braces are opened first: each of their members takes their prefix and what follows.
    inner = r"^(.*?)\{([^{}]*)\}(.*)$"

    def opened(t, _):
        head, body, tail = (F.regexp_extract(t, inner, i) for i in (1, 2, 3))
        cut = F.regexp_extract(head, r"([^{},]*)$", 1)
        members = F.transform(F.filter(F.split(body, ","), lambda x: x != ""), lambda m: F.concat(cut, m))
        return F.when(t.contains("{"), F.concat(F.substring(head, F.lit(1), F.length(head) - F.length(cut)), F.array_join(members, ","), tail)).otherwise(t)

    flat = F.aggregate(F.sequence(F.lit(0), F.length("use") - F.length(F.replace("use", F.lit("{")))), F.regexp_replace(F.trim("use"), r"\s*(::|,|\{|\})\s*", "$1"), opened)
    leaves = uses.select("file", F.explode(F.split(flat, ",")).alias("t")).where("t <> ''")
    plain, alias = F.regexp_replace("t", r" as \w+$", ""), F.regexp_extract("t", r" as (\w+)$", 1)
    wildcard = plain.endswith("*")
    path = F.regexp_replace(plain, r"(::)?(self|\*)$", "")
    name = F.when(wildcard | (alias == "_"), F.lit(None)).when(alias != "", alias).otherwise(F.regexp_extract(path, r"(\w+)$", 1))
    return leaves.select("file", path.alias("path"), name.alias("name"), wildcard.alias("wildcard"))


def scan_scripts(texts: DataFrame) -> DataFrame:
    """file, imports, exports, declared: what TypeScript and JavaScript files bring in, hand out and declare at the top, by pattern.

    Names are resolved by file only; types aren't inferred."""
    code = F.regexp_replace("text", r"(?s)/\*.*?\*/|(?m)^\s*//[^\n]*", " ")
    specifiers = F.regexp_extract_all(code, F.lit(r"""(?m)(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)["']([^"'\n]+)["']"""), F.lit(1))
    declared = F.regexp_extract_all(code, F.lit(r"(?m)^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|type|enum|const|let|var)\s+(\w+)"), F.lit(1))
    exported = F.regexp_extract_all(code, F.lit(r"(?m)^export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|type|enum|const|let|var)\s+(\w+)"), F.lit(1))
    lists = F.flatten(F.transform(F.regexp_extract_all(code, F.lit(r"(?s)\bexport\s*(?:type\s*)?\{([^}]*)\}"), F.lit(1)), lambda x: F.split(x, ",")))
    renamed = F.filter(F.transform(lists, lambda x: F.regexp_extract(F.trim(x), r"(\w+)$", 1)), lambda x: x != "")
    return texts.select("file", F.array_distinct(specifiers).alias("imports"), F.array_distinct(F.concat(exported, renamed)).alias("exports"), F.array_distinct(declared).alias("declared"))
