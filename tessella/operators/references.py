"""References between files: imports, entry points, path resolution in crates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_entry_point
from ..scratch import staged


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file, specifier, target_file, dst: the file that a relative specifier means, and its module.

    imports(file, specifier, and stem if it's known): relative specifiers are joined to the importing folder and tried as they are, with the usual endings, and as a
    folder's index; files(file, module)."""
    joined = import_stems(imports.select("file", "specifier", *(["stem"] if "stem" in imports.columns else [])).distinct()).where("stem is not null")
    return joined.join(meant_files(joined.select("stem").distinct(), files), "stem").select("file", "specifier", "target_file", "dst")


def import_stems(imports: DataFrame) -> DataFrame:
    """The rows of imports(file, specifier) with `stem`, the path that a relative specifier joined to the importing folder comes to; null for others. Scanners
    tell it along (`joined_path`), which costs less."""
    if "stem" in imports.columns:
        return imports
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    # Fold the parts: `.` is skipped, `..` takes the last one off.
    parts = F.aggregate(
        F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), "specifier"), "/"), F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return imports.withColumn("stem", F.when(F.col("specifier").startswith("."), F.regexp_replace(F.array_join(parts, "/"), r"\.js$", "")))


def meant_files(stems: DataFrame, files: DataFrame) -> DataFrame:
    """stem, target_file, dst: the file that each of distinct stems means and its module. What many files of a folder import is tried once."""
    tries = stems.select("stem", F.posexplode(F.array(*[F.concat(F.col("stem"), F.lit(e)) for e in ("", ".ts", ".tsx", ".mts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")])).alias("order", "target_file"))
    found = tries.join(files.select(F.col("file").alias("target_file"), F.col("module").alias("dst")), "target_file")
    return found.groupBy("stem").agg(F.min_by(F.struct("target_file", "dst"), "order").alias("t")).select("stem", "t.target_file", "t.dst")


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Resolved imports into other modules: file, src, target_file, dst (`resolved_imports`)."""
    own = files.select("file", F.col("module").alias("src"))
    return resolved_imports(imports, files).join(own, "file").select("file", "src", "target_file", "dst").where("src <> dst").distinct()


def entry_points(files: DataFrame) -> DataFrame:
    """module, entry_points, entry_point: the module's one entry file, null unless there is just one."""
    entry = F.when(is_entry_point(F.col("file")), F.col("file"))
    found = files.groupBy("module").agg(F.count(entry).alias("entry_points"), F.min(entry).alias("entry"))
    return found.select("module", "entry_points", F.when(F.col("entry_points") == 1, F.col("entry")).alias("entry_point"))


def bypassing_imports(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Imports that reach a module by another file than its entry point; a module without one is always bypassed."""
    joined = edges.join(entries.select(F.col("module").alias("dst"), "entry_point"), "dst", "left")
    return joined.where(~F.col("target_file").eqNullSafe(F.col("entry_point"))).select("src", "file", "dst", "target_file")


def entry_point_findings(entries: DataFrame, edges: DataFrame, name: str = "index") -> DataFrame:
    """module, file, message: every module whose number of entry points isn't one, then every import past a module's entry point.

    A language whose visibility is checked by its compiler has no such file: don't ask for its modules."""
    found = F.concat(F.lit(f"Module must have exactly one public {name} entrypoint; found "), F.col("entry_points").cast("string"), F.lit("."))
    counted = entries.where("entry_points <> 1").select("module", F.lit(None).cast("string").alias("file"), found.alias("message"))
    past = F.concat(F.lit("Import "), F.col("dst"), F.lit(f" through its {name}, not private file "), F.col("target_file"), F.lit("."))
    return counted.unionByName(bypassing_imports(edges, entries).select(F.col("src").alias("module"), "file", past.alias("message")))


def resolve_paths(paths: DataFrame, scopes: DataFrame, aliases: DataFrame, libraries: DataFrame) -> DataFrame:
    """id, target, how: Rust paths to the scope they begin in, by the first of: crate, self, super, an alias, a child, a library.

    paths(id, scope, head): scope is a slashed module path; scopes(scope); aliases(scope, name, target); libraries(name, target)."""
    parent = F.regexp_replace("scope", r"/?[^/]*$", "")
    fixed = paths.select("id", F.when(F.col("head") == "crate", F.struct(F.lit(0).alias("p"), F.lit("").alias("target"), F.lit("crate").alias("how")))
        .when(F.col("head") == "self", F.struct(F.lit(1).alias("p"), F.col("scope").alias("target"), F.lit("self").alias("how")))
        .when(F.col("head") == "super", F.struct(F.lit(2).alias("p"), parent.alias("target"), F.lit("super").alias("how"))).alias("c")).where("c is not null")
    named = lambda df, p, how: df.select("id", F.struct(F.lit(p).alias("p"), F.col("target").alias("target"), F.lit(how).alias("how")).alias("c"))
    by_alias = named(paths.join(aliases.withColumnRenamed("name", "head"), ["scope", "head"]), 3, "alias")
    child = paths.withColumn("target", F.when(F.col("scope") == "", F.col("head")).otherwise(F.concat_ws("/", "scope", "head")))
    by_child = named(child.join(scopes.select(F.col("scope").alias("target")), "target"), 4, "child")
    by_library = named(paths.join(libraries.withColumnRenamed("name", "head"), "head"), 5, "library")
    return fixed.unionByName(by_alias).unionByName(by_child).unionByName(by_library).groupBy("id").agg(F.min("c").alias("c")).select("id", "c.target", "c.how")


def path_hops(paths: DataFrame, scopes: DataFrame) -> DataFrame:
    """id, scope, depth: every prefix of a path (an array of segments) that is a scope."""
    prefixes = paths.select("id", F.explode(F.sequence(F.lit(1), F.size("segments"))).alias("depth"), "segments").select("id", "depth", F.array_join(F.slice("segments", F.lit(1), F.col("depth")), "/").alias("scope"))
    return prefixes.join(scopes.select("scope"), "scope").select("id", "scope", "depth")


def rust_surface(names: DataFrame, references: DataFrame) -> DataFrame:
    """module, name, external_references: consumers of a public name by name or by a wildcard import of its module.

    names(module, name); references(consumer, module, name, wildcard)."""
    other = references.where("consumer <> module")
    by_name = other.where("not wildcard").select("module", "name", "consumer")
    by_glob = names.join(other.where("wildcard").select("module", "consumer"), "module").select("module", "name", "consumer")
    used = by_name.unionByName(by_glob).distinct().groupBy("module", "name").agg(F.count("*").alias("n"))
    return names.distinct().join(used, ["module", "name"], "left").select("module", "name", F.coalesce("n", F.lit(0)).alias("external_references"))


def module_tree(declared: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """scope, file of a crate's modules: `mod name;` in a file is name.rs before name/mod.rs beside it; inline modules stay in their file.

    declared(file, name, inline); files(file); roots(file). One join per level of the tree; a scope that was met
    before isn't opened again."""
    level = out = staged(roots.select(F.lit("").alias("scope"), "file"), "modules")
    while not level.isEmpty():
        inner = level.join(declared, "file")
        folder = F.when(F.col("file").rlike(r"(^|/)(lib|main|mod)\.rs$"), F.regexp_replace("file", r"[^/]*$", "")).otherwise(F.concat(F.regexp_replace("file", r"\.rs$", ""), F.lit("/")))
        named = inner.withColumn("child", F.when(F.col("scope") == "", F.col("name")).otherwise(F.concat_ws("/", "scope", "name"))).withColumn("folder", folder)
        inline = named.where("inline").select(F.col("child").alias("scope"), "file")
        tries = named.where("not inline").select("child", F.posexplode(F.array(F.concat("folder", "name", F.lit(".rs")), F.concat("folder", "name", F.lit("/mod.rs")))).alias("order", "path"))
        found = tries.join(files.select(F.col("file").alias("path")), "path").groupBy("child").agg(F.min_by("path", "order").alias("file")).select(F.col("child").alias("scope"), "file")
        # Inline modules may hold declarations of their own file: these were read with the file.
        level = staged(found.join(out, ["scope", "file"], "left_anti"), "modules")
        out = staged(out.unionByName(inline).unionByName(level).distinct(), "module-tree")
    return out
