"""File paths: modules, entry points, tests, roots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that hold no authored code.
PRUNED = (".git", ".next", "artifacts", "build", "coverage", "dist", "node_modules", "out", "runtime", "playwright-report", "target", "test-results")


def relative(path: Column, root: str) -> Column:
    """Slashed path below a root."""
    slashed = F.regexp_replace(path, r"\\", "/")
    return F.when(slashed.startswith(root.rstrip("/") + "/"), F.substring(slashed, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(slashed)


def module_of(file: Column) -> Column:
    """The file's folder; `.` at the root."""
    folder = F.regexp_extract(file, r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", ".").otherwise(folder)


def is_entry_point(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]*)$", 1).rlike(r"^index(\.stylex)?\.([cm]?[jt]s|[jt]sx)$")


def is_test(file: Column) -> Column:
    """A file of tests by its folder or its name, whatever the case."""
    name = F.lower(F.replace(file, F.lit("\\"), F.lit("/")))
    return name.rlike(r"(^|/)(__tests__|tests?|specs?|e2e)/") | name.rlike(r"[._-](test|spec)\.[^/]*$")


def is_authored(file: Column, pruned: Sequence[str] = PRUNED) -> Column:
    return ~F.arrays_overlap(F.split(file, "/"), F.array(*[F.lit(p) for p in pruned]))


def is_script(file: Column) -> Column:
    return file.rlike(r"\.([cm]?[jt]s|[jt]sx)$") & ~file.rlike(r"\.d\.[cm]?ts$") & is_authored(file)


def under_roots(file: Column, roots: Sequence[str]) -> Column:
    out = F.lit(False)
    for r in roots:
        out = out | (F.lit(True) if r == "." else file.startswith(r.rstrip("/") + "/"))
    return out


def checked_roots(roots: Sequence[str]) -> list[str]:
    """Roots are relative folders that don't climb."""
    for r in roots:
        if not r or r.startswith("/") or ".." in r.split("/") or "\\" in r:
            raise ValueError(f"not a root within the project: {r!r}")
    return list(roots)


def rust_module(file: Column) -> Column:
    """lib.rs, main.rs and mod.rs are their folder; other files their path without the ending."""
    return F.when(file.rlike(r"(^|/)(lib|main|mod)\.rs$"), module_of(file)).otherwise(F.regexp_replace(file, r"\.rs$", ""))


def is_public(visibility: Column) -> Column:
    """Any visibility but pub(self)."""
    v = F.regexp_replace(F.coalesce(visibility, F.lit("")), r"\s", "")
    return (v != "") & (v != "pub(self)")


def code_family(file: Column) -> Column:
    """test, style, page, tool or source."""
    return (
        F.when(is_test(file), "test").when(file.rlike(r"(?i)(\.css|\.stylex\.[jt]sx?|/styles?/)"), "style").when(file.rlike(r"(?i)(^|/)(pages|routes|app|views|components)/"), "page")
        .when(file.rlike(r"(?i)(^|/)(scripts|tools|bin|build)/"), "tool").otherwise("source")
    )


def css_files(files: DataFrame) -> DataFrame:
    """The authored style sheets among files, in order."""
    return files.where(F.col("file").endswith(".css") & is_authored(F.col("file"))).orderBy("file")


def joined_path(file: str | None, specifier: str | None) -> str | None:
    """The path that a relative specifier in a file comes to, without `.js`; none for others. `.` is skipped, `..` takes the last part off."""
    if not specifier or specifier[0] != ".":
        return None
    parts: list[str] = []
    for part in [*(file or "").split("/")[:-1], *specifier.split("/")]:
        if part == ".." and parts:
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts).removesuffix(".js")
