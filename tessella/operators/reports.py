"""Reports over findings, runs and files: one table of all findings, lines for people, totals and inventories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("error", "smell", "info")


def all_findings(findings: Mapping[str, DataFrame], severities: Mapping[str, str], disabled: Sequence[str] = ()) -> DataFrame:
    """severity and the columns of all rules' findings, null where a rule has no such column. Rules in `disabled` are left out before they run; a
    disabled or rated rule that isn't there is an error."""
    if unknown := (set(disabled) | set(severities)) - set(findings):
        raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")
    out = None
    for rule, found in findings.items():
        if rule in disabled:
            continue
        level = severities.get(rule, "error")
        if level not in SEVERITIES:
            raise ValueError(f"{rule}: no severity {level!r}")
        rated = found.withColumn("rule", F.lit(rule)).withColumn("severity", F.lit(level))
        out = rated if out is None else out.unionByName(rated, allowMissingColumns=True)
    if out is None:
        raise ValueError("every rule is disabled")
    return out


def finding_line(severity: Column, rule: Column, module: Column, file: Column, line: Column, message: Column) -> Column:
    """`ERROR HL101 module file:line: message`; what is null, empty or line 0 is left out."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    at = F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(F.lit(":"), line.cast("string"))).otherwise("")
    return F.concat(
        F.upper(severity), F.lit(" "), rule, F.when(given(module), F.concat(F.lit(" "), module)).otherwise(""), F.when(given(file), F.concat(F.lit(" "), file, at)).otherwise(""), F.lit(": "), message
    )


def table_text(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """A small table as text with pipes; a column whose name begins with # is a column of numbers."""
    head = [c.removeprefix("#") for c in columns]
    rule = ["---:" if c.startswith("#") else "---" for c in columns]
    return "".join(" | ".join(map(str, row)) + "\n" for row in (head, rule, *rows))


def json_report(run: DataFrame, findings: DataFrame, metrics: DataFrame, key: str = "run_id") -> DataFrame:
    """key, report: one JSON text per run with the run, its findings and its metrics, in the order of their columns.

    A report holds all of a run's findings, so it is for runs that a person reads."""
    gathered = lambda rows, name: rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != key]))).alias(name))
    joined = run.select(key, F.struct(*run.columns).alias("run")).join(gathered(findings, "diagnostics"), key, "left").join(gathered(metrics, "metrics"), key, "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(joined.schema[c].dataType))
    return joined.select(key, F.to_json(F.struct("run", empty("diagnostics").alias("diagnostics"), empty("metrics").alias("metrics"))).alias("report"))


def file_metrics(names: DataFrame, across: bool = True) -> tuple[DataFrame, DataFrame]:
    """Per (module, file) and per module the distinct declared and exported names of names(module, file, name, exported). A module's are distinct across its
    files, or if not `across` the sum of its files'."""
    count = lambda df, *by: df.groupBy(*by).agg(F.count_distinct("name").alias("declarations"), F.count_distinct(F.when(F.col("exported"), F.col("name"))).alias("exports"))
    files = count(names, "module", "file")
    return files, count(names, "module") if across else files.groupBy("module").agg(F.sum("declarations").alias("declarations"), F.sum("exports").alias("exports"))


def single_declarations(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry files (module, file) with one declaration, which is exported."""
    return files.join(entries.select("module", "file").distinct(), ["module", "file"], "left_semi").where("declarations = 1 and exports = 1").select("module", "file")


def metric_totals(metrics: DataFrame, without: str | None = None) -> DataFrame:
    """One row: modules, sums, the overall ratio (null without declarations) and the largest fan-out (0 without modules); the folder `without`
    and what is below it don't count."""
    path = F.replace("module", F.lit("\\"), F.lit("/"))
    owned = metrics if without is None else metrics.where((path != without) & ~path.startswith(f"{without}/"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = owned.agg(F.count("*").alias("metric_modules"), total("declarations"), total("public_surface"), total("dependencies"), F.coalesce(F.max("dependencies"), F.lit(0)).cast("long").alias("max_dependencies"))
    return sums.withColumn("public_ratio", F.try_divide(F.col("public_surface").cast("double"), F.nullif("declarations", F.lit(0))))


def step_rollup(commands: DataFrame) -> DataFrame:
    """step, count, wall_seconds, statuses (status -> number) of commands(step, status, duration_seconds)."""
    per = commands.groupBy("step", "status").agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("s"))
    return per.groupBy("step").agg(F.sum("n").alias("count"), F.sum("s").alias("wall_seconds"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("statuses"))


def inventory(files: DataFrame) -> DataFrame:
    """One row over files(path, lines, test): counts of files, lines, small and index files and folders; tests only in the first two and test_files."""
    own = lambda c: F.when(~F.col("test"), c)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("nonempty_lines"), F.count_if("test").alias("test_files"), F.count_if(~F.col("test")).alias("production_files"),
        F.median(own(F.col("lines"))).alias("median_lines"), F.count_if(~F.col("test") & (F.col("lines") <= 20)).alias("tiny_files"), F.count_if(~F.col("test") & name.rlike(r"^index(\.[^.]*)?$")).alias("index_files"),
        F.count_distinct(own(F.regexp_extract("path", r"^(.*)/[^/]*$", 1))).alias("directories"),
    )


def described(members: DataFrame, by: str, order: Sequence[str], text: Column, most: int = 8) -> DataFrame:
    """by, text: the number of members and the first `most` of them in order, with an ellipsis if there are more."""
    ranked = members.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("__rn") <= most, F.struct("__rn", text.alias("t"))))), lambda x: x["t"]), ", ")
    n = F.count("*")
    return ranked.groupBy(by).agg(F.concat(n.cast("string"), F.lit(" functions ["), shown, F.when(n > most, ", …").otherwise(""), F.lit("]")).alias("text"))


def funnel(modules: DataFrame) -> DataFrame:
    """One row: all modules, eligible ones, those of them with two large clusters or more, those of these that are separated. modules(eligible, large, separated)."""
    candidate = F.col("eligible") & (F.col("large") >= 2)
    return modules.agg(F.count("*").alias("modules"), F.count_if("eligible").alias("eligible"), F.count_if(candidate).alias("candidates"), F.count_if(candidate & F.col("separated").isNotNull()).alias("separated"))


def window_coverage(commits: DataFrame, window: int) -> DataFrame:
    """seq, coverage and the other columns of the newest `window` commits (seq from 0): `window` if there are more, else `root`."""
    newest = commits.where(F.col("seq") < window + 1)
    more = newest.where(F.col("seq") == window).count() > 0
    return newest.where(F.col("seq") < window).withColumn("coverage", F.lit("window" if more else "root"))


def in_text_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in the order in which people read names, for a last step: by the Unicode collation, not by code points."""
    return rows.orderBy(*[F.collate(F.col(c), "UNICODE") for c in columns])


def models(loaded: Mapping[str, DataFrame | None]) -> DataFrame:
    """The modules of all languages that were found, with a column `model`; none at all is an error."""
    some = [df.withColumn("model", F.lit(name)) for name, df in loaded.items() if df is not None]
    if not some:
        raise ValueError("no model of any language")
    out = some[0]
    for df in some[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
