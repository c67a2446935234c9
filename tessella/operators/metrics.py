"""Module metrics, outliers, scores and rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import checked_roots, under_roots
from ..scratch import staged

#: Points that a finding's severity gives its module.
WEIGHTS = {"error": 4, "smell": 2, "info": 1}


def surface_ratio(surface: Column, declarations: Column) -> Column:
    """Share of declarations that are public; 0 without declarations."""
    return F.when(declarations == 0, F.lit(0.0)).otherwise(surface / declarations).cast("double")


def module_metrics(modules: DataFrame, declarations: DataFrame, dependencies: DataFrame, references: DataFrame) -> DataFrame:
    """One row per module: declarations, public surface and its ratio, fan-out, fan-in, references into other modules and contracts.

    modules(module); declarations(module, name, public); dependencies(src, dst); references(src, dst, contract), where several
    references may name one contract. Modules that nothing mentions stay, with zeros."""
    sizes = declarations.groupBy("module").agg(F.count_distinct("name").alias("declarations"), F.count_distinct(F.when(F.col("public"), F.col("name"))).alias("public_surface"))
    foreign = dependencies.where("src <> dst")
    fan_out = foreign.groupBy(F.col("src").alias("module")).agg(F.count_distinct("dst").alias("dependencies"))
    fan_in = foreign.groupBy(F.col("dst").alias("module")).agg(F.count_distinct("src").alias("dependents"))
    used = references.where("src <> dst").groupBy(F.col("src").alias("module")).agg(F.count("*").alias("cross_module_references"), F.count_distinct("contract").alias("referenced_contracts"))
    out = modules.select("module").distinct()
    for part in (sizes, fan_out, fan_in, used):
        out = out.join(part, "module", "left")
    counts = ["declarations", "public_surface", "dependencies", "dependents", "cross_module_references", "referenced_contracts"]
    out = out.select("module", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    return out.withColumn("public_surface_ratio", surface_ratio(F.col("public_surface"), F.col("declarations")))


def outlier_flags(rows: DataFrame, columns: Sequence[str], minimum: dict[str, float], min_z: float, within: Sequence[str] = ()) -> DataFrame:
    """Add <c>_z and <c>_outlier: at least the minimum, and at least `min_z` population deviations above the mean, where there is a deviation.

    Means and deviations come from one aggregate that is joined back, so no group is gathered for a window."""
    aggs = [f(c).cast("double").alias(f"__{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("dev", F.stddev_pop))]
    out = rows.join(rows.groupBy(*within).agg(*aggs), list(within)) if within else rows.crossJoin(F.broadcast(rows.agg(*aggs)))
    for c in columns:
        z = F.when(F.col(f"__dev_{c}") > 0, (F.col(c) - F.col(f"__mean_{c}")) / F.col(f"__dev_{c}"))
        out = out.withColumn(f"{c}_z", z).withColumn(f"{c}_outlier", F.coalesce((F.col(c) >= minimum.get(c, 0)) & (z >= min_z), F.lit(False)))
    return out.drop(*[f"__{n}_{c}" for c in columns for n in ("mean", "dev")])


def coupling_findings(metrics: DataFrame, minimum: Mapping[str, float], min_z: float) -> DataFrame:
    """module, score, message: modules whose fan-out and whose referenced contracts are both outliers; where their fan-in is one as well, a second
    finding tells it. metrics(module, dependencies, dependents, referenced_contracts); an outlier is at least its `minimum` and `min_z` deviations above the mean."""
    flags = outlier_flags(metrics, ["dependencies", "dependents", "referenced_contracts"], dict(minimum), min_z).where("dependencies_outlier and referenced_contracts_outlier")
    n = lambda c: F.col(c).cast("string")
    outward = F.concat(F.lit("Outward coupling concentration: fan-out of "), n("dependencies"), F.lit(" and "), n("referenced_contracts"), F.lit(" referenced contracts are both repository outliers."))
    inward = F.concat(F.lit("fan-in of "), n("dependents"), F.lit(" is a repository outlier. Outward coupling is also concentrated in this module."))
    told = F.array(F.struct(F.col("referenced_contracts").alias("score"), outward.alias("message")), F.when(F.col("dependents_outlier"), F.struct(F.col("dependents").alias("score"), inward.alias("message"))))
    return flags.select("module", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("x")).select("module", "x.score", "x.message")


def weighted_scores(findings: DataFrame, threshold: float, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """module, score of the modules that reach the threshold; findings without a module, or of other severities, don't count."""
    points = F.lit(None).cast("long")
    for severity, weight in weights.items():
        points = F.when(F.col("severity") == severity, F.lit(weight)).otherwise(points)
    return findings.where("module is not null").withColumn("points", points).where("points is not null").groupBy("module").agg(F.sum("points").cast("long").alias("score")).where(F.col("score") >= threshold)


def run_summary(findings: DataFrame, modules: DataFrame) -> DataFrame:
    """One row: modules, diagnostics, errors, smells."""
    counted = findings.agg(F.count("*").alias("diagnostics"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "smell").alias("smells"))
    return modules.agg(F.count_distinct("module").alias("modules")).crossJoin(counted)


def unused_names(names: DataFrame) -> DataFrame:
    """module, unused, names of public names that no other module refers to."""
    return names.where("external_references = 0").groupBy("module").agg(F.count("*").alias("unused"), F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))


def growth(current: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, prior where the value is above the baseline's; keys that the baseline doesn't have are left out."""
    return current.select(key, value).join(baseline.select(key, F.col(value).alias("prior")), key).where(F.col(value) > F.col("prior"))


def beyond_allowance(rows: DataFrame, allowance: DataFrame, keys: Sequence[str], order: Sequence[str], allowed: str = "allowed") -> DataFrame:
    """Multiset difference: of each key's rows, in order, those after the first `allowed`."""
    numbered = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = numbered.join(allowance.select(*keys, F.col(allowed).alias("__allowed")), list(keys), "left")
    return joined.where(F.col("__rn") > F.coalesce("__allowed", F.lit(0))).drop("__rn", "__allowed")


def multiplicities(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("allowed"))


def gap_histogram(gaps: DataFrame) -> DataFrame:
    """gap, source, test: edges of each gap by the kind of their file."""
    return gaps.groupBy("gap").agg(F.count_if(~F.col("is_test")).alias("source"), F.count_if(F.col("is_test")).alias("test"))


def violations_by_limit(histogram: DataFrame) -> DataFrame:
    """limit, source, test for each limit from 0 to the largest gap: edges whose gap is above it."""
    top = histogram.agg(F.coalesce(F.max("gap"), F.lit(0)).alias("top"))
    limits = top.select(F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("limit"))
    dense = limits.join(histogram, F.col("limit") == F.col("gap"), "left")
    above = Window.orderBy(F.col("limit").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return dense.select("limit", *[F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(above), F.lit(0)).cast("long").alias(c) for c in ("source", "test")])


def limit_exceeded(rows: DataFrame, value: str, limit: int | None) -> DataFrame:
    """Rows above a limit; none where the limit is off."""
    return rows.where(F.lit(False)) if limit is None else rows.where(F.col(value) > limit)


def endpoints(runs: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key the values of its first and last run, as first_<v> and last_<v>, and the number of runs."""
    at = F.struct(*order)
    aggs = [f(F.col(v), at).alias(f"{n}_{v}") for v in values for n, f in (("first", F.min_by), ("last", F.max_by))]
    return runs.groupBy(key).agg(F.count("*").alias("runs"), *aggs)


def around(rows: DataFrame, key: str, order: Sequence[str], event: Column, before: int = 30, after: int = 30) -> DataFrame:
    """Rows of each key by their place around its first event: phase is `before` or `after` within the windows, which exclude the event
    itself, `post` from the event on beyond the window; the rest is left out."""
    w = Window.partitionBy(key).orderBy(*order)
    placed = rows.withColumn("__rn", F.row_number().over(w)).withColumn("__at", F.min(F.when(event, F.col("__rn"))).over(Window.partitionBy(key)))
    step = F.col("__rn") - F.col("__at")
    placed = placed.withColumn("step", step.cast("long"))
    phase = F.when((step < 0) & (step >= -before), "before").when((step > 0) & (step <= after), "after").when(step >= 0, "post")
    return placed.withColumn("phase", phase).where("phase is not null").drop("__rn", "__at")


def commit_summary(commits: DataFrame, key: str) -> DataFrame:
    """key, commits, added, deleted, median_files, fixes of a table (key, files, added, deleted, subject)."""
    return commits.groupBy(key).agg(
        F.count("*").alias("commits"),
        F.sum(F.coalesce("added", F.lit(0))).cast("long").alias("added"),
        F.sum(F.coalesce("deleted", F.lit(0))).cast("long").alias("deleted"),
        F.median("files").alias("median_files"),
        F.count_if(F.lower("subject").rlike(r"\b(fix|bug|revert)")).alias("fixes"),
    )


def top_k(rows: DataFrame, by: Sequence[Column], k: int) -> DataFrame:
    return rows.orderBy(*by).limit(k)


def quantile_samples(rows: DataFrame, band: str, value: str, group: str, key: str, quantiles: Sequence[float] = (0.0, 0.1, 0.5, 0.9, 1.0)) -> DataFrame:
    """Per band and quantile the row whose value is nearest to it, of one row per group (the smallest key)."""
    one = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(band, group).orderBy(key))).where("__rn = 1").drop("__rn")
    marks = one.groupBy(band).agg(F.percentile(value, list(quantiles)).alias("__m"))
    marks = marks.select(band, F.posexplode("__m").alias("__q", "__mark"))
    near = one.join(marks, band).withColumn("__rn", F.row_number().over(Window.partitionBy(band, "__q").orderBy(F.abs(F.col(value) - F.col("__mark")), key))).where("__rn = 1")
    return near.select(band, F.element_at(F.array(*[F.lit(float(q)) for q in quantiles]), F.col("__q") + 1).alias("quantile"), key, value)


def attribute_runs(runs: DataFrame, project: DataFrame, engine: DataFrame) -> DataFrame:
    """Add attribution: whose revisions a run's revision is in: project, engine, ambiguous or unresolved."""
    mark = lambda t, n: t.select("revision").distinct().withColumn(n, F.lit(True))
    joined = runs.join(mark(project, "__p"), "revision", "left").join(mark(engine, "__e"), "revision", "left")
    p, e = F.col("__p").isNotNull(), F.col("__e").isNotNull()
    return joined.withColumn("attribution", F.when(p & e, "ambiguous").when(p, "project").when(e, "engine").otherwise("unresolved")).drop("__p", "__e")


def color_files(files: DataFrame, roots: Sequence[str], maximum: int) -> DataFrame:
    """file, colors, score and other columns of the files (file, colors) below `roots` that have a colour, if there are more than `maximum`; score is
    their number. The files are written once, so that colours are looked for once, not for the count and each mention of them."""
    some = staged(files, "color-files").where(under_roots(F.col("file"), checked_roots(roots)) & (F.size("colors") > 0))
    n = some.count()
    return some.where(F.lit(n > maximum)).withColumn("score", F.lit(n).cast("long"))
