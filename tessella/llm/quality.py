"""Quality rules: fixed limits, then robust outliers of statistic vectors per language and source. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, staged, with_parameters, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT = 50
#: Rows from which a group has an estimate of its own: some sixteen for each of six dimensions. Groups with fewer are judged by all such of their
#: language together, and if these are too few by all such of any language.
MIN_GROUP = 100
#: Share of a group's rows that the determinant is minimised over, and rounds of concentration.
CORE = 0.75
ROUNDS = 3
#: Squared distance from which a vector is an outlier: twice the 0.9999 quantile of chi-square with six degrees of freedom (27.9), as texts have
#: heavier tails than normal vectors.
CUTOFF = 60.0
#: Transformed statistics and the standard deviation that is added to each, below which differences don't matter: half of the words again, a
#: twelfth of a word's length, a quarter more signs. It also keeps the determinant of constant columns above zero.
DIMENSIONS = (("x_length", 0.5), ("x_word", 0.08), ("x_symbols", 0.25), ("x_upper", 0.25), ("x_punct", 0.25), ("x_repeat", 0.15))
NAMES = [n for n, _ in DIMENSIONS]
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _chi2_below(x: float, k: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def _chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_below(mid, k) < q else (low, mid)
    return low


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the five counts, base_failed and the transformed statistics to `docs`; names that start with `__q_` are reserved.

    Three-word windows are hashed to 64 bits, and sorted together with their positions as plain numbers, so repeats are neighbours; a position takes as
    many of the bits as the text's number of windows needs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    mask = F.col("__q_mask")
    at = lambda name, i: F.get(F.col(name), i)
    place = lambda k: at("__q_sorted", k).bitwiseAND(mask)
    empty = F.array().cast("array<bigint>")
    step = docs.withColumns({"__q_words": words(F.col(text_col)), "__q_lines": lines})
    step = step.withColumn(
        "__q_windows",
        F.when(F.size("__q_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("__q_words") - 3), lambda i: F.xxhash64(at("__q_words", i), at("__q_words", i + 1), at("__q_words", i + 2)))).otherwise(empty),
    )
    step = step.withColumn("__q_mask", F.expr("shiftleft(1L, length(bin(size(__q_windows)))) - 1L"))
    step = step.withColumn("__q_sorted", F.sort_array(F.transform("__q_windows", lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))))
    same = lambda k: ((at("__q_sorted", k).bitwiseXOR(at("__q_sorted", k + 1))).bitwiseAND(F.bitwise_not(mask)) == 0) & (at("__q_windows", place(k).cast("int")) == at("__q_windows", place(k + 1).cast("int")))
    step = step.withColumn("__q_pairs", F.when(F.size("__q_sorted") >= 2, F.filter(F.sequence(F.lit(0), F.size("__q_sorted") - 2), same)).otherwise(F.array().cast("array<int>")))
    covered = F.flatten(F.transform("__q_pairs", lambda k: F.array(*[place(k + d) + j for d in (0, 1) for j in (0, 1, 2)])))
    step = step.withColumns(
        {
            "n_words": F.size("__q_words").cast("long"),
            "word_chars": (F.length(text) - _removed(text, WHITE)).cast("long"),
            "n_symbols": _removed(text, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
            "n_repeat_words": F.size(F.array_distinct(covered)).cast("long"),
            "__q_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
            "__q_punct": F.regexp_count(text, F.lit(r"[.,;:!?]")),
        }
    )
    n, chars = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")
    step = step.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")),
            "x_length": F.log(n),
            "x_word": F.log(chars / n),
            "x_symbols": F.log1p(100 * F.col("n_symbols") / chars),
            "x_upper": F.log1p(100 * F.col("__q_upper") / chars),
            "x_punct": F.log1p(100 * F.col("__q_punct") / chars),
            "x_repeat": F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))),
        }
    )
    return step.drop("__q_words", "__q_lines", "__q_windows", "__q_sorted", "__q_mask", "__q_pairs", "__q_upper", "__q_punct")


def _groups(stats: DataFrame) -> DataFrame:
    """lang, source and the group whose estimate holds: their own; with few rows all such of the language; else of all languages."""
    counts = stats.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    seen = stats.select("lang", "source").distinct().select(F.col("lang").alias("l"), F.col("source").alias("s"))
    all_groups = seen.join(counts, F.col("l").eqNullSafe(F.col("lang")) & F.col("s").eqNullSafe(F.col("source")), "left").select(F.col("l").alias("lang"), F.col("s").alias("source"), F.coalesce("n", F.lit(0)).alias("n"))
    small = F.when(F.col("n") < MIN_GROUP, F.col("n")).otherwise(0)
    sized = all_groups.withColumn("pooled", F.sum(small).over(Window.partitionBy("lang")))
    own, language = F.col("n") >= MIN_GROUP, F.col("pooled") >= MIN_GROUP
    null = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return sized.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.when(own, F.concat_ws("\t", null("lang"), null("source"))).when(language, null("lang")).otherwise(F.lit("")).alias("group"))


def _estimate(rows: DataFrame, scale: float, by: list[str]) -> DataFrame:
    """by, n, m_<i>, and w_<i>_<j>: the inverse of the Cholesky factor of the covariance of each group's rows, times `scale`; logdet: the
    logarithm of that covariance's determinant."""
    p = len(NAMES)
    moments = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(NAMES)] + [F.covar_pop(NAMES[i], NAMES[j]).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *moments)
    for i in range(p):
        for j in range(i + 1):
            value = F.col(f"c_{i}_{j}") * scale
            if i == j:
                value = value + F.lit(DIMENSIONS[i][1] ** 2)
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l_{j}_{j}"))
    for j in range(p):
        for i in range(j, p):
            if i == j:
                value = 1 / F.col(f"l_{i}_{i}")
            else:
                value = -sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l_{i}_{i}")
            out = out.withColumn(f"w_{i}_{j}", value)
    logdet = 2 * sum((F.log(F.col(f"l_{i}_{i}")) for i in range(p)), F.lit(0.0))
    return out.select(*by, "n", *_PARAMETERS, logdet.alias("logdet"))


_PARAMETERS = [f"m_{i}" for i in range(len(NAMES))] + [f"w_{i}_{j}" for i in range(len(NAMES)) for j in range(i + 1)]


def _starts(rows: DataFrame) -> DataFrame:
    """Two estimates per group to begin with: medians and interquartile ranges (start 0), means and covariances of all rows (start 1)."""
    p = len(NAMES)
    out = rows.groupBy("group").agg(F.count("*").alias("n"), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, x in enumerate(NAMES)])
    spread = lambda i: F.sqrt(F.pow((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, 2) + DIMENSIONS[i][1] ** 2)
    robust = out.select("group", F.lit(0).alias("start"), "n", *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(p)], *[(1 / spread(i) if i == j else F.lit(0.0)).alias(f"w_{i}_{j}") for i in range(p) for j in range(i + 1)], F.lit(0.0).alias("logdet"))
    return robust.unionByName(_estimate(rows, 1.0, ["group"]).withColumn("start", F.lit(1)))


def _with_distance(rows: DataFrame, estimate: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the squared distance to each estimate of their group, the estimate's columns `keep`, and its number of rows as g_n."""
    p = len(NAMES)
    joined = with_parameters(rows, estimate.withColumnRenamed("group", "e_group"), F.col("group") == F.col("e_group"))
    whitened = [sum((F.col(f"w_{i}_{j}") * (F.col(NAMES[j]) - F.col(f"m_{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(p)]
    return joined.select(*rows.columns, *keep, F.col("n").alias("g_n"), sum((y * y for y in whitened), F.lit(0.0)).alias("distance"))


def fit_groups(stats: DataFrame, core: float = CORE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Group keys, and minimum-covariance-determinant estimates per group, from rows that the base rules keep.

    Each round keeps the `core` share of a group's rows with the smallest distances and estimates from these, which never
    raises the determinant. Two starts go through the rounds side by side, and each group takes the one with the smaller determinant; then
    rows under the 97.5 % distance are estimated once more. All of it is sums per group, so no group is ever in one place.
    """
    p = len(NAMES)
    groups = staged(_groups(stats), "quality-groups")
    rows = staged(with_group(stats.where(~F.col("base_failed")), groups).select("group", *NAMES), "quality-vectors")
    estimate = staged(_starts(rows), "quality-start")
    factor = core / _chi2_below(_chi2_quantile(core, p), p + 2)
    for k in range(rounds):
        near = _with_distance(rows, estimate, ("start",))
        limit = near.groupBy("group", "start").agg(F.percentile_approx("distance", core, 1000).alias("limit")).withColumnsRenamed({"group": "l_group", "start": "l_start"})
        kept = with_parameters(near, staged(limit, f"quality-limit{k}"), (F.col("group") == F.col("l_group")) & (F.col("start") == F.col("l_start"))).where("distance <= limit")
        estimate = staged(_estimate(kept, factor, ["group", "start"]), f"quality-round{k}")
    best = estimate.groupBy("group").agg(F.min(F.struct("logdet", "start", "n", *_PARAMETERS)).alias("best")).select("group", "best.n", *[f"best.{x}" for x in _PARAMETERS])
    last = _chi2_quantile(0.975, p)
    return groups, staged(_estimate(_with_distance(rows, best).where(F.col("distance") <= last), 1.0, ["group"]), "quality-estimate")


def with_group(stats: DataFrame, groups: DataFrame) -> DataFrame:
    joined = with_parameters(stats, groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")))
    return joined.drop("g_lang", "g_source")


def judge(stats: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """Add distance and kept to rows of `with_statistics` that also have lang and source.

    kept is false where a base rule failed or the squared Mahalanobis distance to the group's robust estimate exceeds `cutoff`.
    Groups with fewer than `min_group` rows even when pooled reject nothing."""
    groups, estimate = fit_groups(stats)
    near = _with_distance(with_group(stats, groups), estimate)
    outlier = F.coalesce((F.col("g_n") >= min_group / 2) & (F.col("distance") > cutoff), F.lit(False))
    return near.withColumn("kept", ~F.col("base_failed") & ~outlier).drop("group", "g_n")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, the transformed
    statistics, distance, kept.

    Cases: null and blank texts have no words and fail the base rules; null languages and sources are groups of their own;
    an empty table gives an empty result; repeated rows are judged alike; other columns of `docs` are ignored.
    """
    plain = docs.select(F.col(id_col), F.col(text_col).alias("__q_text"), F.col("lang"), F.col("source"))
    return judge(staged(with_statistics(plain, "__q_text").drop("__q_text"), "quality-statistics"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `quality_rules` keeps, with their columns. Texts are staged beside their statistics, so they are
    counted once and never shuffled."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__q_row")
    plain = docs.select(own, F.col(text_col).alias("__q_text"), F.col("lang"), F.col("source"))
    stats = staged(with_statistics(plain, "__q_text").drop("__q_text"), "quality-documents")
    return judge(stats).where("kept").select("__q_row.*")
