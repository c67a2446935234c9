"""Change history: identities through renames, observations, co-change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import staged

#: Commits in a block of the join of files with the commits that they live through.
BLOCK = 32


def observations(commits: DataFrame, changes: DataFrame, files: DataFrame, maximum_files: int, key: str = "repo") -> DataFrame:
    """repo, seq, file, edited: for each eligible commit the tracked files that exist before it is undone, and whether it edits them.

    commits(repo, seq), seq 0 the newest; changes(repo, seq, path, previous_path, kind, content_changed); files(repo, path). The walk goes
    from new to old: an addition ends a file's identity, a rename moves it to its earlier path; commits with more than `maximum_files`
    changes move identities but aren't observations, nor are those without an edit of a tracked file; so commits without changes play no part.

    A path's stay under one name ends at its next addition or rename. Rounds of written joins follow the renames, first to find which names
    are reached, then to hand on identities; there are as many as the longest chain of renames, and no history is gathered in a task."""
    real = changes.where("path is not null").select(F.col(key).alias("repo"), F.col("seq").cast("int").alias("seq"), "path", "previous_path", "kind", "content_changed")
    ends = real.where("kind in ('A', 'R')").groupBy("repo", "path", "seq").agg(F.min(F.struct("kind", "previous_path")).alias("how"))
    first = files.where("path is not null").select(F.col(key).alias("repo"), "path", F.lit(0).alias("start")).distinct()
    entered = real.where("kind = 'R' and previous_path is not null").select("repo", F.col("previous_path").alias("path"), (F.col("seq") + 1).alias("start")).distinct()
    starts = first.unionByName(entered)
    until = starts.join(ends, ["repo", "path"]).where("seq >= start").groupBy("repo", "path", "start").agg(F.min(F.struct("seq", "how")).alias("e"))
    following = F.when(F.col("e.how.kind") == "R", F.col("e.how.previous_path")).alias("following")
    stays = staged(starts.join(until, ["repo", "path", "start"], "left").select("repo", "path", "start", F.col("e.seq").alias("end"), following), "stays")
    onward = lambda df: df.where("following is not null").select("repo", F.col("following").alias("path"), (F.col("end") + 1).alias("start"), F.col("path").alias("source"), F.col("start").alias("since"))

    at = ["repo", "path", "start"]
    frontier = reached = staged(first.join(stays, at), "reached")
    while not (new := staged(onward(frontier).select(*at).distinct().join(stays, at).join(reached.select(*at), at, "left_anti"), "reached")).isEmpty():
        frontier, reached = new, reached.unionByName(new)
    # Who moves to a name takes it over from whoever had it.
    taken = F.lead("start").over(Window.partitionBy("repo", "path").orderBy("start")) - 1
    kept = staged(reached.withColumn("last", F.least("end", taken)), "kept")
    links = staged(onward(kept.where("last = end")).groupBy(*at).agg(F.max(F.struct("source", "since")).alias("s")).select(*at, "s.source", "s.since"), "links")
    frontier = named = staged(first.withColumn("file", F.col("path")), "named")
    while not (new := staged(links.join(frontier.select("repo", F.col("path").alias("source"), F.col("start").alias("since"), "file"), ["repo", "source", "since"]).select(*at, "file"), "named")).isEmpty():
        frontier, named = new, named.unionByName(new)

    newest = real.groupBy("repo").agg(F.max("seq").alias("oldest"))
    spans = staged(named.join(kept, at).join(newest, "repo").select("repo", "path", "file", "start", F.coalesce("last", "oldest").alias("last")).where("start <= last"), "spans")
    edits = real.where("content_changed and kind <> 'D'").select("repo", "seq", "path").join(spans, ["repo", "path"]).where("seq between start and last").select("repo", "seq", "file").distinct()
    edits = staged(edits, "edits")
    eligible = real.groupBy("repo", "seq").count().where(F.col("count") <= maximum_files).join(edits, ["repo", "seq"], "left_semi").select("repo", "seq", F.floor(F.col("seq") / BLOCK).alias("block"))
    block = lambda c: F.floor(F.col(c) / BLOCK)
    alive = spans.withColumn("block", F.explode(F.sequence(block("start"), block("last")))).join(eligible, ["repo", "block"]).where("seq between start and last")
    marked = alive.select("repo", "seq", "file").join(edits.withColumn("edited", F.lit(True)), ["repo", "seq", "file"], "left")
    return marked.select(F.col("repo").alias(key), "seq", "file", F.coalesce("edited", F.lit(False)).alias("edited"))


def co_change(alive: DataFrame, modules: DataFrame, key: str = "repo") -> DataFrame:
    """Evidence for each pair of files of different modules that were changed together: n, edits_a, edits_b, shared, rates and lift, the
    newest five shared commits.

    alive(repo, seq, file, edited); modules(repo, file, module). n counts commits in which both exist, and edits those of each among
    them. The join starts from edits, so only pairs that share a commit are formed."""
    edited = alive.where("edited").select(key, "seq", "file")
    named = edited.join(modules, [key, "file"])
    a = named.select(key, "seq", F.col("file").alias("a"), F.col("module").alias("ma"))
    b = named.select(key, "seq", F.col("file").alias("b"), F.col("module").alias("mb"))
    pairs = a.join(b, [key, "seq"]).where("a < b and ma <> mb")
    shared = pairs.groupBy(key, "a", "b").agg(F.count("*").alias("shared"), F.slice(F.sort_array(F.collect_list("seq")), 1, 5).alias("commits"))
    left = alive.select(key, "seq", F.col("file").alias("a"), F.col("edited").alias("ea"))
    right = alive.select(key, "seq", F.col("file").alias("b"), F.col("edited").alias("eb"))
    both = shared.select(key, "a", "b").join(left, [key, "a"]).join(right, [key, "b", "seq"])
    counts = both.groupBy(key, "a", "b").agg(F.count("*").alias("n"), F.count_if("ea").alias("edits_a"), F.count_if("eb").alias("edits_b"))
    return rates(shared.join(counts, [key, "a", "b"]))


def baskets(rows: DataFrame, basket: str, item: str, module: str) -> DataFrame:
    """The same evidence for baskets, where every item exists throughout: n is the number of baskets, edits are each item's own."""
    n = rows.agg(F.count_distinct(basket).alias("n"))
    once = rows.select(basket, item, module).distinct()
    single = once.groupBy(item).agg(F.count("*").alias("edits"))
    a, b = (once.select(basket, F.col(item).alias(x), F.col(module).alias(f"m{x}")) for x in "ab")
    pairs = a.join(b, basket).where("a < b and ma <> mb").groupBy("a", "b").agg(F.count("*").alias("shared"))
    joined = pairs.join(single.select(F.col(item).alias("a"), F.col("edits").alias("edits_a")), "a").join(single.select(F.col(item).alias("b"), F.col("edits").alias("edits_b")), "b")
    return rates(joined.crossJoin(F.broadcast(n)))


def rates(pairs: DataFrame) -> DataFrame:
    """Add rate_a, rate_b and lift; null where there is nothing to divide by."""
    return pairs.withColumns(
        {
            "rate_a": F.try_divide(F.col("shared").cast("double"), F.col("edits_a")),
            "rate_b": F.try_divide(F.col("shared").cast("double"), F.col("edits_b")),
            "lift": F.try_divide(F.col("shared").cast("double") * F.col("n"), F.col("edits_a") * F.col("edits_b")),
        }
    )


def qualifying(pairs: DataFrame, observations: int = 30, shared: int = 5, rate: float = 0.8, lift: float = 2.0) -> DataFrame:
    """Pairs at or above all four thresholds; null rates never are."""
    return pairs.where((F.col("n") >= observations) & (F.col("shared") >= shared) & (F.col("rate_a") >= rate) & (F.col("rate_b") >= rate) & (F.col("lift") >= lift))


def direction(pairs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Add dependency: which file of the pair depends on which, left-to-right, right-to-left, both or none."""
    edge = dependencies.select(F.col("src"), F.col("dst")).distinct()
    ab = edge.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("__ab"))
    ba = edge.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(True).alias("__ba"))
    joined = pairs.join(ab, ["a", "b"], "left").join(ba, ["a", "b"], "left")
    there, back = F.col("__ab").isNotNull(), F.col("__ba").isNotNull()
    return joined.withColumn("dependency", F.when(there & back, "both").when(there, "left-to-right").when(back, "right-to-left").otherwise("none")).drop("__ab", "__ba")


def ranked(pairs: DataFrame) -> DataFrame:
    """Add rank: by the smaller rate, shared commits, lift, all falling, then paths."""
    w = Window.orderBy(F.least("rate_a", "rate_b").desc(), F.desc("shared"), F.desc("lift"), "a", "b")
    return pairs.withColumn("rank", F.row_number().over(w))


def snapshot_summary(files: DataFrame) -> DataFrame:
    """A row per repo, seq and revision of snapshot files (repo, seq, revision, path, lines, test, index, reexport): numbers of files, lines, folders and
    index files, of those that aren't tests as a whole and, as ts_, of those in TypeScript."""
    own = ~F.col("test")
    typed = own & F.col("path").rlike(r"\.tsx?$")
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(".")
    count = lambda when: F.count_if(when)
    lines = lambda when: F.coalesce(F.sum(F.when(when, F.col("lines"))), F.lit(0))
    return files.groupBy("repo", "seq", "revision").agg(
        F.count("*").alias("files"), count(own).alias("production_files"), count(F.col("test")).alias("test_files"), F.sum("lines").alias("nonempty_lines"), lines(own).alias("production_nonempty_lines"),
        F.median(F.when(own, F.col("lines"))).alias("median_lines"), count(own & (F.col("lines") <= 20)).alias("tiny_files"), count(own & F.col("index")).alias("index_files"),
        count(own & F.col("index") & F.col("reexport")).alias("reexporting_index_files"), F.count_distinct(F.when(own, folder)).alias("directories"),
        count(typed).alias("ts_files"), lines(typed).alias("ts_nonempty_lines"), F.median(F.when(typed, F.col("lines"))).alias("ts_median_lines"), count(typed & (F.col("lines") <= 20)).alias("ts_tiny_files"),
        count(typed & F.col("index")).alias("ts_index_files"), F.count_distinct(F.when(typed, folder)).alias("ts_directories"),
    )
