"""Clones, near duplicates, vector distances, clustering, projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import drop_staged, staged
from .components import connected_components


def content_hash(text: Column) -> Column:
    """SHA-256, lower-case hexadecimal."""
    return F.sha2(text, 256)


def canonical_text(text: Column) -> Column:
    """Trimmed, lower-cased, digits erased."""
    return F.regexp_replace(F.lower(F.trim(text)), "[0-9]", "")


def same_content(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """hash, members, first: contents that several rows share."""
    return rows.select(key, content_hash(content).alias("hash")).groupBy("hash").agg(F.count("*").alias("members"), F.min(key).alias("first")).where("members > 1")


def exact_clones(functions: DataFrame, minimum_nodes: int = 20, carried: tuple[str, ...] = ()) -> DataFrame:
    """file, a, b, nodes, differences of every pair of one file with one shape (literals erased) and size; `carried` columns of both sides come along
    as a_<column> and b_<column>, which spares a join of all pairs.

    functions(file, fn, nodes, shape, literals): differences lists (place, left, right) of the literals that differ."""
    big = functions.where(F.col("nodes") >= minimum_nodes)
    a = big.select("file", "nodes", "shape", F.col("fn").alias("a"), F.col("literals").alias("la"), *[F.col(c).alias(f"a_{c}") for c in carried])
    b = big.select("file", "nodes", "shape", F.col("fn").alias("b"), F.col("literals").alias("lb"), *[F.col(c).alias(f"b_{c}") for c in carried])
    zipped = F.zip_with(F.zip_with("la", "lb", lambda x, y: F.struct(x.alias("left"), y.alias("right"))), F.sequence(F.lit(0), F.greatest(F.size("la"), F.size("lb"))), lambda p, i: F.struct(i.alias("place"), p["left"].alias("left"), p["right"].alias("right")))
    differences = F.filter(zipped, lambda d: d["left"] != d["right"])
    return a.join(b, ["file", "nodes", "shape"]).where("a < b").select("file", "a", "b", "nodes", differences.alias("differences"), *[f"{x}_{c}" for c in carried for x in "ab"])


def line_anchors(docs: DataFrame, key: str, text: str, longer_than: int = 20) -> DataFrame:
    """key, anchor: hashes of the distinct trimmed, lower-cased lines that are longer than a limit."""
    line = docs.select(key, F.explode(F.split(F.col(text), "\n")).alias("line")).select(key, F.lower(F.trim("line")).alias("line"))
    return line.where(F.length("line") > longer_than).select(key, content_hash(F.col("line")).alias("anchor")).distinct()


def candidate_pairs(anchors: DataFrame, key: str, minimum: int) -> DataFrame:
    """a, b, shared: pairs with at least `minimum` anchors in common. No anchor is left out for being frequent."""
    a, b = (anchors.select("anchor", F.col(key).alias(x)) for x in "ab")
    return a.join(b, "anchor").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= minimum)


def confirmed_pairs(pairs: DataFrame, docs: DataFrame, anchors: DataFrame, key: str, text: str, minimum: float) -> DataFrame:
    """a, b, shared, similarity: candidate pairs whose shared anchors are at least `minimum` of the union of both sides' anchors, except
    pairs of one text. Equal anchors over different texts (case, spaces, short lines, order) are kept."""
    sizes = anchors.groupBy(key).agg(F.count("*").alias("n"))
    facts = docs.select(key, content_hash(F.col(text)).alias("h")).join(sizes, key)
    a, b = (facts.select(F.col(key).alias(x), F.col("n").alias(f"n{x}"), F.col("h").alias(f"h{x}")) for x in "ab")
    similarity = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    joined = pairs.join(a, "a").join(b, "b").where("ha <> hb").select("a", "b", "shared", similarity.alias("similarity"))
    return joined.where(F.col("similarity") >= minimum)


def near_groups(docs: DataFrame, anchors: DataFrame, key: str, text: str, minimum: int, ratio: float) -> DataFrame:
    """key, component (smallest key), similarity (the smallest of the component's links): documents in components of `confirmed_pairs`, without making
    all pairs.

    Documents with equal anchors are one class: they are linked if they have more than one text, or by way of another class. Classes link by
    prefixes: sets of n anchors that share `ratio` of their union share one of their n - ceil(ratio n) + 1 rarest."""
    facts = docs.select(F.col(key).alias("k"), content_hash(F.col(text)).alias("h"))
    sets = anchors.groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_set("anchor")).alias("anchors")).where(F.size("anchors") >= minimum)
    members = staged(sets.select("k", content_hash(F.array_join("anchors", "")).alias("class"), "anchors").join(facts, "k"), "near-members")
    classes = staged(members.groupBy("class").agg(F.first("anchors").alias("anchors"), F.size(F.first("anchors")).alias("n"), (F.min("h") != F.max("h")).alias("mixed")), "near-classes")
    tokens = classes.select("class", "n", F.explode("anchors").alias("anchor"))
    rare = tokens.groupBy("anchor").agg(F.count("*").alias("df")).where("df > 1")
    place = F.row_number().over(Window.partitionBy("class").orderBy("df", "anchor"))
    # Anchors of one class come first in its order and meet nothing.
    alone = tokens.join(rare, "anchor", "left_anti").groupBy("class").agg(F.count("*").alias("alone"))
    ranked = tokens.join(rare, "anchor").withColumn("place", place).join(alone, "class", "left")
    prefix = staged(ranked.where(F.col("place") + F.coalesce("alone", F.lit(0)) <= F.col("n") - F.ceil(F.lit(ratio) * F.col("n") - 1e-9) + 1).select("class", "n", "anchor"), "near-prefixes")
    a, b = (prefix.select("anchor", F.col("class").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    met = a.join(b, "anchor").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(ratio) * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    of = lambda x: classes.select(F.col("class").alias(x), F.col("anchors").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    shared = F.size(F.array_intersect("sa", "sb"))
    told = met.join(of("a"), "a").join(of("b"), "b").select("a", "b", shared.alias("shared"), (shared / (F.col("na") + F.col("nb") - shared)).alias("similarity"))
    links = staged(told.where((F.col("shared") >= minimum) & (F.col("similarity") >= ratio - 1e-9)), "near-links")
    found = staged(connected_components(links, "a", "b"), "near-components")
    alike = classes.where("mixed").select(F.col("class").alias("node")).join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    placed = members.select("k", F.col("class").alias("node")).join(found.unionByName(alike), "node")
    low = links.join(found.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.min("similarity").alias("similarity"))
    named = placed.groupBy("component").agg(F.min("k").alias("first")).join(low, "component", "left")
    return placed.join(named, "component").select(F.col("k").alias(key), F.col("first").alias("component"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))


def clusters(pairs: DataFrame, minimum_members: int, similarity: str | None = None) -> DataFrame:
    """component, members, and the smallest similarity of its pairs, for components of enough members."""
    found = staged(connected_components(pairs, "a", "b"), "clusters")
    sizes = found.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") >= minimum_members)
    if similarity is None:
        return sizes
    low = pairs.join(found.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.min(similarity).alias("similarity"))
    return sizes.join(low, "component")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, between 0 and 2."""
    return F.least(F.greatest(1 - dot(a, b) / (norm(a) * norm(b)), F.lit(0.0)), F.lit(2.0))


def valid_vector(v: Column, size: int) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == size) & fine & (norm(v) > 0), F.lit(False))


#: Vectors of a block that meets another one: with 64 numbers each 256 KB.
BLOCK = 500


def cross_distances(rows: DataFrame, module: str, cluster: str, vector: str) -> DataFrame:
    """module, a, b, distance: the smallest cosine distance between two clusters of a module.

    All pairs count, so the work grows with the square of a module; vectors of one cluster are dealt to blocks of about `BLOCK`, two blocks
    of a module meet in a task as matrices, and only their smallest distance leaves it. Vectors without a finite length are near to none, and
    copies as near as their first."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (module, cluster)}
    length = norm(F.col(vector))
    fine = F.col(cluster).isNotNull() & F.col(module).isNotNull() & (length > 0) & (length < float("inf"))
    told = rows.where(fine).select(F.col(module).alias("module"), F.col(cluster).alias("c"), F.col(vector).alias("v")).distinct()
    sizes = told.groupBy("module", "c").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / BLOCK)
    dealt = told.join(sizes, ["module", "c"]).withColumn("block", F.pmod(F.xxhash64("v"), parts))
    blocks = staged(dealt.groupBy("module", "c", "block").agg(F.collect_list("v").alias("v")), "vector-blocks")

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = (np.stack(x).astype(float) for x in (row.va, row.vb))
                a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
                yield pd.DataFrame({"module": [row.module], "a": [row.a], "b": [row.b], "distance": [float(np.clip(1 - (a @ b.T).max(), 0, 2))]})

    # Numbers of blocks meet first, so that a module's pairs are in as many tasks as it has blocks.
    a, b = (blocks.select("module", F.col("c").alias(x), F.col("block").alias(f"n{x}")) for x in "ab")
    of = lambda x: blocks.select("module", F.col("c").alias(x), F.col("block").alias(f"n{x}"), F.col("v").alias(f"v{x}"))
    meet = a.join(b, "module").where("a < b").join(of("a"), ["module", "a", "na"]).join(of("b"), ["module", "b", "nb"])
    return meet.select("module", "a", "b", "va", "vb").mapInPandas(run, f"module {kinds[module]}, a {kinds[cluster]}, b {kinds[cluster]}, distance double").groupBy("module", "a", "b").agg(F.min("distance").alias("distance"))


def separation(rows: DataFrame, distances: DataFrame, module: str, cluster: str, minimum: int = 8, threshold: float = 0.8) -> DataFrame:
    """module, large, best, a, b, distance: the number of clusters of enough members, the largest distance between two, and the first pair (in
    order) at or above the threshold."""
    large = rows.groupBy(F.col(module).alias("module"), F.col(cluster).alias("c")).agg(F.count("*").alias("n")).where(F.col("n") >= minimum)
    keep = lambda end: large.select("module", F.col("c").alias(end))
    pairs = distances.join(keep("a"), ["module", "a"]).join(keep("b"), ["module", "b"])
    first = pairs.groupBy("module").agg(F.max("distance").alias("best"), F.min(F.when(F.col("distance") >= threshold, F.struct("a", "b", "distance"))).alias("first"))
    return large.groupBy("module").agg(F.count("*").alias("large")).join(first, "module", "left").select("module", "large", "best", "first.a", "first.b", "first.distance")


def _linkage(vectors: np.ndarray, cut: float) -> tuple[list[tuple[int, int, float, int]], list[int]]:
    """Merges of average linkage, and the cluster of each leaf where merges above the cut aren't made. Leaves are in canonical order; ties go to
    the lowest ids."""
    n = len(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return linkage_of(np.clip(1 - unit @ unit.T, 0, 2), cut) if n else ([], [])


def linkage_of(distance: np.ndarray, cut: float) -> tuple[list[tuple[int, int, float, int]], list[int]]:
    """The same for a matrix of distances. Each cluster remembers its nearest one of a higher id, so a merge looks at one row and at those whose
    nearest has gone."""
    d = np.array(distance, float)
    n = len(d)
    if not (np.isfinite(d).all() and (d >= 0).all() and np.isfinite(cut) and cut >= 0):
        raise ValueError("distances and the cut must be finite and not negative")
    ids, sizes, active = np.arange(n), np.ones(n), np.ones(n, bool)
    near, gap = np.full(n, -1), np.full(n, np.inf)
    label, merges = np.arange(n), []

    def look(s: int) -> None:
        others = np.flatnonzero(active & (ids > ids[s]))
        near[s], gap[s] = -1, np.inf
        if len(others):
            least = d[s, others].min()
            tied = others[d[s, others] == least]
            near[s], gap[s] = tied[ids[tied].argmin()], least

    for s in range(n):
        look(s)
    for k in range(n - 1):
        tied = np.flatnonzero(gap == gap.min())
        i = int(tied[ids[tied].argmin()])
        j, found = int(near[i]), float(gap[i])
        merges.append((int(ids[i]), int(ids[j]), found, int(sizes[i] + sizes[j])))
        if found <= cut:
            a, b = label[i], label[j]
            label[label == max(a, b)] = min(a, b)
        row = (d[i] * sizes[i] + d[j] * sizes[j]) / (sizes[i] + sizes[j])
        d[i], d[:, i] = row, row
        sizes[i] += sizes[j]
        ids[i], active[j] = n + k, False
        near[i], near[j], gap[i], gap[j] = -1, -1, np.inf, np.inf
        for s in np.flatnonzero(active):
            if s != i and near[s] in (i, j):
                look(s)
            elif s != i and row[s] < gap[s]:
                near[s], gap[s] = i, row[s]
    return merges, label.tolist()


def average_linkage(rows: DataFrame, module: str, key: str, vector: str, cut: float, most: int = 5000) -> DataFrame:
    """module, key, cluster (its first key in order): average linkage on cosine distances within each module, cut at a distance.

    A module of at most `most` members is one numeric problem of a matrix of its members, so such modules run in parallel; larger ones merge in
    rounds over blocks of clusters, so that no task holds a module."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (module, key)}
    if not (np.isfinite(cut) and cut >= 0):
        raise ValueError("the cut must be finite and not negative")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, kind="stable")
        _, label = _linkage(np.stack(group[vector].to_numpy()).astype(float), cut)
        keys = group[key].to_numpy()
        return pd.DataFrame({module: group[module].to_numpy(), key: keys, "cluster": keys[label]})

    def within(some: DataFrame) -> DataFrame:
        return some.select(module, key, vector).groupBy(module).applyInPandas(run, f"{module} {kinds[module]}, {key} {kinds[key]}, cluster {kinds[key]}")

    large = staged(rows.groupBy(F.col(module).alias("__m")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("__m"), "large-modules")
    if large.isEmpty():
        return within(rows)
    same = F.col(module).eqNullSafe(F.col("__m"))
    rest = rows.join(large, same, "left_semi").select(F.col(module).alias("module"), F.col(key).alias("key"), F.col(vector).alias("v"))
    return within(rows.join(large, same, "left_anti")).unionByName(_linkage_rounds(rest, cut).toDF(module, key, "cluster"))


#: Clusters of a block that meets another one in a task: their distances take 8 MB.
LINKED = 1000
#: Clusters that are left of a module from which on one task merges them, with a matrix of 32 MB: the last merges are few a round.
LAST = 2000


def _linkage_rounds(rows: DataFrame, cut: float) -> DataFrame:
    """module, key, cluster of rows(module, key, v): `average_linkage` without its matrix.

    The mean distance of two clusters follows from the sums of their vectors of length one, so a cluster is its size and its sum. Merging two
    clusters brings neither nearer to a third than the nearer one was: all pairs that are each other's nearest merge at once, and a cluster that is within the
    cut of no other never will be, so it is left as it is. Equal vectors begin as one cluster. Of equally near ones the smallest key is the nearest; each round
    merges the nearest pair at least."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("module", "key")}
    unit = rows.select("module", "key", F.transform("v", lambda x: x.cast("double")).alias("v"), norm(F.col("v")).alias("length"))
    unit = staged(unit.select("module", "key", F.transform("v", lambda x: x / F.nullif("length", F.lit(0.0))).alias("v")), "linkage-rows")
    first = unit.groupBy("module", "v").agg(F.min("key").alias("cluster"), F.count("*").cast("double").alias("n"))
    members = staged(unit.join(first.select("module", "v", "cluster"), ["module", "v"]).select("module", "key", "cluster"), "linkage-members")
    if members.count() < unit.count() or unit.where(F.exists("v", lambda x: x.isNull() | F.isnan(x))).limit(1).count():
        raise ValueError("distances and the cut must be finite and not negative")
    open_ = staged(first.select("module", "cluster", "n", F.transform("v", lambda x: x * F.col("n")).alias("v")), "linkage-open")

    def nearest(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                (ka, na, a), (kb, nb, b) = ((np.asarray(k), np.asarray(n), np.asarray(v).reshape(len(k), -1)) for k, n, v in ((row.ka, row.na, row.va), (row.kb, row.nb, row.vb)))
                d = np.clip(1 - (a @ b.T) / np.outer(na, nb), 0, 2)
                if row.a == row.b:
                    # Both ends of a pair see one number.
                    d = np.triu(d, 1)
                    d += d.T
                    np.fill_diagonal(d, np.inf)
                ends = [(ka, kb, d)] if row.a == row.b else [(ka, kb, d), (kb, ka, d.T)]
                for own, other, to in ends:
                    at = to.argmin(axis=1)
                    gap = to[np.arange(len(own)), at]
                    near = gap <= cut
                    yield pd.DataFrame({"module": [row.module] * int(near.sum()), "cluster": own[near], "near": other[at[near]], "distance": gap[near]})

    def finished(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cluster", kind="stable")
        keys, n, v = group["cluster"].to_numpy(), group["n"].to_numpy(copy=True), np.stack(group["v"].to_numpy())
        into, left = np.arange(len(keys)), np.arange(len(keys))
        while len(left):
            d = np.triu(np.clip(1 - (v[left] @ v[left].T) / np.outer(n[left], n[left]), 0, 2), 1)
            d += d.T
            np.fill_diagonal(d, np.inf)
            at, own = d.argmin(axis=1), np.arange(len(left))
            near = d[own, at] <= cut
            low = own[near & (at[at] == own) & (own < at)]
            high = at[low]
            v[left[low]] += v[left[high]]
            n[left[low]] += n[left[high]]
            into[left[high]] = left[low]
            near[high] = False
            left = left[near]
        for i in range(len(into)):
            # A cluster goes into a smaller one, whose own is known by then.
            into[i] = into[into[i]]
        moved = into != np.arange(len(into))
        return pd.DataFrame({"module": group["module"].to_numpy()[moved], "cluster": keys[moved], "low": keys[into[moved]]})

    while True:
        sizes = staged(open_.groupBy("module").agg(F.count("*").alias("count")), "linkage-sizes")
        if (sizes.agg(F.max("count")).first()[0] or 0) <= LAST:
            merged = open_.groupBy("module").applyInPandas(finished, f"module {kinds['module']}, cluster {kinds['key']}, low {kinds['key']}")
            return members.join(merged, ["module", "cluster"], "left").select("module", "key", F.coalesce("low", "cluster").alias("cluster"))
        parts = F.ceil(F.col("count") / LINKED)
        dealt = open_.join(sizes, "module").withColumn("block", F.pmod(F.xxhash64("cluster"), parts))
        listed = dealt.groupBy("module", "block").agg(F.sort_array(F.collect_list(F.struct("cluster", "n", "v"))).alias("x"))
        blocks = staged(listed.select("module", "block", F.col("x.cluster").alias("k"), F.col("x.n").alias("n"), F.flatten("x.v").alias("v")), "linkage-blocks")
        a, b = (blocks.select("module", F.col("block").alias(x)) for x in "ab")
        of = lambda x: blocks.select("module", F.col("block").alias(x), F.col("k").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("v").alias(f"v{x}"))
        meet = a.join(b, "module").where("a <= b").join(of("a"), ["module", "a"]).join(of("b"), ["module", "b"])
        found = meet.mapInPandas(nearest, f"module {kinds['module']}, cluster {kinds['key']}, near {kinds['key']}, distance double")
        pair = F.struct("distance", F.least("cluster", "near").alias("low"), F.greatest("cluster", "near").alias("high"))
        nears = staged(found.groupBy("module", "cluster").agg(F.min(pair).alias("p")), "linkage-near")
        merged = staged(nears.groupBy("module", "p.low", "p.high").agg(F.count("*").alias("ends")).where("ends = 2").select("module", F.col("high").alias("cluster"), "low"), "linkage-merged")
        into = F.coalesce("low", "cluster").alias("cluster")
        members, before = staged(members.join(merged, ["module", "cluster"], "left").select("module", "key", into), "linkage-members"), members
        left = open_.join(nears.select("module", "cluster"), ["module", "cluster"]).join(merged, ["module", "cluster"], "left").select("module", into, "n", "v")
        both = left.groupBy("module", "cluster").agg(F.sum("n").alias("n"), F.collect_list("v").alias("v"))
        summed = F.when(F.size("v") == 2, F.zip_with(F.get("v", F.lit(0)), F.get("v", F.lit(1)), lambda x, y: x + y)).otherwise(F.get("v", F.lit(0)))
        open_, gone = staged(both.select("module", "cluster", "n", summed.alias("v")), "linkage-open"), open_
        drop_staged(before, gone, sizes, blocks, nears, merged)


def histogram(values: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bucket (from 1), n; the upper bound belongs to the last bucket."""
    bucket = F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return values.groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def pair_sample(rows: DataFrame, key: str, module: str, per_module: int, across: int) -> DataFrame:
    """kind, a, b: `per_module` pairs within each module, all if it has no more, and as well `across` pairs of different modules in all.

    Members are numbered by hash within their module, modules one after the other, so that all possible pairs have numbers. Evenly spaced
    numbers are taken and only those pairs are made: there are never more rows than members or sampled pairs. Modules must fit a table of
    their sizes in one task; their members needn't."""
    member = F.row_number().over(Window.partitionBy("m").orderBy(F.xxhash64("k"), "k")) - 1
    order = staged(rows.select(F.col(module).alias("m"), F.col(key).alias("k")).withColumn("i", member.cast("long")), "sample-order")
    sizes = order.groupBy("m").agg(F.count("*").alias("n"))
    running = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    sizes = sizes.withColumn("total", F.sum("n").over(Window.partitionBy()))
    # Pairs of a member with members of later modules.
    sizes = sizes.withColumn("out", F.col("n") * (F.col("total") - F.col("before") - F.col("n")))
    sizes = staged(sizes.withColumn("start", F.coalesce(F.sum("out").over(running), F.lit(0))), "sample-sizes")
    last = sizes.agg(F.sum("out").alias("pairs")).first()["pairs"] or 0
    within_pairs = F.expr("n * (n - 1) div 2")
    taken = F.least(within_pairs, F.lit(per_module))
    within = sizes.where("n > 1").select("m", "before", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), taken - 1), lambda j: F.floor(j * within_pairs / taken))).alias("p"))
    # Pair p of members i < j: p = j (j - 1) / 2 + i.
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2)
    fixed = F.when(j * (j - 1) / 2 > F.col("p"), j - 1).when(j * (j + 1) / 2 <= F.col("p"), j + 1).otherwise(j).cast("long")
    near = within.withColumn("j", fixed).select(F.lit("within").alias("kind"), (F.col("p") - F.expr("j * (j - 1) div 2") + F.col("before")).alias("x"), (F.col("j") + F.col("before")).alias("y"))
    count = min(across, last)
    # Number k of the sample is pair k * last / count: those that begin in a module.
    first = F.ceil(F.col("start") * F.lit(count) / F.lit(max(last, 1)))
    stop = F.ceil((F.col("start") + F.col("out")) * F.lit(count) / F.lit(max(last, 1)))
    numbers = F.transform(F.sequence(first, stop - 1), lambda k: F.floor(k * F.lit(last) / F.lit(max(count, 1))))
    far = sizes.where((F.col("out") > 0) & (stop > first)).select("n", "before", "total", "start", F.explode(numbers).alias("p"))
    later = F.col("total") - F.col("before") - F.col("n")
    place = F.col("p") - F.col("start")
    far = far.select(F.lit("across").alias("kind"), (F.col("before") + F.floor(place / later)).alias("x"), (F.col("before") + F.col("n") + place % later).alias("y"))
    numbered = order.join(sizes.select("m", "before"), "m").select((F.col("before") + F.col("i")).alias("at"), "k")
    end = lambda c, name: numbered.select(F.col("at").alias(c), F.col("k").alias(name))
    return near.unionByName(far).join(end("x", "a"), "x").join(end("y", "b"), "y").select("kind", "a", "b")


def second_moments(rows: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of vectors; tasks sum outer products of their batches, so only a matrix of the vectors' width comes back."""

    def run(batches):
        for batch in batches:
            x = np.stack(batch[vector].to_numpy()).astype(float) if len(batch) else np.zeros((0, 1))
            if len(x):
                yield pd.DataFrame({"n": [len(x)], "s": [x.sum(0).tolist()], "q": [(x.T @ x).ravel().tolist()]})

    parts = rows.select(vector).mapInPandas(run, "n long, s array<double>, q array<double>")
    add = lambda c: F.aggregate(F.collect_list(c), F.lit(None).cast("array<double>"), lambda a, b: F.when(a.isNull(), b).otherwise(F.zip_with(a, b, lambda x, y: x + y)))
    row = parts.agg(F.sum("n").alias("n"), add("s").alias("s"), add("q").alias("q")).first()
    n, s = row["n"], np.array(row["s"])
    return n, s / n, np.array(row["q"]).reshape(len(s), len(s)) / n - np.outer(s / n, s / n)


def principal_axes(rows: DataFrame, vector: str, k: int = 2) -> dict:
    """mean, axes (the largest component of each is positive), share of the variance of each, and an id of the basis."""
    import hashlib

    _, mean, cov = second_moments(rows, vector)
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, ::-1][:, :k].T
    axes = axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(1)])[:, None]
    return {"mean": mean, "axes": axes, "share": values[::-1][:k] / values.sum(), "id": hashlib.sha256(np.round(axes, 6).tobytes()).hexdigest()[:16]}


def project(rows: DataFrame, vector: str, basis: dict) -> DataFrame:
    """Add coords: the centred vectors on the basis; a frozen basis gives the same coordinates whatever rows are added."""
    mean = F.array(*[F.lit(float(x)) for x in basis["mean"]])
    centred = F.zip_with(F.col(vector), mean, lambda x, m: x - m)
    return rows.withColumn("coords", F.array(*[dot(centred, F.array(*[F.lit(float(x)) for x in axis])) for axis in basis["axes"]]))


def _times(factor: Column):
    return lambda x: x * factor


def deflate(rows: DataFrame, vector: str, basis: dict) -> DataFrame:
    """Add residual: the centred vectors without their parts on the axes; lengths aren't made equal again."""
    out = project(rows, vector, basis)
    mean = F.array(*[F.lit(float(x)) for x in basis["mean"]])
    residual = F.zip_with(F.col(vector), mean, lambda x, m: x - m)
    for i, axis in enumerate(basis["axes"]):
        along = F.get("coords", F.lit(i))
        residual = F.zip_with(residual, F.transform(F.array(*[F.lit(float(x)) for x in axis]), _times(along)), lambda x, a: x - a)
    return out.withColumn("residual", residual)


def density(points: DataFrame, x: str, y: str, grid: DataFrame, bandwidth: float) -> DataFrame:
    """gx, gy, density: Gaussian kernels summed at the grid's nodes; a point reaches the nodes within four bandwidths, found by cells.

    Equal points are counted before they meet the grid; a node stands in its cell and those around it, so that points aren't multiplied. Cells
    are dealt to 64 parts, and each part sums its own points first."""
    cell = max(bandwidth, 1e-6) * 4
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    around = lambda c: F.explode(F.array(*[at(c) + d for d in (-1, 0, 1)]))
    p = points.groupBy(F.col(x).alias("px"), F.col(y).alias("py")).agg(F.count("*").alias("n"))
    p = p.select("px", "py", "n", at("px").alias("cx"), at("py").alias("cy"), F.pmod(F.xxhash64("px", "py"), F.lit(64)).alias("deal"))
    nodes = grid.select("gx", "gy").distinct()
    g = nodes.withColumn("cx", around("gx")).withColumn("cy", around("gy")).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    square = F.pow(F.col("px") - F.col("gx"), 2) + F.pow(F.col("py") - F.col("gy"), 2)
    n = points.count()
    kernel = F.exp(-square / (2 * bandwidth**2)) / (2 * np.pi * bandwidth**2 * max(n, 1))
    sums = g.join(p, ["cx", "cy", "deal"]).groupBy("gx", "gy").agg(F.sum(kernel * F.col("n")).alias("density"))
    return nodes.join(sums, ["gx", "gy"], "left").select("gx", "gy", F.coalesce("density", F.lit(0.0)).alias("density"))


def unique_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """hash, first, rows: distinct vectors by content."""
    h = content_hash(F.to_json(vector))
    return rows.select(key, h.alias("hash")).groupBy("hash").agg(F.min(key).alias("first"), F.count("*").alias("rows"))
