"""References between the modules of Rust crates, from the names that their sources write."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..batches import releasing, short_batches
from ..functions.rust import PIECE, item_pieces, scope_facts
from ..scratch import broadcast_if_small, staged

#: What a scope's row has beside its file and name, as Spark and Arrow have it.
_NAMES = pa.list_(pa.string())
PARTS = {
    "items": ("array<struct<name:string,public:boolean,declared:boolean>>", pa.list_(pa.struct([("name", pa.string()), ("public", pa.bool_()), ("declared", pa.bool_())]))),
    "modules": ("array<struct<name:string,inline:boolean>>", pa.list_(pa.struct([("name", pa.string()), ("inline", pa.bool_())]))),
    "uses": ("array<struct<segments:array<string>,name:string,wildcard:boolean>>", pa.list_(pa.struct([("segments", _NAMES), ("name", pa.string()), ("wildcard", pa.bool_())]))),
    "paths": ("array<array<string>>", pa.list_(_NAMES)),
}


def rust_scopes(texts: DataFrame, parts: tuple[str, ...] = tuple(PARTS)) -> DataFrame:
    """file, scope, and of items, modules, uses, paths those in `parts`, of texts(file, text): a row for the file and for each module written out
    in it. `scope` holds the names of such modules, none for the file itself. A null text is an empty one. Bodies are read only where uses or
    paths are asked for, and what isn't asked for doesn't leave the workers.

    A source may be many rows, each with whole items, and a long text is read in pieces: then a scope has a row for each piece."""
    short_batches(texts.sparkSession)
    bodies = "uses" in parts or "paths" in parts
    columns = {"file": pa.string(), "scope": _NAMES} | {p: PARTS[p][1] for p in parts}

    def told(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in columns.items()], names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for file, text in zip(batch.column(0), batch.column(1)):
                for piece in item_pieces(text.as_py()):
                    rows += [{"file": file.as_py()} | {c: facts[c] for c in columns if c != "file"} for facts in scope_facts(piece, bodies)]
                    size += len(piece)
                    if size >= PIECE:
                        yield told(rows)
                        rows, size = [], 0
            if rows:
                yield told(rows)

    return texts.select("file", "text").mapInArrow(releasing(run), ", ".join(["file string", "scope array<string>", *(f"{p} {PARTS[p][0]}" for p in parts)]))


def scope_table(scopes: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of `rust_scopes` with `crate` and `place`: the slashed path of the scope, the crate's name first.

    files(file, crate, place): where each file stands in its crate, as the module tree has it; a file is there once."""
    inner = F.when(F.size("scope") > 0, F.concat(F.lit("/"), F.array_join("scope", "/"))).otherwise(F.lit(""))
    return scopes.join(broadcast_if_small(files), "file").withColumn("place", F.concat("place", inner))


def rust_references(table: DataFrame) -> DataFrame:
    """id, source, wildcard, hop, owner, name: every scope that a use or a chain of names passes, with the name that it takes there (null: the
    scope itself is meant), hop by hop; `last` marks where it ends.

    A chain begins at its crate, its own scope, the one around it, a scope that a use of its scope binds, a scope within its own, or another
    crate, whichever of these fits first; chains that begin nowhere are left out."""
    places = staged(table.select("place").distinct(), "rust-places")
    crates = broadcast_if_small(staged(table.select(F.col("crate").alias("c_at")).distinct(), "rust-crates"))
    uses = table.select("place", "crate", F.explode("uses").alias("u")).select("place", "crate", "u.segments", "u.name", "u.wildcard", F.lit(True).alias("use"))
    paths = table.select("place", "crate", F.explode("paths").alias("segments")).select("place", "crate", "segments", F.lit(None).cast("string").alias("name"), F.lit(False).alias("wildcard"), F.lit(False).alias("use"))
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    ups = F.size(F.filter("segments", lambda x: x == "super"))
    climbed = F.aggregate(F.slice("segments", F.lit(1), ups), F.col("place"), lambda acc, _: parent(acc))
    head = F.get("segments", F.lit(0))
    fixed = F.when(head == "crate", F.struct(F.col("crate").alias("at"), F.lit(1).alias("used"))).when(head == "self", F.struct(F.col("place").alias("at"), F.lit(1).alias("used"))).when(head == "super", F.struct(climbed.alias("at"), ups.alias("used")))
    written = staged(uses.unionByName(paths).withColumn("id", F.monotonically_increasing_id()).withColumn("head", head).withColumn("fixed", fixed), "rust-written")

    def begun(rows: DataFrame, aliases: DataFrame | None) -> DataFrame:
        """The rows with `at`, `used`: the first of the ways to begin. Each way is at most one row, so a chain stays one row and isn't shuffled for it."""
        open_ = F.col("fixed").isNull()
        child = broadcast_if_small(places.select(F.col("place").alias("p_at")))
        out = rows.join(child, open_ & (F.concat_ws("/", "place", "head") == F.col("p_at")), "left").join(crates, open_ & (F.col("head") == F.col("c_at")), "left")
        ways = [F.col("p_at"), F.col("c_at")]
        if aliases is not None:
            out = out.join(broadcast_if_small(aliases), open_ & ~F.col("use") & (F.col("head") == F.col("a_name")) & (F.col("place") == F.col("a_place")), "left")
            ways.insert(0, F.col("a_at"))
        out = out.withColumn("at", F.coalesce("fixed.at", *ways)).withColumn("used", F.coalesce("fixed.used", F.lit(1)))
        return out.where("at is not null")

    def hops(rows: DataFrame) -> DataFrame:
        """Every prefix of what is left of a chain that is a scope; the first is where it begins."""
        rest = F.slice("segments", F.col("used") + 1, F.greatest(F.size("segments") - F.col("used"), F.lit(0)))
        opened = rows.withColumn("rest", rest)
        steps = opened.select("id", "place", "wildcard", "use", "at", "rest", F.col("name").alias("bound"), F.explode(F.sequence(F.lit(0), F.size("rest"))).alias("hop"))
        steps = steps.withColumn("owner", F.when(F.col("hop") == 0, F.col("at")).otherwise(F.concat_ws("/", "at", F.array_join(F.slice("rest", F.lit(1), F.col("hop")), "/"))))
        owners = broadcast_if_small(places.withColumnRenamed("place", "owner"))
        return steps.join(owners, "owner").select("id", F.col("place").alias("source"), "wildcard", "use", "bound", "hop", "owner", F.get("rest", "hop").alias("name"))

    # A use that means a scope binds its name to it; the smallest place, where one name is bound twice.
    whole = hops(begun(written.where("use"), None)).where("name is null and bound is not null")
    aliases = staged(whole.groupBy(F.col("source").alias("a_place"), F.col("bound").alias("a_name")).agg(F.min("owner").alias("a_at")), "rust-aliases")
    found = hops(begun(written, aliases)).drop("use", "bound")
    return staged(found.withColumn("last", F.col("hop") == F.max("hop").over(Window.partitionBy("id"))), "rust-hops")


def reference_counts(references: DataFrame, module_of: DataFrame) -> DataFrame:
    """module, references, contracts: chains and uses that end in another module, and the different names that they end at (`*`: a whole scope).

    module_of(place, module): scopes written out in a file are of that file's module."""
    module_of = broadcast_if_small(module_of)
    at = lambda end, name: module_of.select(F.col("place").alias(end), F.col("module").alias(name))
    ends = references.where("last").join(at("source", "module"), "source").join(at("owner", "target"), "owner").where("module <> target")
    contract = F.concat_ws("::", "owner", F.coalesce("name", F.lit("*")))
    return ends.groupBy("module").agg(F.count("*").alias("references"), F.count_distinct(contract).alias("contracts"))


def reference_rows(references: DataFrame, module_of: DataFrame) -> DataFrame:
    """consumer, module, name, wildcard: the input of `rust_surface`; a chain uses each name that it passes."""
    module_of = broadcast_if_small(module_of)
    at = lambda end, name: module_of.select(F.col("place").alias(end), F.col("module").alias(name))
    placed = references.join(at("source", "consumer"), "source").join(at("owner", "module"), "owner").where("consumer <> module")
    return placed.where("name is not null or (wildcard and last)").select("consumer", "module", "name", (F.col("wildcard") & F.col("last") & F.col("name").isNull()).alias("wildcard"))


def public_names(table: DataFrame, module_of: DataFrame) -> DataFrame:
    """module, name of everything that a scope shows beyond itself."""
    shown = table.select("place", F.explode("items").alias("x")).where("x.public").join(module_of, "place")
    return shown.select("module", F.col("x.name").alias("name")).distinct()
