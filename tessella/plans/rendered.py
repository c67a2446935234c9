"""Source trees that Spark writes from the given tables, so that what scanners find in them is known from the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def order_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, module, text: a module n<nation> per nation, a script per customer with a function per order, and one per supplier.

    An order's function calls the customer's order before it (the first one of BUILDING customers calls the last), and the functions of its
    suppliers; open orders are exported. Suppliers of other nations are imported from the nation's index, which hands on those whose balance isn't negative,
    the others from their own files. Comments, templates and strings hold what looks like calls."""
    t = lambda name: table(spark, sf_dir, name)
    suppliers = t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    customers = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    used = t("lineitem").select("l_orderkey", "l_suppkey").distinct().join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    supplies = used.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set(F.struct("s_suppkey", "s_nationkey", "s_acctbal"))).alias("supplies"))
    # Texts are written and read in as many tasks as shuffles have, however small the rows are that they are made of.
    lists = spread(orders.join(supplies, "o_orderkey", "left"), "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "supplies"))).alias("orders"))
    whole = customers.join(lists, "c_custkey", "left")

    def function(o, i):
        last = F.element_at("orders", -1)["o_orderkey"]
        before = F.when(i > 0, F.get("orders", i - 1)["o_orderkey"]).when(F.col("c_mktsegment") == "BUILDING", last)
        called = F.array_join(F.transform(F.coalesce(o["supplies"], F.array()), lambda s: text("  supply", s["s_suppkey"], "(quantity);\n")), "")
        back = F.coalesce(text("order", before, "(quantity) + 1"), F.lit("quantity"))
        return text(
            "/** Order ", o["o_orderkey"], ", not order0() nor supply0(). */\n", F.when(o["o_orderstatus"] == "O", "export ").otherwise(""), "function order", o["o_orderkey"],
            "(quantity: number): number {\n  const note = `${quantity} of order0()`; // supply0()\n", called, "  return ", back, ";\n}\n",
        )

    def imported(s):
        near = s["s_nationkey"] == F.col("c_nationkey")
        place = F.when(near, text("./s", s["s_suppkey"])).when(s["s_acctbal"] >= 0, text("../n", s["s_nationkey"])).otherwise(text("../n", s["s_nationkey"], "/s", s["s_suppkey"]))
        return text("import { supply", s["s_suppkey"], " } from '", place, "';\n")

    every = F.array_distinct(F.flatten(F.transform(F.coalesce("orders", F.array()), lambda o: F.coalesce(o["supplies"], F.array()))))
    body = F.concat(F.array_join(F.transform(every, imported), ""), F.array_join(F.transform(F.coalesce("orders", F.array()), function), ""))
    module = text("n", F.col("c_nationkey"))
    scripts = whole.select(text(module, "/c", F.col("c_custkey"), ".ts").alias("file"), module.alias("module"), body.alias("text"))
    module = text("n", F.col("s_nationkey"))
    own = spread(suppliers, "s_suppkey").select(text(module, "/s", F.col("s_suppkey"), ".ts").alias("file"), module.alias("module"), text("export const supply", F.col("s_suppkey"), " = (value: number): number => value * 2;\n").alias("text"))
    handed = text("export { supply", F.col("s_suppkey"), " } from './s", F.col("s_suppkey"), "';\n")
    index = suppliers.where("s_acctbal >= 0").groupBy(module.alias("module")).agg(F.array_join(F.sort_array(F.collect_list(handed)), "").alias("text"))
    return scripts.unionByName(own).unionByName(index.select(F.concat("module", F.lit("/index.ts")).alias("file"), "module", "text"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, module of `order_scripts`, without their texts."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    module = text("n", F.col("c_nationkey"))
    scripts = table(spark, sf_dir, "customer").select(text(module, "/c", F.col("c_custkey"), ".ts").alias("file"), module.alias("module"))
    module = text("n", F.col("s_nationkey"))
    index = suppliers.where("s_acctbal >= 0").select(module.alias("module")).distinct()
    own = suppliers.select(text(module, "/s", F.col("s_suppkey"), ".ts").alias("file"), module.alias("module"))
    return scripts.unionByName(own).unionByName(index.select(F.concat("module", F.lit("/index.ts")).alias("file"), "module"))


def part_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, text: a script per brand with a function per part. Functions of one type differ in their own names and in three literals, those of
    parts above size 25 have one statement more, those of another brand one other name, those of another type seven."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    key, kind = F.col("p_partkey"), F.col("p_type")
    body = text(
        "// Part ", key, "\nfunction part", key, "(value", key, ": number, note: string): number {\n  const base", key, " = value", key, " + ", F.round(F.col("p_retailprice") * 100).cast("long"), ";\n  const total = base", key, " * ", F.col("p_size"),
        ";\n  emit_", kind, "(\"", F.col("p_name"), "\", total);\n  check_", kind, "(base", key, ", total, note)\n  const rate = ", kind, "_rate(total) + ", kind, "_base(note) - ", kind, "_tax(base", key, ");\n",
        F.when(F.col("p_size") > 25, "  trace(total); // once more\n").otherwise(""), "  log_", F.replace("p_brand", F.lit("#")), "(rate, note);\n  return total - base", key, " + ", kind, "_rest(rate) * ", kind, "_last;\n}\n",
    )
    listed = parts.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", body.alias("body")))).alias("rows"))
    return listed.select(F.concat(F.replace("p_brand", F.lit("#")), F.lit(".ts")).alias("file"), F.array_join(F.transform("rows", lambda r: r["body"]), "").alias("text"))


def trade_crates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, crate, place, piece, text: a crate r<region> per region and a module n<nation> per nation, with a function per supplier (not shown where the
    balance is negative) and one per customer, which calls the customer's suppliers: by name, through the crate, or in a macro through another crate.
    A nation also uses all that the nation before it shows. A source is as many rows as it has items, in the order of `piece`,
    so that no row, nor a batch of them, grows with a nation."""
    t = lambda name: table(spark, sf_dir, name)
    nations = t("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    suppliers = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    used = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", F.col("l_suppkey").alias("s_suppkey")).distinct()
    far = suppliers.join(nations, "nation").select("s_suppkey", F.col("nation").alias("s_nation"), F.col("region").alias("s_region"))
    lists = used.join(far, "s_suppkey").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_nation", "s_region"))).alias("used"))
    customers = t("customer").select("c_custkey", F.col("c_nationkey").alias("nation")).join(nations, "nation").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")

    def call(s):
        name = text("supply", s["s_suppkey"], "()")
        through = F.when(s["s_nation"] == F.col("nation"), name).when(s["s_region"] == F.col("region"), text("crate::n", s["s_nation"], "::", name))
        return text("    ", F.coalesce(through, text('println!("{}", r', s["s_region"], "::n", s["s_nation"], "::", name, ")")), ";\n")

    body = text("/* crate::n0::supply0() /* nested */\n*/\nfn customer", F.col("c_custkey"), "() {\n    // r0::n0::supply0()\n", F.array_join(F.transform(F.coalesce("used", F.array()), call), ""), "}\n")
    shown = text(F.when(F.col("s_acctbal") >= 0, "pub").otherwise("pub(self)"), " fn supply", F.col("s_suppkey"), "() -> u32 { 1 }\n")
    lines = customers.select("nation", F.lit(1).alias("part"), F.col("c_custkey").alias("key"), body.alias("body")).unionByName(suppliers.select("nation", F.lit(0).alias("part"), F.col("s_suppkey").alias("key"), shown.alias("body")))
    before = nations.select((F.col("nation") + 1).alias("nation"), F.col("region").alias("b_region"))
    head = F.coalesce(text("use r", F.col("b_region"), "::n", F.col("nation") - 1, "::*;\n"), F.lit(""))
    crate = text("r", F.col("region"))
    pieces = nations.join(before, "nation", "left").select("nation", F.lit(0).cast("long").alias("piece"), head.alias("text")).unionByName(lines.select("nation", ((F.col("part") + 1) * F.lit(1 << 40) + F.col("key")).alias("piece"), F.col("body").alias("text")))
    files = pieces.join(F.broadcast(nations), "nation").select(text(crate, "/src/n", F.col("nation"), ".rs").alias("file"), crate.alias("crate"), text(crate, "/n", F.col("nation")).alias("place"), "piece", "text")
    roots = nations.groupBy(crate.alias("crate")).agg(F.array_join(F.sort_array(F.collect_list(text("pub mod n", F.col("nation"), ";\n"))), "").alias("text"))
    return files.unionByName(roots.select(F.concat("crate", F.lit("/src/lib.rs")).alias("file"), "crate", F.col("crate").alias("place"), F.lit(0).cast("long").alias("piece"), "text"))


def customer_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, text: a component per customer, with an inline style of the segment's sort, or none; what looks like one stands between tags and in comments."""
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_custkey")
    key, size = F.col("c_custkey"), F.abs(F.round("c_acctbal")).cast("long")
    styled = (
        F.when(F.col("c_mktsegment") == "BUILDING", text("<li style={{ width: ", size, ", /* px */ }}>don't {name} style={1}</li>"))
        .when(F.col("c_mktsegment") == "MACHINERY", text("<li\n  {...{ style: { top: ", size, " }, id: 'x' }} />"))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", text("<p>\n  {list.map((x) => <b key={x} style=\"c", key, "\">it's</b>)}</p>"))
        .otherwise(F.lit("<li>style={{ a: 1 }}</li>"))
    )
    return customers.select(text("n", F.col("c_nationkey"), "/v", key, ".tsx").alias("file"), text("export const View", key, " = ({ name, list }) => ", styled, "; // <li style={1} />\n").alias("text"))
