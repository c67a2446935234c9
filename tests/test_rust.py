"""Rust sources: scopes, uses, chains of names, and what they refer to."""

from tessella.functions.rust import scope_facts
from tessella.operators import rust as U
from tessella.operators.references import rust_surface

LIB = """
pub mod net; mod io { pub fn read() { super::net::open(); vec![crate::net::http::get(), left::out::<u8>(), a . b]; } pub(self) struct Hidden; mod deep { } }
// mod gone;
pub use crate::net::{self as wire, http::{Request, self}, *}; pub(crate) use std::fmt as _;
const LIMIT: u32 = u32::MAX; pub const fn f<'a>(x: &'a str) -> T { r#"x::y"#; println!("{}", io::read()); }
impl S { pub fn method() {} } pub static mut COUNT: i8 = 0; macro_rules! m { () => { net::open() } } /* /* nested */ a::b */
"""


def test_scopes_of_a_file():
    file, io, deep = scope_facts(LIB)
    assert [(x["name"], x["public"], x["declared"]) for x in file["items"]] == [
        ("net", True, True), ("io", False, True), ("wire", True, False), ("Request", True, False), ("http", True, False), ("LIMIT", False, True), ("f", True, True), ("COUNT", True, True),
    ]
    assert file["modules"] == [{"name": "net", "inline": False}, {"name": "io", "inline": True}]
    assert [("::".join(x["segments"]), x["name"], x["wildcard"]) for x in file["uses"]] == [("crate::net", "wire", False), ("crate::net::http::Request", "Request", False), ("crate::net::http", "http", False), ("crate::net", None, True), ("std::fmt", None, False)]
    assert file["paths"] == [["::", "MAX"], ["io", "read"], ["net", "open"]]
    assert io["scope"] == ["io"] and io["paths"] == [["super", "net", "open"], ["crate", "net", "http", "get"]] and [(x["name"], x["public"]) for x in io["items"]] == [("read", True), ("Hidden", False), ("deep", False)]
    assert deep["scope"] == ["io", "deep"] and scope_facts(None)[0]["items"] == []


def test_references_between_modules(spark):
    texts = {"src/lib.rs": LIB, "src/net.rs": "pub mod http; pub fn open() { http::get(); wire::open(); }", "src/net/http.rs": "pub fn get() {} pub struct Request; use super::super::io as files; fn g() { files::read(); core::go(); other::x(); }", "core/lib.rs": "pub fn go() { self::go(); }"}
    files = spark.createDataFrame([("src/lib.rs", "app", "app"), ("src/net.rs", "app", "app/net"), ("src/net/http.rs", "app", "app/net/http"), ("core/lib.rs", "core", "core")], "file string, crate string, place string")
    table = U.scope_table(U.rust_scopes(spark.createDataFrame(list(texts.items()), "file string, text string")), files)
    found = U.rust_references(table)
    ends = {(r["source"], r["owner"], r["name"]) for r in found.where("last").collect()}
    assert ends == {
        ("app", "app/net", None), ("app", "app/net/http", "Request"), ("app", "app/net/http", None), ("app", "app/io", "read"), ("app", "app/net", "open"), ("app/io", "app/net", "open"), ("app/io", "app/net/http", "get"),
        ("app/net", "app/net/http", "get"), ("app/net/http", "app/io", None), ("app/net/http", "app/io", "read"), ("app/net/http", "core", "go"), ("core", "core", "go"),
    }
    module_of = table.select("place", "file").withColumnRenamed("file", "module").distinct()
    counts = {r["module"]: (r["references"], r["contracts"]) for r in U.reference_counts(found, module_of).collect()}
    assert counts == {"src/lib.rs": (7, 5), "src/net.rs": (1, 1), "src/net/http.rs": (3, 3)}
    surface = {(r["module"], r["name"]): r["external_references"] for r in rust_surface(U.public_names(table, module_of), U.reference_rows(found, module_of)).collect()}
    assert surface[("src/net.rs", "open")] == 1 and surface[("src/net/http.rs", "get")] == 2 and surface[("core/lib.rs", "go")] == 1 and surface[("src/lib.rs", "net")] == 0
