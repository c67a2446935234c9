"""What source texts and pages hold: styles, colours, lines, links, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from ..session import spread, table
from .base import query


@query(r"""WITH m AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)(<(?:script|textarea|title|style)\b[^>]*>).*?(</(?:script|textarea|title|style))', '\1\2', 'g') AS html FROM pages)
SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<style\b[^>]*>')) + len(regexp_extract_all(regexp_replace(html, '(?is)<style\b[^>]*>', '', 'g'), '(?is)<[a-z][a-z0-9-]*\s[^>]*?\bstyle\s*=')) AS BIGINT) AS tags FROM m""")
def t02_style_tags(spark, sf_dir):
    """Style elements and style attributes per page."""
    return table(spark, sf_dir, "pages").select("page_id", F.size(X.style_tags(F.col("html"))).cast("long").alias("tags"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS lines FROM documents")
def a19_nonblank_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.nonblank_lines(F.col("text")).alias("lines"))


@query("""SELECT target, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT page_id) AS BIGINT) AS pages
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1""")
def t10_page_links(spark, sf_dir):
    """Link targets, how often and on how many pages."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(X.links(F.col("html"))).alias("target"))
    return found.groupBy("target").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


SHEETS = """WITH s AS (SELECT 'b' || p_brand[7:] || '/p' || p_partkey || '.css' AS file, CASE WHEN p_size > 40 THEN [] WHEN p_size > 30 THEN ['#fff'] WHEN p_size > 15 THEN ['rgb(' || p_size || ', 2, 3)'] ELSE ['red'] END AS first,
 CASE WHEN p_retailprice > 950 THEN [] ELSE ['#' || format('{:06x}', CAST(p_partkey % 16777216 AS BIGINT))] END AS second FROM part), c AS (SELECT file, array_to_string(list_sort(list_concat(first, second)), ',') AS colors, len(first) + len(second) AS n FROM s) """


def _sheets(spark, sf_dir):
    """file, text: a sheet per part, whose size and price tell its colours; names of colours also stand in strings, urls and selectors."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    color = F.when(size > 40, "transparent").when(size > 30, "#FFF").when(size > 15, F.concat(F.lit("rgb("), size, F.lit(", 2, 3)"))).otherwise("RED")
    back = F.when(price > 950, "currentcolor; fill: #12345").otherwise(F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey").cast("long") % 16777216), 6, "0")))
    text = F.concat(F.lit("a { color: "), color, F.lit("; background: "), back, F.lit(' url(blue.png) } .red-box { }\nb::after { content: "red" }\n'))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), "p_partkey")
    return parts.select(F.concat(F.lit("b"), F.substring("p_brand", 7, 9), F.lit("/p"), "p_partkey", F.lit(".css")).alias("file"), text.alias("text"))


@query(SHEETS + "SELECT file, colors FROM c")
def t03_css_colors(spark, sf_dir):
    return _sheets(spark, sf_dir).select("file", F.array_join(X.css_colors(F.col("text")), ",").alias("colors"))


@query(SHEETS + "SELECT 'HL118' AS rule, file, (SELECT count(*) FROM c WHERE n > 0) AS score, colors FROM c WHERE n > 0")
def hl118_color_files(spark, sf_dir):
    """Every file with a colour, where there are more such files than a limit of one."""
    rows = _sheets(spark, sf_dir).select("file", X.css_colors(F.col("text")).alias("colors"))
    return M.color_files(rows, ["."], 1).select(F.lit("HL118").alias("rule"), "file", "score", F.array_join("colors", ",").alias("colors"))


COUNTED = "WITH l AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split_regex(text, '\\r?\\n')) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS lines FROM documents) "


@query(COUNTED + "SELECT doc_id, CAST(lines AS BIGINT) AS lines FROM l")
def s18_instruction_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.line_count(F.col("text")).alias("lines"))


@query(COUNTED + "SELECT 'HL112' AS rule, doc_id AS file, CAST(lines AS BIGINT) AS lines FROM l WHERE lines > 20")
def hl112_instruction_limit(spark, sf_dir):
    """Texts of more than twenty lines."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), X.line_count(F.col("text")).alias("lines"))
    return M.limit_exceeded(rows, "lines", 20).select(F.lit("HL112").alias("rule"), "file", "lines")
