"""The operators' queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .filter_audit import audit_filters
from .html_text import extract_main_text
from .jaccard import jaccard_components
from .language_model import score, train
from .line_dedup import dedup_lines
from .manifest import merkle_manifest, proof_text
from .mixing import mix_counts
from .neighbours import nearest
from .ordinal import fit, predict
from .pieces import encode, load_model
from .quality import quality_rules
from .secrets import digest, scan_secrets
from .simhash import hex_digits, near_copies

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = load_model(model_path or vocabulary())
    coded = encode(docs, model, keep=("doc_id",), decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams, learnt from the documents whose crc32 leaves another remainder than 2."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = train(docs.where(~F.col("held_out")), order=3)
    scored = score(docs, model, keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, i, part[i] AS line,
         translate(trim(part[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, part, unnest(range(1, len(part) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS part FROM documents))),
s AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE l.doc_id > s.first) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE s.first IS NULL OR l.doc_id = s.first), '')) AS kept_sha256
FROM l LEFT JOIN s ON l.k = s.k GROUP BY l.doc_id
"""


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_counts(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 to 2: one point for quality, one for text that isn't toxic; kept where the highest grade is likely."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    model = fit(docs, ratings, levels=3)
    return predict(docs, model).withColumn("kept", F.col("tail") >= 0.7)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0)).withColumn("query_id", F.col("query_id").cast("long"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("entropy"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit_filters(docs, table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
m AS (
  SELECT part, doc_id,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f FROM d),
r AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN r USING (doc_id) GROUP BY part, f),
o AS (SELECT CAST('' AS VARCHAR) AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS own, list_transform(range(1, step), lambda j: instr('ABCDE', filter_order[j])) AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
c AS (SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails, NOT list_bool_or(list_transform(before, lambda j: f[j])) IS TRUE AS open,
             len(list_filter(f, lambda x: x)) = 1 AS single FROM g, s),
t AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE open AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (WHERE open AND fails), 0) AS removed,
             coalesce(sum(n) FILTER (WHERE NOT open AND fails), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails AND single), 0) AS unique_fails,
             coalesce(sum(good) FILTER (WHERE open AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE open AND fails), 0) AS toxic_lost
      FROM c GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM t
"""


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle_manifest(docs, tampered)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels one by one: nodes of a source, then of the sources' tree; each row's node climbs with the siblings that it meets.
OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, lang, n_chars, text,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
  FROM documents),
l AS (
  SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || CASE WHEN crc % 2 = 0 THEN coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') ELSE body END) AS found
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                  || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS body FROM t)),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
climb AS (
  SELECT doc_id, source, leaf, pos, n, leaf AS node, found AS folded, '' AS proof FROM p
  UNION ALL
  SELECT doc_id, source, leaf, pos // 3, (n + 2) // 3, sha256(array_to_string(run, '')), sha256(array_to_string(run[1:spot], '') || folded || array_to_string(run[spot + 2:], '')),
         proof || array_to_string(run[1:spot], '') || array_to_string(run[spot + 2:], '')
  FROM (SELECT c.*, g.run, CAST(c.pos % 3 AS BIGINT) AS spot
        FROM climb c JOIN (SELECT source, pos // 3 AS up, list(node ORDER BY pos) AS run FROM (SELECT DISTINCT source, pos, node FROM climb WHERE n > 1) GROUP BY source, pos // 3) g
          ON c.source IS NOT DISTINCT FROM g.source AND c.pos // 3 = g.up WHERE c.n > 1)),
s AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM climb WHERE n = 1),
top AS (
  SELECT doc_id, leaf, node AS subroot, rank AS pos, (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) AS n, node, folded, proof FROM s
  UNION ALL
  SELECT doc_id, leaf, subroot, pos // 3, (n + 2) // 3, sha256(array_to_string(run, '')), sha256(array_to_string(run[1:spot], '') || folded || array_to_string(run[spot + 2:], '')),
         proof || array_to_string(run[1:spot], '') || array_to_string(run[spot + 2:], '')
  FROM (SELECT c.*, g.run, CAST(c.pos % 3 AS BIGINT) AS spot
        FROM top c JOIN (SELECT pos // 3 AS up, list(node ORDER BY pos) AS run FROM (SELECT DISTINCT pos, node FROM top WHERE n > 1) GROUP BY pos // 3) g ON c.pos // 3 = g.up WHERE c.n > 1))
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM top WHERE n = 1
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_lm_score, op3_quality_rules, op4_line_dedup, op5_ngram_jaccard, op6_source_mixing, op7_quality_classifier, op8_nearest_neighbours, op9_secret_scan, op10_html_text, op11_filter_audit, op12_simhash_dedup, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op11_filter_audit": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
