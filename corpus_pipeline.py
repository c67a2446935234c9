"""Corpus preparation in stages: each takes (spark, docs, sf_dir) and returns the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import staged
from tessella.llm.jaccard import keep_one
from tessella.llm.line_dedup import dedup_lines
from tessella.llm.mixing import mix_documents
from tessella.llm.pieces import encode, load_model
from tessella.llm.quality import keep_good
from tessella.llm.registry import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and blank texts fail the rules and go; rows with a null id, language or source are judged like others; repeated rows are judged alike; an empty
    table stays empty; columns named like the rules' own results are kept as they are."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines stay in one document; n_chars follows the text.

    No row goes: a document that loses all lines has an empty text. Rows with a null id lose nothing; rows of one id count as one document; columns
    n_lines and n_dropped, if documents have them, keep their values."""
    own = {c: f"__own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    cleaned = dedup_lines(docs.withColumnsRenamed(own))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return cleaned.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Null and blank texts link with nothing and stay, as do rows with a null id; rows of one id stay or go together."""
    return keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: at least once where the target is at least the source's size.

    A null source is a source of its own; sources without words go; rows equal in id and text are taken equally often."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, ids of every document that the mix has taken, once per copy.

    Null and empty texts have no ids; other columns go."""
    coded = encode(docs, load_model(vocabulary()), keep=("doc_id", "source"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding", encoding),
]

#: Robust estimates, components of links, hash thresholds and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, "pipeline")
    return docs
