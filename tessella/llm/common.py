"""What the corpus operators share: word rules, size-checked broadcasts."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import BATCH_ROWS, release_memory, releasing, small_batches  # noqa: F401
from ..scratch import drop_staged, remove, scratch_path, staged, without_old_shuffles  # noqa: F401

#: White space of the word rule: x20 and x09 to x0D.
WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the maximal runs of characters that aren't white space; empty for null or blank texts."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Rows of a per-group parameter table up to which it is broadcast.
BROADCAST_ROWS = 20_000


def with_parameters(rows: DataFrame, parameters: DataFrame, on: Column, bound: int = BROADCAST_ROWS, how: str = "left") -> DataFrame:
    """Join a small table of per-group parameters.

    It is broadcast only after a count has shown at most `bound` rows; beyond that it is an ordinary join, whose
    skewed keys adaptive execution splits."""
    small = parameters.limit(bound + 1).count() <= bound
    return rows.join(F.broadcast(parameters) if small else parameters, on, how)


def local_path(uri: str) -> str | None:
    """The path of a file:/ URI, None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else os.path.abspath(uri)
