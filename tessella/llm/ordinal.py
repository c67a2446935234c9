"""Ordinal cumulative-link regression on graded ratings, over hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Features: hashed words and bins of how a text is written.
BUCKETS = 1 << 20
#: Labelled rows that a fit uses at most, taken by hash.
MAX_LABELLED = 30_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
SHAPES = (("symbols", r"[#*$%&|<>!]"), ("upper", r"\p{Lu}"), ("digits", r"[0-9]"))
BINS = 8
#: Step of the thresholds.
STEP = 0.02
#: First letters of words that are features too: words of one stem share what is learnt.
STEMS = (4, 6)


def features(text: Column) -> Column:
    """Distinct feature numbers of a text: lower-cased runs of letters and their stems by hash, the share of symbols, capitals, digits and of repeated
    words in bins, and a constant. Null and empty texts have the constant only."""
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    number = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    hashed = F.transform(found, lambda w: number(w))
    stems = [F.transform(F.array_distinct(F.transform(found, lambda w, n=n: F.substring(w, 1, n))), lambda w, n=n: number(F.lit(n), w)) for n in STEMS]
    share = lambda x: F.least(F.floor(F.log2(1 + 255 * x)), F.lit(BINS - 1)).cast("int")
    shapes = [share(F.regexp_count(text, F.lit(p)) / F.greatest(F.length(text), F.lit(1))) + BUCKETS + 1 + i * BINS for i, (_, p) in enumerate(SHAPES)]
    distinct = F.array_distinct(hashed)
    repeats = share(1 - F.size(distinct) / F.greatest(F.size(hashed), F.lit(1))) + BUCKETS + 1 + len(SHAPES) * BINS
    return F.concat(distinct, *stems, F.array(F.lit(BUCKETS), *shapes, repeats))


WIDTH = BUCKETS + 1 + (len(SHAPES) + 1) * BINS


@dataclass(frozen=True)
class Ordinal:
    """Weights of the features that have one, shared by all grades, and the ordered thresholds between grades."""

    at: np.ndarray
    weight: np.ndarray
    thresholds: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(WIDTH)
        out[self.at] = self.weight
        return out

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -50, 50)))


def slopes(f: float, y: int, theta: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Of grade `y` at score `f`: its probability, and the slopes of minus its logarithm along the score and along each threshold."""
    s = 1 / (1 + np.exp(np.clip(theta - f, -30, 30)))
    upper, lower = np.r_[1.0, s][y], np.r_[s, 0.0][y]
    p = max(upper - lower, 1e-9)
    du, dl = upper * (1 - upper), lower * (1 - lower)
    along = np.zeros(len(theta))
    if y > 0:
        along[y - 1] = du / p
    if y < len(theta):
        along[y] = -dl / p
    return p, -(du - dl) / p, along


def _fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, epochs: int) -> Ordinal:
    """Proximal online gradient descent with an L1 term, so that words that tell nothing have no weight; thresholds keep their order."""
    z, n = np.zeros(WIDTH), np.zeros(WIDTH)
    share = np.array([(grades >= g).mean() for g in range(1, levels)]).clip(1e-3, 1 - 1e-3)
    theta = -np.log(share / (1 - share))
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x = rows[i]
            zi, ni = z[x], n[x]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            _, g, along = slopes(w.sum(), grades[i], theta)
            z[x] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[x] += g * g
            theta = theta - STEP * along
            theta = np.maximum.accumulate(theta + np.arange(levels - 1) * 1e-6)
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    at = np.flatnonzero(w)
    return Ordinal(at, w[at], theta)


def fit(docs: DataFrame, ratings: DataFrame, levels: int, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED, epochs: int = EPOCHS) -> Ordinal:
    """Fit on documents with a rating: `ratings` has the id and grade from 0 to levels - 1.

    With more than `most` ratings a share of them is taken by the hash of the id, so that one task can hold them whatever the corpus
    is; only the weights, of a fixed width, come back. Ratings out of range, null, or without a document are left out."""
    ratings = ratings.where(F.col("grade").between(0, levels - 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("rated"), F.col("grade").cast("int").alias("grade"))
    total = ratings.count()
    if total > most:
        ratings = ratings.where(F.pmod(F.xxhash64("rated"), F.lit(1_000_000)) < int(950_000 * most / total))
    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = plain.join(ratings, F.col("__id") == F.col("rated")).select("rated", "grade", features(F.col("__text")).alias("x"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rated", "ascending"), ("grade", "ascending")])
        lists = [np.asarray(x, dtype=np.int32) for x in table.column("x").to_numpy()]
        model = _fit(lists, table.column("grade").to_numpy(), levels, epochs)
        return pa.table({"at": [model.at], "weight": [model.weight], "thresholds": [model.thresholds]}, schema=pa.schema([("at", pa.list_(pa.int64())), ("weight", pa.list_(pa.float64())), ("thresholds", pa.list_(pa.float64()))]))

    found = rows.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(lambda t: run(t.drop_columns(["all"])), "at array<long>, weight array<double>, thresholds array<double>").first()
    if found is None:
        return Ordinal(np.empty(0, np.int64), np.empty(0), np.zeros(levels - 1))
    return Ordinal(np.array(found["at"], np.int64), np.array(found["weight"]), np.array(found["thresholds"]))


def predict(docs: DataFrame, model: Ordinal, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of `docs`: the columns of `keep`, expected_grade, tail (probability of the highest grade).

    Cases: null and empty texts are rated by the constant alone; without ratings every threshold is 0; repeated rows are rated alike;
    other columns are ignored; a column of `keep` named as a result is an error; an empty table gives an empty result."""
    if {"expected_grade", "tail"} & set(keep):
        raise ValueError("columns to keep have the names of results")
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column(part.num_columns - 1)
                ends = lists.offsets.to_numpy()
                sums = np.r_[0.0, np.cumsum(weights[lists.values.to_numpy()[ends[0] : ends[-1]]])]
                tails = model.tails(sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(tails.sum(1)), pa.array(tails[:, -1])], names=[*keep, "expected_grade", "tail"])

    return docs.select(*keep, features(F.col(text_col)).alias("__x")).mapInArrow(run, schema)
