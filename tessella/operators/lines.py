"""What scanners find on the lines of source texts: tokens, inline styles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsx import inline_styles
from ..functions.rust import item_pieces
from ..functions.syntax import token_lines


def token_line_counts(texts: DataFrame) -> DataFrame:
    """file, lines of texts(file, text): lines with a token or a part of one, by the rules of Rust for .rs files and of scripts for others.

    Comments, nested or not, and blank lines don't count; all lines of a template or a raw string do. A null text has none. Long Rust sources are
    read in pieces."""

    def lines_of(file: str | None, text: str | None) -> int:
        return sum(token_lines(x, True) for x in item_pieces(text)) if (file or "").endswith(".rs") else token_lines(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [lines_of(file.as_py(), text.as_py()) for file, text in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64())], names=["file", "lines"])

    return texts.select("file", F.col("text").cast("string").alias("text")).mapInArrow(run, "file string, lines long")


def script_styles(texts: DataFrame) -> DataFrame:
    """file, line, signature of every inline style in the markup of scripts: attributes, and properties of objects spread into an element. The
    signature doesn't depend on the layout. Other text that looks like one, in strings, comments or between tags, isn't found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(file.as_py(), line, signature) for file, text in zip(batch.column(0), batch.column(1)) for line, signature in inline_styles(text.as_py())]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["file", "line", "signature"])

    return texts.select("file", F.col("text").cast("string").alias("text")).mapInArrow(run, "file string, line int, signature string")
