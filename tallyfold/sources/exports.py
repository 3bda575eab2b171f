"""Record exports: CSV as Python's csv module reads it, with header detection; rows keep their place."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def header_row(rows: list[list[str]], most: int = 10) -> int:
    """The first of the first rows with more than one filled cell, else 0."""
    return next((i for i, row in enumerate(rows[:most]) if sum(c not in (None, "") for c in row) > 1), 0)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every file at path, a file at a time on the executors: _file, _row_ord, cells (array), header (array).

    Quoted newlines, blank rows and short rows are as the csv module has them; the header row and what precedes it
    are no rows. An empty file has none. Files are read through Spark, from any store.
    """

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = csv.reader(io.StringIO(content.decode("utf-8"), newline=""))
                head = [row for _, row in zip(range(10), reader)]
                at = header_row(head)
                header = [c.strip() for c in head[at]] if head else []

                def body():
                    yield from head[at + 1 :]
                    yield from reader

                part: list = []
                for k, row in enumerate(body()):
                    part.append({"_file": name, "_row_ord": k, "header": header, "cells": row[: len(header)]})
                    if len(part) == 4096:
                        yield pa.RecordBatch.from_pylist(part, schema)
                        part = []
                if part:
                    yield pa.RecordBatch.from_pylist(part, schema)

    import pyarrow as pa

    schema = pa.schema([("_file", pa.string()), ("_row_ord", pa.int64()), ("header", pa.list_(pa.string())), ("cells", pa.list_(pa.string()))])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "_file string, _row_ord long, header array<string>, cells array<string>")


def as_records(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Text columns by target name; mapping: source column to target. Of two sources of a target the last one mapped wins."""
    last = {target: source for source, target in mapping.items()}
    pick = lambda s: F.nullif(F.expr(f"try_element_at(cells, cast(nullif(array_position(header, '{s}'), 0) as int))"), F.lit(""))
    return rows.select("_file", "_row_ord", *[pick(s).alias(t) for t, s in last.items()])
