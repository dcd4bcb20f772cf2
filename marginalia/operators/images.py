"""Operators on page images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marginalia.functions.image import degradation, netpbm

FIGURES = "name string, status string, score double, reasons array<string>, dark double, light double, edge double, spread double"
NAMES = [x.split(" ")[0] for x in FIGURES.split(", ")]
KINDS = [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), *[pa.float64()] * 4]


def _batch(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in zip(NAMES, KINDS, strict=True)], NAMES)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = []
            for name, pixels, width in zip(batch.column("name").to_pylist(), batch.column("pixels"), batch.column("width").to_pylist(), strict=True):
                flat = np.asarray(pixels.values if pixels.is_valid else [], np.uint8)
                found.append({"name": name} | degradation(flat[: len(flat) // width * width].reshape(-1, width)))
            yield _batch(found)


def triaged(rows: DataFrame) -> DataFrame:
    """Status, score and measures of grey images (``name, pixels, width``); a null image is empty, an unfinished row is left out."""
    return rows.select("name", "pixels", "width").mapInArrow(_rows, FIGURES)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                found = degradation(netpbm(content))
            except ValueError as e:
                found = {"status": "UNREADABLE", "score": None, "reasons": [str(e)], "dark": None, "light": None, "edge": None, "spread": None}
            yield _batch([{"name": path} | found])


def triaged_files(spark: SparkSession, path: str, glob: str = "*.p[gp]m") -> DataFrame:
    """The same for PGM and PPM files; one that is neither is ``UNREADABLE``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(_files, FIGURES)
