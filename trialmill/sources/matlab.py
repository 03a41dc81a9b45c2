"""MATLAB level-5 files: the cell matrix `allResults_APL`, row 0 its header, as a trial table.

Files are decoded where they are read; names and types are settled by aggregation.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import name
from .tables import typed

VARIABLE = "allResults_APL"
# Fixed values of the published level-5 format: element types, and classes of arrays.
NUMBERS = {1: "b", 2: "B", 3: "h", 4: "H", 5: "i", 6: "I", 7: "f", 9: "d", 12: "q", 13: "Q"}
MATRIX, COMPRESSED, UTF8, UTF16 = 14, 15, 16, 17
CELL, CHAR = 1, 4


def version(header: bytes) -> int:
    """1 for level 5, 2 for 7.3 (HDF5); from the first 128 bytes."""
    if len(header) < 128:
        raise ValueError("no MATLAB file")
    return header[125] if header[126:128] == b"IM" else header[124]


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # four bytes or less stand in the tag
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def _array(data: bytes, order: str) -> tuple[str, tuple[int, ...], list]:
    """(name, dimensions, values column by column) of a matrix element; cells hold such values in turn."""
    parts = list(_elements(data, order))
    flags = struct.unpack_from(order + "I", parts[0][1])[0]
    sizes = struct.unpack(order + f"{len(parts[1][1]) // 4}i", parts[1][1])
    label, kind = parts[2][1].decode("latin-1"), flags & 0xFF
    if kind == CELL:
        return label, sizes, [_value(p, order) for _, p in parts[3:]]
    if kind == CHAR:
        t, raw = parts[3] if len(parts) > 3 else (UTF8, b"")
        text = raw.decode("utf-8" if t in (UTF8, 1, 2) else "utf-16-le" if order == "<" else "utf-16-be")
        return label, sizes, ["".join(text)]
    if len(parts) < 4:
        return label, sizes, []
    t, raw = parts[3]
    code = NUMBERS[t]
    return label, sizes, [float(v) for v in struct.unpack(order + f"{len(raw) // struct.calcsize(code)}{code}", raw)]


def _value(data: bytes, order: str):
    """One cell: text, a list of nested values, or numbers."""
    if not data:
        return None
    _, sizes, values = _array(data, order)
    return values[0] if len(values) == 1 else (values or None)


def flatten(value) -> str | None:
    """Empty: missing; text stays; several values: joined by commas."""
    if value is None or value == []:
        return None
    if isinstance(value, list):
        return ",".join("" if v is None else flatten(v) or "" for v in value)
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return str(value)


def flatten_73(value, keep_sign: bool = False):
    """The rule for 7.3 values: logical to number, empty to missing, one item as itself, a vector to the sum of its values.

    The tool that files come from negated that sum; keep_sign=False keeps doing so.
    """
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, (list, tuple)):
        if not value:
            return None
        if len(value) == 1:
            return flatten_73(value[0], keep_sign)
        if all(isinstance(v, (int, float)) for v in value):
            return float(sum(value)) * (1 if keep_sign else -1)
        return flatten_73(value[0], keep_sign)
    return value


def decode(content: bytes) -> list[list[str | None]]:
    """The cells of the result matrix, row by row; the first row is the header. No such variable: no rows."""
    if version(content[:128]) == 2:
        raise ValueError("this is a MATLAB 7.3 file, which needs an HDF5 reader; save it as version 7 instead")
    order = "<" if content[126:128] == b"IM" else ">"
    for kind, data in _elements(content[128:], order):
        if kind == COMPRESSED:
            kind, data = next(_elements(zlib.decompress(data), order))
        if kind == MATRIX:
            label, sizes, values = _array(data, order)
            if label == VARIABLE:
                return [[flatten(values[c * sizes[0] + r]) for c in range(sizes[1])] for r in range(sizes[0])]
    return []


def read_matlab(spark: SparkSession, paths: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Tables of all files by name, with `filename`; empty headers become untitled1, untitled2, ....

    existing: a table that the new rows are added to.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                cells = decode(bytes(content))
                if cells:
                    heads, blank = [], 0
                    for h in cells[0]:
                        blank += h is None
                        heads.append(h if h is not None else f"untitled{blank}")
                    out = [[(h, v) for h, v in zip(heads, r, strict=True)] for r in cells[1:]]
                    yield pd.DataFrame({"filename": os.path.basename(path), "cells": [dict(o) for o in out]})

    held = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(rows, "filename string, cells map<string,string>")
    names = [r[0] for r in held.select(F.explode(F.map_keys("cells")).alias("k")).groupBy("k").count().orderBy("k").collect()]
    table = typed(held.select(*(F.try_element_at("cells", F.lit(n)).alias(n) for n in names), *([] if "filename" in names else ["filename"])))
    if existing is None:
        return table
    return table.unionByName(existing.select(*map(name, existing.columns)), allowMissingColumns=True)
