"""Trial tables from and to files: pipe-separated with quoted text, delimited text, and saved plans.

However many files there are, they are one scan. Their headers become a small table of layouts, which says for each file
in which field a variable stands; every row looks its fields up there.
"""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import fresh, name, number

# Delimiter names and escapes of the import dialog, and its encodings.
ALIASES = {"WhiteSpace": r"\s", ".": r"\.", "$": r"\$", "^": r"\^", "*": r"\*", "+": r"\+", "|": r"\|"}
ENCODINGS = ("utf-8", "gbk")
# Fixed value: names that stay as they are.
_LEGAL = re.compile(r"^[a-zA-Z][a-zA-Z0-9_\-.]*$")


def typed(df: DataFrame) -> DataFrame:
    """Text columns whose known values are all numbers become double, in one aggregation over all of them."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    row = df.agg(*(F.count_if(name(c).isNotNull() & number(df, c).isNull()).alias(f"c{i}") for i, c in enumerate(texts))).first()
    numeric = {c for i, c in enumerate(texts) if not row[i]}
    return df.select(*(number(df, c).alias(c) if c in numeric else name(c) for c in df.columns))


def union(tables: list[DataFrame]) -> DataFrame:
    """By name; variables that a table lacks are missing. A variable that is text anywhere is text."""
    kinds: dict[str, set[str]] = {}
    for t in tables:
        for c, k in t.dtypes:
            kinds.setdefault(c, set()).add(k)
    mixed = {c for c, k in kinds.items() if len(k) > 1}
    same = [t.select(*(name(c).cast("string").alias(c) if c in mixed else name(c) for c in t.columns)) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


def _in_order(found: list, paths: list[str]) -> list:
    """Rows with a file, in the order of the paths that they came from."""
    clean = [p.rstrip("/") for p in paths]
    return sorted(found, key=lambda r: (next((i for i, p in enumerate(clean) if p in unquote(r.file)), len(clean)), r.file))


def _laid_out(rows: DataFrame, layouts: list[tuple[str, list[str]]], fields: list, file_name: bool) -> DataFrame:
    """rows (file, ...) with a column for each name that any file has; layouts: (file, names of its fields), fields: the columns or the array that holds them.

    The driver already holds the layouts, so the table is as small as what it has been able to read of the headers.
    """
    names = list(dict.fromkeys(n for _, own in layouts for n in own))
    places = {tuple(own): [own.index(n) if n in own else -1 for n in names] for _, own in layouts}
    (where, called) = fresh(rows, "places", "called")
    table = rows.sparkSession.createDataFrame([(f, places[tuple(own)], unquote(f.rsplit("/", 1)[-1])) for f, own in layouts], f"file string, {where} array<int>, {called} string")
    faced = rows.join(F.broadcast(table), "file")
    all_ = F.array(*fields) if isinstance(fields, list) else fields
    # Without a field of this name the place is -1, which holds nothing.
    made = [F.get(all_, F.get(where, F.lit(k))).alias(n) for k, n in enumerate(names)]
    return faced.select(*made, *([name(called).alias("fileName")] if file_name and "fileName" not in names else []))


def _first_lines(spark: SparkSession, paths: list[str], width: Column | None = None) -> list:
    """(file, first, width) of every file with a line that is not blank: its first such line and the largest width of any; one job for all files."""
    text = spark.read.text(paths)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    leads = F.when((F.col("start") == 0) & (F.trim("value") != ""), F.col("at"))
    found = lines.groupBy("file").agg(F.min_by("value", leads).alias("first"), F.max(F.lit(0) if width is None else width).alias("width")).collect()
    return _in_order([r for r in found if r["first"] is not None], paths)


def read_piped(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pipe-separated tables with a header; quoted numbers are numbers, empty fields are missing. Files or folders of files, all in one scan."""
    layouts = [(r.file, unique(next(csv.reader([r["first"]], delimiter="|")))) for r in _first_lines(spark, paths)]
    width = max((len(own) for _, own in layouts), default=0)
    if not width:
        return spark.createDataFrame([], T.StructType([]))
    fields = [f"c{i}" for i in range(width)]
    rows = spark.read.schema(", ".join(f"{c} string" for c in fields)).csv(paths, sep="|", header=True, enforceSchema=True, quote='"', escape='"', multiLine=False)
    return typed(_laid_out(rows.select("*", F.col("_metadata.file_path").alias("file")), layouts, [F.col(c) for c in fields], False))


def _decoded(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """(file, line, first) of files in an encoding that Spark's readers don't have; first marks a file's first line that is not blank, other blank lines go.

    The reader cuts files at line ends without looking at characters, which is right for encodings whose characters hold no
    byte of a line end, so one file is read by many tasks; lines are decoded where they are read.
    """
    probe = "\n\r".encode(encoding)
    if probe != b"\n\r":
        raise ValueError(f"lines of {encoding} files cannot be told apart by their bytes")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        led: set[str] = set()
        for b in batches:
            texts = [v.decode(encoding).strip() for v in b["value"].to_pylist()]
            files, starts = b["file"].to_pylist(), b["start"].to_pylist()
            first = []
            for text, file, start in zip(texts, files, starts, strict=True):
                first.append(bool(text) and start == 0 and file not in led)
                if first[-1]:
                    led.add(file)
            keep = np.array([bool(t) for t in texts], dtype=bool)
            yield pa.RecordBatch.from_arrays([b["file"], pa.array(texts, type=pa.string()), pa.array(first, type=pa.bool_())], names=["file", "line", "first"]).filter(pa.array(keep))

    raw = spark.read.text(paths).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return raw.mapInArrow(lines, "file string, line string, first boolean")


def read_texts(spark: SparkSession, paths: list[str], header: bool = True, encoding: str = "utf-8", delimiter: str = r"\s", file_name: bool = True) -> DataFrame:
    """Delimited text files; the delimiter is a regular expression or one of ALIASES, all columns are text.

    Lines are stripped, blank ones go. Short lines end in missing values; fields beyond a file's header are called untitled0, untitled1, ...;
    without header the columns are Column1, Column2, .... file_name adds each file's name as `fileName`.
    """
    delimiter = ALIASES.get(delimiter, delimiter)
    cut = lambda line: F.split(F.trim(line), delimiter)
    if encoding.lower().replace("-", "") == "utf8":
        found = [(r.file, r["first"], r.width) for r in _first_lines(spark, paths, F.size(cut(F.col("value"))))]
        # A separator that no text holds makes each line one field; the reader takes the header off each file itself.
        lines = spark.read.schema("line string").csv(paths, sep="\x01", header=header, enforceSchema=True, quote="", escape="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, comment="")
        body = lines.select("line", F.col("_metadata.file_path").alias("file"))
    else:
        all_ = _decoded(spark, paths, encoding)
        firsts = all_.groupBy("file").agg(F.min_by("line", F.when(F.col("first"), 0)).alias("first"), F.max(F.size(cut(F.col("line")))).alias("width"))
        found = [(r.file, r["first"], r.width) for r in _in_order(firsts.collect(), paths)]
        body = all_.filter(~F.col("first")).select("line", "file") if header else all_.select("line", "file")
    layouts = []
    for file, first, width in found:
        names = re.split(delimiter, first.strip()) if header else [f"Column{i + 1}" for i in range(width)]
        layouts.append((file, unique(names + [f"untitled{i}" for i in range(width - len(names))])))
    return _laid_out(body.filter(F.col("line").isNotNull()), layouts, cut(F.col("line")), file_name)


def read_text(spark: SparkSession, path: str, header: bool = True, encoding: str = "utf-8", delimiter: str = r"\s", file_name: bool = True) -> DataFrame:
    return read_texts(spark, [path], header, encoding, delimiter, file_name)


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)


def unique(names: list[str]) -> list[str]:
    """Repeated names get _1, _2, ..., the first number that makes a name no other has, in whatever case."""
    taken, out = {n.lower() for n in names}, []
    given: set[str] = set()
    for n in names:
        made, k = n, 0
        while made.lower() in given or k and made.lower() in taken:
            k += 1
            made = f"{n}_{k}"
        given.add(made.lower())
        out.append(made)
    return out


def legal_names(df: DataFrame) -> DataFrame:
    """Illegal characters go from column names, `col` comes before what doesn't begin with a letter, repeats are numbered."""

    def clean(n: str) -> str:
        if _LEGAL.match(n):
            return n
        kept = re.sub(r"[^a-zA-Z0-9_\-.]", "", n)
        return kept if kept[:1].isalpha() else f"col{kept}"

    return df.toDF(*unique([clean(c) for c in df.columns]))


def piped_lines(df: DataFrame) -> DataFrame:
    """The table's rows as lines: text quoted, numbers bare, missing values empty quotes."""

    def field(f: T.StructField):
        c = name(f.name)
        if isinstance(f.dataType, T.NumericType):
            return F.coalesce(c.cast("string"), F.lit('""'))
        return F.concat(F.lit('"'), F.coalesce(F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit("")), F.lit('"'))

    return df.select(F.concat_ws("|", *map(field, df.schema.fields)).alias("value"))


def write_piped(df: DataFrame, path: str) -> None:
    """A folder of parts, each with the header, that read_piped() reads back. Parts are written where rows lie."""
    header = "|".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    # The header is the name of the one column, so the writer puts it on top of each part.
    piped_lines(df).withColumnRenamed("value", header).write.csv(path, sep="\x01", header=True, quote="", escape="", emptyValue="", mode="error")


def read_any(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """By the ending of the first file."""
    ending = os.path.splitext(paths[0])[1].lower()
    if ending in (".txt", ".dat", ".csv"):
        return read_texts(spark, paths, **options)
    if ending == ".mat":
        from .matlab import read_matlab

        return read_matlab(spark, paths, **options)
    if ending == ".psydata":
        return read_piped(spark, paths)
    raise ValueError(f"no reader for {ending!r}")
