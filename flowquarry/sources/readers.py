"""CSV and Parquet sources for packet exports and labelled flow tables."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowquarry import fixed
from flowquarry.operators.cleaning import numbered_repeats, require_columns, standard_headers

DELIMITERS = [",", ";", "\t", "|"]
_BROKEN = "_broken_line"


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    try:
        return spark.read.text(list(path) if not isinstance(path, str) else path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no such input: {path}") from error
        raise


def _first_line(spark: SparkSession, path: str) -> str:
    head = _lines(spark, path).limit(1).collect()
    if not head or not head[0][0].strip():
        raise ValueError(f"input is empty: {path}")
    return head[0][0].lstrip("\ufeff")


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that splits the first line into most fields; a comma when none does."""
    line = _first_line(spark, path)
    best = max(DELIMITERS, key=line.count)
    return best if line.count(best) else ","


def detect_encoding(spark: SparkSession, path: str | Sequence[str]) -> str:
    """UTF-8 unless some line anywhere fails to decode, then ISO-8859-1.

    The filter runs over all lines and stops at the first hit.
    """
    bad = _lines(spark, path).filter(~F.is_valid_utf8("value")).take(1)
    return "ISO-8859-1" if bad else "UTF-8"


def read_text_table(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None,
                    limit: int | None = None) -> DataFrame:
    """All columns as text. Lines with too many fields are skipped, short ones padded with NULL."""
    delimiter = delimiter or detect_delimiter(spark, path)
    encoding = encoding or detect_encoding(spark, path)
    header = next(csv.reader([_first_line(spark, path)], delimiter=delimiter))
    names = numbered_repeats(header)
    schema = StructType([StructField(n, StringType()) for n in names] + [StructField(_BROKEN, StringType())])
    rows = (
        spark.read.schema(schema)
        .options(header=True, sep=delimiter, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=_BROKEN, escape='"')
        .csv(path)
    )
    # The marker is set for short and for over-long lines; only the latter have a delimiter too many.
    outside_quotes = F.regexp_replace(F.col(_BROKEN), '"([^"]|"")*"', "")
    delimiters = F.length(outside_quotes) - F.length(F.replace(outside_quotes, F.lit(delimiter), F.lit("")))
    # A short line never reaches the last column.
    short = F.col(f"`{names[-1]}`").isNull() & (delimiters < len(names))
    rows = rows.filter(F.col(_BROKEN).isNull() | short).drop(_BROKEN)
    return rows.limit(limit) if limit else rows


def read_packets(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None,
                 limit: int | None = None) -> DataFrame:
    """Packet export with standard names, still untyped; cleaning types it."""
    rows = standard_headers(read_text_table(spark, path, delimiter, encoding, limit))
    return require_columns(rows, fixed.REQUIRED_COLUMNS, f"packet export {path}")


def merge_packets(spark: SparkSession, paths: Sequence[str], limit: int | None = None) -> DataFrame:
    """Union of several exports; the row cap is per file; missing columns become NULL."""
    out = None
    for path in paths:
        part = read_packets(spark, path, limit=limit)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no input files")
    return out


def from_windows_1252(col: Column) -> Column:
    """Text read as ISO-8859-1 to what windows-1252 means by the bytes 0x80 to 0x9F."""
    codes = [c for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    return F.translate(col, "".join(map(chr, codes)), bytes(codes).decode("windows-1252"))


def _headers(spark: SparkSession, folder: str) -> dict[str, str]:
    """First line of each CSV file of a folder by its path. Files are listed once and only their heads are read."""
    try:
        paths = sorted(spark.read.option("pathGlobFilter", "*.csv").text(folder).inputFiles())
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return {}
        raise

    def head(path: str) -> str:
        line = spark.read.text(path).first()
        return line[0].lstrip("\ufeff").rstrip("\r") if line else ""

    with ThreadPoolExecutor(16) as pool:
        return {path: line for path, line in zip(paths, pool.map(head, paths), strict=True) if line.strip()}


def read_directory(spark: SparkSession, folder: str, fallback: str | None = None) -> DataFrame:
    """Every CSV file of a folder, or of the fallback folder when the first has none.

    Files are joined by the names in their own headers, in any order; a column that a file lacks is NULL there.
    Numeric text is typed on the way in: everything but the label becomes DOUBLE.
    """
    for place in [folder] + ([fallback] if fallback else []):
        headers = _headers(spark, place)
        if headers:
            return _typed_flow_files(spark, headers)
    raise FileNotFoundError(f"no CSV files in {folder} or {fallback}")


def _typed_flow_files(spark: SparkSession, headers: dict[str, str]) -> DataFrame:
    """One read for all files of equal header, and a union by name of those reads."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, line in headers.items():
        groups.setdefault(tuple(numbered_repeats([n.strip() for n in next(csv.reader([line]))])), []).append(path)
    out = None
    for names, paths in groups.items():
        kinds = StructType([StructField(n, StringType()) for n in names])
        rows = spark.read.schema(kinds).options(header=True, encoding="ISO-8859-1", enforceSchema=True).csv(paths)
        rows = rows.select(*[
            from_windows_1252(F.col("Label")).alias("Label") if n == "Label" else F.col(f"`{n}`").try_cast("double").alias(n) for n in names
        ], F.col("_metadata.file_name").alias("_file_name"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def header_compatibility(spark: SparkSession, folder: str) -> DataFrame:
    """Per CSV file: its header and whether it equals the header of the first file (order counts)."""
    clean = {path: ",".join(n.strip(' "\r\ufeff') for n in line.split(",")) for path, line in _headers(spark, folder).items()}
    first = clean[min(clean, key=lambda path: path.rsplit("/", 1)[-1])] if clean else None
    rows = [(path.rsplit("/", 1)[-1], header, header == first) for path, header in clean.items()]
    return spark.createDataFrame(rows, "file_name string, header string, compatible boolean")


def read_flow_table(spark: SparkSession, parquet_path: str, csv_path: str | None = None) -> DataFrame:
    """The Parquet table when present, else the CSV one (windows-1252)."""
    try:
        rows = spark.read.parquet(parquet_path)
    except AnalysisException:
        if csv_path is None:
            raise FileNotFoundError(f"no flow table at {parquet_path}") from None
        return read_directory(spark, csv_path).drop("_file_name")
    return rows.toDF(*numbered_repeats(rows.columns))


def read_any(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """("flows", table) when all 32 features are there, ("packets", table) for a packet export."""
    rows = read_text_table(spark, path)
    if all(c in rows.columns for c in fixed.FLOW32_FEATURES):
        typed = [F.col(f"`{c}`").try_cast("double").alias(c) if c in fixed.FLOW32_FEATURES else F.col(f"`{c}`") for c in rows.columns]
        return "flows", rows.select(*typed)
    if all(c in rows.columns for c in fixed.REQUIRED_COLUMNS):
        return "packets", standard_headers(rows)
    missing = [c for c in fixed.FLOW32_FEATURES if c not in rows.columns]
    raise ValueError(f"neither a flow table nor a packet export; {len(missing)} features missing: {missing[:5]}")
