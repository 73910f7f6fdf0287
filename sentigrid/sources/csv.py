"""CSV sources: lines with too many fields are skipped, short lines are padded with nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentigrid.sources.tables import stringify_columns

# --- fixed values: field contents that mean "no value" ----------------------------------
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# --- end of fixed values ----------------------------------------------------------------

_BROKEN = "_broken_line"
# Appended to a broken line as one more field; it cannot be part of real text.
_SENTINEL = "\ue000\uf8ff\ue000"


def _header(spark: SparkSession, path: str, encoding: str, sep: str) -> list[str]:
    options = {"header": True, "encoding": encoding, "sep": sep}
    return spark.read.options(**options).csv(path).columns


def _files_by_header(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Files grouped by their first line; files without a line are left out.

    One row per file reaches the driver, as in Spark's own file listing.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.base64(F.col("value").cast("binary")).alias("line"))
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("line", "at").alias("line"))
    groups: dict[str, list[str]] = {}
    for row in first.collect():
        groups.setdefault(row.line, []).append(row.file)
    return [sorted(files) for _, files in sorted(groups.items())]


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None,
             encoding: str = "UTF-8", sep: str = ",", multiline: bool = True,
             na_texts: list[str] | None = None, header: bool = True) -> DataFrame:
    """All columns as strings, header names unless `columns` gives others.

    Each file's columns go by its own header line: files with the same columns in another order are
    aligned by name, and a column that a file lacks is null there.

    multiline=True allows line breaks inside quotes but reads each file in one task; for
    large files without them, multiline=False lets Spark split the files.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if not header and not columns:
        raise ValueError("files without a header line need column names")
    if columns:
        return _read_alike(spark, paths, columns, encoding, sep, multiline, na_texts, header)
    groups = _files_by_header(spark, paths) or [paths]
    parts = [_read_alike(spark, files, _header(spark, files[0], encoding, sep), encoding, sep, multiline,
                         na_texts, header) for files in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read_alike(spark: SparkSession, paths: list[str], names: list[str], encoding: str, sep: str,
                multiline: bool, na_texts: list[str] | None, header: bool) -> DataFrame:
    """Files that all have these columns in this order."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    lines = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())]))
        .options(header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=_BROKEN,
                 encoding=encoding, sep=sep, multiLine=multiline, quote='"', escape='"')
        .csv(paths)
    )
    # A broken line is too long exactly when a sentinel put after its last field lies
    # beyond the known columns.
    bare = F.regexp_replace(F.col(_BROKEN), r"[\r\n]+$", "")
    reparsed = F.from_csv(
        F.concat(bare, F.lit(sep + _SENTINEL)),
        F.lit(", ".join(f"f{i} STRING" for i in range(len(names)))),
        {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
         "multiLine": "true"},
    )
    fields = F.array(*[reparsed[f"f{i}"] for i in range(len(names))])
    fits = F.col(_BROKEN).isNull() | F.array_contains(
        F.transform(fields, lambda f: F.coalesce(f, F.lit(""))), _SENTINEL)
    nas = NA_TEXTS if na_texts is None else na_texts
    return lines.filter(fits).select(*[
        F.when(~F.col(f"`{n}`").isin(*nas), F.col(f"`{n}`")).alias(n) for n in names
    ])


def files_by_encoding(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, encoding): UTF-8 where every line is valid UTF-8, else ISO-8859-1.

    Works line by line, so that large files are split over tasks.
    """
    return (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
        .groupBy("file")
        .agg(F.bool_and("valid").alias("valid"))
        .select("file", F.when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"))
    )


def read_csv_any_encoding(spark: SparkSession, path: str | list[str],
                          columns: list[str] | None = None, sep: str = ",",
                          multiline: bool = True) -> DataFrame | None:
    """UTF-8 files as UTF-8, all others as Latin-1; nulls become the text 'nan'.

    Gives None when there is no file to read. Latin-1 accepts any bytes, so no further
    encoding could ever be reached.
    """
    groups: dict[str, list[str]] = {}
    for row in files_by_encoding(spark, path).collect():
        groups.setdefault(row.encoding, []).append(row.file)
    parts = [
        read_csv(spark, sorted(files), columns, encoding, sep, multiline)
        for encoding, files in sorted(groups.items(), reverse=True)
    ]
    if not parts:
        return None
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return stringify_columns(whole)
