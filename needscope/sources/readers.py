"""Reading tables and bringing them to the declared contract."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needscope.sources.scratch import settle


def scan(spark: SparkSession, folder: str | None, name: str) -> DataFrame:
    """A parquet table ``folder/name.parquet``, or a catalog table."""
    return spark.table(name) if folder is None else spark.read.parquet(f"{folder}/{name}.parquet")


LATIN = "ISO-8859-1"
FILE, OTHER, RECORD = "__file", "__other", "__record"


@dataclass(frozen=True)
class CsvInput:
    """What CSV files hold: ``rows`` that fit the schema, ``bad`` (file, record)
    with the raw text of the others, and ``files`` (file, encoding, n_rows, n_bad)."""

    rows: DataFrame
    bad: DataFrame
    files: DataFrame


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType, encoding: str = "auto", corrupt: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A headed CSV file or folder with a declared schema, no inference pass.

    Columns are taken by the header's names, in any order; a column that the
    file lacks is null, others are left out. Without ``corrupt``, a folder
    whose files disagree on the header is an error. ``multi_line`` keeps quoted
    line breaks together; such files can't be split.
    ``auto`` takes each file as UTF-8, or as Latin-1 if any of its text is not
    valid UTF-8; the files are read once and their rows written.
    Values that do not fit the schema become null; name a ``corrupt`` column
    to keep the raw text of such rows.
    """
    if encoding != "auto":
        rows, names = _parsed_csv(spark, path, schema, encoding, corrupt, multi_line, corrupt is None)
        return _wanted(rows, schema, names, *([corrupt] if corrupt else []))
    held, names = _held_csv(spark, path, schema, corrupt, multi_line, corrupt is None)
    return _wanted(_in_file_encoding(held), schema, names, *([corrupt] if corrupt else []))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> CsvInput:
    """Like ``scan_csv`` with ``auto``, with bad records in a table of their own.

    Without a schema, all columns of the header come as text; then only records
    with too few or too many fields are bad. All three tables come from one
    scan of the files.
    """
    held, names = _held_csv(spark, path, schema, RECORD, multi_line, True)
    schema = schema or T.StructType([T.StructField(name, T.StringType()) for name in names])
    told = _in_file_encoding(held, FILE)
    broken = F.col(RECORD).isNotNull()
    counts = held.groupBy(FILE).agg(F.max(OTHER).alias("other"), F.count(F.lit(1)).alias("n_rows"), F.count(RECORD).alias("n_bad"))
    return CsvInput(
        _wanted(told.filter(~broken), schema, names),
        told.filter(broken).select(F.col(FILE).alias("file"), F.col(RECORD).alias("record")),
        counts.select(F.col(FILE).alias("file"), F.when(F.col("other"), LATIN).otherwise("UTF-8").alias("encoding"), "n_rows", "n_bad"),
    )


def _parsed_csv(
    spark: SparkSession, path: str, schema: T.StructType | None, encoding: str, corrupt: str | None, multi_line: bool, same_header: bool
) -> tuple[DataFrame, list[str]]:
    """(all columns of the header, its names); those that ``schema`` lacks are text."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
    reader = reader.option("multiLine", multi_line)
    header = reader.csv(path).columns
    names = [_utf8_name(name) for name in header] if encoding == LATIN else header
    kinds = {field.name: field.dataType for field in schema.fields} if schema else {}
    fields = [T.StructField(raw, kinds.get(name, T.StringType())) for raw, name in zip(header, names)]
    if corrupt:
        fields.append(T.StructField(corrupt, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    if same_header:
        reader = reader.option("enforceSchema", False)
    rows = reader.schema(T.StructType(fields)).csv(path).withColumn(FILE, F.col("_metadata.file_path"))
    return rows.toDF(*names, *([corrupt] if corrupt else []), FILE), names


def _utf8_name(name: str) -> str:
    try:
        return name.encode("latin-1").decode()
    except UnicodeError:
        return name


def _held_csv(
    spark: SparkSession, path: str, schema: T.StructType | None, corrupt: str | None, multi_line: bool, same_header: bool
) -> tuple[DataFrame, list[str]]:
    """The files as Latin-1, in which every byte is a character, written with
    their paths and with whether a row holds text that is not UTF-8."""
    rows, names = _parsed_csv(spark, path, schema, LATIN, corrupt, multi_line, same_header)
    other = F.lit(False)
    for name in _text_columns(rows):
        other = other | ~F.coalesce(F.is_valid_utf8(_from_utf8(name)), F.lit(True))
    return settle(rows.withColumn(OTHER, other), "csv"), names


def _text_columns(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType) and f.name != FILE]


def _from_utf8(name: str) -> Column:
    return F.encode(F.col(f"`{name}`"), LATIN).cast("string")


def _in_file_encoding(held: DataFrame, *keep: str) -> DataFrame:
    """The bytes of text columns as UTF-8, but for files with a row that is not."""
    latin = held.filter(OTHER).select(FILE).distinct().withColumn("__latin", F.lit(True))
    joined = held.join(latin, FILE, "left")
    text = set(_text_columns(held))
    columns = [
        F.when(F.col("__latin"), F.col(f"`{name}`")).otherwise(_from_utf8(name)).alias(name) if name in text else F.col(f"`{name}`")
        for name in held.columns if name not in (FILE, OTHER)
    ]
    return joined.select(*columns, *keep)


def _wanted(rows: DataFrame, schema: T.StructType, header: list[str], *more: str) -> DataFrame:
    wanted = [F.col(f"`{f.name}`") if f.name in header else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return rows.select(*wanted, *more)


def normalise_name(name: str) -> str:
    return re.sub(r"\W", "", re.sub(r"\s+", "_", name.strip().lower()))


def normalise_columns(df: DataFrame) -> DataFrame:
    """Lower-case headers with underscores; clashing results are an error."""
    names = [normalise_name(name) for name in df.columns]
    clashes = sorted({name for name in names if names.count(name) > 1})
    if clashes:
        raise ValueError(f"columns clash after normalisation: {', '.join(clashes)}")
    return df.toDF(*names)


def conform(df: DataFrame, schema: T.StructType, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Exactly the columns and types of ``schema``.

    Text that does not parse becomes null, as does a column the source lacks.
    """
    rename = rename or {}
    df = df.withColumnsRenamed({old: new for old, new in rename.items() if old in df.columns})
    present = set(df.columns)
    return df.select(
        *[
            (F.col(field.name).try_cast(field.dataType) if field.name in present else F.lit(None).cast(field.dataType))
            .alias(field.name)
            for field in schema.fields
        ]
    )


def load_or_fallback(primary: DataFrame | None, fallback: DataFrame) -> DataFrame:
    """``primary`` unless it is missing or empty, decided when the query runs.

    The test is an uncorrelated EXISTS: Spark stops at the first row.
    """
    if primary is None:
        return fallback
    return primary.unionByName(fallback.filter(~primary.exists()))


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small table written out in the program."""
    return spark.createDataFrame(list(rows), schema)
