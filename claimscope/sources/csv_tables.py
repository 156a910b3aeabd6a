"""Claims tables from CSV files with a header line."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType, StructField, StructType

from claimscope import schemas as S
from claimscope.operators.prepare import (
    join_beneficiaries,
    prepare_beneficiary,
    prepare_inpatient,
    union_claims,
)

# Texts that stand for a missing value, as common CSV readers take them.
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


class ClaimTables(NamedTuple):
    beneficiary: DataFrame
    inpatient: DataFrame
    outpatient: DataFrame
    claims: DataFrame


class CsvRows(NamedTuple):
    """Typed rows, and the lines that are none: ``file``, ``line`` and ``reason``."""

    rows: DataFrame
    bad: DataFrame


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files below ``path`` by the text of their first line."""
    files = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()]

    def first_line(file: str) -> str:
        line = spark.read.text(file).head()
        return line[0] if line else ""

    by_header: dict[str, list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for file, header in zip(files, pool.map(first_line, files)):
            # A file without any line has no rows either.
            if header:
                by_header.setdefault(header, []).append(file)
    return by_header


def _names(header: str, path: str, schema: StructType) -> list[str]:
    names = next(csv.reader([header.removeprefix("\ufeff")]))
    absent = [f.name for f in schema if f.name not in names]
    if absent:
        raise ValueError(f"{path} has a file without column {', '.join(absent)}")
    return names


def _lines(spark: SparkSession, files: list[str], header: str, names: list[str], multiline: bool) -> DataFrame:
    """``_file, _line, _fields``, and ``_why`` for lines whose fields do not fit the header of their file."""
    fields = StructType([StructField(f"_{i}", StringType()) for i in range(len(names))] + [StructField("_odd", StringType())])
    how = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_odd"}
    file = F.col("_metadata.file_path").alias("_file")
    if multiline:
        raw = spark.read.options(**how, header=True, multiLine=True, enforceSchema=True).schema(fields).csv(files)
        lines = raw.select(file, F.col("_odd").alias("_line"), F.struct(*fields.names).alias("_fields"))
        open_quote = F.lit(False)
    else:
        text = spark.read.text(files).select(file, F.col("value").alias("_line"))
        lines = text.filter((F.trim("_line") != "") & (F.col("_line") != header))
        lines = lines.withColumn("_fields", F.from_csv("_line", fields.simpleString(), how))
        open_quote = (F.length("_line") - F.length(F.replace("_line", F.lit('"'), F.lit("")))) % 2 == 1
    why = F.when(open_quote, F.lit("open quote")).when(F.col("_fields._odd").isNotNull(), F.lit("number of fields"))
    return lines.withColumn("_why", why)


def _number(text: Column, kind: DataType) -> Column:
    """A text as a number, NULL if it is none; whole numbers may end in a point and zeros."""
    if isinstance(kind, IntegralType):
        text = F.regexp_replace(text, r"^\s*([+-]?\d+)\.0*\s*$", "$1")
    return text.try_cast(kind)


def _parsed(spark: SparkSession, path: str, schema: StructType, multiline: bool) -> DataFrame:
    """All lines: typed columns, and ``_file, _line, _why``, the last of which is NULL for good ones."""
    groups = []
    for header, files in _headers(spark, path).items():
        names = _names(header, path, schema)
        lines = _lines(spark, files, header, names, multiline)
        numbers = [f for f in schema if not isinstance(f.dataType, StringType)]
        texts = {f.name: F.col(f"_fields._{names.index(f.name)}") for f in schema}
        # One projection after the other, so that each text is cleaned and cast once.
        cleaned = lines.select(
            "_file", "_line", "_why", *[F.when(~text.isin(MISSING_TEXTS), text).alias(n) for n, text in texts.items()]
        )
        typed = cleaned.withColumns({f"_n{i}": _number(F.col(f.name), f.dataType) for i, f in enumerate(numbers)})
        odd = [
            F.when(F.col(f.name).isNotNull() & F.col(f"_n{i}").isNull(), F.lit(f"not a number: {f.name}"))
            for i, f in enumerate(numbers)
        ]
        value = {f.name: F.col(f"_n{i}") for i, f in enumerate(numbers)}
        columns = [value.get(n, F.col(n)).alias(n) for n in schema.names]
        # Numbering the rows keeps a filter on the reason from repeating all of this below.
        row = F.monotonically_increasing_id().alias("_row")
        groups.append(typed.select(*columns, "_file", "_line", F.coalesce("_why", *odd).alias("_why"), row))
    if not groups:
        raise ValueError(f"{path} has no file with a header line")
    return reduce(DataFrame.unionByName, groups)


def read_with_quarantine(spark: SparkSession, path: str, schema: StructType, multiline: bool = False) -> CsvRows:
    """Columns of ``schema`` by the header of each file, and apart from them the lines that cannot be read.

    A line is bad when it has more or fewer fields than its file's header, when a quote stays open, or when a number column holds something else;
    ``1068.0`` is a whole number. Missing-value texts become NULL. Codes stay text, so ``0066`` and ``66`` are different codes. Lines
    equal to the file's header are headers. ``multiline`` reads quoted line breaks, a file per task; ``line`` is then only known for a wrong number of
    fields.
    """
    lines = _parsed(spark, path, schema, multiline)
    rows = lines.filter("_why IS NULL AND _row >= 0").select(*schema.names)
    return CsvRows(rows, lines.filter("_why IS NOT NULL AND _row >= 0").selectExpr("_file AS file", "_line AS line", "_why AS reason"))


def read_table(spark: SparkSession, path: str, schema: StructType, multiline: bool = False) -> DataFrame:
    """The rows of ``read_with_quarantine``; a bad line fails the job with its file, reason and text."""
    lines = _parsed(spark, path, schema, multiline)
    message = F.concat_ws(": ", "_file", "_why", "_line")
    good = F.when(F.col("_why").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return lines.filter(good & (F.col("_row") >= 0)).select(*schema.names)


def read_raw(
    spark: SparkSession, beneficiary: str, inpatient: str, outpatient: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        read_table(spark, beneficiary, S.BENEFICIARY),
        read_table(spark, inpatient, S.INPATIENT),
        read_table(spark, outpatient, S.OUTPATIENT),
    )


def read_providers(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, S.PROVIDER_LIST)


def load_claims(
    spark: SparkSession, beneficiary: str, inpatient: str, outpatient: str
) -> ClaimTables:
    """Raw beneficiaries, prepared inpatient, raw outpatient and the merged claims."""
    ben, inp, out = read_raw(spark, beneficiary, inpatient, outpatient)
    inp = prepare_inpatient(inp)
    claims = join_beneficiaries(union_claims(inp, out), prepare_beneficiary(ben))
    return ClaimTables(ben, inp, out, claims)
