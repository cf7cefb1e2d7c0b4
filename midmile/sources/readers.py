"""Scans. Schemas are always given; nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from midmile.functions.columns import in_years
from midmile.sources.schema import columns

HEADER_JOBS = 16  # first lines read at the same time


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def all_text(columns: Sequence[str]) -> T.StructType:
    """Schema that keeps every column as text, for columns of mixed content."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _headers(spark: SparkSession, path: str, options: Mapping[str, str]) -> dict[tuple[str, ...], list[str]]:
    """Files below ``path`` by their column names; files without a line are left out.

    Spark reads the first line of each file only, in jobs that run side by side.
    """
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]
    first_line = lambda f: tuple(spark.read.options(**options).csv(f).columns)
    found: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(HEADER_JOBS) as pool:
        for file, names in zip(files, pool.map(first_line, files), strict=True):
            if names:
                found.setdefault(names, []).append(file)
    return found


def _options(encoding: str, options: Mapping[str, str]) -> dict[str, str]:
    return {"header": "true", "encoding": encoding, "quote": '"', "escape": '"', **options}


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", **options: str) -> DataFrame:
    """CSV with a header and optional quotes; large files are split over tasks.

    Columns are found by the names in each file's own header, in any order and case; further
    columns are not returned. A file whose header lacks a column is an error.
    """
    found = _options(encoding, options)
    out = None
    for names, files in _headers(spark, path, found).items():
        place = {n.strip().lower(): k for k, n in reversed(list(enumerate(names)))}
        missing = [c for c in schema.fieldNames() if c.lower() not in place]
        if missing:
            raise ValueError(f"no column {', '.join(missing)} in {files[0]}")
        fields = [T.StructField(f"_c{k}", T.StringType()) for k in range(len(names))]
        for f in schema.fields:
            fields[place[f.name.lower()]] = T.StructField(f"_c{place[f.name.lower()]}", f.dataType)
        rows = spark.read.schema(T.StructType(fields)).options(**found).csv(files)
        rows = rows.select(*[F.col(f"_c{place[c.lower()]}").alias(c) for c in schema.fieldNames()])
        out = rows if out is None else out.union(rows)
    return spark.createDataFrame([], schema) if out is None else out


def scan_by_header(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with the columns of all headers, all as text; NULL where a file has no such column."""
    found = _options(encoding, {})
    out = None
    for names, files in _headers(spark, path, found).items():
        rows = spark.read.schema(all_text(names)).options(**found).csv(files)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no header in {path}")
    return out


def file_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def scan_tagged(
    spark: SparkSession, folder: str, files: Mapping[str, str], schemas: Mapping[str, T.StructType]
) -> dict[str, DataFrame]:
    """One DataFrame per file that exists, with its ``record_type``; missing files are skipped."""
    return {
        file: scan_csv(spark, f"{folder}/{file}", schemas[file]).withColumn("record_type", F.lit(kind))
        for file, kind in files.items()
        if file_exists(spark, f"{folder}/{file}")
    }


def scan_positional(spark: SparkSession, path: str, names: Sequence[str], casts: Mapping[str, Column], header: bool = True) -> DataFrame:
    """Columns by position, whatever the header calls them; ``casts`` turn bad cells to NULL."""
    raw = spark.read.schema(all_text(names)).option("header", header).option("enforceSchema", True).csv(path)
    return raw.select(*[casts[n].alias(n) if n in casts else F.col(n) for n in names])


def write_by_year(df: DataFrame, path: str, date: str = "date") -> None:
    """Layout for ``scan_years``: one folder per year."""
    df.withColumn("data_year", F.year(date)).write.partitionBy("data_year").parquet(path)


def scan_years(spark: SparkSession, path: str, years: Sequence[int], date: str = "date") -> DataFrame:
    """Only the folders of the given years are listed and read."""
    df = spark.read.parquet(path)
    return df.where(F.col("data_year").isin(*years) & in_years(F.col(date), years)).drop("data_year")


def load_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows and bytes of every file below ``path``, files without rows included."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    counts = rows.select("_metadata.file_path").groupBy("file_path").agg(F.count("*").alias("rows"))
    files = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "_metadata.file_size")  # no contents
    return files.join(counts, "file_path", "left").na.fill(0, ["rows"])


SCENARIO = columns(
    "id string, category string, description string, route_wkt string, vehicle_weight_tons double, "
    "vehicle_height_mt double, expected_verdict string, violation_type string"
)


def read_scenarios(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Scenarios from JSON: one array per file, or one object per line for large sets."""
    return spark.read.schema(SCENARIO).option("multiLine", multi_line).json(path)
