"""Readers: one dispatcher over Spark's formats, and helpers that look at files without loading them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceweft.operators.sampling import hash_order

#: Formats by file name ending.
FORMATS = {"parquet": "parquet", "pq": "parquet", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "orc": "orc", "txt": "text"}
#: Formats that have no distributed reader; they are refused by name.
UNSUPPORTED = {"pkl", "pickle", "feather", "h5", "hdf5"}


def _files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, modification time in ms) of what matches, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [(f.getPath().toString(), f.getModificationTime()) for f in found or []]


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text, hidden ones too, from any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    lines = jvm.java.util.Scanner(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at), "UTF-8").useDelimiter("\\A")
    try:
        return lines.next() if lines.hasNext() else ""
    finally:
        lines.close()


def newest(spark: SparkSession, folder: str, prefix: str, ending: str = ".csv") -> str:
    """The file changed last among those of a folder with this prefix and ending."""
    found = [f for f in _files(spark, f"{folder}/{prefix}*{ending}")]
    if not found:
        raise FileNotFoundError(f"{folder}/{prefix}*{ending}")
    return max(found, key=lambda f: (f[1], f[0]))[0]


def format_of(path: str) -> str:
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending in UNSUPPORTED:
        raise ValueError(f"{ending} files have no distributed reader; convert them to Parquet")
    if ending in ("xls", "xlsx"):
        raise ValueError("use read_excel for workbooks")
    return FORMATS.get(ending, "parquet")


def read(spark: SparkSession, path: str, format: str = "auto", schema: T.StructType | str | None = None, columns: list[str] | None = None, encoding: str | None = None) -> DataFrame:
    """Any supported file or folder; columns are pruned in the scan where the format allows."""
    kind = format_of(path) if format == "auto" else format
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.options(header=True, sep="\t" if path.endswith(".tsv") else ",", inferSchema=schema is None)
        reader = reader.option("encoding", encoding or sniff_encoding(spark, path))
    elif kind == "json" and not path.endswith(".jsonl"):
        reader = reader.option("multiLine", True)
    df = reader.format(kind).load(path)
    return df.select(*columns) if columns else df


def sniff_encoding(spark: SparkSession, path: str, sample: int = 1 << 16) -> str:
    """utf-8 if the beginning of the file (or of one file of the folder) is, else ISO 8859-1."""
    first = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, sample).alias("head")).first()
    if first is None:
        return "utf-8"
    head = bytes(first.head)
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 4:
            return "iso-8859-1"
    return "utf-8"


def read_json_index(spark: SparkSession, path: str, schema: str | None = None, sample: int = 100) -> DataFrame:
    """A JSON object of records by key, as rows with the key in ``index`` and the record in ``record``.

    The records' schema is inferred from the first ``sample`` of them if it is not given.
    """
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("index", "record"))
    if schema is None:
        head = [r["record"] for r in rows.limit(sample).collect()]
        kind = spark.range(1).select(F.schema_of_json(F.lit(f"[{','.join(head)}]")).alias("s")).first()["s"]
        schema = kind.removeprefix("ARRAY<").removesuffix(">") if head else "struct<>"
    return rows.select("index", F.from_json("record", schema).alias("record"))


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """First sheet of a workbook, by pandas on the driver; needs openpyxl."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def from_file(spark: SparkSession, path: str, columns: str = "*", where: str | None = None) -> DataFrame:
    """SQL directly over a Parquet file or folder."""
    return spark.sql(f"SELECT {columns} FROM parquet.`{path}`" + (f" WHERE {where}" if where else ""))


def only(df: DataFrame, column: str, values: list | DataFrame) -> DataFrame:
    """Rows with one of the values: a pushed-down filter for a list, a semi join for a table."""
    if isinstance(values, DataFrame):
        return df.join(values.select(column).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(values))


def bounded(df: DataFrame, rows: int, key: str, seed="") -> DataFrame:
    """At most so many rows, chosen by a hash of the key."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(rows)


def schema_of(df: DataFrame) -> DataFrame:
    """Catalogue of a frame: position, column, type, nullable."""
    spark = df.sparkSession
    rows = [Row(position=i, column=f.name, type=f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "position int, column string, type string")


def parquet_footer(path: str) -> dict:
    """Columns, rows, row groups and codecs from the footer of one local Parquet file."""
    import pyarrow.parquet as pq

    m = pq.ParquetFile(path).metadata
    codecs = {m.row_group(g).column(c).compression for g in range(m.num_row_groups) for c in range(m.num_columns)}
    return {"columns": [m.schema.column(i).path for i in range(m.num_columns)], "rows": m.num_rows, "row_groups": m.num_row_groups, "codecs": sorted(codecs)}


def peek(df: DataFrame, order: list[str], rows: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def row_at(df: DataFrame, order: list[str], ordinal: int) -> DataFrame:
    """The row at a 0-based place of an explicit order."""
    return df.orderBy(*order).offset(ordinal).limit(1)


def last_run(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML configuration file."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)
