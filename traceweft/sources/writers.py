"""Writers. Spark's committer makes each write atomic; nothing is overwritten unless asked."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, codec: str = "snappy", files: int | None = None, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """``files`` bounds the number of files of a small result; ``partition_by`` lets later filters prune folders."""
    out = df if files is None else df.coalesce(files)
    w = out.write.mode(mode).option("compression", codec)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def conform(df: DataFrame, schema) -> DataFrame:
    """Columns of a fixed schema, in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system that Spark writes."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str, preamble: list[str] | None = None, mode: str = "errorifexists") -> None:
    """CSV with a header; a preamble goes to a side file next to the folder."""
    df.write.mode(mode).option("header", True).csv(path)
    if preamble:
        put_text(df.sparkSession, path.rstrip("/") + ".preamble.txt", "".join(f"# {line}\n" for line in preamble))


def flat_header(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Two header levels as one: struct columns become <column>_<part>."""
    return df.select(*[c for c in df.columns if c not in groups], *[F.col(f"{c}.{p}").alias(f"{c}_{p}") for c, parts in groups.items() for p in parts])


def write_lines(df: DataFrame, path: str, columns: list[str], sep: str = "|", mode: str = "errorifexists") -> None:
    """Rows as text, values joined by a separator."""
    lines(df, columns, sep).write.mode(mode).text(path)


def lines(df: DataFrame, columns: list[str], sep: str = "|") -> DataFrame:
    return df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))


def save(df: DataFrame, folder: str, name: str, metadata: dict | None = None, format: str = "parquet") -> str:
    """A new version of a named dataset with its metadata beside it; earlier versions stay. Returns the path."""
    path = f"{folder}/{name}/v{int(time.time() * 1000)}"
    df.write.mode("errorifexists").format(format).save(path)
    stats = {"name": name, "columns": dict(df.dtypes), "rows": df.sparkSession.read.format(format).load(path).count()} | (metadata or {})
    put_text(df.sparkSession, f"{path}.json", json.dumps(stats, default=str, indent=1))
    return path


def versions(spark: SparkSession, folder: str, name: str) -> list[str]:
    from traceweft.sources.readers import _files

    return sorted(p for p, _ in _files(spark, f"{folder}/{name}/v*") if not p.endswith(".json"))


def write_report(spark: SparkSession, path: str, report: dict, html: bool = False) -> None:
    """A report as JSON, or as a plain HTML table of its metrics."""
    if html:
        rows = "".join(f"<tr><td>{k}</td><td>{v}</td></tr>" for k, v in report.items())
        put_text(spark, path, f"<!DOCTYPE html><table>{rows}</table>")
    else:
        put_text(spark, path, json.dumps(report, default=str, indent=1))


def dated_path(df: DataFrame, ts: str, path: str) -> str:
    """The path with the first and last day of a column before its ending: name_2024-01-01_to_2024-01-30.parquet."""
    days = df.agg(F.min(F.to_date(ts)).alias("a"), F.max(F.to_date(ts)).alias("z")).first()
    folder, _, name = path.rpartition("/")
    stem, dot, ending = name.rpartition(".") if "." in name else (name, "", "")
    return f"{folder}/{stem}_{days.a}_to_{days.z}{dot}{ending}" if folder else f"{stem}_{days.a}_to_{days.z}{dot}{ending}"


def save_last_run(spark: SparkSession, path: str, **settings) -> None:
    """Settings of a run as JSON, or as YAML with a .env file beside it that names it."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        put_text(spark, path, yaml.safe_dump({"last_run": settings | {"saved": time.time()}}, sort_keys=False))
        put_text(spark, f"{path.rpartition('/')[0]}/.env", f"PATHS_YAML={path}\n")
        return
    put_text(spark, path, json.dumps(settings | {"saved": time.time()}, default=str))
