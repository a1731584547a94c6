"""File sources and sinks: text and typed CSV, Parquet, JSON manifests, Markdown and failure reports."""

from __future__ import annotations

import hashlib
import json
import math
import os
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import ValidationError


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as text and nothing taken for missing."""
    return spark.read.options(header=True, inferSchema=False, nullValue="\u0000", emptyValue="", multiLine=False).csv(path)


def typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV by a schema; values that do not fit become NULL."""
    return spark.read.options(header=True, mode="PERMISSIVE", enforceSchema=False).schema(schema).csv(path)


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A Parquet table; the columns and the condition reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def parquet_schema(spark: SparkSession, path: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, candidates: list[str], role: str = "input") -> str:
    for c in candidates:
        if path_exists(spark, c):
            return c
    raise ValidationError([f"no {role} among {candidates}"])


def read_json(path: str) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def plain(value: Any) -> Any:
    """A value as JSON can hold it: no NaN, infinities, dates or library numbers."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).isoformat()
    return value if value is None or isinstance(value, (str, int, bool)) else str(value)


def write_json(path: str, value: Any) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.part")
    part.write_text(json.dumps(plain(value), indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n", encoding="utf-8")
    os.replace(part, target)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Appends rows; every file carries the header once."""
    df.write.mode("append").option("header", True).csv(path)


def markdown_table(rows: list[dict], columns: list[str] | None = None) -> str:
    columns = columns or (list(rows[0]) if rows else [])
    def cell(v: Any) -> str:
        return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])


def write_markdown(path: str, title: str, sections: dict[str, str | DataFrame], limit: int = 200) -> None:
    """A report; of a table its first `limit` rows are shown."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        if isinstance(body, DataFrame):
            body = markdown_table([r.asDict() for r in body.limit(limit).collect()], body.columns)
        parts.append(f"## {name}\n\n{body}")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n\n".join(parts) + "\n", encoding="utf-8")


def write_failures(path: str, errors: list[str]) -> None:
    write_markdown(path, "Validation failed", {"Errors": "\n".join(f"- {e}" for e in errors) or "none"})


def file_sha256(path: str, step: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(step):
            digest.update(part)
    return digest.hexdigest()


def text_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
