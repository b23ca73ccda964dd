"""Folders, local documents and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import matches_any
from ..functions.values import markdown_title

#: Largest fetched body, and content types that are text.
MOST_BYTES = 10 * 1024 * 1024
TEXT_TYPES = ["text/html", "text/plain", "application/xhtml+xml", "application/xml", "text/xml", "application/json"]


def folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("md", "mdx"), content: bool = True) -> DataFrame:
    """Files below a folder without hidden parts: path, size, hash of the bytes, title.

    Without ``content`` only names and sizes are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)
    files = files.where(~F.col("path").rlike(r"/\.[^/]"))
    if not content:
        return files.select(F.col("path").alias("source_url"), F.col("length").alias("size"))
    text, stem = F.col("content").cast("string"), F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    return files.select(F.col("path").alias("source_url"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), markdown_title(text, stem).alias("title"))


def listed(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Names and sizes of a folder's files by globs on the relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    root = path if path.startswith("file:") else f"file:{path}"
    relative = F.regexp_replace("path", "^" + "file:/*" + root.removeprefix("file:").strip("/") + "/", "")
    rows = files.select(F.col("path").alias("source_url"), relative.alias("relative_path"), F.col("length").alias("size")).where(~F.col("relative_path").rlike(r"(^|/)\."))
    if include:
        rows = rows.where(matches_any(F.col("relative_path"), include))
    if exclude:
        rows = rows.where(~matches_any(F.col("relative_path"), exclude))
    rows = rows.withColumn("depth", F.size(F.split("relative_path", "/")) - 1)
    return rows.orderBy("relative_path").limit(most) if most else rows


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Local texts with name, extension, size and MD5 fingerprint."""
    rows = spark.read.text(path, wholetext=True).withColumn("file_path", F.input_file_name())
    return rows.select("file_path", F.regexp_extract("file_path", r"([^/]+)$", 1).alias("file_name"), F.regexp_extract("file_path", r"(\.[^./]*)$", 1).alias("extension"), F.col("value").alias("content"), F.octet_length("value").alias("size"), F.md5("value").alias("fingerprint"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines and those that start with ``#`` don't count.  ``_bad`` has lines that aren't objects."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(parsed.alias("r")).select("r.*")


def accepted(fetched: DataFrame) -> DataFrame:
    """``fetched(content_type, content)`` with an error for other content types and for bodies over the limit."""
    kind = F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    error = F.when(~kind.isin(TEXT_TYPES), F.concat(F.lit("Unsupported content type: "), kind)).when(F.octet_length("content") > MOST_BYTES, "Content too large")
    return fetched.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "SUCCESS").otherwise("ERROR"))
