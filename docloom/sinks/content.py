"""Content files and append-only rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import status_from_error


def write_files(docs: DataFrame, folder: str) -> DataFrame:
    """Writes ``docs(path, content)``, one UTF-8 file each, below a folder that the executors share; rewriting is harmless.

    Returns each row's ``(path, status, error)``: a row without a path, with a path that leaves the folder, or whose file can't be written is an
    error and stops no other.  Null content is an empty file.  The files are written once, when this is called; what it returns is stored beside them.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)

        def one(path: str | None, content: str | None) -> str | None:
            if not path or not path.strip("/"):
                return "no path"
            if ".." in path.split("/"):
                return "the path leaves the folder"
            where = f"{root}/{path.lstrip('/')}"
            try:
                store.create_dir(where.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(where) as f:
                    f.write((content or "").encode())
            except (OSError, ValueError) as e:
                return str(e)
            return None

        for frame in frames:
            errors = pd.Series([one(p, c) for p, c in zip(frame["path"], frame["content"])], dtype=object)
            yield pd.DataFrame({"path": frame["path"], "status": errors.isna().map({True: "written", False: "error"}), "error": errors})

    report = f"{folder}/_written/{uuid.uuid4().hex}"
    schema = "path string, status string, error string"
    docs.select("path", "content").mapInPandas(write, schema).write.parquet(report)
    return docs.sparkSession.read.schema(schema).parquet(report)


def fetch_rows(results: DataFrame) -> DataFrame:
    """Fetch results as registry rows: those without an id go, unknown statuses follow the error, figures join the metadata."""
    known = F.upper("status").isin("PENDING", "SUCCESS", "ERROR", "SKIPPED")
    status = F.when(known, F.upper("status")).otherwise(status_from_error(F.col("error")))
    figures = F.map_filter(F.create_map(F.lit("latency_ms"), F.col("latency_ms").cast("string"), F.lit("bytes_fetched"), F.octet_length("content").cast("string"), F.lit("public_url"), F.col("public_url")), lambda k, v: v.isNotNull())
    old = F.coalesce(F.from_json("metadata_json", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(figures, k), F.lit(False)))
    return results.where("coalesce(document_id, '') <> ''").withColumn("status", status).withColumn("metadata_json", F.to_json(F.map_concat(kept, figures)))


def trace_rows(calls: DataFrame) -> DataFrame:
    """Model calls as trace rows: total tokens and zero costs filled in; a call names its model and provider."""
    if not calls.where("coalesce(model, '') = '' or coalesce(provider, '') = ''").isEmpty():
        raise ValueError("model and provider are required")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return calls.withColumns({"input_tokens": zero("input_tokens"), "output_tokens": zero("output_tokens"), "total_tokens": zero("input_tokens") + zero("output_tokens"), "cost": F.coalesce(F.col("cost"), F.lit(0.0))})
