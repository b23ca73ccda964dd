"""Providers of pages, answers and vectors behind one batch interface, with offline stand-ins.

A provider is a callable from a list of inputs to a list of results of the same length.  It is made once for each task, and
one batch's failure makes error rows, never a failed job.  Network clients are made by the caller; tasks may run twice, so
a provider has to bear repeated calls.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list], list]


class Retryable(Exception):
    """A failure that may pass: rate limits, timeouts, server errors."""


def attempted(call: Provider, batch: list, tries: int = 3, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> tuple[list | None, str | None]:
    """The results, or the last error after ``tries`` with exponential pauses."""
    for n in range(tries):
        try:
            return call(batch), None
        except Retryable as e:
            if n + 1 == tries:
                return None, str(e)
            sleep(base * 2**n)
        except Exception as e:  # noqa: BLE001  a provider's fault is a row's error
            return None, str(e)
    return None, "no attempt"


def applied(df: DataFrame, column: str, make: Callable[[], Provider], result: str, schema: str, batch: int = 100, tries: int = 3) -> DataFrame:
    """``df`` with ``result``, ``status`` and ``error``: inputs go out in batches; empty ones are skipped."""
    from pyspark.sql import types as T

    out = T.StructType(df.schema.fields + T.StructType.fromDDL(f"{result} {schema}, status string, error string").fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for frame in frames:
            results, statuses, errors = [None] * len(frame), ["skipped"] * len(frame), [None] * len(frame)
            wanted = [i for i, v in enumerate(frame[column]) if isinstance(v, str) and v.strip()]
            for lo in range(0, len(wanted), batch):
                part = wanted[lo : lo + batch]
                got, error = attempted(call, [frame[column].iloc[i] for i in part], tries)
                for k, i in enumerate(part):
                    results[i], statuses[i], errors[i] = (got[k] if got else None), ("success" if got else "error"), error
            yield frame.assign(**{result: results, "status": statuses, "error": errors})

    return df.mapInPandas(run, out)


def hashed_vectors(size: int = 64) -> Provider:
    """A stand-in for an embedding service: unit vectors that depend on the text alone."""

    def call(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")
            v = np.random.default_rng(seed).standard_normal(size)
            out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
        return out

    return call


def embedded(df: DataFrame, text: str = "text", most_chars: int = 8000, batch: int = 100, make: Callable[[], Provider] = hashed_vectors) -> DataFrame:
    return applied(df.withColumn("_text", F.substring(text, 1, most_chars)), "_text", make, "embedding", "array<float>", batch).drop("_text")


def prompted(df: DataFrame, template: str, make: Callable[[], Provider], batch: int = 100) -> DataFrame:
    """Rows with a model's answer to a template filled from their columns; a null field gives an error row."""
    parts, filled, names = template.split("{"), [], []
    filled.append(F.lit(parts[0]))
    for p in parts[1:]:
        name, rest = p.split("}", 1)
        names.append(name)
        filled += [F.col(name).cast("string"), F.lit(rest)]
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(n).isNull(), n) for n in names]), lambda x: x.isNotNull()), ", ") if names else F.lit("")
    rows = applied(df.withColumn("_prompt", F.concat(*filled)).withColumn("_missing", missing), "_prompt", make, "llm_response", "string", batch)
    rows = rows.withColumn("error", F.when(F.col("_missing") != "", F.concat(F.lit("Missing fields: "), "_missing")).otherwise(F.col("error")))
    return rows.withColumn("status", F.when(F.col("_missing") != "", "error").otherwise(F.col("status"))).drop("_prompt", "_missing")


def recorded(requests: DataFrame, pages: DataFrame, engine: str = "recorded") -> DataFrame:
    """A stand-in for a fetch service: ``requests`` joined with recorded ``pages(url, html)`` by address.

    Adds ``content`` (Markdown), ``title``, ``description``, ``author``, ``date``, ``fetch_engine``, ``status`` and ``error``.  An address without a
    record and a page without content are errors, as they are for a service; of several records of an address the least counts.
    """
    from ..functions.html import extracted

    known = pages.groupBy(F.col("url").alias("_url")).agg(F.min("html").alias("_html"))
    rows = requests.join(known, F.col("source_url") == F.col("_url"), "left").withColumn("_e", extracted(F.col("_html")))
    error = F.when(F.col("_url").isNull(), "HTTP 404").when(F.col("_e.content").isNull(), F.concat(F.lit("No content extracted (page might be empty or paywall blocked): "), "source_url"))
    facts = [F.when(error.isNull(), F.col(f"_e.{c}")).alias(c) for c in ("content", "title", "description", "author", "date")]
    return rows.select(*requests.columns, *facts, F.lit(engine).alias("fetch_engine"), F.when(error.isNull(), "SUCCESS").otherwise("ERROR").alias("status"), error.alias("error"))


def structured(answers: DataFrame, schema: str, column: str = "llm_response") -> DataFrame:
    """Model answers in JSON as columns of ``schema``; an answer that isn't such an object is an error row with null columns."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    rows = answers.withColumn("_fields", F.when(F.get_json_object(column, "$").startswith("{"), parsed))
    bad = (F.col("status") == "success") & F.col("_fields").isNull()
    rows = rows.withColumns({"error": F.when(bad, "the answer isn't an object of the schema").otherwise(F.col("error")), "status": F.when(bad, "error").otherwise(F.col("status"))})
    return rows.select("*", "_fields.*").drop("_fields")


def resolve(url: str, providers: list[dict], default: str | None = None) -> str | None:
    """The provider whose glob fits best: most literal characters, then source project, user, built-in, then name."""
    import fnmatch

    rank = {"project": 0, "user": 1, "builtin": 2}
    fits = [(-len(p.translate({42: None, 63: None})), rank.get(d.get("source", "builtin"), 3), d["name"], p) for d in providers for p in d.get("url_patterns", []) if fnmatch.fnmatchcase(url, p)]
    specific = sorted(f for f in fits if f[3] != "*")
    if specific:
        return specific[0][2]
    return default or (sorted(fits)[0][2] if fits else None)
