"""Content-management exports: searches, types, field paths."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(document_id: Column) -> Column:
    return F.when(document_id.startswith("drafts."), "draft").otherwise("published")


def search(docs: DataFrame, query: str | None = None, filters: dict[str, Any] | None = None, content_type: str | None = None, n: int = 100) -> DataFrame:
    """Documents ``(_id, _type, _updatedAt, title, body, ...)`` by text, type and filters, latest first.

    A list asks for its first value in an array column, ``>v`` and ``<v`` compare, other values are equal.
    """
    found = F.lit(True)
    if content_type:
        found = found & (F.col("_type") == content_type)
    if query:
        found = found & (F.contains(F.lower("title"), F.lit(query.lower())) | F.contains(F.lower("body"), F.lit(query.lower())))
    for key, value in (filters or {}).items():
        c = F.col(key)
        if isinstance(value, list):
            found = found & F.array_contains(c, value[0])
        elif isinstance(value, str) and value[:1] in ("<", ">"):
            found = found & (c > value[1:] if value[0] == ">" else c < value[1:])
        else:
            found = found & (c == value)
    return docs.where(found).withColumn("status", status(F.col("_id"))).orderBy(F.desc("_updatedAt"), "_id").limit(n)


def types(docs: DataFrame) -> DataFrame:
    return docs.groupBy("_type").agg(F.count("*").alias("n"))


def field_value(document: Column, field: str) -> Column:
    """A field of a JSON document: ``a.b``, ``list[]``, ``ref->field``, ``list[]->field``; objects and lists as JSON text."""
    if "->" in field:
        base, ref = field.split("->", 1)
        if base.endswith("[]"):
            items = F.from_json(F.get_json_object(document, f"$.{base[:-2]}"), "array<map<string,string>>")
            return F.to_json(F.filter(F.transform(items, lambda x: F.element_at(x, ref)), lambda v: v.isNotNull()))
        return F.get_json_object(document, f"$.{base}.{ref}")
    if field.endswith("[]"):
        found = F.get_json_object(document, f"$.{field[:-2]}")
        return F.when(found.startswith("["), found).otherwise("[]")
    return F.get_json_object(document, f"$.{field}")


def document_url(slug: Column, base: str, prefix_by: Column | None = None, prefixes: dict[str, str] | None = None) -> Column:
    """The address of a document: the base, a prefix by some field's value where there are some, and the slug."""
    root = base.rstrip("/")
    if prefix_by is None or not prefixes:
        return F.concat(F.lit(root + "/"), slug)
    part = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]), prefix_by), F.lit(""))
    return F.concat(F.lit(root), F.when(part == "", "").otherwise(F.concat(F.lit("/"), F.regexp_replace(part, "^/+|/+$", ""))), F.lit("/"), slug)
