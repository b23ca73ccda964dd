"""Paged listings of a service as a Spark data source, for batch and stream.

A listing names its pages and reads one of them; pages are dealt to tasks, so neither the driver nor one task sees the whole listing.
Conditions that the listing checks itself are given with the load (``scan``), and in a stream the offset is the last id.

``pushFilters`` isn't used: Spark 4.1 keeps what was pushed for every later use of the same DataFrame, so a whole count after a filtered
one returned the filtered rows.  Filters on the DataFrame stay Spark's own.
"""

from __future__ import annotations

import json as text_json
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: ``(field, operation, value)``; all of a list hold.  Operations are ``= in > >= < <=``.
Condition = tuple[str, str, Any]
_COMPARE = {"=": lambda f, v: f == v, "in": lambda f, v: f.isin(list(v)), ">": lambda f, v: f > v, ">=": lambda f, v: f >= v, "<": lambda f, v: f < v, "<=": lambda f, v: f <= v}


class Listing(Protocol):
    """What a service offers.  It is pickled to tasks, and a task may read a page twice."""

    id: str
    filterable: set[str]

    def pages(self, where: list[Condition]) -> list[Any]:
        """Names of all pages that may hold items with these conditions, in order of ids."""

    def read(self, page: Any, where: list[Condition], schema: pa.Schema) -> pa.Table:
        """The items of a page for which all conditions hold."""

    def last(self) -> int:
        """The largest id listed so far, -1 without any.  Ids grow: a stream doesn't go back for a smaller one."""


class Pages(InputPartition):
    """One task's pages and what their items have to fulfil."""

    def __init__(self, pages: list[Any], where: list[Condition]):
        super().__init__(pages)
        self.pages, self.where = pages, where


def source(listing: Listing, schema: str, name: str = "listing", pages_per_task: int = 1) -> type[DataSource]:
    """A data source to register with a session: ``spark.dataSource.register(source(...))``, then ``spark.read.format(name)``."""
    columns = T.StructType.fromDDL(schema)

    def batches(pages: list[Any], where: list[Condition]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(columns)
        for page in pages:
            yield from listing.read(page, where, arrow).select(arrow.names).cast(arrow).to_batches(max_chunksize=1000)

    def dealt(where: list[Condition]) -> list[Pages]:
        pages = listing.pages(where)
        return [Pages(pages[k : k + pages_per_task], where) for k in range(0, len(pages), pages_per_task)] or [Pages([], where)]

    class Reader(DataSourceReader):
        def __init__(self, where):
            self.where = where

        def partitions(self):
            return dealt(self.where)

        def read(self, partition):
            yield from batches(partition.pages, partition.where)

    class Stream(DataSourceStreamReader):
        def __init__(self, where):
            self.where = where

        def initialOffset(self):
            return {"id": -1}

        def latestOffset(self):
            return {"id": listing.last()}

        def partitions(self, start, end):
            return dealt([*self.where, (listing.id, ">", start["id"]), (listing.id, "<=", end["id"])])

        def read(self, partition):
            yield from batches(partition.pages, partition.where)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return columns

        def where(self):
            return checked(listing, [tuple(c) for c in text_json.loads(self.options.get("where", "[]"))])

        def reader(self, schema):
            return Reader(self.where())

        def streamReader(self, schema):
            return Stream(self.where())

    return Source


def checked(listing: Listing, where: list[Condition]) -> list[Condition]:
    for field, operation, _ in where:
        if field not in listing.filterable or operation not in _COMPARE:
            raise ValueError(f"The listing can't check {field!r} {operation!r}")
    return where


def scan(spark: SparkSession, name: str, where: list[Condition] | None = None, stream: bool = False) -> DataFrame:
    """The items of a registered listing for which ``where`` holds; values are texts, numbers, booleans or lists of them."""
    return (spark.readStream if stream else spark.read).format(name).option("where", text_json.dumps(where or [])).load()


def holds(where: list[Condition]) -> pc.Expression | None:
    """All conditions as one expression; a null value fits none."""
    out = None
    for field, operation, value in where:
        one = _COMPARE[operation](pc.field(field), value)
        out = one if out is None else out & one
    return out


class Recorded:
    """A listing recorded by ``record``: a folder ``listing_page=k`` for each ``size`` ids, with its items as lines of JSON.

    Items without an id are a page of their own at the end, which batches read and streams don't.  ``folder`` is a path or an address of a
    filesystem that all executors reach.
    """

    def __init__(self, folder: str, id: str, size: int, filterable: set[str]):
        self.folder, self.id, self.size, self.filterable = folder, id, size, {id} | filterable

    def _pages(self) -> dict[int | None, str]:
        files, root = fs.FileSystem.from_uri(self.folder)
        names = [f.base_name.partition("=")[2] for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("listing_page=")]
        return {int(n) if n.lstrip("-").isdigit() else None: n for n in names}

    def pages(self, where):
        """Pages by their range of ids; conditions on other fields rule none out."""
        low = max((v // self.size for f, o, v in where if f == self.id and o in ("=", ">", ">=")), default=None)
        high = min((v // self.size for f, o, v in where if f == self.id and o in ("=", "<", "<=")), default=None)
        named = [{v // self.size for v in vs} for f, o, vs in where if f == self.id and o == "in"]
        bounded = low is not None or high is not None or named
        found = self._pages()
        fits = [k for k in found if k is not None and (low is None or k >= low) and (high is None or k <= high) and all(k in n for n in named)]
        return [found[k] for k in sorted(fits)] + ([found[None]] if None in found and not bounded else [])

    def read(self, page, where, schema):
        files, root = fs.FileSystem.from_uri(f"{self.folder}/listing_page={page}")
        options = json.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")
        tables = [schema.empty_table()]
        for f in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
            if f.size and f.base_name.endswith(".json"):
                with files.open_input_stream(f.path) as lines:  # one block, so that no item is longer than a block
                    tables.append(json.read_json(lines, json.ReadOptions(block_size=max(f.size, 1 << 16)), options).select(schema.names))
        found = pa.concat_tables(tables)
        return found if not where else found.filter(holds(where))

    def last(self):
        known = [k for k in self._pages() if k is not None]
        if not known:
            return -1
        ids = self.read(str(max(known)), [], pa.schema([(self.id, pa.int64())]))[self.id]
        return pc.max(ids).as_py()


def record(items: DataFrame, folder: str, id: str, size: int) -> None:
    """Adds items to a recorded listing: one page for each ``size`` ids, so pages stay small however many items there are.

    Another call adds files to the pages; an item that is recorded twice is listed twice.  Text of any length stays whole.
    """
    page = F.expr(f"(`{id}` - pmod(`{id}`, {size}L)) div {size}L")
    items.withColumn("listing_page", page).repartition("listing_page").write.mode("append").partitionBy("listing_page").json(folder)


def documents(spark: SparkSession, name: str, platform: str, instance: str, content_type: str | None = None, status: str | None = None) -> DataFrame:
    """Items ``(id, title, content_type, slug, status)`` of a listing as discovered documents, ``url`` being ``platform/instance/type/slug``.

    The listing checks type and status itself.  Without a type that part reads ``None``, without a slug the address ends in ``untitled``.
    """
    items = scan(spark, name, [(f, "=", v) for f, v in (("content_type", content_type), ("status", status)) if v is not None])
    path = [F.lit(platform), F.lit(instance), F.coalesce("content_type", F.lit("None")), F.coalesce("slug", F.lit("untitled"))]
    return items.select(F.concat_ws("/", *path).alias("url"), "title", F.col("id").alias("cms_id"), F.col("content_type").alias("schema"), "slug")


def fetched(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The listed items whose ``id`` is among ``ids(id)``; a semi-join, so Spark picks its form by size.  A few known ids go into ``scan``."""
    return items.join(ids.select("id").distinct(), "id", "left_semi")
