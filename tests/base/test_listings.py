"""Recorded listings through the data source: pages, conditions that the listing checks, streams."""

import random
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.sources import listings

ITEM = "id bigint, title string, content_type string, slug string, status string, at timestamp"


def items(n, seed=1):
    rnd = random.Random(seed)
    return [(k, rnd.choice([None, "", "ä\n\"q\"", "long " * 30000]) if k % 17 == 0 else f"t{k}", rnd.choice(["post", "page", None]), rnd.choice([f"s{k}", None]), rnd.choice(["draft", "published"]), datetime(2024, 1, 1, k % 24, 5, 7) if k % 3 else None) for k in range(n)]


@pytest.fixture(scope="module")
def listing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("listing") / "items")
    rows = items(230) + [(None, "no id", "post", "x", "draft", None), (-3, "below", "page", "y", "draft", None)]
    listings.record(spark.createDataFrame(rows, ITEM), folder, "id", 25)
    found = listings.Recorded(folder, "id", 25, {"content_type", "status"})
    spark.dataSource.register(listings.source(found, ITEM, "recorded_listing", 2))
    return found, rows


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_whole_listing(spark, listing):
    df = listings.scan(spark, "recorded_listing")
    assert key(df.collect()) == key(listing[1])
    assert df.rdd.getNumPartitions() == 6  # ten pages of ids from 0, one below, one without ids; two for each task


@pytest.mark.parametrize(
    "where, fits, pages",
    [
        ([("content_type", "=", "post"), ("status", "=", "draft")], lambda r: r[2] == "post" and r[4] == "draft", 12),
        ([("id", ">=", 60), ("id", "<", 76)], lambda r: r[0] is not None and 60 <= r[0] < 76, 2),
        ([("id", "in", [3, 4, 229, 1000])], lambda r: r[0] in (3, 4, 229, 1000), 2),
        ([("id", "=", -3)], lambda r: r[0] == -3, 1),
        ([("id", ">", 5000)], lambda r: False, 0),
        ([("id", "<=", 30), ("content_type", "in", ["page"])], lambda r: r[0] is not None and r[0] <= 30 and r[2] == "page", 3),
    ],
)
def test_conditions_of_a_scan(spark, listing, where, fits, pages):
    df = listings.scan(spark, "recorded_listing", where)
    assert key(df.collect()) == key(r for r in listing[1] if fits(r))
    assert df.rdd.getNumPartitions() == max(1, -(-pages // 2))


def test_filters_of_a_frame_do_not_stay(spark, listing):
    df = listings.scan(spark, "recorded_listing", [("status", "=", "draft")])
    drafts = [r for r in listing[1] if r[4] == "draft"]
    assert df.where("content_type = 'post'").count() == sum(r[2] == "post" for r in drafts)
    assert df.count() == len(drafts)


@pytest.mark.parametrize("where", [[("title", "=", "t5")], [("id", "like", "5")]])
def test_what_a_listing_cannot_check(spark, listing, where):
    with pytest.raises(Exception, match="can't check"):
        listings.scan(spark, "recorded_listing", where).count()


def test_documents_of_a_listing(spark, listing):
    df = listings.scan(spark, "recorded_listing")
    got = listings.documents(spark, "recorded_listing", "cms", "main", "page", "published").select("url", "cms_id").collect()
    assert key(got) == key((f"cms/main/page/{r[3] or 'untitled'}", r[0]) for r in listing[1] if r[2] == "page" and r[4] == "published")
    ids = spark.createDataFrame([(4,), (4,), (None,), (9999,), (20,)], "id bigint")
    assert sorted(r["id"] for r in listings.fetched(df, ids).collect()) == [4, 20]


def test_nothing_recorded(spark, tmp_path):
    spark.dataSource.register(listings.source(listings.Recorded(str(tmp_path / "none"), "id", 10, set()), ITEM, "empty_listing"))
    assert listings.scan(spark, "empty_listing").count() == 0


def test_a_stream_goes_on_after_the_last_id(spark, tmp_path):
    folder, rows = str(tmp_path / "items"), items(120, seed=2)
    spark.dataSource.register(listings.source(listings.Recorded(folder, "id", 25, {"status"}), ITEM, "growing_listing"))

    def follow():
        query = listings.scan(spark, "growing_listing", [("status", "=", "draft")], stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(ITEM).parquet(str(tmp_path / "out"))

    sizes = []
    for upto in (0, 40, 40, 47, 120):  # the second page grows while the stream rests
        new = rows[sizes[-1] if sizes else 0 : upto]
        if new:
            listings.record(spark.createDataFrame(new, ITEM), folder, "id", 25)
        got = follow()
        assert key(got.collect()) == key(r for r in rows[:upto] if r[4] == "draft")
        sizes.append(upto)


def test_a_service_of_its_own(spark):
    class Numbers:
        """Pages of ten, made where they are read."""

        id, filterable = "id", {"id"}

        def pages(self, where):
            return list(range(7))

        def read(self, page, where, schema):
            found = pa.table({"id": list(range(page * 10, page * 10 + 10))}, schema)
            return found.filter(listings.holds(where)) if where else found

        def last(self):
            return 69

    spark.dataSource.register(listings.source(Numbers(), "id bigint", "numbers"))
    df = listings.scan(spark, "numbers")
    assert listings.scan(spark, "numbers", [("id", ">", 64)]).agg(F.sum("id")).first()[0] == 65 + 66 + 67 + 68 + 69
    assert df.count() == 70 and df.rdd.getNumPartitions() == 7
