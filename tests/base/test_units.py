import json
import random
from urllib.parse import urlsplit

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import url as U
from docloom.functions import values as V
from docloom.operators import graph
from docloom.operators.analytics import trace_summary, trend
from docloom.operators.registry import Filters, listing
from docloom.operators.sql import SqlError, parameters, positional, run_sql
from docloom.schemas import TABLES, schema
from docloom.sinks import tables
from docloom.sources import files, pages, providers
from docloom.streaming import events
from docloom.workflow import run as workflow


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("HTTP://Example.COM:80/a//b/", "http://example.com/a/b"), ("https://example.com:443", "https://example.com/"), ("https://e.com/%7Euser/%2F", "https://e.com/~user/%2F"),
        ("https://e.com/?b=2&a=1#x", "https://e.com/?a=1&b=2"), ("https://e.com?b=2", "https://e.com?b=2"), ("mailto:me@x", "mailto:me@x"), ("", ""), (None, None), ("https://e.com/p/?q=", "https://e.com/p?q="),
    ],
)
def test_normalize_strict(raw, want):
    assert U.normalize_strict(raw) == want
    assert U.normalize_strict(want) == want


@given(st.from_regex(r"https?://[a-z]{1,5}(\.[a-z]{1,3}){1,2}(:[0-9]{2,4})?(/[a-z%0-9]{0,4}){0,3}(\?[a-z]=[a-z0-9]{0,2})?", fullmatch=True))
def test_normalize_strict_is_stable(u):
    once = U.normalize_strict(u)
    assert U.normalize_strict(once) == once and urlsplit(once).hostname == urlsplit(u).hostname


def test_native_url_parts_agree_with_urllib(spark):
    urls = ["https://U:p@Ex.com:8080/a/b?q=1#f", "http://x.org", "file:///docs/readme.md", "//h/p", "no-scheme/path", "https://a.b/c d"]
    assert values(spark, U.authority, urls) == [urlsplit(u).netloc for u in urls] and values(spark, U.path, urls) == [urlsplit(u).path for u in urls]


def test_glob_is_whole_and_case_sensitive(spark):
    got = values(spark, lambda c: U.matches_any(c, ["*.md", "a?c"]), ["x/y.md", "a.md\n", "A.MD", "abc", "xabc"])
    assert got == [True, False, False, True, False]


def test_profiles_and_posts(spark):
    assert values(spark, U.profile_name, ["https://x.com/jane", "https://twitter.com/home", "https://x.com/jane/likes", "https://x.com/a/status/12"]) == ["jane", None, "jane", None]
    assert values(spark, U.tweet_id, ["https://X.com/a/status/12", "https://x.com/a"]) == ["12", None]


IMAGES = [
    ("![a](u)\n\n![b](u)\ntext\n![c](u)", "![a](u)\n\ntext\n![c](u)"),
    ("one\n ![a](u)\t\r\n![b](v)\n![c](u)\n", "one\n ![a](u)\t\r\n![b](v)\n"),
    ("![a](u)\nsee ![b](u)\n![c](u)\n![d](u)\n\n\n![e](u)", "![a](u)\nsee ![b](u)\n![c](u)\n\n"),
    ("![](u)\n![]()\n![](u)", "![](u)\n![]()\n![](u)"),
    ("\n\n", "\n\n"),
    ("", ""),
    (None, None),
]


def test_images_deduplicated(spark):
    got = spark.createDataFrame(IMAGES, "text string, want string").select("want", V.images_deduplicated(F.col("text")).alias("got"))
    assert [r["got"] for r in got.collect()] == [want for _, want in IMAGES]
    assert "Python" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("now,before,want", [(5, 0, ("increasing", None)), (0, 0, ("stable", None)), (112, 100, ("increasing", 12.0)), (89, 100, ("decreasing", -11.0)), (110, 100, ("stable", 10.0))])
def test_trend(spark, now, before, want):
    got = spark.range(1).select(F.lit(now).alias("n"), F.lit(before).alias("b")).select(*[c.alias(k) for k, c in trend(F.col("n"), F.col("b")).items()]).first()
    assert tuple(got) == want


def test_trace_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "model string, input_tokens bigint, output_tokens bigint, latency_ms bigint")
    assert tuple(trace_summary(empty, F.lit(0.0)).first()) == (0, 0, 0, 0.0, None)


ROWS = [
    ("doc-1", "https://example.com/docs/intro", "url", "sitemap", "SUCCESS", "Introduction", None), ("doc-2", "https://example.com/docs/guide", "url", "sitemap", "SUCCESS", "User Guide", None),
    ("doc-3", "https://example.com/blog/post-1", "url", "crawl", "SUCCESS", "Blog Post", None), ("doc-4", "https://example.com/docs/api", "url", "sitemap", "SUCCESS", "API Reference", None),
    ("doc-5", "https://example.com/docs/config", "url", "sitemap", "SUCCESS", "Configuration", None), ("doc-6", "https://example.com/private/secret", "url", "crawl", "SUCCESS", "Private Page", None),
    ("doc-7", "https://example.com/broken", "url", "crawl", "ERROR", None, "Invalid URL format"), ("doc-8", "file:///docs/readme.md", "file", "folder", "SUCCESS", "README", None),
]


@pytest.mark.parametrize(
    "filters,want",
    [
        (Filters(not_fetched=True), "12378"), (Filters(fetch_status="SUCCESS"), "45"), (Filters(has_error=True), "67"), (Filters(include=["*/docs/*"], limit=2, order_by="source_url"), "48"),
        (Filters(url_contains="docs"), "12458"), (Filters(url_contains="https://*/docs/*"), "1245"), (Filters(exclude=["*/private/*", "*broken"]), "123458"), (Filters(min_content_length=4000), "4"),
        (Filters(ids=["doc-1", "doc-9"]), "1"), (Filters(has_content=False), "123678"), (Filters(discovery_method="folder"), "8"), (Filters(file_ext="md"), "8"),
    ],
)
def test_registry(spark, filters, want):
    m = spark.createDataFrame([(*r, None, None, None, None) for r in ROWS], "document_id string, source_url string, source_type string, discovery_method string, status string, title string, error string, discovery_url string, user_id string, workspace_id string, created_at timestamp")
    x = spark.createDataFrame([("doc-4", "SUCCESS", 5000, "trafilatura", None), ("doc-5", "SUCCESS", 3000, "firecrawl", None), ("doc-6", "ERROR", 0, "httpx", "403 Forbidden")], "document_id string, status string, content_length int, fetch_engine string, error string")
    assert "".join(sorted(r.document_id[-1] for r in listing(m, x, filters).collect())) == want


def test_sql_guard(spark):
    t = spark.createDataFrame([(1, "item1", 0.5), (2, "item2", 0.8), (3, "item3", 0.3)], "id int, name string, score double")
    assert [r.id for r in run_sql(spark, "SELECT id FROM test_data WHERE score >= :least ORDER BY id LIMIT :n", {"least": 0.5, "n": 5}, {"test_data": t}).collect()] == [1, 2]
    for text, kind in (("DELETE FROM test_data", "not_select"), ("WITH a AS (SELECT 1) SELECT * FROM a", "not_select"), ("SELECT * FROM nowhere", "table_not_found"), ("SELECT (1", "syntax_error"), ("SELECT :b, :a", "parameter_error")):
        with pytest.raises(SqlError) as e:
            run_sql(spark, text, {}, {"test_data": t})
        assert e.value.kind == kind
    assert parameters("a = :x and b = '::y' and c = :x") == ["x"] and positional(":a + :b + :a", {"a": 1, "b": 2}) == ("? + ? + ?", [1, 2, 1])


def test_writes(spark, tmp_path):
    target = spark.createDataFrame([(1, "a", 0.1), (2, "b", 0.2)], "id int, name string, score double")
    rows = spark.createDataFrame([(2, "B"), (3, None)], "id int, name string")
    up = {r.id: tuple(r)[1:] for r in tables.upserted(target, rows, ["id"]).collect()}
    assert up == {1: ("a", 0.1), 2: ("B", 0.2), 3: (None, None)}
    assert {r.id: r.score for r in tables.replaced(target, rows, ["id"]).collect()} == {1: 0.1, 2: None, 3: None}
    assert {(r.row_id, r.write_status) for r in tables.statuses(target, rows, ["id"]).collect()} == {("2", "updated"), ("3", "inserted")}
    first, folder = tables.commit(target, str(tmp_path / "t")), str(tmp_path / "t")
    assert tables.current(spark, folder).count() == 2 and first.startswith(folder)
    tables.commit(tables.upserted(tables.current(spark, folder), rows, ["id"]), folder)
    assert tables.current(spark, folder).count() == 3
    assert tables.inferred_schema({"a": 1, "b": "x", "c": True, "d": {}, "e": None}) == "`a` bigint, `b` string, `c` int, `d` string, `e` string".replace("int, `d`", tables.SQL_TYPES[bool] + ", `d`")
    repeated = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "id int, name string, _pos int")
    assert [r.name for r in tables.last_of_each(repeated, ["id"], "_pos").collect()] == ["y"]


SITEMAP = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://e.com/A/ </loc></url><url><loc>https://E.com/A</loc></url><url><loc>https://e.com/b.pdf</loc></url></urlset>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="https://e.com/s"/><link rel="alternate" href="https://e.com/p/"/></entry></feed>'
RSS = "<rss><channel><item><title>One</title><link>https://E.com/1/</link></item><item><link>https://e.com/1</link></item></channel></rss>"


def test_discovery(spark):
    maps = spark.createDataFrame([(SITEMAP,)], "xml string")
    assert [r[0] for r in pages.sitemap_urls(maps, exclude=["*.pdf"]).collect()] == ["https://e.com/A"]
    feeds = spark.createDataFrame([(ATOM,), (RSS,), ("not xml",), (None,)], "xml string")
    assert sorted(r.source_url for r in pages.feed_urls(feeds).collect()) == ["https://e.com/1", "https://e.com/p"]
    site = spark.createDataFrame([("https://e.com/a/", '<a href="b#x">1</a><a href="#top"></a><a href="https://o.com/">o</a><a href="mailto:x"></a>')], "url string, html string")
    assert [r.dst for r in pages.crawl_edges(site).collect()] == ["https://e.com/a/b"] and pages.crawl_edges(site, external=True).count() == 2


def test_reach_and_robots(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")], "src string, dst string")
    got = {r.node: (r.depth, r.parent) for r in graph.reach(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b")}
    rules = values(spark, graph.robots_rules, ["User-agent: x\nDisallow: /no\nUser-agent: *\nDisallow: /Tmp/*\nDisallow: /"])[0]
    assert rules == ["/", "/tmp/*"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "sub" / "my-page.md").write_text("no heading")
    (tmp_path / "a.mdx").write_text("x\n# Title here\n")
    (tmp_path / ".hidden" / "c.md").write_text("# C")
    (tmp_path / "d.jsonl").write_text('{"a": 1}\n\n# note\n{"a": 2}\n[broken\n')
    got = {r.source_url.rsplit("/", 1)[-1]: r.title for r in files.folder(spark, str(tmp_path)).collect()}
    assert got == {"my-page.md": "My Page", "a.mdx": "Title here"}
    rows = files.json_lines(spark, str(tmp_path / "d.jsonl"), "a int").collect()
    assert sorted((r.a or 0) for r in rows) == [0, 1, 2] and sum(r._bad is not None for r in rows) == 1
    assert sorted(r.relative_path for r in files.listed(spark, str(tmp_path), include=["*.md*"]).collect()) == ["a.mdx", "sub/my-page.md"]


def test_providers(spark):
    docs = spark.createDataFrame([(1, "text"), (2, ""), (3, None), (4, "text")], "id int, text string")
    rows = {r.id: r for r in providers.embedded(docs).collect()}
    assert rows[1].embedding == rows[4].embedding and len(rows[1].embedding) == 64 and rows[2].status == rows[3].status == "skipped"

    def failing():
        def call(batch):
            raise RuntimeError("down")

        return call

    out = providers.prompted(docs, "Say {text}!", failing).collect()
    assert {(r.id, r.status) for r in out} == {(1, "error"), (2, "error"), (3, "error"), (4, "error")} and next(r for r in out if r.id == 3).error == "Missing fields: text"
    calls = []

    def flaky(batch):
        calls.append(len(calls))
        if len(calls) < 3:
            raise providers.Retryable("429")
        return batch

    pauses = []
    assert providers.attempted(flaky, ["x"], sleep=pauses.append) == (["x"], None) and pauses == [0.5, 1.0]
    known = [{"name": "a", "url_patterns": ["*"]}, {"name": "b", "url_patterns": ["*x.com/*"]}, {"name": "c", "url_patterns": ["*x.com/*"], "source": "project"}]
    assert providers.resolve("https://x.com/1", known) == "c" and providers.resolve("https://y.com", known) == "a" and providers.resolve("https://y.com", known, "d") == "d"


def test_streaming(spark, tmp_path):
    def rows(ids, status="running"):
        return spark.createDataFrame([(i, f"r{i % 2}", "s", None, status, None, None, None, None, None) for i in ids], schema("step_events"))

    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    events.appended(rows(range(10)), src)
    events.copied(events.stream(spark, src), out, check)
    events.appended(rows(range(10, 15)), src)
    events.copied(events.stream(spark, src), out, check)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(15))
    assert [r.id for r in events.after(spark.read.parquet(src), "r1", 3, 2).collect()] == [5, 7]
    with pytest.raises(ValueError):
        events.appended(rows([1]).withColumn("step_id", F.lit("")), src)
    events.appended(rows([20, 21], "completed").union(rows([22], "running")), src)
    q = events.states(events.stream(spark, src)).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.run_id, r.status) for r in spark.table("states").collect()} == {("r0", "completed"), ("r1", "completed")}


TOML = """
[workflow]
name = "demo"
[inputs.least]
type = "float"
default = 0.4
[inputs.n]
type = "int"
required = true
[steps.pick]
type = "sql"
config = { query = "SELECT id, name, score FROM test_data WHERE score >= {{least}} ORDER BY id LIMIT {{n:int}}" }
[steps.double]
type = "function"
function = "double"
depends_on = ["pick"]
[steps.save]
type = "write-db"
depends_on = ["double"]
config = { table = "results", mode = "upsert", key = "id" }
[steps.read]
type = "sql"
depends_on = ["save"]
config = { query = "SELECT id, score FROM results ORDER BY id" }
"""


def test_workflow(spark, tmp_path):
    data = spark.createDataFrame([(1, "item1", 0.5), (2, "item2", 0.8), (3, "item3", 0.3)], "id int, name string, score double")
    before = spark.createDataFrame([(2, "old", 9.0), (7, "kept", 7.0)], "id int, name string, score double")
    out = workflow.run(spark, workflow.parse(TOML), {"n": 5}, {"test_data": data, "results": before}, {"double": lambda df, c: df.withColumn("score", F.col("score") * 2)}, str(tmp_path))
    assert [tuple(r) for r in out["read"].collect()] == [(1, 1.0), (2, 1.6), (7, 7.0)]
    assert {r.row_id: r.write_status for r in out["save"].collect()} == {"1": "inserted", "2": "updated"}
    for bad in (TOML.replace('["pick"]', '["nope"]'), TOML.replace("default = 0.4", 'default = "x"'), TOML + "\n[other]\n", TOML.replace('type = "function"', 'type = "magic"'), TOML.replace("[steps.pick]", '[steps.pick]\ndepends_on = ["read"]')):
        with pytest.raises(workflow.WorkflowError):
            workflow.parse(bad)
    with pytest.raises(workflow.WorkflowError):
        workflow.run(spark, workflow.parse(TOML), {}, {"test_data": data})
    assert workflow.filled({"a": ["{{x}}", "n={{x:string}}", r"\{{x}}"]}, {"x": 3}) == {"a": [3, "n=3", "{{x}}"]}


def test_schemas(spark):
    for name in TABLES:
        assert spark.createDataFrame([], schema(name)).columns


def test_merge_rows(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    ours, theirs = base.where("k <> 1").withColumn("v", F.upper("v")), spark.createDataFrame([(1, "a"), (2, "x"), (3, "C")], "k int, v string")
    got = {r.k: (json.loads(r.row)["v"] if r.row else None, r.conflict) for r in tables.merged(base, ours, theirs, "k").collect()}
    assert got == {1: (None, False), 2: ("B", True), 3: ("C", False)}


def test_packing(spark):
    rnd = random.Random(0)
    df = spark.createDataFrame([([rnd.random() for _ in range(5)],), (None,)], "v array<float>")
    assert [r.s for r in df.select(V.unpacked(V.packed("v")).eqNullSafe(F.col("v")).alias("s")).collect()] == [True, True]


BLOCKS = [
    {"_type": "block", "style": "h2", "children": [{"text": "Head", "marks": []}]},
    {"_type": "block", "children": [{"text": "a ", "marks": ["strong", "em"]}, {"text": "link", "marks": ["l1", "code"]}], "markDefs": [{"_key": "l1", "_type": "link", "href": "https://e.com"}]},
    {"_type": "code", "language": "py", "code": "x = 1"}, {"_type": "image", "_key": "k1", "alt": "pic"}, {"_type": "other"}, {"_type": "block", "style": "blockquote", "children": [{"text": "q"}]},
]


def test_markdown(spark):
    from docloom.functions import markdown

    got = values(spark, markdown.from_blocks, [json.dumps(BLOCKS), "[]", None, "broken"])
    assert got[0] == "## Head\n\n***a ***[`link`](https://e.com)\n\n```py\nx = 1\n```\n\n![pic](sanity-image-k1)\n\n> q" and got[1:] == ["", "", ""]
    assert [tuple(r) for r in values(spark, markdown.front_matter, ["---\na: 1\n---\nbody", "no matter"])] == [("a: 1", "body"), (None, "no matter")]


def test_cms_fields(spark):
    from docloom.sources import cms

    doc = json.dumps({"slug": {"current": "s"}, "tags": ["a", "b"], "author": {"name": "J"}, "cats": [{"title": "x"}, {"other": 1}, {"title": "y"}]})
    want = {"slug.current": "s", "tags[]": '["a","b"]', "title[]": "[]", "author->name": "J", "cats[]->title": '["x","y"]', "none.deep": None}
    for field, value in want.items():
        assert values(spark, lambda c, f=field: cms.field_value(c, f), [doc]) == [value]
    assert values(spark, lambda c: cms.document_url(c, "https://e.com/", F.lit("b"), {"b": "/blog/"}), ["slug"]) == ["https://e.com/blog/slug"]


def test_blocks_round_trip(spark):
    from docloom.functions import blocks, markdown

    text = "# Head\n\none\ntwo\n\n> q\n\n```py\nx = 1\n\ny\n```"
    assert values(spark, lambda c: markdown.from_blocks(blocks.to_blocks(c)), [text]) == ["# Head\n\none two\n\n> q\n\n```py\nx = 1\n\ny\n```"]


def test_content_and_rows(spark, tmp_path):
    from docloom.sinks import content

    docs = spark.createDataFrame([("a/b.md", "text ü"), ("../evil.md", "x"), (None, "y"), ("/", "y"), ("a/..b.md", None), ("a", "a folder")], "path string, content string").coalesce(1)
    got = {(r.path, r.status): r.error for r in content.write_files(docs, f"file://{tmp_path}/out").collect()}
    assert got[("a/b.md", "written")] is None and got[("a/..b.md", "written")] is None and (tmp_path / "out/a/..b.md").read_text() == ""
    assert got[("../evil.md", "error")] == "the path leaves the folder" and got[(None, "error")] == got[("/", "error")] == "no path" and got[("a", "error")]
    assert (tmp_path / "out/a/b.md").read_text() == "text ü" and not (tmp_path / "evil.md").exists()
    rows = spark.createDataFrame([("d1", "weird", "boom", 12, "abc", None, '{"k": "v", "latency_ms": "1"}'), (None, "success", None, 1, "", None, None)], "document_id string, status string, error string, latency_ms int, content string, public_url string, metadata_json string")
    got = content.fetch_rows(rows).collect()
    assert [(r.status, json.loads(r.metadata_json)) for r in got] == [("ERROR", {"k": "v", "latency_ms": "12", "bytes_fetched": "3"})]
    calls = spark.createDataFrame([("m", "p", 3, None, None)], "model string, provider string, input_tokens int, output_tokens int, cost double")
    assert [(r.total_tokens, r.cost) for r in content.trace_rows(calls).collect()] == [(3, 0.0)]
    with pytest.raises(ValueError):
        content.trace_rows(calls.withColumn("model", F.lit("")))


def test_actor_items_and_usage(spark):
    from docloom.sources import actors

    items = spark.createDataFrame([('{"full_text": "Hello\\nworld", "likeCount": [7], "author": {"userName": "jo"}, "createdAt": "2024-01-02T03:04:05Z"}',), ('{"likes": 1}',), ('{"url": "https://e.com", "likes": "x"}',)], "value string")
    got = {r.title: r for r in actors.parsed(items, F.lit("2020-01-01").cast("timestamp")).collect()}
    assert got["Hello"].score == 7 and got["Hello"].author == "jo" and got["Hello"].timestamp.year == 2024 and got["https://e.com"].score == 0 and len(got) == 2
    assert [tuple(r) for r in values(spark, V.usage, ['{"usage": {"total_tokens": 10, "output_tokens": 4}}', '{"usage": {"prompt_tokens": 3}}', "{}"])] == [(6, 4), (3, 0), (0, 0)]
    assert [str(x) for x in values(spark, V.parsed_time, ["2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123456", "no"])] == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04:05.123456", "None"]


def test_repeated_keys_and_versions(spark, tmp_path):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    rows = spark.createDataFrame([(2, "x", 1), (2, "w", 2), (3, "y", 3), (3, None, 4)], "id int, name string, at int")
    for write in (tables.upserted, tables.replaced):
        assert sorted(map(tuple, write(target, rows, ["id"], "at").collect()), key=str) == [(1, "a"), (2, "w"), (3, None)]
        assert sorted(map(tuple, write(target, rows.drop("at"), ["id"]).collect()), key=str) == [(1, "a"), (2, "x"), (3, None)]
    folder = str(tmp_path / "versions")
    for n in range(3):
        tables.commit(target.limit(n), folder)
        assert tables.current(spark, folder).count() == n


def test_network_addresses(spark):
    assert values(spark, U.profile_name, ["https://www.x.com/Jane_1/media/", "https://x.com/jane/other", "https://netflix.com/jane", "https://x.com/Search"]) == ["Jane_1", None, None, None]
    assert values(spark, U.tweet_id, ["https://mobile.twitter.com/a/Status/77/photo/1", "https://x.com/a/status/7x", "https://vox.com/a/status/5"]) == ["77", None, None]
    assert values(spark, U.content_path, ["https://e.com/a//b/", "https://e.com/__/", "https://e.com/%/p.html", "/x"]) == ["e.com/a/b.md", "e.com/index.md", "e.com/p.md", "unknown/x.md"]


PAGE = """<html><head><title> Tea &amp; more </title><meta property="og:description" content="All about &quot;tea&quot;"><meta content='Ann' name='author'>
<script>var x = "<p>no</p>";</script></head><body><nav><a href="/">Home</a></nav><main class="m"><h1>Tea</h1><!-- <p>old</p> --><p>Some  <b>hot</b>
 and <em>iced</em> <a class="k" href="/k">kinds</a>.<ul><li>green</li><li> black</li></ul><table><tr><th>a</th><th>b</th></tr></table><img src="t.png" alt="cup"><pre><code>x &lt; 1</code></pre></main><footer>no</footer></body></html>"""


def test_page_extraction(spark):
    from docloom.functions import html

    rows = spark.createDataFrame([(PAGE,), (None,), ("",), ("<body><script>1</script></body>",), ("plain words",)], "h string").select(html.extracted(F.col("h")).alias("e")).select("e.*").collect()
    assert rows[0].content == "# Tea\n\nSome **hot** and *iced* [kinds](/k).\n\n- green\n- black\n\na | b\n\n![cup](t.png)\n\n`x < 1`"
    assert (rows[0].title, rows[0].description, rows[0].author, rows[0].date) == ("Tea & more", 'All about "tea"', "Ann", None)
    assert [r.content for r in rows[1:]] == [None, None, None, "plain words"]
    found = providers.recorded(spark.createDataFrame([("a",), ("b",), ("c",)], "source_url string"), spark.createDataFrame([("a", PAGE), ("c", "")], "url string, html string"))
    assert {r.source_url: (r.status, r.title) for r in found.collect()} == {"a": ("SUCCESS", "Tea & more"), "b": ("ERROR", None), "c": ("ERROR", None)}


def test_structured_answers(spark):
    rows = spark.createDataFrame([('{"n": 3, "tags": ["x"]}', "success", None), ("none", "success", None), (None, "error", "late")], "llm_response string, status string, error string")
    got = [(r.n, r.tags, r.status) for r in providers.structured(rows, "n int, tags array<string>").collect()]
    assert got == [(3, ["x"], "success"), (None, None, "error"), (None, None, "error")]


def test_sessions_and_follow_ups_of_streams(spark, tmp_path):
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    rows = [(1, "a", "view", 0), (2, "a", "purchase", 10), (3, "a", "view", 39), (4, "a", "purchase", 80), (5, "b", "view", 30), (6, "b", "purchase", 30), (7, "b", "purchase", 60)]
    rows = [(i, r, s, at(m)) for i, r, s, m in rows] + [(8, "z", "view", at(600)), (9, "z", "purchase", at(601))]
    table = spark.createDataFrame(rows, "id bigint, run_id string, status string, t string").selectExpr("id", "run_id", "status", "timestamp(t) AS created_at")
    table.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))

    def drained(df, name):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    seen = lambda df: sorted((r.run_id, str(r.start)[11:16], str(r.end)[11:16], r.n) for r in df.collect())
    batch = seen(events.sessions(table))
    assert batch == [("a", "00:00", "01:09", 3), ("a", "01:20", "01:50", 1), ("b", "00:30", "01:30", 3), ("z", "10:00", "10:31", 2)]
    # The last session stays open until later events move the watermark.
    assert seen(drained(events.sessions(read()), "sessions")) == batch[:-1]
    kinds = lambda df: (df.where("status = 'view'"), df.where("status = 'purchase'"))
    found = events.followed(*kinds(table), within="30 minutes")
    assert sorted(map(tuple, found.collect())) == [("a", 1, 2), ("b", 5, 7), ("z", 8, 9)]
    assert sorted(map(tuple, drained(events.followed(*kinds(read()), within="30 minutes"), "followed").collect())) == [("a", 1, 2), ("b", 5, 7), ("z", 8, 9)]
    slid = events.counts_by_window(table.where("id = 2"), "1 hour", slide="15 minutes")
    assert sorted(str(r.start)[11:16] for r in slid.collect()) == ["00:00", "23:15", "23:30", "23:45"]


def test_progress_of_runs(spark):
    from docloom.operators.analytics import progress

    rows = [
        (1, 1, "a", 1, 9, None), (1, 2, "b", 2, None, '{"current": 5, "total": 8}'), (1, 3, "c", None, 7, '{"current": 6}'),
        (2, 4, "a", 3, 4, None), (2, 5, "b", None, None, "no json"), (3, 6, "a", None, None, None), (None, 7, "z", 1, 2, None),
        *[(4, 100 + k, "late", None, None, None) for k in range(20)], (4, 8, "early", 1, 1, None),
    ]
    events = spark.createDataFrame(rows, "run_id int, id bigint, step_id string, current int, total int, metadata_json string")
    steps = spark.createDataFrame([(2, "fetch", "running", 1), (2, "embed", "running", 2), (2, "write", "pending", 3), (5, "only", "running", 1), (6, "done", "completed", 1)], "run_id int, name string, status string, position int")
    got = {r.run_id: (r.stage, r.current, r.total) for r in progress(events, steps).collect()}
    assert got == {1: ("b", 5, 8), 2: ("embed", 3, 4), 3: (None, 0, 0), None: ("z", 1, 2), 4: (None, 0, 0), 5: ("only", 0, 0), 6: (None, 0, 0)}


def test_table_exists(spark):
    from docloom.operators.sql import table_exists

    spark.range(1).createOrReplaceTempView("there_it_is")
    assert table_exists(spark, "there_it_is") and table_exists(spark, "given", {"given": spark.range(1)})
    assert not table_exists(spark, "not_there") and not table_exists(spark, "a b; --") and not table_exists(spark, "")


def test_sitemaps_expanded(spark):
    from docloom.sources import pages

    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>"
    plain = lambda *names: '<s:urlset xmlns:s="u">' + "".join(f"<s:url><s:loc> {n} </s:loc></s:url>" for n in names) + "</s:urlset>"
    texts = [("r1", index("a", "b", "gone", "r2", "deep")), ("r2", plain("p3", "p3")), ("a", plain("p1", "p2")), ("a", plain("p9")), ("b", "<urlset><url>"), ("deep", index("x")), ("x", plain("never")), ("empty", "<urlset></urlset>"), ("null", None)]
    frame = spark.createDataFrame(texts, "url string, xml string")
    robots = spark.createDataFrame([("User-agent: *\nSitemap: r1\n  SITEMAP:\tr2 \nDisallow: /sitemap: no",), ("Sitemap: empty\r\nsitemap: null\nsitemap: r1",), (None,)], "text string")
    roots = pages.robots_sitemaps(robots)
    assert sorted(r.url for r in roots.collect()) == ["empty", "null", "r1", "r2"]
    got = sorted(map(tuple, pages.sitemaps_expanded(roots, frame).collect()), key=str)
    want = [("a", "p1", None), ("a", "p2", None), ("b", None, "invalid XML"), ("empty", None, "no entries"), ("gone", None, "no text"), ("null", None, "no text"), ("r2", "p3", None), ("r2", "p3", None)]
    assert got == sorted(want, key=str)
    assert [r.source_url for r in pages.sitemap_urls(spark.createDataFrame([("<urlset><url>",), (None,), (plain("https://e.org/p"),)], "xml string")).collect()] == ["https://e.org/p"]
