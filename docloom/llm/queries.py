"""The queries of the corpus operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import clustered
from .common import table
from .decontaminate import leaks
from .jaccardjoin import jaccard_groups
from .licenses import NOTICES, license_scan
from .linededup import boilerplate_removed
from .maxscore import ranked
from .mixing import mixed
from .quality import selected
from .secrets import secret_scan
from .simhash import simhash_groups
from .spotsigs import edited_likeness, spot_groups
from .substrings import repeats_removed
from .tokenfiles import token_files


def vocabulary() -> str:
    """The tokenizer file of the token queries: the same path on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, weight)`` for the mix, from the ratings: good 2, poor 0.5, toxic 0.25; the unrated have none."""
    weight = F.when(F.col("toxic") > 0, 0.25).when(F.col("quality") > 0, 2.0).when(F.col("quality") <= 0, 0.5)
    return table(spark, sf_dir, "labels").select("doc_id", weight.alias("weight"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"), vocabulary())


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def spot_signature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus-wide part of operator 2: classes of documents at a likeness of 0.8."""
    return spot_groups(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boilerplate_removed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_removed").cast("bigint").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_quality_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return selected(docs, table(spark, sf_dir, "labels")).drop("text")


def op7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("blob")


def op9_repeats_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op11_vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def op12_benchmark_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_spotsigs": op2_spotsigs,
    "op3_license_scan": op3_license_scan,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_line_spread": op5_line_spread,
    "op6_quality_selection": op6_quality_selection,
    "op7_weighted_mix": op7_weighted_mix,
    "op8_secret_scan": op8_secret_scan,
    "op9_repeats_removed": op9_repeats_removed,
    "op10_simhash_groups": op10_simhash_groups,
    "op11_vector_clusters": op11_vector_clusters,
    "op12_benchmark_search": op12_benchmark_search,
    "op13_jaccard_groups": op13_jaccard_groups,
    "spot_signature_groups": spot_signature_groups,
}

_OP3 = r"""
WITH notices(n, license, notice) AS (VALUES %s),
t AS (
  SELECT 'k' AS kind, n AS rid, NULL::BIGINT AS doc_id, 0 AS way, replace(notice, '{}', chr(2)) AS text FROM notices
  UNION ALL SELECT 'd', d.rid, d.doc_id, ways.way, d.text FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents) d CROSS JOIN (VALUES (0), (1)) ways(way)
), m AS (
  SELECT kind, rid, doc_id, way, regexp_replace(regexp_replace(lower(text), '[.]([ \t\r\n]+[^a-z0-9 \t\r\n]*(?:nor|be|may|shall|disclaims|as is)[^a-z0-9])', '\1', 'g'), '[.;:!?]+(?:[ \t\r\n]+|\z)|\n[ \t\r]*\n' || CASE way WHEN 1 THEN '|\n' ELSE '' END, chr(1), 'g') AS text FROM t
), c AS (
  SELECT kind, rid, doc_id, way, string_split(regexp_replace(text, '[^a-z0-9\x01\x02]+', ' ', 'g'), chr(1)) AS parts FROM m
), s AS (
  SELECT kind, rid, doc_id, way, pos, sentence FROM (SELECT *, unnest(list_transform(parts, lambda x: trim(x))) AS sentence, generate_subscripts(parts, 1) AS pos FROM c) WHERE sentence <> ''
), k AS (SELECT rid AS n, row_number() OVER (PARTITION BY rid ORDER BY pos) - 1 AS pos, sentence FROM s WHERE kind = 'k'
), ids AS (SELECT sentence, arg_min('n' || n || 's' || pos, n * 1000 + pos) AS id FROM k GROUP BY sentence
), rules AS (SELECT n, list(id ORDER BY pos) AS ids FROM k JOIN ids USING (sentence) GROUP BY n
), stops AS (
  SELECT a.n, flatten(list(list_filter(b.ids, lambda x: NOT list_contains(a.ids, x)) || list_transform(list_filter(b.ids, lambda x: NOT list_contains(a.ids, x)), lambda x: x || 'x'))) AS stops FROM rules a JOIN rules b
    ON len(b.ids) > len(a.ids) AND regexp_matches(' ' || array_to_string(b.ids, ' ') || ' ', ' ' || array_to_string(a.ids, ' (?:.* )?') || ' ') GROUP BY a.n
), w AS (
  SELECT s.rid, s.doc_id, s.way, s.pos, i.id FROM s JOIN ids i ON s.sentence = i.sentence WHERE s.kind = 'd'
  UNION ALL SELECT s.rid, s.doc_id, s.way, s.pos, CASE WHEN regexp_full_match(s.sentence, replace(i.sentence, chr(2), '[a-z0-9].*')) THEN i.id ELSE i.id || 'x' END FROM s JOIN ids i ON contains(i.sentence, chr(2)) AND starts_with(s.sentence, string_split(i.sentence, chr(2))[1])
    WHERE s.kind = 'd' AND (regexp_full_match(s.sentence, replace(i.sentence, chr(2), '[a-z0-9].*')) OR len(string_split(string_split(i.sentence, chr(2))[1], ' ')) > 3)
), f AS (SELECT rid, doc_id, way, list(id ORDER BY pos) AS ids FROM w GROUP BY rid, doc_id, way
), l AS (
  SELECT f.rid, f.doc_id, o.license, array_to_string(f.ids, ' ') AS sentences FROM f CROSS JOIN rules r JOIN notices o ON o.n = r.n LEFT JOIN stops p ON p.n = r.n
  WHERE regexp_matches(array_to_string(list_transform(f.ids, lambda x: CASE WHEN list_contains(p.stops, x) THEN '#' ELSE x END), ' '), '(?:^| )' || array_to_string(r.ids, '(?: [a-z0-9]+)* ') || '(?: [a-z0-9]|$)')
)
SELECT doc_id, license, max(sentences) AS sentences FROM l GROUP BY rid, doc_id, license
""" % ", ".join("({}, '{}', '{}')".format(n, name, text.replace("'", "''")) for n, (name, text) in enumerate(NOTICES))

_OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT rid, coalesce('=' || source, '') AS site, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
w AS (SELECT trim(l.line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l WHERE trim(l.line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 10),
g AS (SELECT rid, count(*) AS n FROM l JOIN w ON trim(l.line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = w.line GROUP BY rid),
k AS (SELECT rid, string_agg(l.line, chr(10) ORDER BY pos) AS kept FROM l LEFT JOIN w ON trim(l.line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = w.line WHERE w.line IS NULL GROUP BY rid)
SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (rid) LEFT JOIN k USING (rid)
"""

_OP7 = r"""
WITH rated AS (
  SELECT doc_id, max(CASE WHEN toxic > 0 THEN 0.25 WHEN quality > 0 THEN 2.0 WHEN quality <= 0 THEN 0.5 END)::DOUBLE AS weight FROM labels GROUP BY doc_id
), r AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|' || md5(coalesce(d.text, '')) || '|20240'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
      / CASE WHEN w.weight > 0 THEN w.weight ELSE 1.0 END AS key
  FROM documents d LEFT JOIN rated w USING (doc_id)
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3.0::DOUBLE * sum(size)::BIGINT AS cap
  FROM r GROUP BY source
), f AS (
  SELECT *, ((SELECT sum(source_size) FROM per) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per
), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT level FROM f WHERE cap > level * w ORDER BY cap / w, source NULLS LAST LIMIT 1) * w), cap) AS target FROM f
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), o AS (
  SELECT r.*, p.source_size, p.target, p.epochs, round(p.target - p.epochs * p.source_size)::BIGINT AS rest,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM o
"""


_OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT rid, doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM d WHERE len(words) >= 50 AND doc_id IS NOT NULL
), h AS (
  SELECT rid, doc_id, pos, array_to_string(words[pos:pos + 49], ' ') AS win FROM w
), o AS (
  SELECT win, min(doc_id) AS lo FROM h GROUP BY win HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT rid, unnest(range(pos, pos + 50)) AS pos FROM h JOIN o USING (win) WHERE doc_id > lo
), g AS (
  SELECT rid, list(pos) AS gone FROM c GROUP BY rid
), k AS (
  SELECT d.doc_id, d.words, g.gone, list_filter(list_transform(range(1, len(d.words) + 1), lambda i: CASE WHEN g.gone IS NULL OR NOT list_contains(g.gone, i) THEN d.words[i] END), lambda x: x IS NOT NULL) AS kept
  FROM d LEFT JOIN g USING (rid)
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""



def _op11(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds written out one after the other."""
    nearest = """a%d AS MATERIALIZED (
  SELECT rid, vec_id, q, c, d FROM (
    SELECT v.rid, v.vec_id, v.q, m.c, list_sum(list_transform(list_zip(v.q, m.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN c%d m
  ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1
)"""
    moved = """c%d AS MATERIALIZED (
  WITH sums AS (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS p FROM a%d) GROUP BY c, p),
  means AS (SELECT c, list(((s - ((s %% n) + n) %% n) // n)::BIGINT ORDER BY p) AS q FROM sums GROUP BY c)
  SELECT o.c, coalesce(means.q, o.q) AS q FROM c%d o LEFT JOIN means USING (c)
)"""
    steps = [nearest % (0, 0)]
    for r in range(1, rounds + 1):
        steps += [moved % (r, r - 1, r - 1), nearest % (r, r)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v ORDER BY h, q LIMIT {k})
), {", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} m USING (c)
"""


_OP12 = r"""
WITH low AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT rid, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM low),
s AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY rid, term),
q AS (
  SELECT iid, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT row_number() OVER () AS iid, * FROM benchmark)
), w AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN s GROUP BY term),
m AS (SELECT rid, doc_id, 100 - 50 + (50 * len(terms) * s.n) // s.l AS m FROM d CROSS JOIN s WHERE len(terms) > 0),
f AS (
  SELECT iid, item_id, m.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY iid, item_id, rid, m.doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM f WHERE score > 0) WHERE rank <= 50
"""

_OP13 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT rid, unnest(list_distinct(CASE WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END)) AS gram
  FROM d WHERE len(words) > 0
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid
), o AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.gram = b.gram AND a.rid <> b.rid GROUP BY 1, 2
), l AS (SELECT a, b FROM o JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), r(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id FROM d JOIN r USING (rid) JOIN d e ON e.rid = r.other LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": _OP3,
    "op5_line_spread": _OP5,
    "op7_weighted_mix": _OP7,
    "op9_repeats_removed": _OP9,
    "op11_vector_clusters": _op11(),
    "op12_benchmark_search": _OP12,
    "op13_jaccard_groups": _OP13,
}
