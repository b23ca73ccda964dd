from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, **more):
    """``rows`` of (doc_id, text[, source]) as documents; ``more`` adds constant columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


#: Names that the operators use inside.
CLASHING = dict(row=1, h=2, fp=3, key=4, bucket=5, size=6, b=7, at=8, blob="x", hash=9, id=10, t="y", _id=11, _row=12, _copies=13, _gone=14, target=15, n_lines=16, n_removed=17, kept="z", node=18, s=19, token=20)
