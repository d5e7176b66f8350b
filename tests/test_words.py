from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import arrow, text as X
from larkspur.operators import news


def test_white_space_is_the_same_in_python():
    assert {chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not f"a{chr(c)}b".split()[1:] == []} == set(X.SPACES)


def test_different_words(spark, monkeypatch):
    monkeypatch.setattr(arrow, "WORDS_HELD", 2)
    rows = [(0, "a b", "b c a d"), (0, "e", None), (None, "f", "")] + [(1, f"w{i % 7}", "x") for i in range(50)]
    table = spark.createDataFrame(rows, "batch int, title string, summary string").coalesce(1)
    found = table.mapInArrow(arrow.different_words(1), "batch int, t string").distinct()
    assert {tuple(r) for r in found.collect()} == {(0, "a"), (0, "b"), (0, "c"), (0, "d"), (None, "f"), (1, "x"), *((1, f"w{i}") for i in range(7))}
    assert "MapInArrow" in news.ordinary_words(table, ["batch"])._jdf.queryExecution().executedPlan().toString()


def test_articles_without_an_opening_word_are_dealt_out(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    rows = spark.range(4000).select("id", F.concat(F.lit("Title "), "id").alias("title"), F.lit("word").alias("summary"), F.lit("x").alias("source"), F.lit("/u/x").alias("author"), now.alias("published_at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        parts = news.with_reasons(rows, now).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for key in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
    assert sum(r["count"] for r in parts) == 4000
    assert max(r["count"] for r in parts) < 2000
