"""Titles that are one run of thousands of names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur.operators import stories
from larkspur.plans import brief

RUN = " ".join(["Alpha"] * 20_000)


@pytest.fixture(scope="module")
def articles(spark):
    titles = [RUN, f"{RUN} and Beta Gamma", "Beta Gamma and Delta", RUN + " and Delta"]
    return spark.createDataFrame([(0, i, t, f"s{i}") for i, t in enumerate(titles)], "batch int, pos long, title string, source string")


def test_counts(articles):
    assert {(r.name, r.df) for r in stories.name_counts(articles, ["batch"]).collect()} == {(RUN, 3), ("Beta Gamma", 2), ("Delta", 2)}


def test_rare(articles):
    rare = stories.rare_names(articles, ["batch"], share=0.0, floor=2)
    assert {(r.pos, r.name) for r in rare.collect()} == {(1, "Beta Gamma"), (2, "Beta Gamma"), (2, "Delta"), (3, "Delta")}


def test_pairs(articles):
    assert {(r.early, r.late, r.shared) for r in stories.story_pairs(articles, ["batch"], shared=1).collect()} == {(0, 1, 1), (0, 3, 1), (1, 2, 1), (1, 3, 1), (2, 3, 1)}


def test_groups(articles):
    assert [(r.pos, r.story_pos) for r in stories.story_groups(articles, ["batch"], shared=1).orderBy("pos").collect()] == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_chain(articles):
    rows = stories.build_stories(articles, ["batch"], shared=2).orderBy("chain_pos").collect()
    assert [(r.pos, r.chain_pos) for r in rows] == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_brief(spark, articles):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    rows = articles.select("*", F.col("pos").cast("string").alias("article_id"), F.lit("").alias("summary"), now.alias("published_at"), F.lit("/u/x").alias("author"))
    games = spark.createDataFrame([], "batch int, home_team string, away_team string")
    _, told = brief.news_of(rows, games, rows.where("false").select("article_id"), now, ["batch"])
    assert {r.pos for r in told.collect()} == {1, 2}
