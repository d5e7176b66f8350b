"""Near-duplicate titles: the pass in order against its definition, with repeats, long titles and several batches; let and unused."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import games as G, news, stories
from larkspur.sources import tables as T


def by_definition(rows: list[tuple[int, str]], threshold: float = 0.85) -> list[int]:
    kept: list[tuple[int, str]] = []
    for pos, title in rows:
        shown = " ".join(title.lower().split())
        if all(difflib.SequenceMatcher(None, shown, old).ratio() < threshold for _, old in kept):
            kept.append((pos, shown))
    return [pos for pos, _ in kept]


def table(spark, titles, batch=None):
    rows = [(f"x:{i}", i, t, (batch or [0] * len(titles))[i]) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "article_id string, pos long, title string, batch int")


def kept_of(spark, titles, **how):
    rows = table(spark, titles)
    return sorted(r.pos for r in news.deduplicated(rows, rows.where("false"), **how).collect())


def test_a_repeat_of_a_dropped_title_is_dropped(spark):
    titles = ["star signs a two year deal", "star signs a two year deals!", "Star  signs a two year deals!", "other news"]
    assert kept_of(spark, titles) == by_definition(list(enumerate(titles))) == [0, 3]


@pytest.mark.parametrize("seed", range(2))
def test_the_pass_in_order(spark, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    titles = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 8, 12, 45, 90]))) for _ in range(40)]
    for _ in range(120):
        t = rnd.choice(titles)
        for _ in range(rnd.choice([0, 0, 1, 2, 6, 20])):
            i = rnd.randrange(len(t) + 1)
            t = t[:i] + rnd.choice(["", " ", "a", "xy"]) + t[i + rnd.choice([0, 1, 2]) :]
        titles.append(rnd.choice([t, t.upper()]))
    rnd.shuffle(titles)
    titles += ["", " ", "a"]
    assert max(map(len, titles)) > 200
    assert kept_of(spark, titles) == by_definition(list(enumerate(titles)))


def test_blocks_of_titles_lose_nothing(spark, monkeypatch):
    rnd = random.Random(9)
    base = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randint(3, 9))) for _ in range(60)]
    titles = [t + rnd.choice(["", "!", " now"]) for t in base for _ in range(2)]
    want = {(r.early, r.late, r.ratio) for r in news.similar_titles(table(spark, titles)).collect()}
    monkeypatch.setattr(news, "NEAR_BLOCK", 7)
    monkeypatch.setattr(news, "FAR_BLOCK", 11)
    assert {(r.early, r.late, r.ratio) for r in news.similar_titles(table(spark, titles)).collect()} == want and want


def test_batches_stand_alone(spark):
    titles = ["one title here", "one title here", "one title hers", "one title here"]
    rows = table(spark, titles, [0, 1, 1, 0])
    assert sorted(r.pos for r in news.deduplicated(rows, rows.where("false"), batch=["batch"]).collect()) == [0, 1]


def test_ordinary_words_are_those_of_the_batch(spark):
    rows = [(0, "Trade talk", "", 0), (1, "all trade here", "", 1), (2, "Trade talk", "", 1)]
    articles = spark.createDataFrame([(f"x:{p}", p, t, s, b, "r/nba", None) for p, t, s, b in rows], "article_id string, pos long, title string, summary string, batch int, source string, author string").withColumns({"published_at": F.current_timestamp(), "rule": F.lit(1), "word": F.lit(2), "opens": F.lit(3)})
    reasons = {r.pos: r.reason for r in news.with_reasons(articles, F.current_timestamp(), batch=["batch"]).collect()}
    assert reasons[0] is None and reasons[2].startswith("community opinion")
    assert {"rule", "word", "opens"} <= set(news.with_reasons(articles, F.current_timestamp(), batch=["batch"]).columns)


def test_tonight_is_that_of_the_batch(spark):
    articles = spark.createDataFrame([("x:0", 0, "hawks win", "", 0), ("x:1", 1, "hawks win", "", 1)], "article_id string, pos long, title string, summary string, batch int")
    games = spark.createDataFrame([("Big Hawks", "Old Bulls", 1)], "home_team string, away_team string, batch int")
    assert {r.pos: r.tonight for r in news.ranked(articles, games, batch=["batch"]).collect()} == {0: False, 1: True}


def test_head_to_head_by_running_sums(spark):
    rnd = random.Random(1)
    teams = ["A", "B", "C"]
    rows = []
    for i in range(300):
        home, away = rnd.sample(teams, 2)
        rows.append((i, f"2025-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d} 20:00:00", rnd.choice(["Final", "Scheduled"]), home, away, rnd.randint(90, 95), rnd.randint(90, 95)))
    games = spark.createDataFrame(rows, "game_id long, at string, status string, home_team string, away_team string, home_score int, away_score int").withColumn("start_time", F.col("at").cast("timestamp"))
    results = G.results_of(games)
    results = results.unionByName(results.where("game_id % 7 = 0").withColumn("played_on", F.date_sub("played_on", 5)).where("game_id % 2 = 0"))  # an own result of an earlier day
    held = results.collect()
    season = lambda d: d.year - (d.month < 10)
    for bounded in (False, True):
        want = {}
        for g in games.collect():
            day = g.start_time.date()
            met = [r for r in held if {r.home_team, r.away_team} == {g.home_team, g.away_team} and r.played_on < day and r.game_id != g.game_id and (not bounded or season(r.played_on) == season(day))]
            won = [r.home_team if r.home_score > r.away_score else r.away_team for r in met]
            if met:
                want[g.game_id] = (won.count(g.home_team), won.count(g.away_team), len(met))
        assert {r.game_id: (r.home_wins, r.away_wins, r.meetings) for r in G.head_to_head(games, results, bounded).collect()} == want


def test_dropped_by_source(spark):
    leads = spark.createDataFrame([(0, i, "a" if i < 5 else "b") for i in range(8)], "batch int, story_pos int, source string")
    assert {(r.source, r.dropped) for r in stories.dropped_by_source(leads, ["batch"], {"a": 2, "b": 0}).collect()} == {("a", 3)}


def test_let_and_unused(spark):
    row = spark.range(3).select(X.let(F.col("id") + 1, lambda x: x * x).alias("n")).collect()
    assert [r.n for r in row] == [1, 4, 9]
    assert X.unused(["Place"], "place", "cap") == ["place_", "cap"]


def test_small_scans_are_spread_and_others_are_not(spark):
    cores = spark.sparkContext.defaultParallelism
    assert T.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    many = spark.range(10, numPartitions=cores + 1)
    assert T.spread(many) is many
