from __future__ import annotations

import json

import pytest

from larkspur.operators import games as G, render
from larkspur.schemas import GAME, GAME_RESULTS
from larkspur.sources import games as source

SLATE = [
    (18447392, "2026-01-15T19:00", "Memphis Grizzlies", 111, "Orlando Magic", 118, [23, 35, 26, 34], [39, 28, 12, 32]),
    (18447393, "2026-01-16T00:00", "Phoenix Suns", 105, "Detroit Pistons", 108, [23, 33, 33, 19], [32, 31, 27, 15]),
    (18447394, "2026-01-16T00:30", "Boston Celtics", 119, "Miami Heat", 114, [36, 28, 29, 21], [25, 29, 29, 36]),
    (18447395, "2026-01-16T00:30", "Oklahoma City Thunder", 111, "Houston Rockets", 91, [19, 29, 27, 16], [21, 34, 22, 34]),
    (18447396, "2026-01-16T01:00", "Milwaukee Bucks", 101, "San Antonio Spurs", 119, [31, 35, 40, 13], [27, 26, 16, 32]),
    (18447397, "2026-01-16T01:30", "Utah Jazz", 122, "Dallas Mavericks", 144, [35, 35, 42, 32], [24, 26, 29, 43]),
    (18447398, "2026-01-16T03:00", "New York Knicks", 113, "Golden State Warriors", 126, [30, 32, 37, 27], [35, 24, 28, 26]),
    (18447399, "2026-01-16T03:00", "Atlanta Hawks", 101, "Portland Trail Blazers", 117, [33, 21, 34, 29], [25, 31, 31, 14]),
    (18447400, "2026-01-16T03:30", "Charlotte Hornets", 135, "Los Angeles Lakers", 117, [39, 16, 38, 24], [30, 34, 40, 31]),
]


def frame(spark, rows):
    made = [(i, None, status, home, away, hs, as_, period, hp, ap, pos) for pos, (i, status, home, away, hs, as_, period, hp, ap) in enumerate(rows)]
    return spark.createDataFrame(made, GAME)


@pytest.fixture(scope="module")
def slate(spark):
    return frame(spark, [(i, "Final", home, away, hs, as_, 4, hp, ap) for i, _, away, as_, home, hs, hp, ap in SLATE])


def test_metrics(slate):
    got = {r.game_id: (r.margin, r.total_points, r.largest_deficit_overcome, r.led_wire_to_wire, r.biggest_period, r.second_half_swing) for r in G.with_metrics(slate).collect()}
    assert list(got.values()) == [(7, 229, 16, False, 39, 16), (3, 213, 9, False, 33, 10), (5, 233, 11, False, 36, 15), (20, 202, 0, True, 34, 13), (18, 220, 0, True, 40, 5), (22, 266, 0, True, 43, 2), (13, 239, 5, False, 37, 10), (16, 218, 2, False, 34, 18), (18, 252, 9, False, 40, 9)]


def test_highlights_of_the_slate(slate):
    rows = G.notable_games(slate, []).orderBy("category_pos", "pos").collect()
    assert [(r.category, r.game_id) for r in rows] == [("comeback", 18447392), ("closest_finish", 18447393), ("wire_to_wire", 18447396), ("biggest_period", 18447397), ("largest_margin", 18447395), ("highest_scoring", 18447400)]


def test_highlight_message(slate):
    text = render.highlights(G.notable_games(slate, []).selectExpr("*", "0 AS batch"), ["batch"]).first().text
    assert text.startswith("📊 NOTABLE\n\nComeback — Orlando Magic came back from 16 down\n   Memphis Grizzlies 111 @ Orlando Magic 118\n\nClose finish — decided by 3\n")
    assert text.endswith("High scoring — 252 combined points\n   Charlotte Hornets 135 @ Los Angeles Lakers 117")


def test_games_without_periods_or_with_ties(spark):
    rows = G.with_metrics(frame(spark, [(1, "Scheduled", "A", "B", 0, 0, 0, [], []), (2, "Final", "A", "B", 10, 12, 6, [1, 2], [3])])).orderBy("game_id").collect()
    assert [(r.largest_deficit_overcome, r.led_wire_to_wire, r.biggest_period, r.second_half_swing, r.went_to_overtime) for r in rows] == [(0, False, 0, 0, False), (0, False, 3, 0, True)]


def test_a_game_is_fresh_once_its_state_changes(spark):
    game = lambda score: frame(spark, [(1, "Final", "A", "B", score, 0, 4, [], [])])
    seen = game(1).select(G.state_hash().alias("state_hash"))
    assert G.fresh_games(game(1), seen).count() == 0 and G.fresh_games(game(2), seen).count() == 1


def test_history_takes_either_side_and_earlier_days_only(spark):
    games = spark.sql("SELECT 9L game_id, timestamp'2026-01-16 03:00:00' start_time, 'A' home_team, 'B' away_team")
    results = spark.sql("SELECT * FROM VALUES (1L, date'2026-01-01', 'A', 'B', 10, 5, 'Final'), (2L, date'2026-01-02', 'B', 'A', 10, 5, 'Final'), (3L, date'2025-09-30', 'B', 'A', 4, 4, 'Final/OT'), (4L, date'2026-01-16', 'A', 'B', 9, 1, 'Final'), (9L, date'2026-01-01', 'A', 'B', 9, 1, 'Final'), (5L, date'2026-01-03', 'A', 'C', 9, 1, 'Final') AS t(game_id, played_on, home_team, away_team, home_score, away_score, status)")
    assert [tuple(r) for r in G.head_to_head(games, results).collect()] == [(9, 2, 1, 3)]
    assert [tuple(r) for r in G.head_to_head(games, results, season_bounded=True).collect()] == [(9, 1, 1, 2)]
    context = G.series_context(games, results)
    note = games.selectExpr("*", "1 home_score").join(context, "game_id").select(render.series_note().alias("n")).first().n
    assert note == "4th meeting — A led 2-1"


def test_upsert_takes_the_last(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, v string, seq long"), spark.createDataFrame([(1, "c", 3)], "k long, v string, seq long")
    assert sorted(map(tuple, G.upserted(old, new, "k", "seq").collect())) == [(1, "c", 3), (2, "b", 2)]


def test_payload(spark):
    team = lambda n, i: {"id": i, "full_name": n}
    game = {"id": 1, "date": "2026-01-15", "datetime": "2026-01-16T00:00:00Z", "status": "Final", "period": 5, "home_team_score": 100, "visitor_team_score": 98, "home_team": team("H", 1), "visitor_team": team("V", 2), "home_q1": 25, "home_q2": None, "home_q3": 20, "home_q4": 30, "home_ot1": 5, "home_ot2": None, "home_ot3": 9, "visitor_q1": 1}
    bare = {"id": 2, "date": "2026-01-15", "home_team": team("", None), "visitor_team": team("V", 2)}
    payload = {"data": [game, bare, {"id": None, "date": "2026-01-15", "home_team": team("H", 1), "visitor_team": team("V", 2)}, {"id": 3, "home_team": team("H", 1), "visitor_team": team("V", 2)}, {"id": 4, "date": "2026-01-15", "home_team": None, "visitor_team": team("V", 2)}]}
    texts = spark.createDataFrame([(json.dumps(payload),)], "json string")
    one, two = source.parse_games(texts).orderBy("pos").collect()
    assert (one.game_id, str(one.start_time), one.home_periods, one.away_periods, one.away_score) == (1, "2026-01-16 00:00:00", [25, 20, 30, 5], [1], 98)
    assert (two.game_id, two.home_team, two.status, two.home_score, two.period, two.home_periods) == (2, "Unknown", "Unknown", 0, 0, [])
    assert [tuple(r) for r in source.team_ids(texts).collect()] == [(1, 1, 2), (3, 1, 2)]


def test_results_schema(slate, spark):
    assert G.results_of(slate.withColumn("start_time", slate["start_time"])).schema.simpleString() == spark.createDataFrame([], GAME_RESULTS).schema.simpleString()
