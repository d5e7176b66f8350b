"""Games: derived columns, highlights, history between two teams, and what changed since the last run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X, values as V

_H, _A = "home_score", "away_score"


def state_hash() -> Column:
    """What of a game, if it changes, makes it news again."""
    return F.sha2(F.concat_ws("|", F.col("game_id").cast("string"), "status", F.col(_H).cast("string"), F.col(_A).cast("string")), 256)


def leads() -> Column:
    """The winner's lead after each period; away wins a tie. Empty where the sides' periods don't pair."""
    home = F.col(_H) > F.col(_A)
    pairs = F.zip_with("home_periods", "away_periods", lambda h, a: F.when(home, h - a).otherwise(a - h))
    running = F.transform(pairs, lambda _, i: F.aggregate(F.slice(pairs, F.lit(1), i + 1), F.lit(0), lambda acc, x: acc + x))
    return F.when(F.size("home_periods") == F.size("away_periods"), running).otherwise(F.array().cast("array<int>"))


def with_metrics(games: DataFrame) -> DataFrame:
    run = F.col("_leads")
    some = F.size(run) > 0
    back = F.when(some, F.greatest(F.lit(0), -F.array_min(run))).otherwise(0)
    half = lambda side: F.aggregate(F.slice(side, 3, 100), F.lit(0), lambda acc, x: acc + x)
    later = F.when(F.col(_H) > F.col(_A), half("home_periods") - half("away_periods")).otherwise(half("away_periods") - half("home_periods"))
    return (
        games.withColumn("_leads", leads())
        .withColumns(
            {
                "margin": F.abs(F.col(_H) - F.col(_A)),
                "total_points": F.col(_H) + F.col(_A),
                "went_to_overtime": F.col("period") > 4,
                "largest_deficit_overcome": back,
                "largest_lead_lost": back,  # the same, as the other side sees it
                "led_wire_to_wire": some & F.forall(run, lambda x: x > 0),
                "biggest_period": F.coalesce(F.array_max(F.concat("home_periods", "away_periods")), F.lit(0)),
                "second_half_swing": F.when((F.size("home_periods") < 4) | (F.size("away_periods") < 4), 0).otherwise(later),
            }
        )
        .drop("_leads")
    )


def fresh_games(games: DataFrame, seen: DataFrame) -> DataFrame:
    """Games whose state was not delivered yet."""
    return games.withColumn("state_hash", state_hash()).join(seen.select("state_hash"), "state_hash", "left_anti")


def qualifies(category: str) -> Column:
    """Whether a game's own numbers are enough for a category."""
    margin = F.col("margin")
    return {
        "comeback": F.col("largest_deficit_overcome") >= V.COMEBACK,
        "overtime": F.col("went_to_overtime"),
        "wire_to_wire": F.col("led_wire_to_wire") & (margin > V.CLOSE) & (margin < V.BLOWOUT),
        "second_half_takeover": F.col("second_half_swing") >= V.SWING,
        "closest_finish": margin <= V.CLOSE,
        "biggest_period": F.col("biggest_period") >= V.BIG_PERIOD,
        "largest_margin": margin >= V.BLOWOUT,
        "highest_scoring": F.col("total_points") >= V.HIGH_TOTAL,
    }[category]


#: Categories that only the most extreme game gets: what is measured, and 1 for the least, -1 for the most.
EXTREME = {"closest_finish": ("margin", 1), "biggest_period": ("biggest_period", -1), "largest_margin": ("margin", -1), "highest_scoring": ("total_points", -1)}


def notable_games(games: DataFrame, batch: list[str]) -> DataFrame:
    """Highlights of each batch: a game counts once, under the first category that takes it; of equal extremes the first in order is taken.

    Categories follow one another as window minima over the games not taken yet. All windows share one partitioning, and the
    minima take no order, so it is one shuffle and no join.
    """
    rows = with_metrics(games).withColumn("category", F.lit(None).cast("string"))
    over = Window.partitionBy(*batch)
    for name in V.CATEGORIES:
        free = F.col("category").isNull()
        takes = free & qualifies(name)
        if name in EXTREME:
            measure, sign = EXTREME[name]
            key = F.when(free, F.struct((F.col(measure) * sign).alias("m"), F.col("pos").alias("p")))
            takes = takes & (key == F.min(key).over(over))
        rows = rows.withColumn("category", F.when(takes, name).otherwise(F.col("category")))
    return rows.where("category IS NOT NULL").withColumn("category_pos", F.array_position(X.literals(V.CATEGORIES), F.col("category")).cast("int"))


def head_to_head(games: DataFrame, results: DataFrame, season_bounded: bool = False) -> DataFrame:
    """Earlier results between the same two teams, whichever was at home: (game_id, home_wins, away_wins, meetings); games without any aren't there.

    A tied result counts for the team that was away then; a game's own result doesn't count for it. Results are summed by pair and day first, so the running
    sums go over days, not meetings, and no result meets another; `season_bounded` starts them anew with each season.
    """
    first, second = F.least("home_team", "away_team"), F.greatest("home_team", "away_team")
    pair = F.struct(first.alias("first"), second.alias("second"))
    keys = ["pair", "season"] if season_bounded else ["pair"]
    won = F.when(F.col("home_score") > F.col("away_score"), F.col("home_team")).otherwise(F.col("away_team"))
    then = results.select("game_id", pair.alias("pair"), F.col("played_on").alias("day"), X.season(F.col("played_on")).alias("season"), (won == first).cast("long").alias("won"))
    now = games.select("game_id", (F.col("home_team") == first).alias("home_first"), pair.alias("pair"), F.to_date("start_time").alias("day")).withColumn("season", X.season(F.col("day")))
    daily = then.groupBy(*keys, "day").agg(F.count("*").alias("n"), F.sum("won").alias("won"))
    asked = now.select(*keys, "day", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("won")).distinct()
    days = daily.unionByName(asked).groupBy(*keys, "day").agg(F.sum("n").alias("n"), F.sum("won").alias("won"))
    before = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    sums = days.select(*keys, "day", F.sum("n").over(before).alias("n"), F.sum("won").over(before).alias("won")).where("n > 0")
    own = then.select("game_id", *keys, F.col("day").alias("own_day"), F.col("won").alias("own_won"))
    own = now.join(own, ["game_id", *keys]).where("own_day < day").groupBy("game_id").agg(F.count("*").alias("own_n"), F.sum("own_won").alias("own_won"))
    met = now.join(sums, [*keys, "day"]).join(own, "game_id", "left")
    n, wins = F.col("n") - F.coalesce("own_n", F.lit(0)), F.col("won") - F.coalesce("own_won", F.lit(0))
    home = F.when(F.col("home_first"), wins).otherwise(n - wins)
    away = F.when(F.col("pair.first") == F.col("pair.second"), wins).otherwise(n - home)
    return met.select("game_id", home.alias("home_wins"), away.alias("away_wins"), n.alias("meetings")).where("meetings > 0")


def series_context(games: DataFrame, results: DataFrame, season_bounded: bool = False) -> DataFrame:
    """For each game with earlier meetings: which meeting it is, and each side's earlier wins."""
    h2h = head_to_head(games, results, season_bounded)
    return games.join(h2h, "game_id").select("game_id", (F.col("meetings") + 1).alias("meeting_number"), F.col("home_wins").alias("home_team_prior_wins"), F.col("away_wins").alias("away_team_prior_wins"), (F.col("meetings") + 1 <= 1).alias("is_first_meeting"))


def results_of(games: DataFrame) -> DataFrame:
    """Rows for the results history: final games only, on the UTC date of their start."""
    return games.where(X.is_final(F.col("status"))).select("game_id", F.to_date("start_time").alias("played_on"), "home_team", "away_team", "home_score", "away_score", "status")


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the last by `order` of each key: one aggregation, no join."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in (key, order)]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"), F.max(order).alias(order))
    return last.select(key, "_last.*", order)
