"""Game results: one day's JSON payload, a row a game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import PERIODS, RAW_GAMES


def _periods(side: str) -> Column:
    """Quarters that are there, then overtimes up to the first that is not."""
    quarters = F.filter(F.array(*(F.col(f"g.{side}_{p}") for p in PERIODS[:4])), lambda x: x.isNotNull())
    extra = F.array(*(F.col(f"g.{side}_{p}") for p in PERIODS[4:]))
    missing = F.array_position(F.transform(extra, lambda x: x.isNull()), F.lit(True))
    return F.concat(quarters, F.slice(extra, F.lit(1), F.when(missing > 0, missing.cast("int") - 1).otherwise(F.size(extra))))


def _or(name: str, default) -> Column:
    """The value, or the default where it is null, empty or zero."""
    column = F.col(name)
    return F.coalesce(F.nullif(column, F.lit("" if isinstance(default, str) else 0)), F.lit(default))


def parse_games(payloads: DataFrame, column: str = "json") -> DataFrame:
    """Games of payload texts. Games without an id, a team or a date are left out; what else is missing has a default."""
    rows = payloads.select(F.posexplode(F.from_json(F.col(column), RAW_GAMES)["data"]).alias("pos", "g"))
    start = F.try_to_timestamp(F.coalesce(F.nullif(F.col("g.datetime"), F.lit("")), F.nullif(F.col("g.date"), F.lit(""))))
    games = rows.where("g.id IS NOT NULL AND g.home_team IS NOT NULL AND g.visitor_team IS NOT NULL").select(
        F.col("g.id").alias("game_id"), start.alias("start_time"), _or("g.status", "Unknown").alias("status"), _or("g.home_team.full_name", "Unknown").alias("home_team"), _or("g.visitor_team.full_name", "Unknown").alias("away_team"),
        _or("g.home_team_score", 0).alias("home_score"), _or("g.visitor_team_score", 0).alias("away_score"), _or("g.period", 0).alias("period"), _periods("home").alias("home_periods"), _periods("visitor").alias("away_periods"), F.col("pos").cast("long").alias("pos"),
    )
    return games.where("start_time IS NOT NULL")


def team_ids(payloads: DataFrame, column: str = "json") -> DataFrame:
    """Ids of the game and its teams, where all three are known."""
    rows = payloads.select(F.explode(F.from_json(F.col(column), RAW_GAMES)["data"]).alias("g"))
    ids = rows.select(F.col("g.id").alias("game_id"), F.col("g.home_team.id").alias("home_id"), F.col("g.visitor_team.id").alias("away_id"))
    return ids.where("game_id IS NOT NULL AND home_id IS NOT NULL AND away_id IS NOT NULL")


def read_games(spark: SparkSession, path: str) -> DataFrame:
    return parse_games(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))
