"""State between runs: what was delivered, the results history; batch writers and streaming forms."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.plans import unestimated
from ..operators.games import results_of, state_hash


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that the cluster names; in a temporary one only where none is named."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="larkspur-state-"))
    return unestimated(df.checkpoint(eager=True))


def newly_seen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The first row of each key that was not seen: what an insert that ignores known keys would add."""
    fresh = rows.join(seen.select(key), key, "left_anti")
    order = Window.partitionBy(key).orderBy("seen_at")
    return fresh.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table; empty before the first run."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def record_articles(articles: DataFrame, folder: str, seen_at) -> int:
    """Append the ids not seen yet; gives how many."""
    spark, path = articles.sparkSession, f"{folder}/seen_articles"
    new = cut(newly_seen(articles.select("article_id", seen_at.alias("seen_at")), read_or_empty(spark, path, "article_id string, seen_at timestamp"), "article_id"))
    new.write.mode("append").parquet(path)
    return new.count()


def record_games(games: DataFrame, folder: str, seen_at) -> int:
    """Append the states not seen yet, and keep of each final game its last result; gives how many states were new."""
    spark, path = games.sparkSession, f"{folder}/seen_games"
    new = cut(newly_seen(games.select(state_hash().alias("state_hash"), "game_id", seen_at.alias("seen_at")), read_or_empty(spark, path, "state_hash string, game_id long, seen_at timestamp"), "state_hash"))
    new.write.mode("append").parquet(path)
    finals = results_of(games).withColumn("recorded_at", seen_at)
    if finals.limit(1).count():
        finals.write.mode("append").parquet(f"{folder}/game_results")
    return new.count()


def results_history(spark: SparkSession, folder: str) -> DataFrame:
    """The last result of each game. Results are appended, and the last taken on reading, so a lost writer leaves no hole."""
    schema = "game_id long, played_on date, home_team string, away_team string, home_score int, away_score int, status string, recorded_at timestamp"
    rows = read_or_empty(spark, f"{folder}/game_results", schema)
    rest = [c for c in rows.columns if c not in ("game_id", "recorded_at")]
    return rows.groupBy("game_id").agg(F.max_by(F.struct(*rest), "recorded_at").alias("r")).select("game_id", "r.*")


def deliver(messages: DataFrame, send: Callable[[str, bool], bool], commit: Callable[[], None]) -> list[bool]:
    """Send a brief's few messages in order, only the first aloud; commit the run if at least one arrived. A sender that raises has failed."""
    done = []
    for row in messages.orderBy("message_pos").collect():
        try:
            done.append(bool(send(row.text, row.message_pos > 0)))
        except Exception:  # a channel's failure is an answer, not an end
            done.append(False)
    if any(done):
        commit()
    return done


def stream_unseen(stream: DataFrame, key: str, ttl: str | None = None, event_time: str | None = None) -> DataFrame:
    """Each key once over all micro-batches; with a ttl, state older than that is let go."""
    if ttl is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, ttl).dropDuplicatesWithinWatermark([key])


def stream_counts(stream: DataFrame, event_time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Events a tumbling window and key; a window is given out once nothing of it can still come."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def replayed(spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame], files: str = "*", mode: str = "append") -> DataFrame:
    """Run a streaming transform over all files at a path, and give what it wrote: a table in the shared folder.

    The stream reads once to the end and stops; its checkpoint and table are new for each call.
    """
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="larkspur-stream-")
    folder = f"{named.rstrip('/')}/stream/{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(path)
    query = transform(stream).writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


__all__ = ["cut", "deliver", "newly_seen", "read_or_empty", "record_articles", "record_games", "replayed", "results_history", "stream_counts", "stream_unseen"]
