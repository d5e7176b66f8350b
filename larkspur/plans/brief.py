"""The whole brief, batch by batch, and a command that runs it once."""

from __future__ import annotations

import argparse
import datetime
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import values as V
from ..operators import games as G, grounding, news, render, stories, summarize
from ..sources import writers
from ..streaming.channels import Stdout, Telegram
from ..streaming.state import cut


def news_of(articles: DataFrame, games: DataFrame, seen_articles: DataFrame, now: Column, batch: list[str], **rules) -> tuple[DataFrame, DataFrame]:
    """What passes the filter, is new and repeats no title kept before it, and its stories: ranked, then told apart by story before any cap. All of it batch by batch."""
    # Cut where a relation is read several times below: the messages would each plan and read it anew.
    passed = cut(news.drop_non_news(articles, now, batch=batch, **rules))
    kept = cut(news.deduplicated(passed, seen_articles, batch=batch))
    place = F.row_number().over(Window.partitionBy(*batch).orderBy("rank_key"))
    ranked = cut(news.ranked(kept, games, batch=batch).withColumn("pos", place.cast("long")))
    return kept, cut(stories.build_stories(ranked, batch))


def games_of(games: DataFrame, seen_games: DataFrame, results: DataFrame, batch: list[str]) -> DataFrame:
    fresh = cut(G.fresh_games(games, seen_games))
    scores = render.scoreboard(fresh, G.series_context(fresh, results), batch)
    return scores.unionByName(render.highlights(G.notable_games(fresh, batch), batch))


def brief(articles: DataFrame, games: DataFrame, seen_articles: DataFrame, seen_games: DataFrame, results: DataFrame, now: Column, batch: list[str], **rules) -> DataFrame:
    """(batch..., message_pos, text): scores, highlights, headlines; a section with nothing in it is left out. Both relations carry the batch's columns."""
    _, told = news_of(articles, games, seen_articles, now, batch, **rules)
    return games_of(games, seen_games, results, batch).unionByName(render.headlines(told, batch))


def summarised(told: DataFrame, vocabulary: DataFrame, batch: str, writers: list[Callable[[str], str | None]], failed: list[str] | None = None) -> DataFrame:
    """The news as a written text where a safe one was found, with what its sources don't link marked; else the headlines."""
    order = Window.partitionBy(batch).orderBy("chain_pos")
    leads = told.where("member_pos = 0").withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < V.MAX_STORIES)
    leads = cut(leads.withColumn("pos", F.col("place").cast("long")))
    texts = cut(summarize.safe_summaries(leads, batch, writers, vocabulary))
    flagged = grounding.unsupported_sentences(texts, leads, batch).groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("sentence_pos", "sentence"))).alias("found"))
    marked = texts.join(flagged, batch, "left").select(batch, "summary", F.coalesce(F.transform("found", lambda x: x["sentence"]), F.array().cast("array<string>")).alias("unsupported"))
    rest = told.join(texts.select(batch), batch, "left_anti")
    return render.written_news(marked, [batch], failed).unionByName(render.headlines(rest, [batch]))


def show(messages: DataFrame) -> int:
    """Print a brief's few messages, each with its number and length."""
    texts = [row.text for row in messages.orderBy("message_pos").collect()]
    for i, text in enumerate(texts, 1):
        print(f"\n--- message {i} of {len(texts)} ({len(text)} chars) ---\n{text}")
    print()
    return len(texts)


def chosen_writers(name: str, settings, attempts: int = V.ATTEMPTS) -> list[Callable[[str], str | None]]:
    """Writers of a run: none, the titles, or a model asked so many times. `auto` takes the hosted model, else the local one, if one is set."""
    if name == "auto":
        name = "hosted" if settings.prefers_hosted_summariser else "local" if settings.local_url and settings.local_model else "none"
    if name == "none":
        return []
    if name == "titles":
        return [summarize.first_sentences]
    if name == "hosted":
        return [writers.hosted_model(settings.hosted_key, settings.hosted_model)] * attempts
    return [writers.local_model(settings.local_url, settings.local_model)] * attempts


def main(arguments: list[str] | None = None, write_with: list[Callable[[str], str | None]] | None = None) -> int:
    """Read landed feeds and a day's games, print or deliver the brief, and record what was delivered.

    Each writer is one attempt at a written text; without any, and where none is safe, the news are headlines. Gives 0, also when there is nothing new; 1 when
    nothing arrived or delivery isn't set up; 2 for settings that can't be used.
    """
    from ..settings import Settings, SettingsError
    from ..sources import feeds, games as game_source
    from ..streaming import state

    parser = argparse.ArgumentParser(prog="larkspur")
    parser.add_argument("landing", help="folder with feeds and games/<date>.json")
    parser.add_argument("--date", type=datetime.date.fromisoformat, default=None)
    parser.add_argument("--dry-run", action="store_true", help="print, record nothing")
    parser.add_argument("--channel", choices=("stdout", "telegram"), default="stdout")
    parser.add_argument("--writer", choices=("auto", "none", "titles", "local", "hosted"), default="auto")
    parser.add_argument("--no-summary", action="store_true", help="headlines only")
    parser.add_argument("--log-level", default="WARN")
    given = parser.parse_args(arguments)
    try:
        settings = Settings.from_env()
    except SettingsError as wrong:
        print(wrong, file=sys.stderr)
        return 2
    if given.channel == "telegram" and not given.dry_run:
        try:
            settings.require_delivery()
        except SettingsError as wrong:
            print(wrong, file=sys.stderr)
            return 1
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel(given.log_level)
    day = given.date or datetime.datetime.now(datetime.timezone.utc).date()
    articles, failed = feeds.fetch_all(spark, given.landing)
    games = game_source.read_games(spark, f"{given.landing}/games/{day.isoformat()}.json")
    folder, now = settings.state_folder, F.current_timestamp()
    one = lambda df: df.withColumn("batch", F.lit(0))
    articles, games = state.cut(one(articles)), state.cut(one(games))  # parsed once
    seen = state.read_or_empty(spark, f"{folder}/seen_articles", "article_id string, seen_at timestamp")
    states = state.read_or_empty(spark, f"{folder}/seen_games", "state_hash string, game_id long, seen_at timestamp")
    kept, told = news_of(articles, games, seen, now, ["batch"])
    parts = games_of(games, states, state.results_history(spark, folder), ["batch"])
    attempts = [] if given.no_summary else chosen_writers(given.writer, settings) if write_with is None else write_with
    told_as = summarised(told, articles, "batch", attempts, failed) if attempts else render.headlines(told, ["batch"])
    messages = state.cut(parts.unionByName(told_as))
    for name in failed:
        print(f"not read: {name}", file=sys.stderr)
    if given.dry_run:
        show(messages)
        return 0
    if messages.isEmpty():
        return 0

    def commit() -> None:
        state.record_games(games, folder, now)
        state.record_articles(kept, folder, now)

    channel = Stdout() if given.channel == "stdout" else Telegram(settings.bot_token, settings.chat_id)
    return 0 if any(state.deliver(messages, channel.send, commit)) else 1


if __name__ == "__main__":
    sys.exit(main())
