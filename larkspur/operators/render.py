"""The brief's messages: scores, highlights, stories or a written summary; packing and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X, values as V
from .stories import other_outlets


def lines_of(rows: DataFrame, keys: list[str], order: str, line: str, between: str = "\n") -> DataFrame:
    """(keys..., body): lines in order, one text."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line])
    return rows.groupBy(*keys).agg(F.array_join(listed, between).alias("body"))


def series_note() -> Column:
    """How the teams stood before this game; empty at a first meeting. Needs the columns of games and of series_context."""
    home, away, n = F.col("home_team_prior_wins"), F.col("away_team_prior_wins"), F.col("meeting_number")
    leader = F.when(home > away, F.col("home_team")).otherwise(F.col("away_team"))
    level = F.concat(X.ordinal(n), F.lit(" meeting — series level at "), home.cast("string"), F.lit("-"), away.cast("string"))
    led = F.concat(X.ordinal(n), F.lit(" meeting — "), leader, F.lit(" led "), F.greatest(home, away).cast("string"), F.lit("-"), F.least(home, away).cast("string"))
    return F.when(n.isNull() | (n <= 1), "").when(home == away, level).otherwise(led)


def score(separate: str = "") -> Column:
    return F.concat("away_team", F.lit(" "), F.col("away_score").cast("string"), F.lit(" @ "), "home_team", F.lit(" "), F.col("home_score").cast("string"), F.lit(separate))


def scoreboard(games: DataFrame, series: DataFrame, batch: list[str]) -> DataFrame:
    rows = games.join(series, "game_id", "left")
    note = series_note()
    line = F.concat(score("  ("), "status", F.lit(")"), F.when(note != "", F.concat(F.lit("\n   "), note)).otherwise(""))
    body = lines_of(rows.withColumn("line", line), batch, "pos", "line")
    return body.select(*batch, F.lit(0).alias("message_pos"), F.concat(F.lit(V.SCORES_HEAD + "\n\n"), "body").alias("text"))


def clause() -> Column:
    """What made a game notable, in its own numbers."""
    winner = F.when(F.col("home_score") > F.col("away_score"), F.col("home_team")).otherwise(F.col("away_team"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    overtimes = F.greatest(F.col("period") - 4, F.lit(1))
    by = {
        "comeback": say(winner, " came back from ", F.col("largest_deficit_overcome"), " down"),
        "overtime": say(winner, " won in overtime", F.when(overtimes > 1, say(" (", overtimes, " OT)")).otherwise("")),
        "closest_finish": say("decided by ", F.col("margin")),
        "wire_to_wire": say(winner, " led at every break"),
        "second_half_takeover": say(winner, " outscored them by ", F.col("second_half_swing"), " after half time"),
        "biggest_period": say("a ", F.col("biggest_period"), "-point quarter"),
        "largest_margin": say(winner, " by ", F.col("margin")),
        "highest_scoring": say(F.col("total_points"), " combined points"),
    }
    return F.coalesce(*(F.when(F.col("category") == name, text) for name, text in by.items()), F.lit(""))


def highlights(notable: DataFrame, batch: list[str]) -> DataFrame:
    label = F.coalesce(*(F.when(F.col("category") == c, name) for c, name in V.CATEGORY_LABELS.items()), F.col("category"))
    rows = notable.withColumns({"line": F.concat(label, F.lit(" — "), clause(), F.lit("\n   "), score()), "place": F.struct("category_pos", "pos")})
    body = lines_of(rows, batch, "place", "line", "\n\n")
    return body.select(*batch, F.lit(1).alias("message_pos"), F.concat(F.lit(V.NOTABLE_HEAD + "\n\n"), "body").alias("text"))


def headlines(stories: DataFrame, batch: list[str], place: str = "chain_pos", most: int = V.MAX_STORIES, limit: int = V.SUMMARY_CHARS) -> DataFrame:
    """The first stories of each batch by their leads, with who else covered them, and how many were left out."""
    (at,) = X.unused(stories.columns, "place")
    leads = stories.where("member_pos = 0").withColumn(at, F.row_number().over(Window.partitionBy(*batch).orderBy(place)))
    totals = leads.groupBy(*batch).agg(F.count("*").alias("total"))
    shown = leads.where(F.col(at) <= most).join(other_outlets(stories, batch), [*batch, "story_pos"])
    also = F.when(F.size("others") > 0, F.concat(F.lit("  (also "), F.array_join("others", ", "), F.lit(")"))).when(F.col("more") > 0, F.concat(F.lit("  (+"), F.col("more").cast("string"), F.lit(" more)"))).otherwise("")
    summary = X.truncated(F.col("summary"), limit)
    by = F.coalesce(F.nullif("author", F.lit("")), F.col("source"))
    block = F.concat("title", F.lit("\n"), F.when(summary != "", F.concat(summary, F.lit("\n"))).otherwise(""), F.lit("— "), by, also)
    body = lines_of(shown.withColumn("line", block), batch, at, "line", "\n\n").join(totals, batch)
    rest = F.col("total") - most
    tail = F.when(rest > 0, F.concat(F.lit("\n\n+ "), rest.cast("string"), F.lit(" more, ranked lower"))).otherwise("")
    return body.select(*batch, F.lit(2).alias("message_pos"), F.rtrim(F.concat(F.lit(V.NEWS_HEAD + "\n\n"), "body", tail)).alias("text"))


def written_news(summaries: DataFrame, batch: list[str], failed_sources: list[str] | None = None) -> DataFrame:
    """(batch..., summary, unsupported: array of sentences) as the news message: such sentences are marked where they stand."""
    mark = V.MARK

    marked = F.aggregate("unsupported", F.col("summary"), lambda acc, s: F.when((s != "") & (F.instr(acc, s) > 0), F.concat(F.substring(acc, F.lit(1), F.instr(acc, s) + F.length(s) - 1), F.lit(" " + mark), F.substring(acc, F.instr(acc, s) + F.length(s), F.length(acc)))).otherwise(acc))
    legend = "\n\n" + V.LEGEND.format(mark=mark)
    missing = "\n\n" + V.MISSING.format(names=", ".join(failed_sources)) if failed_sources else ""
    return summaries.select(*batch, F.lit(2).alias("message_pos"), F.concat(F.lit(V.NEWS_HEAD + "\n\n"), marked, F.when(F.size("unsupported") > 0, legend).otherwise(""), F.lit(missing)).alias("text"))


def packed(text: Column, limit: int = V.MESSAGE_CHARS) -> Column:
    """Pieces of at most `limit` characters: blocks between blank lines put together while they fit; a longer block is cut."""
    blocks = F.split(text, "\n\n")
    chars = lambda b: F.when(F.length(b) > limit, F.transform(F.sequence(F.lit(0), F.floor((F.length(b) - 1) / limit).cast('int')), lambda i: F.substring(b, i * limit + 1, F.lit(limit)))).otherwise(F.array(b))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def add(acc: Column, block: Column) -> Column:
        joined = F.when(acc["now"] == "", block).otherwise(F.concat(acc["now"], F.lit("\n\n"), block))
        done = F.when(acc["now"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["now"]))
        parts = chars(block)
        over = F.struct(F.concat(done, F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("out"), F.element_at(parts, -1).alias("now"))
        return F.when(F.length(joined) <= limit, F.struct(acc["out"].alias("out"), joined.alias("now"))).otherwise(over)

    folded = F.aggregate(blocks, empty, add, lambda acc: F.when(acc["now"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["now"])))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(folded)


def _head(form: str, n: Column, most: int) -> Column:
    return F.replace(F.lit(form.replace("{most}", str(most))), F.lit("{n}"), n.cast("string"))


def prompt(articles: DataFrame, batch: list[str], most: int = V.BRIEF_CHARS) -> DataFrame:
    """(batch..., prompt): how many stories there are and how long the text may be, then each one's title and summary. A batch is what one prompt holds."""
    summary = X.collapsed(F.col("summary"))
    line = F.concat(F.lit("- "), "title", F.when(summary != "", F.concat(F.lit("\n  "), summary)).otherwise(""))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    return articles.groupBy(*batch).agg(F.concat(_head(V.ITEMS_HEAD, F.count("*"), most), F.lit("\n\n"), F.array_join(listed, "\n")).alias("prompt"))


def reduce_prompt(notes: Column, most: int = V.BRIEF_CHARS) -> Column:
    """A prompt over the lines that notes have in common form."""
    return X.let(F.flatten(F.transform(notes, X.note_lines)), lambda lines: F.concat(_head(V.NOTES_HEAD, F.size(lines), most), F.lit("\n\n"), F.array_join(lines, "\n")))
