"""Stories: articles about one thing, capped by source, and put in an order that keeps like stories together."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as X, values as V


def name_counts(articles: DataFrame, batch: list[str]) -> DataFrame:
    """How many titles of a batch bear each name: (batch..., name, df)."""
    return articles.select(*batch, F.explode(X.title_names(F.col("title"))).alias("name")).groupBy(*batch, "name").agg(F.count("*").alias("df"))


def rare_names(articles: DataFrame, batch: list[str], share: float = V.RARE_SHARE, floor: int = V.RARE_FLOOR) -> DataFrame:
    """Names borne by few enough titles of their batch: (batch..., pos, name)."""
    sizes = articles.groupBy(*batch).agg(F.greatest(F.floor(F.count("*") * share), F.lit(floor)).alias("most"))
    rare = name_counts(articles, batch).join(sizes, batch).where("df <= most").select(*batch, "name")
    return articles.select(*batch, "pos", F.explode(X.title_names(F.col("title"))).alias("name")).join(rare, [*batch, "name"])


def story_pairs(articles: DataFrame, batch: list[str], shared: int = V.SHARED_NAMES, share: float = V.RARE_SHARE, floor: int = V.RARE_FLOOR) -> DataFrame:
    """Pairs of titles of a batch with enough rare names in common: (batch..., early, late, shared). A name is rare up to a share of the batch, so in a large batch pairs grow as its square."""
    names = rare_names(articles, batch, share, floor)
    other = names.withColumnRenamed("pos", "late")
    both = names.withColumnRenamed("pos", "early").join(other, [*batch, "name"]).where("early < late")
    return both.groupBy(*batch, "early", "late").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared)


def story_groups(articles: DataFrame, batch: list[str], shared: int = V.SHARED_NAMES, share: float = V.RARE_SHARE, floor: int = V.RARE_FLOOR) -> DataFrame:
    """Each article's story: (batch..., pos, story_pos, member_pos).

    In order of `pos`, an article joins the first story with which it has enough rare names in common, and the story then bears its names too; else it
    opens one. The fold goes batch by batch; only articles that share a rare name with another take part in it, the others are stories of their own.
    """
    names = rare_names(articles, batch, share, floor)
    held = names.groupBy(*batch, "pos").agg(F.collect_set("name").alias("names"))
    linked = names.join(names.groupBy(*batch, "name").agg(F.count("*").alias("n")).where("n > 1"), [*batch, "name"], "left_semi").select(*batch, "pos").distinct()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        where: dict[str, list[int]] = {}
        bears: list[set[str]] = []
        story = []
        for names_ in rows["names"]:
            mine = set(names_)
            common: dict[int, int] = {}
            for name in mine:
                for at in where.get(name, ()):
                    common[at] = common.get(at, 0) + 1
            found = min((at for at, n in common.items() if n >= shared), default=None)
            if found is None:
                found = len(bears)
                bears.append(set())
            for name in mine - bears[found]:
                where.setdefault(name, []).append(found)
            bears[found] |= mine
            story.append(found)
        lead = rows["pos"].groupby(pd.Series(story, index=rows.index)).transform("min")
        return rows[[*batch, "pos"]].assign(lead=lead)

    kinds = {f.name: f.dataType.simpleString() for f in articles.select(*batch).schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in batch) + ", pos long, lead long"
    grouped = held.join(linked, [*batch, "pos"], "left_semi").groupBy(*batch).applyInPandas(fold, schema)
    rows = articles.select(*batch, "pos").join(grouped, [*batch, "pos"], "left").withColumn("lead", F.coalesce("lead", "pos"))
    place = F.dense_rank().over(Window.partitionBy(*batch).orderBy("lead")) - 1
    member = F.row_number().over(Window.partitionBy(*batch, "lead").orderBy("pos")) - 1
    return rows.select(*batch, "pos", place.alias("story_pos"), member.alias("member_pos"))


def within_source_limits(leads: DataFrame, batch: list[str], limits: Mapping[str, int] = V.SOURCE_LIMITS, default: int = V.SOURCE_LIMIT) -> DataFrame:
    """Stories (batch..., story_pos, source of the lead) that are among the first so many of their source; a limit of 0 lets all pass."""
    place = F.row_number().over(Window.partitionBy(*batch, "source").orderBy("story_pos"))
    cap = F.lit(default)
    for source, limit in limits.items():
        cap = F.when(F.col("source") == source, limit).otherwise(cap)
    at, most = X.unused(leads.columns, "place", "cap")
    return leads.withColumns({at: place, most: cap}).where((F.col(most) == 0) | (F.col(at) <= F.col(most))).drop(at, most)


def dropped_by_source(leads: DataFrame, batch: list[str], limits: Mapping[str, int] = V.SOURCE_LIMITS, default: int = V.SOURCE_LIMIT) -> DataFrame:
    """How many stories of each source its limit leaves out: (batch..., source, dropped)."""
    kept = within_source_limits(leads, batch, limits, default).groupBy(*batch, "source").agg(F.count("*").alias("kept"))
    every = leads.groupBy(*batch, "source").agg(F.count("*").alias("all"))
    return every.join(kept, [*batch, "source"], "left").select(*batch, "source", (F.col("all") - F.coalesce("kept", F.lit(0))).alias("dropped")).where("dropped > 0")


def chained(stories: DataFrame, batch: list[str]) -> DataFrame:
    """Stories (batch..., story_pos, words) with `chain_pos`: from the first story, always on to the one that shares most words, the earliest of equals.

    An index says which stories bear a word; those that are placed leave it, and where none of the rest shares a word, the earliest follows. A batch is what one
    brief may hold, some dozens of stories.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("story_pos").reset_index(drop=True)
        bearers: dict[str, set[int]] = {}
        for story, words in enumerate(rows["words"]):
            for word in words:
                bearers.setdefault(word, set()).add(story)
        ahead, here, places = dict.fromkeys(range(len(rows))), 0, [0] * len(rows)
        for place in range(len(rows)):
            del ahead[here]
            places[here] = place
            shared: Counter[int] = Counter()
            for word in rows["words"][here]:
                bearers[word].discard(here)
                shared.update(bearers[word])
            most = max(shared.values(), default=0)
            here = min((story for story, n in shared.items() if n == most), default=next(iter(ahead), None))
        return rows[[*batch, "story_pos"]].assign(chain_pos=places)

    kinds = {f.name: f.dataType.simpleString() for f in stories.select(*batch).schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in batch) + ", story_pos int, chain_pos int"
    return stories.select(*batch, F.col("story_pos").cast("int"), "words").groupBy(*batch).applyInPandas(walk, schema)


def build_stories(articles: DataFrame, batch: list[str], limits: Mapping[str, int] = V.SOURCE_LIMITS, default: int = V.SOURCE_LIMIT, **how) -> DataFrame:
    """Articles with their story and its place: grouped, then capped by source, then chained."""
    grouped = articles.join(story_groups(articles, batch, **how), [*batch, "pos"])
    leads = within_source_limits(grouped.where("member_pos = 0").select(*batch, "story_pos", "source"), batch, limits, default)
    kept = grouped.join(leads.drop("source"), [*batch, "story_pos"], "left_semi")
    name = F.explode_outer(X.title_names(F.col("title")))
    words = kept.select(*batch, "story_pos", name.alias("n")).select(*batch, "story_pos", F.explode_outer(X.tokens(F.lower(X.comparable(F.col("n"))))).alias("w")).groupBy(*batch, "story_pos").agg(F.collect_set("w").alias("words"))
    return kept.join(chained(words, batch), [*batch, "story_pos"])


def other_outlets(members: DataFrame, batch: Iterable[str]) -> DataFrame:
    """For each story the sources of its members other than its lead's, sorted, and how many members follow the lead."""
    keys = [*batch, "story_pos"]
    return members.groupBy(*keys).agg(
        F.array_sort(F.array_except(F.collect_set(F.when(F.col("member_pos") > 0, F.col("source"))), F.collect_set(F.when(F.col("member_pos") == 0, F.col("source"))))).alias("others"),
        (F.count("*") - 1).alias("more"),
    )
