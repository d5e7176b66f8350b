"""Articles: the news filter, ranking by subject, and duplicates across runs and within a batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import arrow, text as X, values as V


def rejection_reason(now: Column, max_hours: int = V.MAX_AGE_HOURS, tags: Iterable[str] = V.REJECTED_TAGS, phrases: Iterable[str] = V.RETROSPECTIVE_PHRASES, community: Iterable[str] = V.COMMUNITY_SOURCES) -> Column:
    """Why an article is no news, by the first rule that says so; null if none does."""
    hours = (F.unix_micros(now) - F.unix_micros("published_at")) / 3.6e9
    lead = lambda kind, what: F.concat(F.lit(kind), what)

    def by_title(shown: Column) -> Column:
        return X.let(F.struct(shown.alias("shown"), F.lower(shown).alias("told"), X.leading_tag(shown).alias("raw"), X.stripped(X.leading_tag(shown)).alias("tag")), rules)

    def rules(title: Column) -> Column:
        reason = F.when(hours > max_hours, F.concat(F.lit(f"older than {max_hours}h ("), F.rint(hours).cast("long").cast("string"), F.lit("h)")))
        reason = reason.when(F.lower(title["tag"]).isin(*tags), F.concat(lead("content-type tag [", title["tag"]), F.lit("]")))
        for phrase in phrases:
            reason = reason.when(F.contains(title["told"], F.lit(phrase)), f"retrospective phrase '{phrase}'")
        reason = reason.when(F.lower(X.stripped(F.col("author"))).rlike("(_mod|moderator)$"), lead("subreddit business, posted by ", F.col("author")))
        question = F.col("source").isin(*community) & (title["raw"] == "") & F.endswith(title["shown"], F.lit("?"))
        return reason.when(question, "community discussion, an untagged question")

    return X.let(X.visible(F.col("title")), by_title)


def ordinary_words(articles: DataFrame, batch: list[str] | None = None) -> DataFrame:
    """Words that the batch also writes in lower case: (batch..., word). Different spellings are told apart first, so each is cleaned once."""
    keys = batch or []
    rows = articles.select(*keys, "title", "summary")
    schema = StructType([*rows.select(*keys).schema.fields, StructField("t", StringType())])
    each = rows.mapInArrow(arrow.different_words(len(keys)), schema).distinct().where(F.col("t").rlike(r"^\p{Ll}"))
    return each.select(*keys, X.normalised_word(F.col("t")).alias("word")).where("word <> ''").distinct()


def with_reasons(articles: DataFrame, now: Column, community: Iterable[str] = V.COMMUNITY_SOURCES, most: int = V.MAX_OPINION_WORDS, batch: list[str] | None = None, **rules) -> DataFrame:
    """Articles with `reason`: the rules' own, or that of a short community post that opens with an ordinary word.

    The first words of such posts are looked up among the ordinary words of their batch (all articles, where none is named), by a hash join on the word.
    """
    keys, (rule, opens, word, deal) = batch or [], X.unused(articles.columns, "rule", "opens", "word", "deal")
    first = X.let(X.tokens(X.visible(F.col("title"))), lambda words: F.when(F.size(words) <= most, X.normalised_word(F.try_element_at(words, F.lit(1)))))
    marked = articles.withColumns({rule: rejection_reason(now, community=community, **rules), opens: F.when(F.col("source").isin(*community), first)})
    # Most articles have no such word: they are dealt by what they hold, or one task would get them all.
    marked = marked.withColumn(deal, F.when(F.col(opens).isNotNull(), F.xxhash64(opens)).otherwise(F.xxhash64("title", "source", "published_at")))
    known = ordinary_words(articles, keys)
    known = known.select(F.col("word").alias(word), F.xxhash64("word").alias(f"{word}_deal"), *(F.col(k).alias(f"{word}_{i}") for i, k in enumerate(keys)))
    same = [F.col(opens) == F.col(word), F.col(deal) == F.col(f"{word}_deal"), *(F.col(k).eqNullSafe(F.col(f"{word}_{i}")) for i, k in enumerate(keys))]
    joined = marked.join(known, same, "left")
    opinion = F.when(F.col(word).isNotNull(), "community opinion, short and not led by a name")
    return joined.withColumn("reason", F.coalesce(rule, opinion)).drop(rule, opens, deal, *known.columns)


def drop_non_news(articles: DataFrame, now: Column, **rules) -> DataFrame:
    """Articles that no rule rejects; their `pos` keeps the order."""
    return with_reasons(articles, now, **rules).where("reason IS NULL").drop("reason")


def tier(high: Iterable[str] = V.HIGH_WORDS, low: Iterable[str] = V.LOW_WORDS) -> Column:
    high, low = list(high), list(low)
    overlap = lambda words, some: F.arrays_overlap(words, X.literals(some))
    return X.let(X.subject_words(F.concat_ws(" ", "title", "summary")), lambda words: F.when(overlap(words, low), "low").when(overlap(words, high), "high").otherwise("medium"))


def team_keywords(games: DataFrame, batch: list[str] | None = None) -> DataFrame:
    """The last word of each team that plays: (batch..., keyword)."""
    keys = batch or []
    teams = games.select(*keys, F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    return teams.select(*keys, X.last_word(F.col("team")).alias("keyword")).where("keyword IS NOT NULL").distinct()


def mentions_tonight(articles: DataFrame, keywords: DataFrame, batch: list[str] | None = None) -> DataFrame:
    """article_id (and batch) of articles that name a team that plays, in their batch: a semi-join on their words."""
    keys = batch or []
    words = articles.select(*keys, "article_id", F.explode(X.subject_words(F.concat_ws(" ", "title", "summary"))).alias("keyword"))
    return words.join(keywords, [*keys, "keyword"], "left_semi").select(*keys, "article_id").distinct()


def ranked(articles: DataFrame, games: DataFrame | None = None, high: Iterable[str] = V.HIGH_WORDS, low: Iterable[str] = V.LOW_WORDS, batch: list[str] | None = None) -> DataFrame:
    """All articles, with `tier`, `tonight` and `rank_key`: by tier, then those that name a team that plays (in their batch), then as they came."""
    keys, rows = batch or [], articles.withColumn("tier", tier(high, low))
    if games is None:
        rows = rows.withColumn("tonight", F.lit(False))
    else:
        (flag,) = X.unused(rows.columns, "tonight_flag")
        named = mentions_tonight(articles, team_keywords(games, keys), keys).withColumn(flag, F.lit(True))
        rows = rows.join(named, [*keys, "article_id"], "left").withColumn("tonight", F.coalesce(flag, F.lit(False))).drop(flag)
    order = F.when(F.col("tier") == "high", 0).when(F.col("tier") == "medium", 1).otherwise(2)
    return rows.withColumn("rank_key", F.struct(order.alias("tier"), (~F.col("tonight")).alias("later"), F.col("pos").alias("pos")))


def unseen(articles: DataFrame, seen: DataFrame) -> DataFrame:
    return articles.join(seen.select("article_id"), "article_id", "left_anti")


def dedup_hash(title: Column) -> Column:
    return F.sha2(X.normalised_title(title), 256)


#: Titles of one side, and of the other, that are compared in one task.
NEAR_BLOCK, FAR_BLOCK = 1024, 4096


def title_firsts(articles: DataFrame, batch: list[str] | None = None) -> DataFrame:
    """Different normalised titles of a batch by their first article: (batch..., pos, title)."""
    return articles.groupBy(*(batch or []), X.normalised_title(F.col("title")).alias("title")).agg(F.min("pos").alias("pos"))


def close_titles(firsts: DataFrame, threshold: float = V.SIMILAR_TITLES, batch: list[str] | None = None) -> DataFrame:
    """Pairs (early, late, ratio) of different titles (batch..., pos, title) whose ratio, the later one's to the earlier one's, is at least the threshold.

    Titles meet in bands of length: a ratio of t needs lengths within t / (2 - t) of each other, so equal and adjacent bands of that width
    hold every pair. A band is dealt into blocks, so however many titles it has, no task holds more than a block of either side; only pairs
    that pass come out. In a block, counts of letters and of letter pairs rule out most; then the longest common subsequence; then the ratio is taken.
    """
    keys = batch or []
    width = -F.log(F.lit(threshold / (2 - threshold)))
    shaped = firsts.withColumn("band", F.floor(F.log(F.greatest(F.length("title"), F.lit(1)).cast("double")) / width))
    sizes = shaped.groupBy(*keys, "band").agg(F.count("*").alias("n"))
    beside = sizes.select(*keys, (F.col("band") - 1).alias("band"), F.col("n").alias("above"))
    plan = sizes.join(beside, [*keys, "band"], "full").select(*keys, "band", *(F.greatest(F.ceil(F.coalesce(c, F.lit(0)) / size), F.lit(1)).cast("int").alias(name) for c, size, name in (("n", NEAR_BLOCK, "xs"), (F.coalesce("n", F.lit(0)) + F.coalesce("above", F.lit(0)), FAR_BLOCK, "ys"))))
    deal = lambda n: F.pmod(F.xxhash64("pos"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    near = shaped.join(plan, [*keys, "band"]).select(*keys, "band", deal("xs").alias("x"), every("ys").alias("y"), F.lit(0).alias("side"), "pos", "title")
    far = shaped.withColumn("side", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("band", F.col("band") - F.col("side") + 1)
    far = far.join(plan, [*keys, "band"]).select(*keys, "band", every("xs").alias("x"), deal("ys").alias("y"), "side", "pos", "title")
    met = near.unionByName(far).groupBy(*keys, "band", "x", "y")
    return met.applyInArrow(arrow.close_pairs(threshold), "early long, late long, ratio double")


def similar_titles(articles: DataFrame, threshold: float = V.SIMILAR_TITLES, batch: list[str] | None = None) -> DataFrame:
    """Pairs (early, late, ratio) of articles of a batch whose normalised titles have at least this ratio.

    Titles that are equal after normalising are linked to the first of them, and only the first is linked with other titles: what holds of it
    holds of those that repeat it.
    """
    keys, firsts = batch or [], title_firsts(articles, batch)
    rows = articles.select(*keys, F.col("pos").alias("late"), X.normalised_title(F.col("title")).alias("title"))
    equal = rows.join(firsts, [*(rows[k].eqNullSafe(firsts[k]) for k in keys), rows["title"] == firsts["title"]]).where("late > pos")
    equal = equal.select(F.col("pos").alias("early"), "late", F.lit(1.0).alias("ratio"))
    return close_titles(firsts, threshold, batch).unionByName(equal)


def first_kept(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pos of the rows that a pass in order keeps, a row being dropped exactly if it is paired with one kept before it.

    By rounds: a row all of whose earlier partners are dropped is kept, one with a kept earlier partner is dropped. Each round settles at least the first
    open row of every chain, so rounds are as many as the longest chain of drops is deep; each cuts its lineage.
    """
    from ..streaming.state import cut

    state = cut(nodes.select("pos").join(pairs.select(F.col("late").alias("pos")).distinct().withColumn("has", F.lit(True)), "pos", "left").select("pos", F.when(F.col("has").isNull(), True).alias("kept")))
    while state.where("kept IS NULL").limit(1).count():
        about = pairs.join(state.withColumnRenamed("pos", "early"), "early").groupBy(F.col("late").alias("pos")).agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("any_kept"), F.bool_and(F.coalesce(~F.col("kept"), F.lit(False))).alias("all_dropped"))
        state = cut(state.join(about, "pos", "left").select("pos", F.coalesce("kept", F.when(F.col("any_kept"), False).when(F.col("all_dropped"), True)).alias("kept")))
    return state.where("kept").select("pos")


def deduplicated(articles: DataFrame, seen: DataFrame, threshold: float = V.SIMILAR_TITLES, batch: list[str] | None = None) -> DataFrame:
    """Unseen articles, less those whose title is like that of one kept before. `pos` must be unique; a null title is like none.

    Of equal titles only the first can be kept: where it is dropped, what dropped it stands before all that repeat it.
    """
    from ..streaming.state import cut

    fresh = unseen(articles, seen)
    firsts = cut(title_firsts(fresh.where("title IS NOT NULL"), batch))
    kept = first_kept(firsts, cut(close_titles(firsts, threshold, batch)))
    return fresh.join(kept.unionByName(fresh.where("title IS NULL").select("pos")), "pos", "left_semi")
