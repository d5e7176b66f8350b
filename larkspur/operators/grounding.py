"""Grounding: whether the names, figures and links of a written text are those of its sources.

Texts and sources are relations with a common key (a conversation, a brief): claims (key, summary), sources (key, pos, title, summary).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X, values as V
from .news import ordinary_words


def named(x: Column, min_words: int = 2) -> Column:
    """Names of a text, sentence by sentence, without a sentence starter: array, repeats kept."""
    found = F.flatten(F.transform(X.sentences(x), lambda s: X.scanned_names(s, min_words)))
    return F.transform(found, lambda n: X.trimmed_name(X.stripped(n, " .,;:")))


def name_index(sources: DataFrame, key: str) -> DataFrame:
    """(key, word, words): names of sources under their first and last word, ordinary words left out, of at least two words."""
    ordinary = ordinary_words(sources, [key])
    # Title and summary apart, and sentence by sentence: no name may span them.
    fields = sources.select(key, F.explode(F.flatten(F.transform(F.array("title", "summary"), X.sentences))).alias("_s"))
    names = fields.select(key, F.explode(X.scanned_names(F.col("_s"))).alias("_n")).distinct().withColumn("_all", X.name_words(X.stripped(F.col("_n"), " .,;:")))
    words = names.select(key, "_n", F.posexplode("_all").alias("_i", "word")).join(ordinary, [key, "word"], "left_anti")
    kept = words.groupBy(key, "_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "word"))), lambda x: x["word"]).alias("words")).where(F.size("words") >= 2)
    ends = F.array_distinct(F.array(F.element_at("words", -1), F.element_at("words", 1)))
    return kept.select(key, F.explode(ends).alias("word"), F.array_distinct("words").alias("words"))


def contradicted(names: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Of names (key, name, words), those that every long enough source name under their first or last word disagrees with: (key, name)."""
    ends = names.select(key, "name", F.array_distinct("words").alias("mine"), F.explode(F.array_distinct(F.array(F.element_at("words", -1), F.element_at("words", 1)))).alias("word"))
    met = ends.join(index, [key, "word"]).where(F.size("words") >= F.size("mine"))
    disagrees = (F.size(F.array_except("mine", "words")) > 0) & (F.size(F.array_except("words", "mine")) > 0)
    return met.groupBy(key, "name", "word").agg(F.bool_and(disagrees).alias("all")).where("all").select(key, "name").distinct()


def _escaped(word: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))


def appears(word: Column, source: Column, teams: Iterable[Iterable[str]] = V.TEAM_NAMES) -> Column:
    """Whether a word, or another name of the same team, stands in the source between characters that are no letters or digits."""
    bounded = lambda w: F.regexp_like(source, F.concat(F.lit("(?<![a-z0-9])(?:"), w, F.lit(")(?![a-z0-9])")))
    out = bounded(_escaped(word))
    for group in teams:
        out = out | (word.isin(*group) & bounded(F.lit("|".join(sorted(group)))))
    return out


def sources_text(sources: DataFrame, key: str) -> DataFrame:
    """(key, source): all that a key's sources say, folded and in lower case."""
    each = F.collect_list(F.struct("pos", F.concat_ws(" ", "title", "summary").alias("t")))
    joined = sources.groupBy(key).agg(F.array_join(F.transform(F.array_sort(each), lambda x: x["t"]), " ").alias("s"))
    return joined.select(key, F.lower(X.comparable(F.col("s"))).alias("source"))


def ungrounded_names(claims: DataFrame, sources: DataFrame, key: str, vocabulary: DataFrame | None = None, competition: Iterable[str] = V.COMPETITION_WORDS, abbreviations: Mapping[str, Iterable[str]] = V.ABBREVIATIONS) -> DataFrame:
    """Names of each claim with `grounded`: (key, name, grounded).

    In this order: said as it is; said by its abbreviation; nothing left of it, then not; all of it the competition's own words; contradicted by the
    sources' names, then not; all its words said; its last or first word said.
    """
    names = claims.select(key, F.explode(F.array_distinct(named(F.col("summary")))).alias("name")).where("name <> ''").withColumns({"folded": F.lower(X.comparable(F.col("name"))), "words": X.name_words(F.col("name"))})
    against = contradicted(names.where(F.size("words") > 0), name_index(vocabulary if vocabulary is not None else sources, key), key).withColumn("refuted", F.lit(True))
    rows = names.join(sources_text(sources, key), key, "left").join(against, [key, "name"], "left").withColumn("source", F.coalesce("source", F.lit("")))
    short = F.lit(False)
    for name, forms in abbreviations.items():
        short = short | ((F.col("folded") == name) & F.col("source").rlike("(?<![a-z0-9])(?:" + "|".join(forms) + ")(?![a-z0-9])"))
    said = F.regexp_replace("source", r"(?U)['’](?:s\b|\b)", "")
    rows = rows.withColumn("_said", said)
    every = F.forall("words", lambda w: appears(w, F.col("_said")))
    either = appears(F.try_element_at("words", F.lit(-1)), F.col("_said")) | appears(F.try_element_at("words", F.lit(1)), F.col("_said"))
    grounded = (
        F.when(F.contains("source", F.col("folded")), True)
        .when(short, True)
        .when(F.size("words") == 0, False)
        .when(F.forall("words", lambda w: F.array_contains(X.literals(competition), w)), True)
        .when(F.col("refuted"), False)
        .when(every, True)
        .otherwise(either)
    )
    return rows.select(key, "name", grounded.alias("grounded"))


def ungrounded_figures(claims: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Figures of each claim with `grounded`: whether their digits stand in the digits of all the sources, one after another."""
    held = sources_text(sources, key).select(key, X.digits(F.col("source")).alias("digits"))
    rows = claims.select(key, F.explode(X.figures(F.col("summary"))).alias("figure")).join(held, key, "left")
    mine = X.digits(F.col("figure"))
    return rows.select(key, "figure", ((mine == "") | F.contains(F.coalesce("digits", F.lit("")), mine)).alias("grounded"))


def entity_keys(x: Column, min_words: int, competition: Iterable[str] = V.COMPETITION_WORDS) -> Column:
    """The last word of each name of a text that is not all of the competition's words; distinct, in order."""
    words = F.filter(F.transform(named(x, min_words), X.name_words), lambda w: (F.size(w) > 0) & ~F.forall(w, lambda v: F.array_contains(X.literals(competition), v)))
    return F.array_distinct(F.transform(words, lambda w: F.element_at(w, -1)))


def source_pairs(sources: DataFrame, key: str) -> DataFrame:
    """Pairs of entities that one source names together: (key, first, second), both ways and each with itself."""
    keys = sources.select(key, entity_keys(F.concat_ws(" ", "title", "summary"), 1).alias("_named"))
    return keys.select(key, F.explode("_named").alias("first"), "_named").select(key, "first", F.explode("_named").alias("second")).distinct()


def unsupported_sentences(claims: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Sentences that name two entities no source names together: (key, sentence_pos, sentence)."""
    said = claims.select(key, F.posexplode(X.sentences(F.col("summary"))).alias("sentence_pos", "_s")).withColumn("_named", entity_keys(F.col("_s"), 2)).where(F.size("_named") > 1)
    pairs = said.select(key, "sentence_pos", "_s", "_named", F.posexplode("_named").alias("_i", "first")).select(key, "sentence_pos", "_s", "first", F.explode(F.slice("_named", F.col("_i") + 2, F.size("_named"))).alias("second"))
    return pairs.join(source_pairs(sources, key), [key, "first", "second"], "left_anti").select(key, "sentence_pos", X.stripped(F.col("_s")).alias("sentence")).distinct()


def validated(claims: DataFrame, sources: DataFrame, key: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """For each claim: invented_names, invented_figures, has_preamble, is_safe and a line that says so."""
    names = ungrounded_names(claims, sources, key, vocabulary).where("NOT grounded").groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("invented_names"))
    sums = ungrounded_figures(claims, sources, key).where("NOT grounded").groupBy(key).agg(F.array_sort(F.collect_set("figure")).alias("invented_figures"))
    none = F.array().cast("array<string>")
    rows = claims.join(names, key, "left").join(sums, key, "left").select(key, F.coalesce("invented_names", none).alias("invented_names"), F.coalesce("invented_figures", none).alias("invented_figures"), X.has_preamble(F.col("summary")).alias("has_preamble"))
    says = lambda label, column: F.when(F.size(column) > 0, F.concat(F.lit(label), F.array_join(column, ", ")))
    told = F.concat_ws("; ", says("invented names: ", "invented_names"), says("invented figures: ", "invented_figures"), F.when(F.col("has_preamble"), "preamble present"))
    return rows.withColumns({"is_safe": (F.size("invented_names") == 0) & (F.size("invented_figures") == 0), "description": F.when(told == "", "clean").otherwise(told)})
